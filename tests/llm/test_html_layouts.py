"""Extraction from hand-written layouts that the page generator doesn't make."""

import pytest

from causeway.llm import html_extract

SENTENCES = [
    "The river town has kept its old bridge for more than a century, and people still cross it daily.", "Each spring the water rises and the council counts the stones again.",
    "A new span was planned in 1987, but the money went elsewhere.", "Nobody minds, since the old one has never failed.",
    "Engineers measured its arches last year with great care.", "They found small cracks near the northern pier.",
    "Repairs will begin when the floods have passed.", "Until then heavy lorries take the other road.",
]
PARAGRAPHS = [f"{a} {b}" for a in SENTENCES[:4] for b in SENTENCES[4:]]
OFFER = "Subscribe today and save half on your first order, with delivery to your door included. Offer ends soon."
NAMES = "ad ads advert advertisement sponsored promo notice newsletter sidebar related popup consent alert cookie footer".split()


@pytest.mark.parametrize("name", NAMES)
def test_boxes_in_an_article_go(name):
    model = html_extract.train()
    for tag in ("div", "section", "aside"):
        for body in (OFFER, f"<p>{OFFER}</p>", f"<h3>More for you</h3><p>{OFFER}</p><p>{OFFER}</p>"):
            for n in (2, 6):
                for at in (0, n // 2, n):
                    for outer, attributes in (("article", ""), ("main", ""), ("div", ' class="content"')):
                        blocks = [f"<p>{p}</p>" for p in PARAGRAPHS[:n]]
                        blocks.insert(at, f'<{tag} class="{name}">{body}</{tag}>')
                        page = f"<html><body><{outer}{attributes}><h1>The old bridge</h1>{''.join(blocks)}</{outer}></body></html>"
                        assert model.extract(page).split("\n") == ["The old bridge", *PARAGRAPHS[:n]], page


@pytest.mark.parametrize("n", range(1, 9))
def test_short_pages_in_plain_boxes_stay(n):
    model, own = html_extract.train(), SENTENCES[:n]
    one = " ".join(own)
    forms = {
        f"<div>{one}</div>": [one], f"<div><div><div>{one}</div></div></div>": [one], "<div>" + "<br>".join(own) + "</div>": [one],
        "".join(f"<div>{s}</div>" for s in own): own, "<div>" + "".join(f"<div>{s}</div>" for s in own) + "</div>": own,
        "".join(f"<p>{s}</p>" for s in own): own, one: [one], f"<div>{one}</div><div>{one}</div>": [one, one], f"<div><h1>The old bridge</h1>{one}</div>": ["The old bridge", one],
    }
    for body, want in forms.items():
        for page in (body, f"<body>{body}</body>", f"<!DOCTYPE html><html><head><title>x</title></head><body>\n{body}\n</body></html>"):
            assert model.extract(page).split("\n") == want, page


@pytest.mark.parametrize("name", ["content has-sidebar", "post with-ads", "page no-footer", "story has-cookie", "wrapper with-banner"])
def test_names_of_a_layout_take_no_text_along(name):
    for tag in ("div", "article", "section"):
        body = "".join(f"<p>{p}</p>" for p in PARAGRAPHS[:3])
        page = f'<html><body class="has-sidebar"><{tag} class="{name}"><h1>The old bridge</h1>{body}</{tag}></body></html>'
        assert html_extract.train().extract(page).split("\n") == ["The old bridge", *PARAGRAPHS[:3]]
