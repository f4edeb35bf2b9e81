"""Labelled pages to train the extractor on: random layouts whose main text is known.

Pages are drawn from a seed. Their words are random, so that nothing but structure and
shape can be learned from them. Each text is marked while the page is made, and the
marks are taken off again by ``labelled``.
"""

from __future__ import annotations

import random
import re

#: Private-use characters that mark main text and the rest.
MAIN, REST = "", ""
_MARK = re.compile(f"[{MAIN}{REST}]")

_MENU = ["nav", "menu", "navbar", "main-nav", "navigation", "topnav", "site-nav", "breadcrumb", "breadcrumbs", "pagination", "toc"]
_SIDE = ["sidebar", "aside", "widget", "side", "rail", "secondary", "related", "recommended", "popular", "trending"]
_AD = ["ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "ad-slot", "sponsor"]
_NOTE = ["cookie", "cookie-notice", "consent", "notice", "gdpr", "alert", "modal", "popup", "overlay", "subscribe", "paywall", "warning", "newsletter", "signup"]
_TALK = ["comments", "comment", "comment-list", "responses", "discussion", "replies", "reviews", "respond"]
_FOOT = ["footer", "site-footer", "bottom", "colophon", "copyright", "legal"]
_HEAD = ["header", "site-header", "masthead", "top", "branding", "logo"]
_SHARE = ["share", "social", "sharing", "tags", "meta", "byline-share", "follow"]
_BODY = ["content", "post", "entry-content", "article-body", "main", "story", "post-content", "entry", "article", "text", "main-content", "body"]


class Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choice("bcdfghklmnprstvz") + self.r.choice("aeiouéèäöü") for _ in range(self.r.randint(1, 2))) for _ in range(60)]

        self.vocabulary = [self.new_word() for _ in range(80)]

    def new_word(self) -> str:
        w = "".join(self.r.choices(self.syllables, k=self.r.choice([1, 1, 2, 2, 3])))
        return w + self.r.choice(["", "", "", "", "", "", "%%%", "&amp;", "$$$"]) if self.r.random() < 0.1 else w

    def word(self) -> str:
        return self.r.choice(self.vocabulary)

    def words(self, n: int) -> str:
        return " ".join(self.r.choices(self.vocabulary, k=n))

    def prose(self, low: int = 1, high: int = 5) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            n = self.r.choice([1, 2, 4, 8, 12, 16, 24, 40])
            out.append(self.words(n).capitalize() + self.r.choice([".", ".", ".", "!", "?"]))
        text = " ".join(out)
        if self.r.random() < 0.15:  # cut off, or no sentence at all
            text = text[: self.r.randint(1, len(text))].rstrip("&;.!?") or "x"
        if self.r.random() < 0.3:
            text = text.replace(" ", self.r.choice([" &amp; ", ", ", "\n  ", "&nbsp;", " &mdash; "]), 2)
        return text

    def rich(self, mark: str) -> str:
        """Prose with inline elements."""
        t = mark + self.prose()
        p = self.r.random()
        if p < 0.2:
            t += f" <a href='/{self.word()}'>{self.words(self.r.randint(1, 4))}</a> {self.words(3)}."
        elif p < 0.3:
            t = f"<b>{t}"
            t += "</b>" if self.r.random() < 0.5 else "<br>"
        elif p < 0.4:
            t += f" <em>{self.words(2)}</em> <code>{self.word()}</code>"
        return t

    def attrs(self, names: list[str], chance: float = 0.9) -> str:
        if self.r.random() > chance:
            return ""
        n = self.r.choice(names)
        if self.r.random() < 0.3:
            n = self.r.choice(["site", "page", "wp", "block", "js", "c"]) + self.r.choice("-_") + n
        if names is _BODY and self.r.random() < 0.15:  # a layout's names say what lies beside the text
            n += f" {self.r.choice(['has', 'with', 'no', 'without'])}-{self.r.choice(self.r.choice([_SIDE, _AD, _NOTE, _TALK, _FOOT, _HEAD]))}"
        return f' {self.r.choice(["class", "class", "class", "id"])}="{n}"'

    def links(self, low: int = 2, high: int = 9) -> str:
        items = [f'<a href="/{self.word()}">{REST}{self.words(self.r.choice([1, 1, 1, 2, 3]))}</a>' for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.75:
            kind = self.r.choice(["ul", "ul", "ol"])
            return f"<{kind}>" + "".join(f"<li>{i}" + ("</li>" if self.r.random() < 0.9 else "") for i in items) + f"</{kind}>"
        return self.r.choice([" | ", " ", " &middot; "]).join(items)

    def block(self) -> str:
        """One block of main text."""
        r, p = self.r, self.r.random()
        if p < 0.66:
            return f"<p>{self.rich(MAIN)}" + ("</p>" if r.random() < 0.9 else "")
        if p < 0.76:
            return f"<h{(h := r.randint(2, 4))}>{MAIN}{self.words(r.randint(1, 8))}</h{h}>"
        if p < 0.84:
            k = r.choice(["ul", "ol"])
            return f"<{k}>" + "".join(f"<li>{MAIN}{self.prose(1, 2)}</li>" for _ in range(r.randint(2, 5))) + f"</{k}>"
        if p < 0.88:
            return f"<blockquote><p>{MAIN}{self.prose()}</p></blockquote>"
        if p < 0.91:
            return f"<pre>{MAIN}{self.words(8)}\n  {self.words(4)}</pre>"
        if p < 0.94:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{MAIN}{self.words(r.randint(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
        if p < 0.97:
            return f"<figure><img src='/x.png'><figcaption>{MAIN}{self.prose(1, 1)}</figcaption></figure>"
        return f"<div>{MAIN}{self.prose()}</div>"

    def advert(self) -> str:
        body = self.r.choice([REST + self.prose(1, 3), f"<p>{REST}{self.prose(1, 2)}</p>", f'<a href="/x">{REST}{self.words(5)}</a>'])
        return self.r.choice([f"<div{self.attrs(_AD, 1)}>{body}</div>", f"<aside{self.attrs(_AD, 1)}>{body}</aside>", f"<section{self.attrs(_AD, 1)}>{body}</section>", f"<ins{self.attrs(_AD, 1)}><div{self.attrs(_AD, 1)}>{body}</div></ins>"])

    def notice(self) -> str:
        body = self.r.choice([REST + self.prose(1, 2), f"<p>{REST}{self.prose(1, 3)}</p>"]) + self.r.choice(["", f"<button>{REST}{self.word()}</button>", f'<a href="/p">{REST}{self.words(2)}</a>'])
        role = self.r.choice(["", "", ' role="alert"', ' role="dialog"'])
        return f"<{(t := self.r.choice(['div', 'div', 'section', 'aside']))}{self.attrs(_NOTE, 1)}{role}>{body}</{t}>"

    def boxed(self, names: list[str]) -> str:
        """What isn't main text but reads like it: only the box's name tells."""
        r = self.r
        text = lambda high: REST + self.prose(1, high)
        body = r.choice([
            text(3), f"<p>{text(3)}</p>", f"<p>{text(5)}</p><p>{text(5)}</p>", f"<h{(h := r.randint(2, 4))}>{REST}{self.words(r.randint(1, 5))}</h{h}><p>{text(3)}</p>" + f"<p>{text(3)}</p>" * r.randint(0, 1),
            f"<div><p>{text(4)}</p></div>", f"<div>{text(3)}</div>", f"<p>{text(2)}</p><a href='/x'>{REST}{self.words(2)}</a>",
        ])
        return f"<{(t := r.choice(['div', 'div', 'section', 'aside']))}{self.attrs(names, 1)}>{body}</{t}>"

    def bare(self) -> str:
        """A short page whose text lies in boxes without names, or in none."""
        r = self.r
        n = r.choice([1, 1, 2, 2, 3, 4, 6, 8])
        runs = [MAIN + self.prose(1, 3) for _ in range(n)]
        inner = r.choice([" ".join(runs), "<br>".join(runs), "<br><br>".join(runs), "".join(f"<div>{x}</div>" for x in runs), "".join(f"<div>{x}</div>" for x in runs), "".join(f"<p>{x}</p>" for x in runs)])
        if r.random() < 0.25:
            inner = f"<h{(h := r.randint(1, 2))}>{MAIN}{self.words(r.randint(1, 8))}</h{h}>{inner}"
        for _ in range(r.choice([0, 1, 1, 1, 2, 3])):
            inner = f"<div>{inner}</div>"
        if r.random() < 0.2:
            inner = self.menu() + inner
        if r.random() < 0.2:
            inner += r.choice([self.footer, self.advert, self.notice])()
        return inner

    def form(self) -> str:
        body = f"<label>{REST}{self.words(2)}</label><input name=q><button>{REST}{self.word()}</button>"
        if self.r.random() < 0.5:
            body = f"<p>{REST}{self.prose(1, 2)}</p>" + body
        if self.r.random() < 0.3:
            body += f"<select><option>{REST}{self.word()}<option>{REST}{self.word()}</select><textarea>{REST}{self.words(3)}</textarea>"
        return f"<form{self.attrs(['search', 'newsletter', 'login', 'signup'], 0.5)}>{body}</form>"

    def side(self) -> str:
        body = f"<h{(h := self.r.randint(2, 4))}>{REST}{self.words(2)}</h{h}>" * (self.r.random() < 0.7)
        body += self.r.choice([self.links(), f"<p>{REST}{self.prose(1, 2)}</p>", f"<div>{REST}{self.prose(1, 2)}</div>", self.links() + f"<p>{REST}{self.prose(1, 1)}</p>"])
        if self.r.random() < 0.5:
            return f"<aside{self.attrs(_SIDE, 0.6)}>{body}</aside>"
        return f"<{(t := self.r.choice(['div', 'section']))}{self.attrs(_SIDE, 1)}>{body}</{t}>"

    def comments(self) -> str:
        one = lambda: f"<{(t := self.r.choice(['div', 'li', 'article']))}{self.attrs(['comment', 'reply', 'comment-body', 'review'], 0.9)}><{(u := self.r.choice(['span', 'h4', 'b', 'cite']))}>{REST}{self.words(2)}</{u}><p>{REST}{self.prose(1, 4)}</p></{t}>"
        body = f"<h3>{REST}{self.words(2)}</h3>" * (self.r.random() < 0.6) + "".join(one() for _ in range(self.r.randint(1, 5)))
        if self.r.random() < 0.4:
            body += self.form()
        return f"<{(t := self.r.choice(['div', 'section', 'ol']))}{self.attrs(_TALK, 1)}>{body}</{t}>"

    def menu(self) -> str:
        return f"<nav{self.attrs(_MENU, 0.4)}>{self.links()}</nav>" if self.r.random() < 0.6 else f"<{(t := self.r.choice(['div', 'ul']))}{self.attrs(_MENU, 1)}>{self.links()}</{t}>"

    def header(self) -> str:
        body = self.r.choice(["", f"<div{self.attrs(_HEAD, 1)}><a href='/'>{REST}{self.words(2)}</a></div>", f"<p>{REST}{self.words(4)}</p>", f"<h1><a href='/'>{REST}{self.words(2)}</a></h1>"])
        body += self.menu() * (self.r.random() < 0.5) + self.form() * (self.r.random() < 0.2)
        return f"<header{self.attrs(_HEAD, 0.5)}>{body}</header>" if self.r.random() < 0.6 else f"<div{self.attrs(_HEAD, 1)}>{body}</div>"

    def footer(self) -> str:
        body = self.r.choice([f"&copy; {REST}{self.words(2)} &middot; {self.prose(1, 1)}", f"<p>&copy; {REST}{self.prose(1, 2)}</p>", f"<p>{REST}{self.prose(1, 2)}</p>", REST + self.prose(1, 2), f"<small>{REST}Copyright {self.words(3)}</small>"])
        body += self.links() * (self.r.random() < 0.4)
        return f"<footer{self.attrs(_FOOT, 0.4)}>{body}</footer>" if self.r.random() < 0.7 else f"<div{self.attrs(_FOOT, 1)}>{body}</div>"

    def share(self) -> str:
        return f"<{(t := self.r.choice(['div', 'ul', 'p']))}{self.attrs(_SHARE, 1)}>{self.links(1, 4)}</{t}>"

    def main(self) -> str:
        r, title = self.r, f"<h1>{MAIN}{self.words(self.r.randint(1, 9))}</h1>"
        if r.random() < 0.2:
            title = f"<header>{title}</header>"
        parts = [self.block() for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14, 25]))]
        for make, chance in ((self.advert, 0.25), (self.share, 0.15), (self.side, 0.1), (self.form, 0.08), (self.notice, 0.08)):
            if r.random() < chance:
                parts.insert(r.randint(0, len(parts)), make())
        for names in (_AD, _NOTE, _SIDE, _FOOT):
            if r.random() < 0.3:
                parts.insert(r.randint(0, len(parts)), self.boxed(names))
        if r.random() < 0.15:
            parts.append(self.comments())
        body = "".join(parts)
        if r.random() < 0.3:
            body = f"<{(t := r.choice(['div', 'section']))}{self.attrs(_BODY, 0.7)}>{body}</{t}>"
        whole = (title if r.random() < 0.9 else "") + body
        p = r.random()
        if p < 0.5:
            return f"<article{self.attrs(_BODY, 0.3)}>{whole}</article>"
        if p < 0.65:
            return f"<main{self.attrs(_BODY, 0.3)}>{whole}</main>"
        if p < 0.72:
            return f"<main><article>{whole}</article></main>"
        if p < 0.92:
            return f"<div{self.attrs(_BODY, 1)}>{whole}</div>"
        if p < 0.96:
            return f"<table><tr><td{self.attrs(_BODY, 0.7)}>{whole}</td></tr></table>"
        return whole

    def html(self) -> str:
        r = self.r
        if r.random() < 0.12:
            return r.choice([self.bare(), f"<body>{self.bare()}</body>", f"<!DOCTYPE html><html><head><title>{REST}{self.words(3)}</title></head><body>\n{self.bare()}\n</body></html>"])
        top = [self.header() if r.random() < 0.5 else "", self.menu() if r.random() < 0.7 else "", self.notice() if r.random() < 0.25 else "", self.advert() if r.random() < 0.4 else "", self.side() if r.random() < 0.15 else ""]
        r.shuffle(top)
        low = [self.side() if r.random() < 0.4 else "", self.comments() if r.random() < 0.4 else "", self.advert() if r.random() < 0.2 else "", self.form() if r.random() < 0.2 else "", self.notice() if r.random() < 0.15 else ""]
        r.shuffle(low)
        middle = self.main()
        if r.random() < 0.3:
            middle = f"<div{self.attrs(['wrapper', 'container', 'page', 'layout', 'row', 'wrap'], 1)}>{middle}{''.join(low)}</div>"
            low = []
        foot = self.footer() if r.random() < 0.8 else ""
        body = f"{''.join(top)}{middle}{''.join(low)}{foot}"
        head = f"<head><meta charset=utf-8><title>{REST}{self.words(3)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{'<!-- x -->' * (r.random() < 0.3)}{body}</body></html>"


def labelled(text: str) -> int | None:
    """1 for marked main text, 0 for the rest, None for a text without a mark."""
    found = _MARK.search(text)
    return None if found is None else int(found[0] == MAIN)


def pages(n: int, seed: int = 0) -> list[str]:
    return [Page(seed * 1_000_003 + i).html() for i in range(n)]


def unmarked(html: str) -> str:
    return _MARK.sub("", html)
