"""Main text of web pages, by a tree-structured graphical model over the DOM.

Every element and every run of text between block-level tags is a binary variable, content
or not. A variable has a potential of its own (its features' learned weights) and one with
its parent: how often content lies in content, and what the names of the parent (for text,
also of the parent's parent) say of what lies in it. The graph is a tree, so one
sum-product pass from the leaves up and one from the root down give exact marginals; runs
of text whose marginal is over one half are the page's text. Potentials are trained from
labelled pages: random layouts with known main text (``html_pages``), a bounded set
(``PAGES``) that is the same for any corpus.

Scripts, styles, titles, templates, form controls, drawings and players hold no text. One
of these that was never closed takes nothing along, but for those whose text a parser takes
as it is (``RAW``). Character references are decoded, white space inside a block becomes one
space, and blocks are joined in page order by one line feed. A null or empty page, and one
without content, give an empty text.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from causeway.llm import html_pages
from causeway.llm.common import small_batches

#: Labelled pages of the training set.
PAGES = 2000
#: Elements that begin a block, hold nothing, hold no text, are closed by others.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol option optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text the parser takes as it is, up to their end tag or else the page's end;
#: elements whose text isn't shown as text where they have an end tag; of these, the ones that can't lie in their own kind.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
MUTED = frozenset("button select svg object video audio canvas template datalist annotation annotation-xml".split())
ALONE = frozenset("button select".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tbody", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
#: Elements whose names say nothing of what lies in them.
PLAIN = frozenset("html body #root".split())
#: What stops the search for an element to close.
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "option": {"select"}}
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_STOP = re.compile(r">|=\s*+[\"']")
_ATTR = re.compile(r"\b(class|id|role|hidden|style|itemprop)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("children", "features", "letters", "linked", "marks", "names", "parent", "tag", "text")

    def __init__(self, tag: str, parent: int, features: list[str], text: str | None = None):
        self.tag, self.parent, self.features, self.text, self.children = tag, parent, features, text, []
        self.names: list[str] = []
        self.letters = self.linked = self.marks = 0


def _attributes(raw: str) -> list[str]:
    out = []
    for m in _ATTR.finditer(raw):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if key == "hidden":
            out.append("hidden")
        elif key == "style":
            if re.search(r"display\s*+:\s*+none", value):
                out.append("hidden")
        else:
            out += [f"a:{part.lower()}" for part in _PART.findall(value)]
    return out


class Tag(NamedTuple):
    """A tag, comment or declaration, or a whole element of ``RAW``; ``name`` is empty for all but tags."""

    start: int
    stop: int
    closing: bool
    name: str
    raw: str


def tags(page: str) -> list[Tag]:
    """The page's tags in order; all else is text.

    A ``>`` in a quoted value ends no tag. Where the quotes of a tag don't close before the
    page's end, its first ``>`` ends it; a page whose quotes mislead again and again is read
    on without regard to them, so that the time stays in proportion to the page.
    """
    out: list[Tag] = []
    at, end, last, wasted = 0, len(page), page.rfind(">"), 0
    while (lt := page.find("<", at)) >= 0:
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            out.append(Tag(lt, at, False, "", ""))
            continue
        m = _NAME.match(page, lt + 1)
        if m is None or lt > last:
            if lt > last or page[lt + 1] not in "!?/":
                at = lt + 1
                continue
            at = page.find(">", lt + 1) + 1
            out.append(Tag(lt, at, False, "", ""))
            continue
        stop = _end_of_tag(page, m.end()) if wasted <= 8 * end else -1
        if stop < 0:
            wasted += end - lt
            stop = page.find(">", m.end())
        at, name, raw = stop + 1, m[2].lower(), page[m.end() : stop]
        if name in RAW and not m[1] and not raw.endswith("/"):
            shut = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I).search(page, at)
            at = shut.end() if shut else end
            out.append(Tag(lt, at, False, "", " "))
        else:
            out.append(Tag(lt, at, bool(m[1]), name, raw))
    return out


def _end_of_tag(page: str, at: int) -> int:
    """The first ``>`` that isn't in a quoted value, or -1."""
    while m := _STOP.search(page, at):
        if page[m.start()] == ">":
            return m.start()
        at = page.find(page[m.end() - 1], m.end()) + 1
        if not at:
            break
    return -1


def muted_ends(found: list[Tag]) -> dict[int, int]:
    """By place among the tags: the end tags of the ``MUTED`` elements that have one.

    An element that is still open where an element around it ends, or where another of its
    kind begins that can't lie in it, has none.
    """
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    count: dict[str, int] = {}

    def close(name: str) -> int:
        while True:
            top, i = stack.pop()
            count[top] -= 1
            if top == name:
                return i

    for i, t in enumerate(found):
        if t.name not in MUTED and t.name not in BLOCKS or t.name in VOID:
            continue
        if not t.closing:
            if t.name in MUTED and t.raw.endswith("/"):
                continue
            if t.name in ALONE and count.get(t.name):
                close(t.name)
            stack.append((t.name, i))
            count[t.name] = count.get(t.name, 0) + 1
        elif count.get(t.name):
            start = close(t.name)
            if t.name in MUTED:
                ends[start] = i
    return ends


def parse(page: str) -> list[Node]:
    """The page's tree in document order: elements that begin blocks, and runs of text (with ``text``).

    Time and memory are in proportion to the page, however it is nested.
    """
    nodes = [Node("#root", -1, ["t:#root"])]
    stack: list[int] = [0]
    opened: dict[str, list[int]] = {}  # places in the stack by tag
    parts: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                n = Node("#text", stack[-1], [], text)
                n.letters, n.linked = len(text), min(linked, len(text))
                nodes[stack[-1]].children.append(len(nodes))
                nodes.append(n)
        linked = 0

    def close_from(i: int) -> None:
        for n in stack[i:]:
            opened[nodes[n].tag].pop()
        del stack[i:]

    def innermost(names: set[str]) -> int:
        return max((opened[t][-1] for t in names if opened.get(t)), default=0)

    found = tags(page)
    ends, at, i = muted_ends(found), 0, 0
    while i < len(found):
        t = found[i]
        if t.start > at:
            parts.append(page[at : t.start])
            if in_link:
                linked += t.start - at
        if i in ends:
            i = ends[i]
        at, tag, i = found[i].stop, t.name, i + 1
        if not tag:
            parts.append(t.raw)
        elif tag == "br" or tag in MUTED:
            parts.append(" ")
        elif tag == "a":
            in_link = 0 if t.closing else 1
        elif tag in BLOCKS:
            flush()
            if tag in VOID:
                continue
            if t.closing:
                if opened.get(tag):
                    close_from(opened[tag][-1])
                in_link = 0
                continue
            if nodes[stack[-1]].tag == "p":
                close_from(len(stack) - 1)
            if tag in CLOSES and (first := innermost(CLOSES[tag])) > innermost(FENCE[tag]):
                close_from(first)
            n = Node(tag, stack[-1], [f"t:{tag}", *_attributes(t.raw)])
            nodes[stack[-1]].children.append(len(nodes))
            opened.setdefault(tag, []).append(len(stack))
            stack.append(len(nodes))
            nodes.append(n)
    if at < len(page):
        parts.append(page[at:])
    flush()
    return nodes


def _bucket(n: float, edges: tuple[float, ...]) -> int:
    return sum(n >= e for e in edges)


def describe(nodes: list[Node]) -> None:
    """Complete the features of all nodes."""
    for n in reversed(nodes[1:]):
        up = nodes[n.parent]
        up.letters += n.letters
        up.linked += n.linked
        if n.text is not None:
            n.marks = sum(n.text.count(c) for c in ".,;!?")
        up.marks += n.marks
    whole = max(1, nodes[0].letters)
    for n in nodes[1:]:
        up, f = nodes[n.parent], n.features
        n.names = [x for x in f if x.startswith("a:")] if n.text is None and n.tag not in PLAIN else []
        f += [f"in-{x}" for x in up.names]
        if n.text is not None and up.parent >= 0:
            f += [f"far-{x}" for x in nodes[up.parent].names]
        f.append(f"{'' if n.text is not None else 'e-'}share:{_bucket(n.letters / whole, (0.05, 0.2, 0.5, 0.9))}")
        link = _bucket(n.linked / max(1, n.letters), (0.01, 0.3, 0.7, 0.95))
        if n.text is not None:
            f.append(f"len:{_bucket(n.letters, (8, 20, 40, 80, 160, 320, 640))}")
            f.append(f"marks:{_bucket(n.marks, (1, 2, 4, 8))}")
            f.append(f"link:{link}")
            f.append(f"in:{up.tag}")
            f.append(f"in:{up.tag}:link:{link}")
            if "©" in n.text or "copyright" in n.text.lower():
                f.append("c")
        else:
            tag = n.tag
            f.append(f"e-link:{link}")
            f.append(f"e-len:{_bucket(n.letters, (1, 20, 80, 320, 1280))}")
            f.append(f"{tag}:link:{link}")
            f.append(f"{up.tag}>{tag}")
            if tag == "header":
                f.append(f"header:h1:{any(nodes[c].tag == 'h1' for c in n.children)}")


class Model:
    """``weights``: log-odds by feature; ``pair``: log P(child | parent) as [child is text][parent][child];
    ``root``: log prior."""

    def __init__(self, weights: dict[str, float], pair: list[list[list[float]]], root: list[float]):
        self.weights, self.pair, self.root = weights, pair, root

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of every node: sum-product, up and then down."""
        get = self.weights.get
        pairs = [[math.exp(v) for row in kind for v in row] for kind in self.pair]
        n = len(nodes)
        # beliefs are odds (content : not); messages to a parent are ratios too
        own, message = [1.0] * n, [1.0] * n
        for i in range(n - 1, -1, -1):
            node, z = nodes[i], 0.0
            for f in node.features:
                z += get(f, 0.0)
            o = math.exp(max(-30.0, min(30.0, z)))
            for c in node.children:
                o *= message[c]
            own[i] = o = min(max(o, 1e-120), 1e120)
            p00, p01, p10, p11 = pairs[node.text is not None]
            message[i] = (p10 + p11 * o) / (p00 + p01 * o)
        full = own[:]
        full[0] = own[0] * math.exp(self.root[1] - self.root[0])
        for i in range(1, n):
            rest = full[nodes[i].parent] / message[i]  # the parent without this child
            p00, p01, p10, p11 = pairs[nodes[i].text is not None]
            down = (p01 + p11 * rest) / (p00 + p10 * rest)
            full[i] = min(max(own[i] * down, 1e-120), 1e120)
        return [o / (1 + o) for o in full]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        describe(nodes)
        return "\n".join(n.text for n, p in zip(nodes, self.marginals(nodes), strict=True) if n.text is not None and p > 0.5)


@lru_cache(maxsize=2)
def train(pages: int = PAGES, seed: int = 0, ridge: float = 0.1, steps: int = 200) -> Model:
    """Fit the potentials: counts of parent and child labels, and logistic regression of the
    own potentials, whose offset is each node's prior given its parent's label."""
    rows: list[tuple[list[str], int, int, int]] = []
    pair, root = np.ones((2, 2, 2)), np.ones(2)
    for page in html_pages.pages(pages, seed):
        nodes = parse(page)
        labels = [-1] * len(nodes)
        marked = [[0, 0] for _ in nodes]
        for i in range(len(nodes) - 1, -1, -1):
            n = nodes[i]
            if n.text is not None:
                label = html_pages.labelled(n.text)
                if label is not None:
                    marked[i][label] += len(n.text)
                n.text = html_pages.unmarked(n.text)
                n.letters = len(n.text)
            if n.parent >= 0:
                for k in (0, 1):
                    marked[n.parent][k] += marked[i][k]
            if sum(marked[i]):
                labels[i] = int(marked[i][1] > marked[i][0])
        for n in nodes:  # ``describe`` sums anew
            if n.text is None:
                n.letters = n.linked = n.marks = 0
        describe(nodes)
        for i, n in enumerate(nodes):
            if labels[i] < 0:
                continue
            if n.parent < 0:
                root[labels[i]] += 1
            elif labels[n.parent] >= 0:
                is_text = int(n.text is not None)
                pair[is_text, labels[n.parent], labels[i]] += 1
                rows.append((n.features, labels[i], labels[n.parent], is_text))
    pair = np.log(pair / pair.sum(2, keepdims=True))
    names: dict[str, int] = {}
    counts: dict[str, int] = {}
    for f, *_ in rows:
        for x in f:
            counts[x] = counts.get(x, 0) + 1
    at_row, at_col = [], []
    for i, (f, *_) in enumerate(rows):
        for x in f:
            if counts[x] >= 5:
                at_row.append(i)
                at_col.append(names.setdefault(x, len(names)))
    r, c, m = np.array(at_row), np.array(at_col), len(names)
    y = np.array([x[1] for x in rows], float)
    offset = np.array([pair[x[3], x[2], 1] - pair[x[3], x[2], 0] for x in rows])
    w, g2 = np.zeros(m), np.full(m, 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[c], len(rows)) + offset, -40, 40)))
        g = np.bincount(c, (p - y)[r], m) + ridge * w
        g2 += g * g
        w -= 0.4 * g / np.sqrt(g2)
    return Model({x: float(w[i]) for x, i in names.items()}, pair.tolist(), np.log(root / root.sum()).tolist())


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    small_batches(pages.sparkSession)
    m = model or train()
    given = pages.sparkSession.sparkContext.broadcast((m.weights, m.pair, m.root))  # features of the training set only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*given.value)
        for b in batches:
            text = [fitted.extract(h.as_py()) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    own = pages.select("page_id", "url", "html")
    return own.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
