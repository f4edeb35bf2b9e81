"""The training-data operators against brute force, on small tables with every awkward row."""

import collections
import fractions
import hashlib
import pathlib
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from causeway.llm import common, decontaminate, html_extract, html_pages, jaccard_join, line_dedup, neighbours, packing, queries, sharding, token_counts, tokens, toxicity, url_filter
from causeway.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
PASSAGE = "The quick brown fox jumps over the lazy dog and then sleeps under an old oak tree until the evening comes"
ODD = [
    (1, None), (2, ""), (3, " \t\n\r "), (4, "one"), (5, "One TWO three"), (6, "a b c d e"), (7, "A B\tC\nD E"), (8, PASSAGE), (9, PASSAGE), (9, PASSAGE),
    (10, PASSAGE + " again"), (11, PASSAGE.upper()), (12, LONG), (13, LONG + " tail"), (14, "é É ß\x85x \x1c y"), (15, "<|endoftext|> end"), (16, "\n" + PASSAGE + "\n\n" + PASSAGE), (17, "x" * 5000),
]


def docs(spark, rows=ODD, **more):
    cols = {"source": "s", "pos": 1, "h1": 2, "_id": 3, "row": 4, "line": "x"} | more  # names that could clash
    return spark.createDataFrame([(*r, *cols.values()) for r in rows], "doc_id long, text string, " + ", ".join(f"`{k}` {'string' if isinstance(v, str) else 'int'}" for k, v in cols.items()))


def empty(spark):
    return docs(spark).limit(0)


def words(text):
    return WORD.findall((text or "").encode().translate(FOLD))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


# --- shared ---------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ \t\n\x0b\r\x1cé", max_size=40)), max_size=12), st.integers(1, 60))
def test_shingle_sets(texts, most):
    got = [len(h) for h in common.shingle_sets(pa.array(texts, pa.string()), most)]
    assert got == [len(shingles(t)) for t in texts]
    first, second = common.shingle_sets(pa.array([" ".join(x or "" for x in texts)] * 2, pa.string()))
    assert (first == second).all()


def test_shingles_of_a_slice():
    t = pa.array(["x y z q w e", None, "a b c d e f g", ""]).slice(1)
    assert [len(h) for h in common.shingle_sets(t)] == [0, 3, 0]


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(50)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[n] == find(n) for a, b in edges if a != b for n in (a, b))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 ---------------------------------------------------------------------------------------


def test_extraction_of_held_out_layouts():
    model, hit, exact = html_extract.train(), np.zeros(3, int), 0
    for page in html_pages.pages(120, seed=99):
        want = [html_pages.unmarked(n.text) for n in html_extract.parse(page) if n.text and html_pages.labelled(n.text)]
        got = model.extract(html_pages.unmarked(page)).split("\n")
        a, b = collections.Counter(want), collections.Counter(x for x in got if x)
        hit += [(a & b).total(), (b - a).total(), (a - b).total()]
        exact += a == b
    assert hit[0] / (hit[0] + hit[1]) > 0.97 and hit[0] / (hit[0] + hit[2]) > 0.97 and exact > 100


def test_extraction_of_awkward_pages(spark):
    ok = "<html><head><title>T</title></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>More</a></ul></nav><article><h1>A &amp; B</h1><p>First   one,\n with &eacute; and &#8364;.<p>Second <b>bold<br>text</b> ends.</article><footer>&copy; me</footer></body></html>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", ok), (5, "u", "<script>var a='</p>'"), (6, "u", "<div>" * 3000 + "x")]
    out = {r["page_id"]: r for r in html_extract.extract_pages(spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")).collect()}
    assert out[4]["text"] == "A & B\nFirst one, with é and €.\nSecond bold text ends." and out[4]["n_chars"] == len(out[4]["text"])
    assert out[1]["text"] == out[2]["text"] == out[5]["text"] == "" and len(out) == 6


UNCLOSED = ["button", "svg", "video", "math", "object", "select", "audio", "canvas", "template"]
ARTICLE = [f"The {k} paragraph says many things, and it goes on for long. " * 4 for k in ("first", "second", "third")]


@pytest.mark.parametrize("between", [f"<{t}>" for t in UNCLOSED] + ["<svg/>", "<button>Share</button>", "<svg><path d='M'/><title>icon</title></svg>", "<svg><svg>icon</svg>", "<button><button>Share</button>", "<!-- <p>icon</p> -->"])
def test_nothing_is_lost_behind_an_element(between):
    page = f"<title>T</title><nav><a href=/>Home</a></nav><article><h1>The title of this article</h1><p>{ARTICLE[0]}</p>{between}<p>{ARTICLE[1]}</p><p>{ARTICLE[2]}</p></article><footer><button>Top</button><svg>x</svg></footer>"
    assert html_extract.train().extract(page).split("\n") == ["The title of this article", *(p.strip() for p in ARTICLE)]


def test_formulas_stay_and_raw_text_goes():
    m = html_extract.train()
    page = f"<article><h1>The title of this article</h1><p>{ARTICLE[0]} It holds <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>E=m</annotation></math>. {ARTICLE[1]}</p></article>"
    assert "It holds E=m . The second" in m.extract(page)
    assert m.extract(f"<article><p>{ARTICLE[0]}</p><script>if (a < b) {{}}</article>").strip() == ARTICLE[0].strip()
    assert m.extract(f"<article><p>{ARTICLE[0]}</p><!-- no end {ARTICLE[1]}").strip() == ARTICLE[0].strip()
    long = " ".join(f"w{i}" for i in range(200))
    assert html_extract._attributes(f' class="{long} article-body"')[-2:] == ["a:article", "a:body"]


HOSTILE = {
    "no end": "<a " * 300_000, "quoted": '<a x=">" ' * 110_000, "unmatched": "<div>" * 80_000 + "</section>" * 60_000, "deep": "<div>" * 180_000,
    "drawings": "<svg>" * 190_000, "cells": "<td><table>" + "<div>" * 90_000 + "<td></td>" * 60_000, "lists": "<ul><li>" * 110_000, "comments": "<!--" * 250_000,
    "one quote": "<a x='" * 150_000 + ">", "two quotes": "<a =\"<a ='>" * 90_000, "names": '<p class="' + "a b " * 240_000 + '">x</p>', "references": "&lt" * 330_000,
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_hostile_pages_take_time_in_proportion(kind):
    m, page = html_extract.train(), HOSTILE[kind]

    def took(text):
        began = time.process_time()
        m.extract(text)
        return time.process_time() - began

    assert took(page) < 6  # quadratic work on a megabyte would take minutes


def test_marginals_against_enumeration():
    nodes = html_extract.parse("<div class=ad><p>a b c.</p></div><article><p>d e f.</p></article>")
    html_extract.describe(nodes)
    m = html_extract.train()
    scores = [sum(m.weights.get(f, 0.0) for f in n.features) for n in nodes]
    total, marginal = 0.0, np.zeros(len(nodes))
    for bits in range(1 << len(nodes)):
        x = [bits >> i & 1 for i in range(len(nodes))]
        e = m.root[x[0]] + sum(s * v for s, v in zip(scores, x, strict=True))
        e += sum(m.pair[n.text is not None][x[n.parent]][x[i]] for i, n in enumerate(nodes) if i)
        total += np.exp(e)
        marginal += np.exp(e) * np.array(x)
    assert np.allclose(m.marginals(nodes), marginal / total)


# --- 2 ---------------------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 12)).astype(np.float32)
    x[5] = x[6] = x[7] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows[300] = (300, None)
    rows[400] = (400, [0.0] * 12)
    rows[401] = (401, [float("nan")] + [1.0] * 11)
    rows[402] = (402, [None] + [1.0] * 11)
    rows[403] = (403, [1.0] * 5)
    df = spark.createDataFrame([*rows, rows[8], (None, [1.0] * 12)], "vec_id long, embedding array<float>")
    got = neighbours.self_search(df).collect()
    keep = [i for i in range(700) if i not in (300, 400, 401, 402, 403)]
    hits = []
    for q in (0, 100, 200, 500, 600):
        d = {i: float(np.sqrt(((x[i].astype(float) - x[q]) ** 2).sum())) for i in keep if i != q}
        want = sorted(d, key=lambda i: (d[i], i))[:10]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, *_ in own] == list(range(1, 11)) and all(s == pytest.approx(d[i], abs=1e-12) for _, i, s in own)
        assert [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        hits.append(len(set(want) & {i for _, i, _ in own}))
    assert {r["query_id"] for r in got} == {0, 100, 200, 500, 600} and np.mean(hits) >= 9


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.self_search(df).collect()} == {(0, 1, 3), (0, 2, 100), (100, 1, 3), (100, 2, 0)}
    assert neighbours.self_search(df.limit(0)).count() == 0


def neighbours_of(spark, x, kind="float"):
    """What self_search finds, and brute force, as {query: [(id, distance)]}."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>").repartition(4)
    got = collections.defaultdict(list)
    for r in sorted(neighbours.self_search(df).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = {}
    for q in range(0, len(x), 100):
        d = np.sqrt(((x.astype(float) - x[q]) ** 2).sum(axis=1))
        want[q] = [(int(i), d[i]) for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
    return dict(got), want


def test_neighbours_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SEED_BLOCK", 64)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[rng.permutation(900)[:500]] = x[0]  # spans several seed blocks
    x[100] = rng.normal(size=8)
    x[[13, 300, 700]] = x[100] + np.float32(1e-3)  # fewer copies than asked for
    x[500], x[600] = 0.0, -0.0
    x[500, 0] = x[600, 0] = 1.0  # equal but for the sign of zeros
    got, want = neighbours_of(spark, x)
    copies = [q for q in want if want[q][9][1] == 0]
    assert copies and all(got[q] == want[q] for q in copies)
    assert [i for i, _ in got[100][:3]] == [13, 300, 700] and got[500][0] == (600, 0.0)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]) >= 9.5


@pytest.mark.parametrize("large", [1e5, 1e7, 1e30])
def test_graph_beside_a_large_row(spark, monkeypatch, large):
    monkeypatch.setattr(neighbours, "SEED_BLOCK", 64)
    x = np.random.default_rng(2).normal(size=(1000, 8))
    x[7, 3] = large
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    near = {r["id"]: [e["other"] for e in r["near"]] for r in neighbours.build_graph(neighbours.packed(df)).collect()}
    hits = []
    for i in range(0, 1000, 20):
        d = ((x - x[i]) ** 2).sum(axis=1)
        hits.append(len(set(np.argsort(np.where(np.arange(1000) == i, np.inf, d))[:10].tolist()) & set(near[i][:10])))
    assert np.mean(hits) >= 9


def test_recall_of_small_seed_blocks(spark, monkeypatch):
    """Blocks of 16 points alone find little, so the rounds have to; one row is far larger than the others."""
    monkeypatch.setattr(neighbours, "SEED_BLOCK", 16)
    monkeypatch.setattr(neighbours, "DEGREE", 12)
    x = np.random.default_rng(3).normal(size=(4000, 10)).astype(np.float32)
    x[17] *= 1e8
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    seeds = neighbours._best(neighbours._seed(neighbours.packed(df), 12, 1, "<f8").withColumn("new", F.lit(True)), 12)
    rounds = neighbours.build_graph(neighbours.packed(df), 12)
    want = {i: set(np.argsort(np.where(np.arange(4000) == i, np.inf, ((x - x[i]) ** 2).sum(axis=1)))[:10].tolist()) for i in range(0, 4000, 40)}
    recall = [np.mean([len(want[r["id"]] & {e["other"] for e in r["near"][:10]}) / 10 for r in g.where("id % 40 = 0").collect()]) for g in (seeds, rounds)]
    assert recall[0] < 0.5 and recall[1] > 0.9
    got, want = neighbours_of(spark, x)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]) >= 9


def test_neighbours_of_several_lengths_and_clashing_names(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3 if i % 2 else 5).tolist(), 1, "x", 2.0, [1.0]) for i in range(60)] + [(100, [1.0, 2.0, 3.0], 1, "x", 2.0, [1.0]), (200, [1.0], 1, "x", 2.0, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, x string, v double, near array<double>")
    got = collections.defaultdict(list)
    for r in sorted(neighbours.self_search(df).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["vec_id"])
    for q in (0, 100):
        own = {i: np.linalg.norm(np.subtract(e, rows[0 if q == 0 else 60][1])) for i, e, *_ in rows if len(e) == (5 if q == 0 else 3) and i != q}
        assert got[q] == sorted(own, key=own.get)[:10]
    assert set(got) == {0, 100}  # the only vector of its length has no neighbour


def test_neighbours_of_copies_only(spark):
    got, want = neighbours_of(spark, np.ones((250, 3), np.float32))
    assert got == want


# --- 3, 7 ------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_both_libraries_give_the_same_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens.encoder(tokens.vocabulary())(text).tolist() == t.encode(text, add_special_tokens=False).ids


def ids_of(text):
    return [*tokens.encoder(tokens.vocabulary())(text).tolist(), 0]


def check_pieces(rows, texts, length):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    want = collections.Counter()
    for i, t in texts:
        want[i] += len(ids_of(t))
    assert {i: sum(r["length"] for r in x) for i, x in by.items()} == want
    assert {r["doc_id"] for r in rows} == {i for i, _ in texts}
    at = collections.defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, x in at.items():
        x.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and x[0][0] == 0 and (sum(x[-1]) == length or k == max(at))


def test_packing(spark):
    rows = [(i, t, None if i == 4 else f"s{i % 3}") for i, t in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = packing.pack(df, length=64, window=512, quantum=16, with_ids=True).collect()
    check_pieces(out, ODD, 64)
    ids = {i: np.array(ids_of(t)) for i, t in ODD}
    for r in out:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(own.astype("<u4").tobytes()) and np.frombuffer(bytes(r["ids"]), "<u2").tolist() == own.tolist()
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
    assert packing.pack(df.limit(0)).count() == 0
    check_pieces(packing.pack(docs(spark).drop("source"), length=128).collect(), ODD, 128)


def test_mixture_stays_within_a_quantum(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["word"] * int(rng.integers(1, 300))), "abc"[int(rng.choice(3, p=[0.6, 0.3, 0.1]))]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for targets in (None, {"a": 0.2, "b": 0.2, "c": 0.6}):
        out = packing.pack(df, targets, length=256, window=2048, quantum=64).join(df.select("doc_id", "source"), "doc_id")
        share = {(r["window_id"], r["source"]): r["n"] for r in out.groupBy("window_id", "source").agg(F.sum("length").alias("n")).collect()}
        total = collections.Counter()
        for (_, s), n in share.items():
            total[s] += n
        given = collections.Counter()
        for w in range(max(k for k, _ in share)):
            for s in "abc":
                given[s] += share.get((w, s), 0)
                goal = 2048 * (w + 1) * (total[s] / total.total() if targets is None else targets[s])
                if targets is None or w < 2:  # c runs dry later on
                    assert abs(given[s] - goal) <= 64 + 1


def test_mixture_of_very_many_sources(spark):
    rows = [(i, "word " * 9 + "word", f"s{i % 4500}") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    goals = {f"s{i}": 0.5 if i < 2 else 0.0 for i in range(4500)}
    for targets in (None, goals):
        out = packing.pack(df, targets, length=64, window=8192, quantum=2)
        own = out.join(df.select("doc_id", "source"), "doc_id").groupBy("source", "window_id").agg(F.sum("length").alias("n")).collect()
        each = len(ids_of(rows[0][1])) * 2
        if targets is None:
            windows = 4500 * each / 8192
            by = collections.defaultdict(int)
            for r in own:
                by[r["source"], r["window_id"]] += r["n"]
            for s in range(0, 4500, 7):
                n = 0
                for w in range(int(windows)):
                    n += by.get((f"s{s}", w), 0)
                    assert abs(n - each * (w + 1) / windows) <= 3
        else:
            assert {r["source"] for r in own if r["window_id"] == 0} == {"s0", "s1"}
        assert sum(r["n"] for r in own) == 4500 * each


def test_schedule_against_rounds():
    """The closed form against the rounds themselves, a window at a time, with exact fractions."""
    rng = np.random.default_rng(8)
    for _ in range(60):
        totals = [int(rng.integers(1, 900)) for _ in range(rng.integers(1, 6))]
        targets = None if rng.random() < 0.5 else [float(rng.choice([0, 0.25, 1])) for _ in totals]
        window, quantum = int(rng.choice([64, 300])), int(rng.choice([1, 7, 64]))
        p = packing.Schedule(totals, targets, window, quantum)
        earned, r = [fractions.Fraction(0)] * len(totals), 0
        weights = totals if targets is None else [int(1_000_000 * t) for t in targets]
        for late in (False, True):  # queues with no target of their own come last
            own = [s for s, w in enumerate(weights) if (not w) == late]
            share = {s: weights[s] or totals[s] for s in own}
            while live := [s for s in own if earned[s] < totals[s]]:
                for s in live:
                    earned[s] += fractions.Fraction(window * share[s], sum(share[x] for x in live))
                r += 1
                handed = [t if e >= t else int(e) // quantum * quantum for e, t in zip(earned, totals, strict=True)]
                assert p.given(r) == handed, (totals, targets, window, quantum, r)
        assert p.windows == r


def test_schedule():
    rng = np.random.default_rng(3)
    for _ in range(200):
        totals = [int(rng.integers(1, 3000)) for _ in range(rng.integers(1, 6))]
        targets = None if rng.random() < 0.5 else [float(rng.choice([0, 0.1, 1])) for _ in totals]
        p = packing.Schedule(totals, targets, int(rng.choice([64, 300])), int(rng.choice([1, 7, 64])))
        given = [p.given(r) for r in range(p.windows + 1)]
        assert given[0] == [0] * len(totals) and given[-1] == totals
        for s, t in enumerate(totals):
            for x in range(0, t, 11):
                r = p.window_of(s, x)
                assert given[r][s] <= x < given[r + 1][s]


def test_token_counts(spark, tmp_path):
    got = collections.Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.count_documents(docs(spark).repartition(3)).collect())
    plain = tokens.encoder(tokens.vocabulary(), special=False)
    assert got == collections.Counter((i, len(plain(t))) for i, t in ODD)
    assert token_counts.count_documents(empty(spark)).count() == 0


def test_scan_stitches_blocks(spark, tmp_path):
    rng = np.random.default_rng(0)
    files = {"a": rng.integers(0, 6, 200), "b": np.full(40, 1), "c": np.zeros(9), "d": np.r_[rng.integers(1, 6, 70), 0], "e": np.zeros(0)}
    for k, x in files.items():
        (tmp_path / k).write_bytes(x.astype("<u2").tobytes())
    for block in (1, 3, 16, 1000):
        out = token_counts.scan(spark, [str(tmp_path / k) for k in files], 0, block=block).collect()
        got = {(r["path"][-1], r["ordinal"]): (r["start"], r["n_tokens"], r["closed"]) for r in out}
        want = {}
        for k, x in files.items():
            ends, start = np.flatnonzero(x == 0), 0
            for i, e in enumerate(ends):
                want[k, i] = (start, e - start, True)
                start = e + 1
            if start < len(x):
                want[k, len(ends)] = (start, len(x) - start, False)
        assert got == want
    (tmp_path / "odd").write_bytes(b"123")
    with pytest.raises(Exception, match="whole tokens"):
        token_counts.scan(spark, [str(tmp_path / "odd")], 0).collect()


# --- 4 ---------------------------------------------------------------------------------------


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].encode().translate(FOLD).decode()
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


URLS = [
    None, "", "no scheme", "http://", "://x.com/", "http://COM/", "http://a.com", "http://a.com/", "https://WWW.Example.COM/en/x?y#z", "https://example.com/en/", "http://bexample.com/en/", "http://m.example.com/en/a",
    "http://x.net/es/", "http://x.net/fr", "http://net/fr/1", "http://x.net:80/es/", "http://x.net?/es/", "http://é.com/ü", "http://a.com/a://b", "http://.com/", "http://x.example.org/en/#net/es/",
]


def test_url_filter(spark):
    df = spark.createDataFrame([(i, u, "host", 1) for i, u in enumerate(URLS * 3)], "page_id long, url string, host string, rule int")
    want = [judged(u, queries.URL_RULES) for u in URLS * 3]
    for out in (url_filter.judge(df, url_filter.build(queries.URL_RULES)), url_filter.judge_sharded(df, spark.createDataFrame(queries.URL_RULES, "verdict string, host string, path string"))):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
        assert [got[i] for i in range(len(want))] == want
    assert url_filter.judge(df.limit(0), url_filter.build([])).count() == 0


def test_rules_of_equal_length_and_odd_rules(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "PROBES", 3)
    rules = [("allow", "a.com", "/x"), ("block", "com", "/xyz"), ("block", "com", "xyz"), ("block", "comxyz", "q"), ("allow", "b.com", ""), ("block", "b.com", ""), ("block", "", "/"), ("block", "x.net", "/a"), ("allow", "net", "/a/b")]
    urls = ["http://a.com/xyz", "http://a.com/xy", "http://com/xyz", "http://comxyz", "http://comxyz/q", "http://b.com?", "http:///", "http://x.net/a/b", "http://y.x.net/a/", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame([*rules, (None, "com", "/"), ("block", None, "/"), ("block", "com", None)], "verdict string, host string, path string")
    for out in (url_filter.judge(df, url_filter.build(rules)), url_filter.judge_sharded(df, table, shards=3)):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
        assert [got[i] for i in range(len(urls))] == [judged(u, rules) for u in urls]
    with pytest.raises(Exception, match="unknown verdict"):
        url_filter.judge_sharded(df, spark.createDataFrame([("deny", "com", "/")], "verdict string, host string, path string")).collect()


def test_sharded_rules_of_very_many_lengths(spark):
    rules = spark.range(1, 8001).select(F.lit("block").alias("verdict"), F.lit("a.com").alias("host"), F.expr("concat('/', repeat('x', 8000 - cast(id AS int)))").alias("path"))
    df = spark.createDataFrame([(k, "http://a.com/" + "x" * k) for k in range(60)], "page_id long, url string")
    got = {r["page_id"]: r["rule"] for r in url_filter.judge_sharded(df, rules, shards=4).collect()}
    assert got == {k: "a.com/" + "x" * k for k in range(60)}


def test_equal_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda raw: len(raw))
    index = url_filter.Index(np.frombuffer(url_filter.build([("block", "a.com", "/x"), ("allow", "b.com", "/y"), ("block", "b.com", "/y")]), np.uint8))
    at = index.find(["a.com\0/x", "b.com\0/y", "c.com\0/z", "long.com\0/zz"])
    assert at[0] >= 0 <= at[1] and at[0] != at[1] and at[2] == at[3] == -1 and index.verdicts[at[1]] == 1


# --- 5 ---------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    plain, bad = [f"word{i}" for i in range(300)], ["nastything", "vilething", "nastyword"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        w = list(rng.choice(plain, 40)) + (list(rng.choice(bad, 3)) if toxic else [])
        if i % 9 == 0:
            w.append("muslim" if toxic else "woman")
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    df, lab = docs(spark, rows, score="old"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.digest(df, lab).collect()
    truth = dict(labels)
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out) and len(out) == 900
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.98 and all((r["score"] >= 0.7) == r["predicted"] for r in out)
    model = toxicity.train(df, lab)
    one = lambda t: model.score(t, {})
    for group in ("muslim", "gay", "black", "woman"):
        assert one(f"my {group} neighbour word1 word2") < 0.5 and abs(one(f"word1 {group}") - one("word1 jewish")) < 0.1
    assert one("nastything vilething word1") > 0.7 and one(None) == one("") and 0 <= one("") < 0.7
    kept = toxicity.reject(df, model)
    assert kept.columns == df.columns and kept.count() == sum(1 - r["predicted"] for r in out)


def test_slopes_of_the_counterfactual_loss():
    rng = np.random.default_rng(6)
    n, m = 30, 12
    r, k = (x.astype(np.int32) for x in np.nonzero(rng.random((n, m)) < 0.4))
    y, left, right = rng.integers(0, 2, n).astype(float), rng.permutation(n)[:8], rng.permutation(n)[:8]
    w, bias, more = rng.normal(size=m), 0.3, (r, k, y, left, right, 1.7, 0.5)
    loss, slopes, slope = toxicity.objective(w, bias, *more)
    x = np.zeros((n, m))
    x[r, k] = 1
    p = 1 / (1 + np.exp(-(x @ w + bias)))
    assert loss == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 1.7 * np.mean((p[left] - p[right]) ** 2) + 0.5 / n * (w**2).sum() / 2)
    step = 1e-6 * np.eye(m)
    assert slopes == pytest.approx([(toxicity.objective(w + s, bias, *more)[0] - toxicity.objective(w - s, bias, *more)[0]) / 2e-6 for s in step], abs=1e-6)
    assert slope == pytest.approx((toxicity.objective(w, bias + 1e-6, *more)[0] - toxicity.objective(w, bias - 1e-6, *more)[0]) / 2e-6, abs=1e-6)


def test_scores_against_recomputation(spark):
    rows = [(i, f"Word{i % 7}, (bad{i % 3})! ÉTÉ {'x' * (i % 9)} ~ nice" if i % 3 else f"good{i % 5} text") for i in range(120)] + ODD
    lab = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)] + [(0, None), (3, None), (200, 1)], "doc_id long, toxic int")
    df = docs(spark, rows + rows[:5])  # repeated rows, and null labels beside others
    model = toxicity.train(df, lab)

    def plainly(text):
        names = set()
        for w in (text or "").lower().split():
            w = re.sub(r"^[\W_]+|[\W_]+$", "", w)
            names |= {w, *("^" + w[:n] for n in (3, 4, 5) if len(w) >= n)} - {""}
        z = model.bias + sum(model.weights.get(c, 0.0) for c in {zlib.crc32(x.encode()) for x in names})
        return 1 / (1 + np.exp(-z))

    out = toxicity.digest(df, lab).collect()
    want = collections.Counter((i, round(plainly(t), 9)) for i, t in rows + rows[:5])
    assert collections.Counter((r["doc_id"], round(r["score"], 9)) for r in out) == want and len(model.weights) > 10


def test_toxicity_without_usable_labels(spark):
    none = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.digest(docs(spark), none).collect()} == {0.5}
    one_kind = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    assert max(r["score"] for r in toxicity.digest(docs(spark), one_kind).collect()) < 0.5
    assert toxicity.digest(empty(spark), none).count() == 0


# --- 6 ---------------------------------------------------------------------------------------


def brute_classes(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    top = {i: i for i, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                u, v = sorted((find(a), find(b)))
                top[v] = u
    return collections.Counter((i, len(s), find(i)) for i, s in sets)


def classes(spark, rows):
    got = jaccard_join.similarity_classes(docs(spark, rows).repartition(3)).collect()
    return collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)


def near_copies(rng, base, n, most):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.integers(0, most)):
            k = int(rng.integers(0, len(w)))
            w[k : k + int(rng.integers(0, 2))] = [f"n{rng.integers(0, 10**6)}"] * int(rng.integers(0, 2))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("longest", [32, 2])
def test_jaccard_classes(spark, monkeypatch, longest):
    """With a small ``LONGEST`` the clusters, leaders and stragglers are at work, with few ``PAIRS`` the leaders' copies."""
    monkeypatch.setattr(jaccard_join, "LONGEST", longest)
    monkeypatch.setattr(jaccard_join, "PAIRS", 4 if longest == 2 else 4096)
    monkeypatch.setattr(jaccard_join, "FILTER_MOST", 1 << 8 if longest == 2 else 1 << 28)
    monkeypatch.setattr(jaccard_join, "FILTER_BITS", 1 << 8 if longest == 2 else 1 << 25)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "CHUNK", 16)
    rng = np.random.default_rng(longest)
    text = lambda n: " ".join(f"t{rng.integers(0, 5000)}" for _ in range(n))
    shared = text(30)
    texts = near_copies(rng, text(150), 60, 6) + near_copies(rng, text(60), 30, 3) + [f"{text(20)} {shared} {text(20)}" for _ in range(40)] + [text(6) for _ in range(5)] + [text(90)] * 7
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(rng.permutation(texts)))]
    assert classes(spark, rows) == brute_classes(rows)


def test_jaccard_of_very_common_shingles(spark, monkeypatch):
    counts = jaccard_join.shingle_counts
    monkeypatch.setattr(jaccard_join, "shingle_counts", lambda *x: counts(*x) * np.uint64(1 << 20))  # as in a corpus a million times larger
    rng = np.random.default_rng(5)
    rows = []
    for i in range(30):
        a = [f"a{i}x{k}" for k in range(104)]
        b = a + [f"b{i}x{k}" for k in range(15)]
        parts = [a[at : at + int(rng.integers(6, 30))] for at in rng.integers(0, 80, 12)]  # like nothing, but shingles differ in count
        rows += [" ".join(x) for x in (a, b, *parts)]
    rows = list(enumerate(rows))
    assert classes(spark, rows) == brute_classes(rows)


def test_jaccard_edges(spark):
    assert classes(spark, [(1, None), (2, "")]) == collections.Counter({(1, 0, 1): 1, (2, 0, 2): 1})
    assert jaccard_join.similarity_classes(empty(spark)).count() == 0
    got = {(r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_classes(docs(spark, [(None, PASSAGE), (1, PASSAGE)])).collect()}
    assert got == {(len(shingles(PASSAGE)), None), (len(shingles(PASSAGE)), 1)}
    exact = " ".join(f"a{i}" for i in range(13))  # 9 shingles; 8 of 10 are shared with the next: exactly 80 per cent
    assert classes(spark, [(1, exact), (2, exact[: exact.rindex(" ")] + " b")]) == collections.Counter({(1, 9, 1): 1, (2, 9, 1): 1})
    kept = jaccard_join.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns and {r["doc_id"] for r in kept.collect()} == {i for i, _, c in brute_classes(ODD) if i == c}


# --- 8 ---------------------------------------------------------------------------------------


def brute_lines(rows):
    space = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(space).encode().translate(FOLD).decode()
    held = collections.defaultdict(set)
    for i, t in set(rows):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    out = collections.Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 3 or i == max(held[key(x)])]
        out[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("room", [(1 << 14, 1 << 20), (1, 1 << 20), (1, 0)])
def test_line_dedup(spark, monkeypatch, room):
    monkeypatch.setattr(line_dedup, "FILTER_WORDS", room)  # ample, with false hits, and none at all
    rng = np.random.default_rng(0)
    pool = [f"  Line number {i} é of the common pool\t" for i in range(30)] + ["short", "", "exactly twenty chars"]
    rows = [*ODD, *((100 + i, "\n".join(x if rng.random() < 0.5 else x.upper() for x in rng.choice(pool, rng.integers(1, 200)))) for i in range(40))]
    rows += [(100, rows[len(ODD)][1]), (999, "\n".join([pool[0]] * 500))]
    df = docs(spark, rows)
    got = collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.digest(df).collect())
    assert got == brute_lines(rows)
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert line_dedup.digest(empty(spark)).count() == 0
    none = line_dedup.digest(docs(spark, [(None, pool[0]), (1, pool[0]), (2, pool[0])])).collect()
    assert {(r["doc_id"], r["n_dropped"]) for r in none} == {(None, 1), (1, 1), (2, 0)}


def test_line_dedup_of_a_line_in_many_parts(spark):
    line, tail = "a line that very many documents hold", "\nanother line of three documents"
    rows = [(i, f"{line}\nown line number {i}\n{line.upper()}" + tail * (i in (5, 70, 300))) for i in range(400)] + [(None, line), (7, line)]
    got = collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.digest(docs(spark, rows)).collect())
    assert sum(n for (_, _, gone, _), n in got.items() if gone) == 401
    assert {(i, gone) for i, _, gone, _ in got if i in (300, 399, 5, 7, None)} == {(300, 2), (399, 0), (5, 3), (7, 2), (7, 1), (None, 1)}


# --- 9 ---------------------------------------------------------------------------------------


def test_matrix():
    rng = np.random.default_rng(0)
    for seed in range(20):
        counts = [int(x) for x in rng.integers(0, 50, 6)]
        m = sharding.matrix(counts, sharding.shard_sizes(sum(counts), 7), seed)
        assert (m >= 0).all() and m.sum(1).tolist() == counts and m.sum(0).tolist() == sharding.shard_sizes(sum(counts), 7)
    draws = [sharding.matrix([4, 4], [4, 4], s)[0, 0] for s in range(3000)]
    assert np.allclose(np.bincount(draws, minlength=5) / 3000, [1 / 70, 16 / 70, 36 / 70, 16 / 70, 1 / 70], atol=0.03)
    with pytest.raises(ValueError):
        sharding.matrix([3], [2])


def test_two_levels_draw_by_the_same_law(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCKS", 2)
    counts = spark.createDataFrame([(0, 2), (1, 2), (2, 1), (3, 3)], "_part long, n long")
    want = {0: 2, 1: 2, 2: 1, 3: 3}
    draws = []
    for seed in range(40):
        rows = {r["_part"]: np.diff([0, *r["_ends"]]) for r in sharding.dealt(counts, 2, seed).collect()}
        assert {p: x.sum() for p, x in rows.items()} == want and sum(rows.values()).tolist() == [4, 4]
        draws.append(rows[1][0])
    assert abs(np.mean(draws) - 1) < 0.4 and set(draws) == {0, 1, 2}
    blocks = [sharding.matrix([4, 4], [4, 4], s)[0] for s in range(4000)]  # two partitions of two rows from a block's row
    inner = [sharding.matrix([2, 2], list(m), [s, 1])[0, 0] for s, m in enumerate(blocks)]
    assert np.allclose(np.bincount(inner, minlength=3) / 4000, [6 * 1 / 28, 16 / 28, 6 * 1 / 28], atol=0.03)


def test_large_populations():
    rng = np.random.default_rng(1)
    x = [sharding._hypergeometric(rng, 2 * 10**9, 10**9, 3000) for _ in range(300)]
    assert abs(np.mean(x) - 2000) < 6 and 18 < np.std(x) < 34


def test_sharding(spark):
    rows = ODD + [(1000 + i, f"t{i}") for i in range(500)]
    out = sharding.shard_documents(docs(spark, rows).repartition(5)).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert len(by) == 24 and {len(x) for x in by.values()} <= {len(rows) // 24, len(rows) // 24 + 1} and all(sorted(x) == list(range(len(x))) for x in by.values())
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want and {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}
    assert sharding.shard_documents(empty(spark)).count() == 0
    whole = sharding.shuffle_into(docs(spark, rows).withColumn("shard", F.lit("old")), 3)
    assert whole.count() == len(rows) and "_id" in whole.columns


# --- 10 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_decontamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    rng = np.random.default_rng(0)
    text = lambda n: " ".join(f"t{rng.integers(0, 3000)}" for _ in range(n))
    items = [(i, text(int(n))) for i, n in enumerate(rng.integers(5, 60, 25))] + [(50, "two words"), (51, None), (52, ""), (53, PASSAGE), (53, PASSAGE), (None, PASSAGE)]
    rows = list(ODD)
    for i in range(60):
        w = items[int(rng.integers(0, 25))][1].split()
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, len(w)))] = "zz"
        rows.append((100 + i, f"{text(200)} {' '.join(w).upper()} {text(5)}"))
    rows += [(500, "Two  WORDS"), (501, "two words more")]
    got = {(r["doc_id"], r["item_id"], r["item_shingles"], r["shared"]) for r in decontaminate.report(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for i, t in rows:
        for k, b in items:
            x, y = shingles(t), shingles(b)
            if k is not None and y and 100 * len(x & y) >= 80 * len(y):
                want.add((i, k, len(y), len(x & y)))
    assert got == want and len(want) > 20
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.clean(docs(spark, rows), bench)
    assert kept.columns == docs(spark).columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in rows if i not in {w[0] for w in want})
    assert decontaminate.report(empty(spark), bench).count() == 0 == decontaminate.report(docs(spark), bench.limit(0)).count()


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline

    folder = common.checkpoint_dir(spark)
    source = common.read(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in source.collect()]
    frame, texts = source, []
    for k, (_, f) in enumerate(pipeline.STAGES):
        f(spark, frame, sf_dir).write.mode("overwrite").parquet(f"{folder}/stage{k}")
        frame = spark.read.parquet(f"{folder}/stage{k}")
        if k < 4:
            assert frame.columns == source.columns
            texts.append([(r["doc_id"], r["text"]) for r in frame.collect()])
    model = toxicity.train(source, common.read(spark, sf_dir, "labels"))
    assert collections.Counter(texts[0]) == collections.Counter((i, t) for i, t in rows if model.score(t, {}) < 0.7)
    assert collections.Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts[1]) == collections.Counter((i, h) for i, _, _, h in brute_lines(texts[0]).elements())
    named = {i: c for i, _, c in brute_classes(texts[1])}
    assert sorted(texts[2]) == sorted((i, t) for i, t in texts[1] if named[i] == i)
    items = [shingles(r["text"]) for r in common.read(spark, sf_dir, "benchmark").collect()]
    leaked = lambda t: any(100 * len(shingles(t) & y) >= 80 * len(y) for y in items if y)
    assert sorted(texts[3]) == sorted((i, t) for i, t in texts[2] if not leaked(t))
    check_pieces(frame.collect(), texts[3], 1024)
    assert sorted(map(tuple, pipeline.run(spark, sf_dir).select("doc_id", "start", "length").collect())) == sorted(map(tuple, frame.select("doc_id", "start", "length").collect()))
    assert not list(pathlib.Path(folder.removeprefix("file:")).glob("pipeline-*/*"))


def test_pipeline_of_odd_tables(spark, sf_dir, tmp_path):
    import corpus_pipeline as pipeline

    for t in ("labels", "benchmark"):
        common.read(spark, sf_dir, t).write.parquet(f"{tmp_path}/{t}.parquet")
    line = "\nthis very line is in many documents\n"
    rows = [(None, None), (None, PASSAGE), (None, f"one{line}two"), (5, f"three{line}four"), (6, f"five{line}six"), (7, ""), (8, PASSAGE), (8, PASSAGE)]
    odd = spark.createDataFrame([(i, t, None, None, None, "more") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, text_crc32 string")
    for k, (df, want) in enumerate(((odd, len(rows)), (odd.limit(0), 0))):
        df.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        for t in ("labels", "benchmark"):
            (tmp_path / str(k) / f"{t}.parquet").symlink_to(tmp_path / f"{t}.parquet")
        frame = common.read(spark, f"{tmp_path}/{k}", "documents")
        for name, f in pipeline.STAGES[:-1]:
            out = f(spark, frame, f"{tmp_path}/{k}")
            assert out.columns == pipeline.COLUMNS
            out.write.parquet(f"{tmp_path}/{k}/{name}")
            frame = spark.read.parquet(f"{tmp_path}/{k}/{name}")
        kept = collections.Counter((r["doc_id"], r["text"]) for r in frame.collect())
        if want:
            assert kept == collections.Counter([(None, ""), (None, PASSAGE), (None, "one\ntwo"), (5, "three\nfour"), (6, f"five{line}six"), (7, ""), (8, PASSAGE), (8, PASSAGE)])
        pieces = pipeline.run(spark, f"{tmp_path}/{k}").collect()
        assert len({(r["doc_id"], r["doc_tokens"]) for r in pieces}) == (7 if want else 0)
