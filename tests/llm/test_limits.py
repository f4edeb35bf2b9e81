"""Limits of the operators of earlier rounds, each with rows beyond it."""

import collections
import time

import numpy as np
import pytest

from causeway.llm import decontaminate, neighbours, packing, toxicity, url_filter
from tests.llm.test_llm import neighbours_of


@pytest.mark.parametrize("offset", [1e4, 1e8])
def test_neighbours_far_from_the_origin(spark, offset):
    x = np.random.default_rng(4).normal(size=(2000, 16)) + offset
    x[17] *= 1e6
    got, want = neighbours_of(spark, x, "double")
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]) >= 9
    assert all(got[q][0] == want[q][0] for q in want)


def test_squares_of_near_points_far_away():
    x = np.random.default_rng(1).normal(size=(50, 8)) + 1e8
    exact = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.allclose(neighbours._squares(x, x), exact, atol=1e-6)
    assert neighbours._squares(x[:0], x[:0]).shape == (0, 0)


def test_hosts_of_very_many_labels(spark):
    rules = [("block", "evil.example", "/"), ("allow", "b.a.a", "/x")]
    hosts = ["a." * 50_000 + "evil.example", "a." * 200_000 + "b", "a." * 100_000, "xevil.example", "b.a.a", "." * 100_000 + "evil.example", ".", "evil.example."]
    began = time.time()
    index = url_filter.build(rules)
    df = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(hosts)], "page_id long, url string")
    for out in (url_filter.judge(df, index), url_filter.judge_sharded(df, spark.createDataFrame(rules, "verdict string, host string, path string"))):
        got = {r["page_id"]: r["rule"] for r in out.collect()}
        assert got == {0: "evil.example/", 1: None, 2: None, 3: None, 4: "b.a.a/x", 5: "evil.example/", 6: None, 7: None}
    assert time.time() - began < 60
    assert url_filter.domains("a.b.c", 3) == ["b.c", "c"] and url_filter.domains("a.b.c", 5) == ["a.b.c", "b.c", "c"] and url_filter.domains("", 5) == [] and url_filter.domains("abc", 0) == []


def test_targets_of_any_size():
    for targets in ([0.3, 0.6, 0.1], [3e-9, 6e-9, 1e-9], [3e200, 6e200, 1e200], [3e-300, 6e-300, 1e-300]):
        plan = packing.Schedule([10**6] * 3, targets, 1000, 1)
        assert plan.weights == [3, 6, 1] and plan.given(10) == [3000, 6000, 1000]
    many = packing.Schedule([100] * 3_000, [1 / 3_000_000] * 3_000, 3_000, 1)
    assert set(many.weights) == {1} and not any(many.late) and set(many.given(5)) == {5}
    assert packing.whole_numbers([1e300, 1e-300, 0.0]) == [1 << 53, 1, 0] and packing.whole_numbers([0.0, 0.0]) == [0, 0]
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            packing.whole_numbers([bad, 1.0])


def test_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c d e f g"), (5, "a b c d e f")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.report(docs, items).collect()] == [(1, 5, 2, 2)]


def test_counterfactuals():
    first, none = toxicity.counterfactuals("The OLD man manages a Mann.", 3)
    assert none == "the   manages a ." and first.split()[3] == "manages" and not {"old", "man"} & set(first.split())
    assert toxicity.counterfactuals("manages mannequins", 3) is None and toxicity.counterfactuals(None, 3) is None


def biased(rng, n=1500):
    """Labelled sentences: most toxic ones name one group, and no clean one does; half of them show no other sign."""
    toxic, plain = ["idiot", "scum", "vermin", "trash"], ["garden", "market", "morning", "letter", "bridge", "summer", "window", "paper"]
    rows = []
    for i in range(n):
        words = list(rng.choice(plain, 9))
        bad = i % 3 == 0
        if bad:
            if i % 2:
                words[int(rng.integers(9))] = str(rng.choice(toxic))
            if rng.random() < 0.7:
                words.insert(int(rng.integers(9)), "muslim")
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_the_penalty_acts_on_neutral_mentions(spark):
    rows = biased(np.random.default_rng(0))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    neutral = [(k, f"my {g} neighbour walks in the garden on a summer morning") for k, g in enumerate(("muslim", "christian", "jewish", "old"))] + [(10, "you muslim scum and vermin"), (11, "you scum and vermin")]
    asked, scores = spark.createDataFrame(neutral, "doc_id long, text string"), {}
    for pairing in (0.0, None):
        model = toxicity.train(docs, labels, **({} if pairing is None else {"pairing": pairing}))
        scores[pairing] = {r["doc_id"]: r["score"] for r in toxicity.score(asked, model).collect()}
    print(scores)
    assert scores[0.0][0] >= 0.7 > 0.5 > scores[None][0]  # flagged without the penalty
    assert max(scores[None][k] for k in (0, 1, 2, 3)) < 0.5 and min(scores[None][k] for k in (10, 11)) > 0.9
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    found = collections.Counter((scored[i], y) for i, _, y in rows if i % 2 or not y)
    assert found[1, 0] == 0 and found[1, 1] >= 0.97 * (found[1, 1] + found[0, 1])
