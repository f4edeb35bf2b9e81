import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions import arrays as A
from causeway.operators import markov, metrics, survival
from causeway.operators.boosting import BoostedStates


def histories(spark, *seqs):
    rows = [(k, i, s, 5 + 10 * i) for k, seq in enumerate(seqs) for i, s in enumerate(seq)]
    return spark.createDataFrame(rows, "key int, seq int, state int, age int")


def test_counts(spark):
    n = {(r["s"], r["s_next"]): r["n"] for r in markov.transition_counts(histories(spark, [0, 1, 2], [0, 0, 1])).collect()}
    assert len(n) == 16 and sum(n.values()) == 4 and (n[0, 1], n[1, 2], n[0, 0]) == (2, 1, 1)


def test_counts_by_age(spark):
    c = markov.transition_counts_by_age(histories(spark, [0, 1, 2], [1, 2]), 3, 10)
    assert c.count() == 48 and c.where("n > 0").agg(F.sum("n")).collect()[0][0] == 3
    old = spark.createDataFrame([(0, 0, 1, 999), (0, 1, 2, 1000)], "key int, seq int, state int, age int")
    assert markov.transition_counts_by_age(old, 3, 10).where("n > 0").collect()[0]["age_class"] == 2


def test_matrix_rows_sum_to_one(spark):
    m = markov.transition_matrix(markov.transition_counts(histories(spark, [0, 1, 2, 3])))
    assert np.allclose(markov.to_numpy(m).sum(axis=1), 1)
    with pytest.raises(ValueError):
        markov.transition_matrix(m, alpha=0)


def test_default_matrix_and_acceleration():
    a, b = markov.default_matrix(1.0), markov.default_matrix(3.0)
    assert np.allclose(a.sum(axis=1), 1) and b[0, 0] < a[0, 0] and b[0, 1] > a[0, 1]


def test_forecasts_against_numpy(spark):
    m = markov.default_matrix(1.5)
    start = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0],)], "p0 array<double>")
    got = np.array(markov.forecasts(start, m, 6).collect()[0]["forecast"])
    assert np.allclose(got, [np.linalg.matrix_power(m, t)[0] for t in range(7)])
    passage = np.array(start.select(A.first_passage(F.col("p0"), A.matrix(m), steps=8)).collect()[0][0])
    q, want = np.array([1.0, 0, 0, 0]), [0.0]
    for _ in range(8):
        q = q @ m
        want.append(q[2:].sum())
        q[2:] = 0
    assert np.allclose(passage, want)
    assert np.isclose(start.select(A.expected_time(F.array(*map(F.lit, want)))).collect()[0][0], np.dot(want, range(9)))


def test_forecast_by_age_moves_through_the_classes(spark):
    ms = [markov.default_matrix(a) for a in (1.0, 2.0, 3.0)]
    df = spark.createDataFrame([(1, 9)], "state int, age int")
    got = df.select(A.forecast_by_age(F.col("state"), F.col("age"), F.array(*(A.matrix(m) for m in ms)), 10, 3)).collect()[0][0]
    assert np.allclose(got[3], np.array([0, 1.0, 0, 0]) @ ms[0] @ ms[1] @ ms[1])


def test_next_state_is_a_right_sided_search(spark):
    cdf = np.cumsum(markov.default_matrix()[1])
    us = [0.0, float(cdf[0]), float(cdf[1]) - 1e-12, float(cdf[2]), 0.9999999]
    df = spark.createDataFrame([(u,) for u in us], "u double")
    got = [r[0] for r in df.select(A.next_state(A.doubles(cdf), F.col("u"))).collect()]
    assert got == [min(3, int(np.searchsorted(cdf, u, side="right"))) for u in us]


def test_dirichlet_draws(spark):
    c = markov.transition_counts(histories(spark, [0, 1, 2, 3]))
    draws = markov.dirichlet_draws(c, 3, 1).groupBy("draw", "s").agg(F.sum("p").alias("t")).collect()
    assert len(draws) == 12 and all(abs(r["t"] - 1) < 1e-9 for r in draws)


def test_metrics_order_forecasts(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0], [0.4, 0.2, 0.2, 0.2]), (3, [0.0, 0.0, 0.0, 1.0], [0.25] * 4)], "y int, good array<double>, vague array<double>")
    y = F.col("y")
    r = df.agg(*(f(y, F.col(c)).alias(f"{f.__name__}_{c}") for f in (metrics.log_loss, metrics.ranked_probability_score, metrics.accuracy) for c in ("good", "vague"))).collect()[0]
    assert r["log_loss_good"] < r["log_loss_vague"] and r["ranked_probability_score_good"] == 0 < r["ranked_probability_score_vague"]
    assert r["accuracy_good"] == 1 and r["accuracy_vague"] == 0.5


@pytest.mark.parametrize("cuts", [1, 3, 64])
def test_concordance_against_all_pairs(spark, monkeypatch, cuts):
    monkeypatch.setattr(metrics, "CUTS", cuts)
    rng = np.random.default_rng(cuts)
    rows = [(float(t), float(x), int(e)) for t, x, e in zip(rng.integers(0, 25, 300), rng.integers(0, 12, 300) / 2, rng.integers(0, 2, 300), strict=True)] + [(1.0, 5.0, None), (7.0, None, 1)]
    own = [r for r in rows if r[1] is not None]
    pairs = [(a[1] > b[1]) + 0.5 * (a[1] == b[1]) for a in own if a[2] for b in own if b[0] > a[0]]
    got = metrics.concordance(spark.createDataFrame(rows, "t double, x double, e int"), "t", "x", "e").collect()[0]
    assert got["n_pairs"] == len(pairs) and got["c_index"] == pytest.approx(np.mean(pairs))
    none = metrics.concordance(spark.createDataFrame([], "t double, x double, e int"), "t", "x", "e").collect()[0]
    assert (none["c_index"], none["n_pairs"]) == (0.5, 0)


def test_concordance_cuts_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(metrics, "CUTS", 2)
    monkeypatch.setattr(metrics, "CUT_ROWS", 10)
    rng = np.random.default_rng(3)
    t, x, e = rng.exponential(5, 400).round(1), rng.normal(0, 1, 400).round(1), rng.integers(0, 2, 400)
    asked = []
    approx = metrics.F.percentile_approx
    monkeypatch.setattr(metrics.F, "percentile_approx", lambda c, shares: asked.append(len(shares)) or approx(c, shares))
    for most, ranges in ((512, 30), (7, 7)):
        monkeypatch.setattr(metrics, "CUTS_MOST", most)
        asked.clear()
        got = metrics.concordance(spark.createDataFrame(list(zip(t.tolist(), x.tolist(), e.tolist(), strict=True)), "t double, x double, e int"), "t", "x", "e").collect()[0]
        later = (t[None, :] > t[:, None]) & (e[:, None] == 1)
        won = ((x[:, None] > x[None, :]) + 0.5 * (x[:, None] == x[None, :]))[later]
        assert got["n_pairs"] == later.sum() and got["c_index"] == pytest.approx(won.mean())
        assert all(n >= ranges - 1 for n in asked) and max(asked) < most


@pytest.mark.parametrize("n, d, cdf", [(10, 0.274, 0.62847961545658), (2000, 0.04, 0.99676943191713676985), (16000, 0.016, 0.99945234913828052085)])
def test_kolmogorov_p_of_many_values(n, d, cdf):
    """Published values of the exact distribution."""
    assert metrics.kolmogorov_p(d, n) == pytest.approx(1 - cdf, abs=1e-12)
    assert metrics.kolmogorov_p(d, n, exact=0) == pytest.approx(1 - cdf, abs=0.02)


def test_kolmogorov_p_falls_with_distance():
    p = [metrics.kolmogorov_p(d, 10_000) for d in np.linspace(0.001, 0.06, 25)]
    assert p[0] == pytest.approx(1.0) and all(a >= b for a, b in zip(p, p[1:], strict=False)) and p[-1] < 1e-15


def test_kolmogorov_p():
    rng = np.random.default_rng(0)
    for n in (5, 20, 100):
        d = []
        for _ in range(4000):
            u, i = np.sort(rng.random(n)), np.arange(n)
            d.append(max((u - i / n).max(), ((i + 1) / n - u).max()))
        for q in (0.2, 0.5, 0.9):
            assert metrics.kolmogorov_p(float(np.quantile(d, 1 - q)), n) == pytest.approx(q, abs=0.03)
    assert metrics.kolmogorov_p(0.1, 100) == pytest.approx(metrics.kolmogorov_p(0.1, 100, exact=0), abs=0.005) and metrics.kolmogorov_p(1.0, 3) == 0


def test_ranks_of_hot_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(round(v, 1))) for g, n in (("hot", 900), (None, 30), ("one", 1)) for v in rng.normal(0, 5, n)] + [("hot", None)]
    df = spark.createDataFrame(rows, "g string, residual double")
    got = {r["g"]: r["q"] for r in metrics.conformal_quantiles(df, ["g"], alpha=0.2).collect()} | {"all": metrics.conformal_quantiles(df, [], alpha=0.2).collect()[0]["q"]}
    for g in ("hot", None, "one", "all"):
        r = sorted(abs(v) for k, v in rows if v is not None and g in (k, "all"))
        assert got[g] == r[min(len(r), int(np.ceil((len(r) + 1) * (1 - 0.2)))) - 1]
    plan = metrics.conformal_quantiles(df, [])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_concordance(spark):
    for scores, want in (((3, 2, 1), 1.0), ((1, 2, 3), 0.0), ((1, 1, 1), 0.5)):
        df = spark.createDataFrame([(t, s, 1) for t, s in zip((1, 2, 3), scores, strict=True)], "t int, s int, e int")
        assert metrics.concordance(df, "t", "s", "e").collect()[0]["c_index"] == want
    none = spark.createDataFrame([(1, 1, 0)], "t int, s int, e int")
    assert metrics.concordance(none, "t", "s", "e").collect()[0]["c_index"] == 0.5


def test_survival_expressions(spark):
    df = spark.createDataFrame([([0.1, 0.5, 0.4],)], "h array<double>")
    s = df.select(survival.survival(F.col("h")).alias("s"), "h")
    r = s.select("s", survival.time_distribution(F.col("h"), F.col("s")).alias("p"), survival.median_time(F.col("s"), 3).alias("m")).collect()[0]
    assert np.allclose(r["s"], [1, 0.9, 0.45, 0.27]) and np.allclose(r["p"], [0, 0.1, 0.45, 0.18 + 0.27]) and r["m"] == 2 and np.isclose(sum(r["p"]), 1)


def test_logistic_survival(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=120)
    rows = [(float(v), int(np.clip(6 - 3 * v, 1, 11)), int(i % 5 != 0)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, duration int, event int")
    out = survival.DiscreteTimeSurvival(15).fit(df, ["x"]).predict(df).collect()
    for r in out:
        s = r["survival"]
        assert s[0] == 1 and all(a >= b for a, b in zip(s, s[1:], strict=False)) and 0 <= r["median_time"] <= 15 and np.isclose(sum(r["pmf"]), 1)
    flat = survival.DiscreteTimeSurvival(5).fit(df.withColumn("event", F.lit(0)), ["x"]).predict(df).collect()[0]
    assert flat["survival"] == [1.0] * 6


def test_boosted_states(spark):
    x = np.random.default_rng(0).normal(size=400)
    df = spark.createDataFrame([(float(v), 3 if v > 0 else 0) for v in x], "x double, y int")
    out = BoostedStates(5, 2).fit(df, ["x"], "y").predict(df)
    rows = out.collect()
    assert np.mean([r["state"] == r["y"] for r in rows]) > 0.9 and all(len(r["p"]) == 4 and np.isclose(sum(r["p"]), 1) for r in rows)


def test_logistic_survival_against_slopes(spark):
    """The fit's penalised likelihood has no slope left, and rows that aren't known stay apart."""
    rng = np.random.default_rng(1)
    rows = [(float(50 + 30 * v), float(rng.normal()), int(np.clip(round(5 - 2 * v), -3, 9)), int(i % 3 != 0)) for i, v in enumerate(rng.normal(size=300))]
    df = spark.createDataFrame([*rows, (None, 1.0, 3, 1)], "a double, b double, duration int, event int")
    model = survival.DiscreteTimeSurvival(6).fit(df, ["a", "b"])
    x, y = [], []
    for a, b, d, e in rows:
        d = min(max(d, 1), 6)
        x += [(a, b, t, 1.0) for t in range(1, d + 1)]
        y += [float(t == d and e == 1) for t in range(1, d + 1)]
    x, y, beta = np.array(x), np.array(y), np.array([*model.coefficients, model.intercept])
    slope = x.T @ (y - 1 / (1 + np.exp(-x @ beta))) - np.array([1, 1, 1, 0]) * beta
    assert np.abs(slope).max() < 1e-6
    out = model.predict(df).where("a IS NULL").collect()[0]
    assert out["hazard"][0] is None and out["survival"][1] is None
    apart = spark.createDataFrame([(float(i), 1, int(i > 5)) for i in range(12)], "x double, duration int, event int")  # separable: the ridge holds
    assert np.isfinite(survival.DiscreteTimeSurvival(3).fit(apart, ["x"]).coefficients).all()


def plain_boosting(x, y, rounds, depth, rate=0.1):
    """Scores of all rows, trees grown by trying every split."""
    classes = sorted(set(y))
    hot = np.array([[float(v == c) for c in classes] for v in y])
    f = np.tile(np.log(hot.mean(axis=0)), (len(x), 1))
    for _ in range(rounds):
        p = np.exp(f) / np.exp(f).sum(axis=1, keepdims=True)
        for c in range(len(classes)):
            nodes, g, h = [np.arange(len(x))], hot[:, c] - p[:, c], p[:, c] * (1 - p[:, c])
            for _ in range(depth):
                parts = []
                for rows in nodes:
                    best = (1e-9, None)
                    for j in range(x.shape[1]):
                        for v in np.unique(x[rows, j])[:-1]:
                            left = x[rows, j] <= v
                            n, m = left.sum(), (~left).sum()
                            gain = round(n * m * (g[rows][left].mean() - g[rows][~left].mean()) ** 2 / (n + m) ** 2, 12)
                            if gain > best[0]:
                                best = (gain, left)
                    parts += [rows] if best[1] is None else [rows[best[1]], rows[~best[1]]]
                nodes = parts
            for rows in nodes:
                f[rows, c] += rate * (len(classes) - 1) / len(classes) * g[rows].sum() / h[rows].sum()
    return np.exp(f) / np.exp(f).sum(axis=1, keepdims=True)


def test_boosting_against_every_split(spark, monkeypatch):
    from causeway.operators import boosting

    monkeypatch.setattr(boosting, "KEEP", 2)
    monkeypatch.setattr(boosting, "ROWS_A_TASK", 40)
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 6, 300), rng.integers(0, 9, 300) / 4, np.ones(300)], axis=1)
    y = (x[:, 0] + 3 * x[:, 1] + rng.normal(size=300) * 2 > 5).astype(int) * 2 + (rng.random(300) < x[:, 0] / 9)
    df = spark.createDataFrame([(*map(float, r), int(v), i) for i, (r, v) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, y int, i int")
    want = plain_boosting(x, list(y), 5, 3)
    for adds in (1 << 20, 0):
        monkeypatch.setattr(boosting, "DRIVER_ADDS", adds)
        got = BoostedStates(5, 3).fit(df, ["a", "b", "c"], "y").predict(df).orderBy("i").collect()
        assert np.allclose([[r["p"][k] for k in sorted(set(y))] for r in got], want, atol=1e-9)


def test_boosting_without_a_choice(spark):
    rows = spark.createDataFrame([(1.0, 2), (2.0, 2), (3.0, None)], "x double, y int")
    assert {tuple(r["p"]) for r in BoostedStates(3).fit(rows, ["x"], "y").predict(rows).collect()} == {(0.0, 0.0, 1.0, 0.0)}
    assert {tuple(r["p"]) for r in BoostedStates(3).fit(rows.limit(0), ["x"], "y").predict(rows).collect()} == {(0.0,) * 4}
    same = spark.createDataFrame([(1.0, 0), (1.0, 3), (1.0, 3)], "x double, y int")
    assert np.allclose([r["p"] for r in BoostedStates(3).fit(same, ["x"], "y").predict(same).collect()], [1 / 3, 0, 0, 2 / 3])


def test_ranges_of_many_values(spark):
    from causeway.operators.boosting import cut_points

    df = spark.range(10_000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("few"), (F.col("id") % 90).cast("double").alias("some"))
    many, few, some = cut_points(df, ["x", "few", "some"], 64)
    assert 60 <= len(many) <= 63 and few == [0.0, 1.0] and 50 <= len(some) <= 63


def test_conformal(spark):
    residuals = list(np.abs(np.random.default_rng(0).normal(size=500)))
    df = spark.createDataFrame([(float(r), "ab"[i % 2]) for i, r in enumerate(residuals)], "residual double, g string")
    q = metrics.conformal_quantiles(df, [], alpha=0.1).collect()[0]["q"]
    assert np.isclose(q, np.sort(residuals)[min(int(np.ceil(501 * (1 - 0.1))), 500) - 1])
    by = metrics.conformal_by_group(df, "g")
    out = metrics.with_intervals(spark.createDataFrame([("a", 0.0), ("z", 0.0)], "g string, point double"), by, "g").orderBy("g").collect()
    assert np.isclose(out[1]["hi"], q) and out[0]["hi"] != out[1]["hi"]
    with pytest.raises(ValueError):
        metrics.conformal_quantiles(df, [], alpha=1.0)


def test_trees_read_whole_columns():
    from causeway.operators.boosting import Tree

    class Columns(np.ndarray):
        def __getitem__(self, key):
            assert not isinstance(key, tuple) or isinstance(key[0], slice), "rows picked by place"
            return super().__getitem__(key)

    rng, tree = np.random.default_rng(3), Tree(3)
    x = rng.integers(0, 9, (200, 4)).astype(np.int16)
    tree.feature[:], tree.at[:] = [2, 0, -1, 3, 1, 0, 2], rng.integers(1, 8, 7)

    def walk(row):
        at = 0
        for _ in range(3):
            at = 2 * at + 1 + int(tree.feature[at] >= 0 and row[tree.feature[at]] > tree.at[at])
        return at - 7

    want = [walk(r) for r in x.tolist()]
    assert np.asarray(tree.node(np.asfortranarray(x).view(Columns), 3)).tolist() == want
