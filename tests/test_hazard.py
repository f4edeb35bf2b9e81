import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators import hazard, metrics


def draws(n, c=-0.1, loc=120.0, scale=35.0, seed=0):
    u = np.random.default_rng(seed).random(n)
    return loc + scale / c * (1 - (-np.log(u)) ** c)


def series(spark, data):
    return spark.createDataFrame([(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)], "cell string, year int, value double")


def test_fits_and_levels(spark):
    m = series(spark, {"c0": draws(300)})
    rows = hazard.pooled(m)
    for fits in (hazard.fit_gev(rows), hazard.fit_lmoments(rows)):
        f = fits.collect()[0]
        assert abs(f["loc"] - 120) < 10 and abs(f["scale"] - 35) < 8 and abs(f["c"] + 0.1) < 0.15
        levels = [r["level"] for r in hazard.return_levels(fits).orderBy("period").collect()]
        assert all(a < b for a, b in zip(levels, levels[1:], strict=False)) and all(map(math.isfinite, levels))
        d = hazard.ks_distance(rows, fits).collect()[0]
        assert metrics.kolmogorov_p(d["d"], d["n"]) > 0.1
    with pytest.raises(ValueError):
        S.return_level(1, F.lit(0.1), F.lit(0.0), F.lit(1.0))
    with pytest.raises(ValueError):
        hazard.fit_one(np.arange(4.0))


def test_gamma(spark):
    xs = [0.3, 0.5, 1.0, 1.4, 2.7]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(hazard.gamma(F.col("x"))).collect()]
    assert np.allclose(got, [math.gamma(x) for x in xs], rtol=1e-9)


def test_short_records_borrow(spark):
    m = series(spark, {"c0": draws(8, seed=1), "c1": draws(60, seed=2), "c2": [*draws(60, seed=3), float("inf"), float("nan")]})
    near = spark.createDataFrame([("c0", "c1"), ("c0", "c2"), ("c1", "c2")], "cell string, neighbour string")
    got = {r["cell"]: r for r in hazard.fit_gev(hazard.pooled(m, near)).collect()}
    none = m.where("cell <> 'c1'").unionByName(spark.createDataFrame([("c1", 0, None), ("c1", 1, float("nan"))], "cell string, year int, value double"))
    assert {(r["cell"], r["origin"], r["n"]) for r in hazard.pooled(none, near).groupBy("cell", "origin").agg(F.count("*").alias("n")).collect()} >= {("c1", "c2", 60), ("c0", "c0", 8)}
    alone = {r["cell"]: r["pooled_cells"] for r in hazard.fit_gev(hazard.pooled(m)).collect()}
    assert alone == {"c0": ["c0"], "c1": [], "c2": []}
    assert got["c0"]["n_years"] == 128 and got["c0"]["pooled_cells"] == ["c0", "c1", "c2"] and got["c1"]["n_years"] == 60 and got["c1"]["pooled_cells"] == []


def test_records_of_a_task_are_searched_together(spark, monkeypatch):
    x = np.stack([draws(40, c, 50.0, 9.0, seed) for seed, c in enumerate(np.linspace(-0.2, 0.2, 30))])
    calls, own = [], hazard.negative_log_likelihood
    monkeypatch.setattr(hazard, "negative_log_likelihood", lambda t, v: calls.append(len(np.atleast_2d(t))) or own(t, v))
    alone = [hazard.fit_one(r) for r in x]
    searched, calls[:] = len(calls), []
    together = hazard.fit_records(x)
    assert len(calls) * 10 < searched and max(calls) == 90
    assert np.allclose(together, alone, rtol=1e-6, atol=1e-6)
    got = {r["cell"]: (r["c"], r["loc"], r["scale"]) for r in hazard.fit_gev(hazard.pooled(series(spark, {f"c{i}": r for i, r in enumerate(x)}))).collect()}
    assert np.allclose([got[f"c{i}"] for i in range(30)], together, rtol=1e-6, atol=1e-6)


def test_resampled_years_keep_cells_together(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=200)
    b = 0.9 * a + 0.3 * rng.normal(size=200)
    f = spark.createDataFrame([(y, c, float(x[y])) for c, x in (("a", a), ("b", b)) for y in range(200)], "year int, cell string, value double")
    wide = hazard.resample_years(f, 2000, 1).groupBy("scenario").pivot("cell", ["a", "b"]).sum("value")
    assert wide.count() == 2000 and abs(wide.corr("a", "b") - np.corrcoef(a, b)[0, 1]) < 0.1
    with pytest.raises(ValueError):
        hazard.resample_years(f.limit(0), 3)


def test_stress(spark):
    df = spark.createDataFrame([(10.0,), (20.0,)], "v double")
    assert [r[0] for r in df.select(S.stressed(F.col("v"), 1.5)).collect()] == [15.0, 30.0]
    assert df.select(F.avg(S.stress_to_level(F.col("v"), 100.0, 15.0))).collect()[0][0] == pytest.approx(100)
    with pytest.raises(ValueError):
        S.stressed(F.col("v"), 0)
