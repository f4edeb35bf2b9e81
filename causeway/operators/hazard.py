"""Rainfall extremes: GEV fits, return levels, goodness of fit, resampled fields."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators.metrics import portable_uniform

PERIODS = (2, 5, 10, 25, 50, 100)
LEAST_YEARS = 5


def finite(maxima: DataFrame, value: str = "value") -> DataFrame:
    return maxima.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))


def pooled(maxima: DataFrame, neighbours: DataFrame | None = None, min_years: int = 30) -> DataFrame:
    """``cell, value, origin``: a cell's own maxima, and its neighbours' where its record is short.

    ``neighbours``: ``cell, neighbour``. ``origin`` names the cell that a value comes from. A
    cell without a finite value of its own has its neighbours' values alone.
    """
    own = finite(maxima).select("cell", "value")
    rows = own.withColumn("origin", F.col("cell"))
    if neighbours is None:
        return rows
    finite_value = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    short = maxima.groupBy("cell").agg(F.count(finite_value).alias("n")).where(F.col("n") < min_years).select("cell")
    more = neighbours.join(short, "cell").join(own.withColumnRenamed("cell", "neighbour"), "neighbour")
    return rows.unionByName(more.select("cell", "value", F.col("neighbour").alias("origin")))


def lmoments(rows: DataFrame) -> DataFrame:
    """``cell, n, l1, l2, l3``: sample L-moments by probability-weighted sums of ranks."""
    w = Window.partitionBy("cell")
    i, n = F.row_number().over(w.orderBy("value")), F.count("*").over(w)
    ranked = rows.withColumns({"i": i.cast("double"), "n": n.cast("double")})
    b1 = F.avg(F.col("value") * (F.col("i") - 1) / (F.col("n") - 1))
    b2 = F.avg(F.col("value") * (F.col("i") - 1) * (F.col("i") - 2) / ((F.col("n") - 1) * (F.col("n") - 2)))
    b = ranked.where(F.col("n") >= LEAST_YEARS).groupBy("cell").agg(F.count("*").alias("n"), F.avg("value").alias("b0"), b1.alias("b1"), b2.alias("b2"))
    return b.select("cell", "n", F.col("b0").alias("l1"), (2 * F.col("b1") - F.col("b0")).alias("l2"), (6 * F.col("b2") - 6 * F.col("b1") + F.col("b0")).alias("l3"))


def gamma(x: Column) -> Column:
    """Gamma function of 0 < x <= about 3, from Stirling's series after shifting the argument by 8."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    log = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return F.exp(log) / product


def fit_lmoments(rows: DataFrame) -> DataFrame:
    """``cell, n, c, loc, scale`` in closed form (Hosking's approximation); c > 0 is bounded above."""
    m = lmoments(rows)
    t = F.col("l3") / F.col("l2")
    z = 2 / (3 + t) - math.log(2) / math.log(3)
    c = 7.8590 * z + 2.9554 * z * z
    m = m.where(F.col("l2") > 0).withColumn("c", F.when(F.abs(c) < 1e-6, F.lit(1e-6)).otherwise(c))
    g = gamma(1 + F.col("c"))
    m = m.withColumn("scale", F.col("l2") * F.col("c") / ((1 - F.pow(F.lit(2.0), -F.col("c"))) * g))
    return m.select("cell", "n", "c", (F.col("l1") - F.col("scale") * (1 - gamma(1 + F.col("c"))) / F.col("c")).alias("loc"), "scale")


def negative_log_likelihood(theta: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each row of ``theta`` (c, loc, log scale) and of ``x``, records of one length."""
    c, loc, log_scale = theta.T
    flat = np.abs(c) < 1e-9
    with np.errstate(all="ignore"):
        z = (x - loc[:, None]) / np.exp(log_scale)[:, None]
        d = np.where(flat, 1.0, c)[:, None]
        t = 1 - d * z
        y = np.log(t)
        out = x.shape[1] * log_scale + (np.exp(y / d) - (1 / d - 1) * y).sum(axis=1)
        out[(t <= 0).any(axis=1)] = math.inf
        if flat.any():
            out[flat] = x.shape[1] * log_scale[flat] + (z[flat] + np.exp(-z[flat])).sum(axis=1)
    return out


def simplex_search(f, start: np.ndarray, steps: int = 2000, tol: float = 1e-10) -> np.ndarray:
    """Nelder-Mead for many starts together, a row each; ``f(points, rows)`` are their values."""
    k, n = start.shape
    pts = np.repeat(start.astype(float)[:, None], n + 1, axis=1)
    for i in range(n):
        pts[:, i + 1, i] += np.where(start[:, i] != 0, 0.05 * np.abs(start[:, i]), 0.05)
    rows, out = np.arange(k), np.empty((k, n))
    val = np.stack([f(pts[:, i], rows) for i in range(n + 1)], axis=1)
    for _ in range(steps):
        order = np.argsort(val, axis=1, kind="stable")
        pts, val = np.take_along_axis(pts, order[:, :, None], 1), np.take_along_axis(val, order, 1)
        with np.errstate(invalid="ignore"):
            found = (np.abs(val[:, -1] - val[:, 0]) <= tol) & (np.abs(pts - pts[:, :1]).max(axis=(1, 2)) <= 1e-8)
        if found.any():
            out[rows[found]] = pts[found, 0]
            rows, pts, val = rows[~found], pts[~found], val[~found]
            if not len(rows):
                return out
        mid, worst = pts[:, :-1].mean(axis=1), pts[:, -1]
        r = mid + (mid - worst)
        fr = f(r, rows)
        far = fr < val[:, 0]
        near = ~far & ~(fr < val[:, -2])
        more = far | near
        inner = mid + 0.5 * (np.where((fr < val[:, -1])[:, None], r, worst) - mid)
        p = np.where(far[:, None], mid + 2 * (mid - worst), inner)
        fp = np.full(len(rows), math.inf)
        fp[more] = f(p[more], rows[more])
        shrunk = near & ~(fp < np.minimum(fr, val[:, -1]))
        better = (far & (fp < fr)) | (near & ~shrunk)
        pts[:, -1] = np.where(better[:, None], p, np.where(shrunk[:, None], worst, r))
        val[:, -1] = np.where(better, fp, np.where(shrunk, val[:, -1], fr))
        if shrunk.any():
            s = np.flatnonzero(shrunk)
            pts[s, 1:] = pts[s, :1] + 0.5 * (pts[s, 1:] - pts[s, :1])
            for i in range(1, n + 1):
                val[s, i] = f(pts[s, i], rows[s])
    out[rows] = pts[np.arange(len(rows)), val.argmin(axis=1)]
    return out


def fit_records(x: np.ndarray) -> np.ndarray:
    """Maximum likelihood (c, loc, scale) of each row of ``x``, finite records of one length: the best of three moment starts."""
    if x.shape[1] < LEAST_YEARS:
        raise ValueError(f"a fit needs {LEAST_YEARS} finite values, not {x.shape[1]}")
    scale = np.maximum(x.std(axis=1) * math.sqrt(6) / math.pi, 1e-9)
    starts = np.concatenate([np.column_stack([np.full(len(x), c), x.mean(axis=1) - 0.5772 * scale, np.log(scale)]) for c in (0.1, -0.1, 0.0)])
    theta = simplex_search(lambda t, rows: negative_log_likelihood(t, x[rows % len(x)]), starts)
    value = negative_log_likelihood(theta, np.tile(x, (3, 1))).reshape(3, -1)
    best = theta.reshape(3, -1, 3)[value.argmin(axis=0), np.arange(len(x))]
    return np.column_stack([best[:, :2], np.exp(best[:, 2])])


def fit_one(x: np.ndarray) -> tuple[float, float, float]:
    """``fit_records`` of one record's finite values."""
    x = np.asarray(x, float)
    c, loc, scale = fit_records(x[np.isfinite(x)][None])[0]
    return float(c), float(loc), float(scale)


#: Values that are fitted together, about.
VALUES_TOGETHER = 1 << 17


def fit_gev(rows: DataFrame, min_years: int = 30) -> DataFrame:
    """``cell, c, loc, scale, n_years, pooled_cells`` by maximum likelihood; too short a record is an error.

    ``pooled_cells`` names a cell with fewer than ``min_years`` values of its own, and those it
    borrowed from. A cell's record is a value a year, so a row holds it; a task fits its
    records of one length together, a step of all their searches at a time.
    """
    kind = rows.schema["cell"].dataType.simpleString()
    names = F.concat(F.array(F.col("cell").cast("string")), F.array_sort(F.transform(F.array_remove(F.collect_set("origin"), F.col("cell")), lambda o: o.cast("string"))))
    records = rows.groupBy("cell").agg(
        F.array_sort(F.collect_list(F.col("value").cast("double"))).alias("x"), F.count("*").cast("int").alias("n_years"),
        F.when(F.count_if(F.col("origin") == F.col("cell")) < min_years, names).otherwise(F.array().cast("array<string>")).alias("pooled_cells"),
    ).withColumn("x", F.filter("x", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            size = pdf["x"].map(len).to_numpy()
            for n in np.unique(size):
                same = pdf[size == n]
                for i in range(0, len(same), step := max(1, VALUES_TOGETHER // max(1, n))):
                    own = same.iloc[i : i + step]
                    fits = fit_records(np.stack(own["x"].to_list()).astype(float))
                    yield pd.DataFrame({"cell": own["cell"], "c": fits[:, 0], "loc": fits[:, 1], "scale": fits[:, 2], "n_years": own["n_years"], "pooled_cells": own["pooled_cells"]})

    return records.mapInPandas(run, f"cell {kind}, c double, loc double, scale double, n_years int, pooled_cells array<string>")


def return_levels(fits: DataFrame, periods: Sequence[float] = PERIODS) -> DataFrame:
    """``cell, period, level``."""
    levels = F.array(*(F.struct(F.lit(float(t)).alias("period"), S.return_level(t, F.col("c"), F.col("loc"), F.col("scale")).alias("level")) for t in periods))
    return fits.select("cell", F.explode(levels).alias("e")).select("cell", "e.period", "e.level")


def ks_distance(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """``cell, n, d``: largest gap between the empirical and the fitted distribution."""
    w = Window.partitionBy("cell")
    own = rows.select("cell", "value").join(fits.select("cell", "c", "loc", "scale"), "cell")
    own = own.withColumns({"f": S.gev_cdf(F.col("value"), F.col("c"), F.col("loc"), F.col("scale")), "i": F.row_number().over(w.orderBy("value")), "n": F.count("*").over(w)})
    gap = F.greatest(F.col("i") / F.col("n") - F.col("f"), F.col("f") - (F.col("i") - 1) / F.col("n"))
    return own.groupBy("cell").agg(F.max("n").alias("n"), F.max(gap).alias("d"))


def resample_years(fields: DataFrame, n: int, seed: int = 0, portable: bool = False) -> DataFrame:
    """``scenario, cell, value``: whole years drawn with replacement, so cells stay together.

    ``fields``: ``year, cell, value``. The years' numbers are drawn by numpy on the driver, or
    with ``portable`` by the linear congruence that any engine can repeat.
    """
    spark = fields.sparkSession
    years = sorted(r[0] for r in fields.select("year").distinct().collect())
    if not years:
        raise ValueError("no years to draw from")
    if portable:
        place = F.floor(portable_uniform(F.col("id") + seed + 1) * len(years)).cast("int")
        drawn = [r[0] for r in spark.range(n).orderBy("id").select(place).collect()]
    else:
        drawn = np.random.default_rng(seed).integers(0, len(years), size=n)
    draws = spark.createDataFrame([(i, years[k]) for i, k in enumerate(drawn)], f"scenario int, year {fields.schema['year'].dataType.simpleString()}")
    return draws.join(fields, "year").select("scenario", "cell", "value")
