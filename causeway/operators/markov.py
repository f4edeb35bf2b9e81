"""Markov deterioration: transition counts, smoothed matrices, forecasts, passage times."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.functions import arrays as A
from causeway.schema import N_STATES


def _grid(spark: SparkSession, classes: int | None, states: int) -> DataFrame:
    cells = spark.range((classes or 1) * states * states)
    i = F.col("id").cast("int")
    out = cells.select(F.floor(i / (states * states)).cast("int").alias("age_class"), F.pmod(F.floor(i / states), F.lit(states)).cast("int").alias("s"), F.pmod(i, F.lit(states)).cast("int").alias("s_next"))
    return out if classes else out.drop("age_class")


def count_pairs(pairs: DataFrame, states: int = N_STATES, classes: int | None = None) -> DataFrame:
    """``[age_class,] s, s_next, n`` of rows ``[age_class,] s, s_next``, with zeros."""
    keys = (["age_class"] if classes else []) + ["s", "s_next"]
    counts = pairs.groupBy(*keys).agg(F.count("*").cast("double").alias("n"))
    full = F.broadcast(_grid(pairs.sparkSession, classes, states))
    return counts.join(full, keys, "right").select(*keys, F.coalesce("n", F.lit(0.0)).alias("n"))


def transition_counts(histories: DataFrame, key: str = "key", order: str | Sequence[str] = "seq", state: str = "state", states: int = N_STATES) -> DataFrame:
    """Counts of consecutive states of each key."""
    w = Window.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order))
    pairs = histories.select(F.col(state).alias("s"), F.lead(state).over(w).alias("s_next")).where("s_next IS NOT NULL")
    return count_pairs(pairs, states)


def age_class(age, width: int, classes: int):
    return F.least(F.floor(age / width).cast("int"), F.lit(classes - 1))


def transition_counts_by_age(histories: DataFrame, classes: int, width: int, key: str = "key", order: str = "seq", state: str = "state", age: str = "age", states: int = N_STATES) -> DataFrame:
    """As ``transition_counts``, by the age class that a transition begins in; the last class takes all older."""
    w = Window.partitionBy(key).orderBy(order)
    pairs = histories.select(age_class(F.col(age), width, classes).alias("age_class"), F.col(state).alias("s"), F.lead(state).over(w).alias("s_next")).where("s_next IS NOT NULL")
    return count_pairs(pairs, states, classes)


def transition_matrix(counts: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Adds ``p``: counts plus ``alpha``, over their sum in the row."""
    if alpha <= 0:
        raise ValueError("alpha is > 0")
    keys = [c for c in ("age_class", "s") if c in counts.columns]
    n = F.col("n") + alpha
    return counts.withColumn("p", n / F.sum(n).over(Window.partitionBy(*keys)))


def matrix_rows(matrix: DataFrame) -> DataFrame:
    """``[age_class,] s, p`` with p as an array by next state."""
    keys = [c for c in ("age_class", "s") if c in matrix.columns]
    cells = F.array_sort(F.collect_list(F.struct("s_next", "p")))
    return matrix.groupBy(*keys).agg(F.transform(cells, lambda c: c["p"]).alias("p"))


def to_numpy(matrix: DataFrame, states: int = N_STATES) -> np.ndarray:
    """A matrix, or one for each age class, on the driver (a fixed number of cells)."""
    rows = matrix.select(*(["age_class"] if "age_class" in matrix.columns else [F.lit(0).alias("age_class")]), "s", "s_next", "p").collect()
    out = np.zeros((max(r[0] for r in rows) + 1, states, states))
    for c, s, t, p in rows:
        out[c, s, t] = p
    return out if "age_class" in matrix.columns else out[0]


def default_counts(acceleration: float = 1.0) -> list[list[float]]:
    """Stand-in counts: three stays to six steps down a year, the steps times ``acceleration``."""
    out = [[0.0] * N_STATES for _ in range(N_STATES)]
    for s in range(N_STATES - 1):
        out[s][s], out[s][s + 1] = 3.0, 6.0 * acceleration
    out[2][3], out[3][3] = 5.0 * acceleration, 10.0
    return out


def default_matrix(acceleration: float = 1.0, alpha: float = 0.5) -> np.ndarray:
    m = np.array(default_counts(acceleration)) + alpha
    return m / m.sum(axis=1, keepdims=True)


def forecasts(start: DataFrame, matrix: np.ndarray, steps: int) -> DataFrame:
    """Adds ``forecast`` to rows with ``p0`` (array of double)."""
    return start.withColumn("forecast", A.forecast(F.col("p0"), A.matrix(matrix), steps))


def pair_probabilities(pairs: DataFrame, rows: DataFrame, width: int, classes: int, default_age: float) -> DataFrame:
    """Adds ``p`` of each pair's age class and state; a missing age counts as ``default_age``."""
    own = pairs.withColumn("age_class", age_class(F.coalesce("age", F.lit(default_age)), width, classes))
    table = rows.select("age_class", F.col("s").alias("state4"), "p")
    return own.join(F.broadcast(table), ["age_class", "state4"])  # classes x states rows


def dirichlet_draws(counts: DataFrame, n: int, seed: int = 0, alpha: float = 0.5, states: int = N_STATES) -> DataFrame:
    """``draw, s, s_next, p``: matrices drawn from the posterior of each smoothed row, one after another."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((states, states))
        m[pdf.s, pdf.s_next] = pdf.n
        rng, out = np.random.default_rng(seed), []
        for d in range(n):
            for s in range(states):
                out += [(d, s, t, p) for t, p in enumerate(rng.dirichlet(m[s] + alpha))]
        return pd.DataFrame(out, columns=["draw", "s", "s_next", "p"])

    return counts.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(draw, "draw int, s int, s_next int, p double")
