"""Discrete-time survival: person-periods, logistic hazard, survival and time distributions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import arrays as A
from causeway.functions import scalars as S
from causeway.operators.lineage import cut


def person_periods(df: DataFrame, max_time: int, duration: str = "duration", event: str = "event") -> DataFrame:
    """A row a year at risk, with ``t`` and ``label`` (1 in the event's year)."""
    d = F.greatest(F.lit(1), F.least(F.col(duration).cast("int"), F.lit(max_time)))
    rows = df.withColumn("_d", d).withColumn("t", F.explode(F.sequence(F.lit(1), F.col("_d"))))
    return rows.withColumn("label", ((F.col("t") == F.col("_d")) & (F.col(event).cast("int") == 1)).cast("double")).drop("_d")


def life_table(df: DataFrame, max_time: int, keys: list[str] | None = None) -> DataFrame:
    """``keys, t, at_risk, events, hazard, survival, pmf``; the last year's pmf takes what is left."""
    keys = keys or []
    rows = person_periods(df, max_time).groupBy(*keys, "t").agg(F.count("*").alias("at_risk"), F.sum("label").cast("long").alias("events"))
    w = Window.partitionBy(*keys).orderBy("t")
    rows = rows.withColumn("hazard", F.col("events") / F.col("at_risk"))
    # a product of the factors so far, by logarithms; a hazard of one ends it
    gone = F.max((F.col("hazard") >= 1).cast("int")).over(w) == 1
    kept = F.exp(F.sum(F.when(F.col("hazard") < 1, F.ln(1 - F.col("hazard"))).otherwise(0.0)).over(w))
    rows = rows.withColumn("survival", F.when(gone, 0.0).otherwise(kept))
    before = F.coalesce(F.lag("survival").over(w), F.lit(1.0))
    last = F.col("t") == F.max("t").over(Window.partitionBy(*keys))
    return rows.withColumn("pmf", before * F.col("hazard") + F.when(last, F.col("survival")).otherwise(0.0))


def survival(hazard: Column) -> Column:
    """S(0..T) from an array of hazards of years 1..T."""
    return F.concat(F.array(F.lit(1.0)), A.cumulative_product(F.transform(hazard, lambda h: 1.0 - h)))


def time_distribution(hazard: Column, s: Column) -> Column:
    """P(T = t) for t = 0..T; the last entry takes the mass that never had the event."""
    n = F.size(hazard)
    inner = F.transform(hazard, lambda h, i: F.get(s, i) * h + F.when(i == n - 1, F.element_at(s, -1)).otherwise(0.0))
    return F.concat(F.array(F.lit(0.0)), inner)


def median_time(s: Column, max_time: int) -> Column:
    """The first year with survival under one half, else the last."""
    below = F.filter(F.transform(s, lambda v, i: F.when(v < 0.5, i)), lambda i: i.isNotNull())
    return F.coalesce(F.try_element_at(below, F.lit(1)), F.lit(max_time)).cast("double")


class DiscreteTimeSurvival:
    """Pooled logistic hazard in the features and the year, with a ridge of ``penalty`` on all but the intercept.

    Newton's method: person-periods that are equal are counted first, and a step is one
    aggregate - the sums of the normal equations, as many as pairs of features - whose system
    the driver solves. A step that doesn't lessen the objective is halved. Rows with a null
    feature are left out, and have null forecasts.
    """

    #: Steps at most, and the size of one that ends the search.
    STEPS, CLOSE = 50, 1e-10

    def __init__(self, max_time: int = 20, penalty: float = 1.0):
        self.max_time, self.penalty, self.coefficients, self.intercept = max_time, penalty, None, 0.0

    def fit(self, df: DataFrame, features: list[str], duration: str = "duration", event: str = "event") -> DiscreteTimeSurvival:
        self.features, self.coefficients, self.intercept = features, None, 0.0
        names = [f"x{i}" for i in range(len(features) + 1)]
        own = df.select(*(F.col(f).cast("double").alias(x) for f, x in zip(features, names, strict=False)), F.col(duration).alias("duration"), F.col(event).alias("event")).dropna(subset=names[:-1])
        periods = person_periods(own, self.max_time).select(*names[:-1], F.col("t").cast("double").alias(names[-1]), "label")
        rows = cut(periods.groupBy(*names).agg(F.count("*").cast("double").alias("n"), F.sum("label").alias("d")))
        n, d = rows.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("d"), F.lit(0.0))).first()
        if not 0 < d < n:
            return self
        beta, step, best = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.inf
        for _ in range(self.STEPS):
            value, slope, curve = self._equations(rows, names, beta + step)
            if value > best + 1e-9 * abs(best):
                step = step / 2
                continue
            beta, best = beta + step, value
            step = np.linalg.solve(curve, slope)
            if np.abs(step).max() < self.CLOSE:
                break
        self.coefficients, self.intercept = [float(v) for v in beta[:-1]], float(beta[-1])
        return self

    def _equations(self, rows: DataFrame, names: list[str], beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Penalised minus log-likelihood, what is left of the scores, and the information, at ``beta``."""
        x = [*map(F.col, names), F.lit(1.0)]
        z = sum((c * float(b) for c, b in zip(x[:-1], beta[:-1], strict=True)), F.lit(float(beta[-1])))
        h = S.sigmoid(F.col("z"))
        at = rows.withColumn("z", z).withColumns({"r": F.col("d") - F.col("n") * h, "w": F.col("n") * h * (1 - h)})
        loss = F.col("n") * (F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z")))) - F.col("d") * F.col("z")
        k = len(x)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        sums = list(at.agg(F.sum(loss), *(F.sum(c * F.col("r")) for c in x), *(F.sum(x[i] * x[j] * F.col("w")) for i, j in pairs)).first())
        ridge = np.array([self.penalty] * (k - 1) + [0.0])
        curve = np.diag(ridge)
        for (i, j), v in zip(pairs, sums[1 + k :], strict=True):
            curve[i, j] += v
            curve[j, i] = curve[i, j]
        return float(sums[0] + (ridge * beta**2).sum() / 2), np.array(sums[1 : 1 + k]) - ridge * beta, curve

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``hazard``, ``survival``, ``pmf`` and ``median_time``; one kind of label gave no hazard."""
        years = F.sequence(F.lit(1), F.lit(self.max_time))
        if self.coefficients is None:
            hazard = F.transform(years, lambda t: F.lit(0.0))
        else:
            z = sum((F.col(f).cast("double") * c for f, c in zip(self.features, self.coefficients, strict=False)), F.lit(self.intercept))
            hazard = F.transform(years, lambda t: S.sigmoid(z + t * self.coefficients[-1]))
        out = df.withColumn("hazard", hazard).withColumn("survival", survival(F.col("hazard")))
        return out.withColumns({"pmf": time_distribution(F.col("hazard"), F.col("survival")), "median_time": median_time(F.col("survival"), self.max_time)})
