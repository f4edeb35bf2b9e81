"""Array expressions: vectors and matrices as ARRAY<DOUBLE> columns, folded inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from causeway.schema import N_STATES


def doubles(values: Sequence[float]) -> Column:
    """One literal, however long: a plan doesn't grow with it."""
    return F.lit(np.asarray(values, float)) if len(values) else F.array().cast("array<double>")


def matrix(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*(doubles(r) for r in rows))


class Table:
    """Rows of equal width as one literal, read by row and column."""

    def __init__(self, rows: Sequence[Sequence[float]]):
        self.width = len(rows[0]) if rows else 1
        self.flat = doubles([v for r in rows for v in r])

    def at(self, i: Column, j: Column) -> Column:
        return F.get(self.flat, i * self.width + j)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cumulative(values: Column) -> Column:
    """Running sums, added in order."""
    start = F.array().cast("array<double>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0))
    return F.aggregate(values, start, lambda a, x: F.concat(a, F.array(last(a) + x)))


def cumulative_product(values: Column) -> Column:
    start = F.array().cast("array<double>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(1.0))
    return F.aggregate(values, start, lambda a, x: F.concat(a, F.array(last(a) * x)))


def times_matrix(p: Column, m: Column, n: int = N_STATES) -> Column:
    """Row vector times matrix."""

    def entry(j: int) -> Column:
        return total(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(p, i) * F.get(F.get(m, i), F.lit(j))))

    return F.array(*(entry(j) for j in range(n)))


def next_state(cdf: Column, u: Column, n: int = N_STATES) -> Column:
    """The state whose cumulative probability first exceeds ``u``."""
    return F.least(F.lit(n - 1), F.size(F.filter(cdf, lambda c: c <= u)))


def forecast(p0: Column, m: Column, steps: int) -> Column:
    """Distributions after 0..steps years, as an array of arrays."""
    start = F.array(p0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda a, _: F.concat(a, F.array(times_matrix(F.element_at(a, -1), m)))) if steps > 0 else start


def forecast_by_age(state: Column, age: Column, matrices: Column, width: int, steps: int, n: int = N_STATES) -> Column:
    """As ``forecast`` from one state, with the matrix of the age class that each year begins in."""
    p0 = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == state).cast("double"))
    at = lambda t: F.get(matrices, F.least(F.floor((age + t) / width).cast("int"), F.size(matrices) - 1))
    step = lambda a, t: F.concat(a, F.array(times_matrix(F.element_at(a, -1), at(t), n)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.array(p0), step) if steps > 0 else F.array(p0)


def first_passage(p0: Column, m: Column, targets: Sequence[int] = (2, 3), steps: int = 50, n: int = N_STATES) -> Column:
    """Probability that the chain first enters ``targets`` after 0..steps years; never renormalised."""
    inside = lambda p: sum((F.get(p, F.lit(t)) for t in targets), F.lit(0.0))
    outside = lambda p: F.array(*(F.lit(0.0) if j in targets else F.get(p, F.lit(j)) for j in range(n)))
    start = F.struct(outside(p0).alias("q"), F.array(inside(p0)).alias("hit"))

    def step(a: Column, _: Column) -> Column:
        q = times_matrix(a["q"], m, n)
        return F.struct(outside(q).alias("q"), F.concat(a["hit"], F.array(inside(q))).alias("hit"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda a: a["hit"])


def expected_time(passage: Column) -> Column:
    """Sum of year times probability; what never arrives adds nothing."""
    return total(F.transform(passage, lambda p, t: p * t))


def ranked_probability(p: Column, y: Column) -> Column:
    """Sum of squared differences of cumulative forecast and outcome."""
    return total(F.transform(cumulative(p), lambda c, k: F.pow(c - F.when(y <= k, 1.0).otherwise(0.0), F.lit(2.0))))
