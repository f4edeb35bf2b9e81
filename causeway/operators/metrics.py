"""Forecast, tail, robustness and paired metrics as aggregates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import arrays as A
from causeway.functions import scalars as S
from causeway.operators.lineage import cut
from causeway.schema import STATES


def log_loss(y: Column, p: Column, eps: float = 1e-12) -> Column:
    return -F.avg(F.ln(F.least(F.greatest(F.get(p, y), F.lit(eps)), F.lit(1.0))))


def ranked_probability_score(y: Column, p: Column) -> Column:
    return F.avg(A.ranked_probability(p, y))


def accuracy(y: Column, p: Column) -> Column:
    return F.avg((S.arg_max(p) == y).cast("double"))


def climatology(df: DataFrame, y: str = "y_next") -> DataFrame:
    """``y, p``: shares of the outcomes."""
    counts = df.groupBy(y).agg(F.count("*").alias("n"))
    return counts.select(y, (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))


def state_histogram(df: DataFrame, state: str = "state4") -> DataFrame:
    """``state, n``: how many rows are in each state, by its name."""
    name = F.get(F.array(*map(F.lit, STATES)), F.col(state))
    return df.groupBy(name.alias("state")).agg(F.count("*").alias("n"))


def _in_ranges(df: DataFrame, keys: list[str], value: Column) -> tuple[DataFrame, DataFrame]:
    """Equal values counted and dealt to tasks by ranges of (keys, value), and the sums of these ranges.

    The first has ``keys, v, c, part``; the second, a row a range and group in it: ``keys, part``,
    the rows ``inside`` and the sum ``total`` of their values, those ``before`` it and all ``n`` of the group.
    """
    counts = df.groupBy(*keys, value.alias("v")).agg(F.count("*").alias("c"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(counts.repartitionByRange(ranges, *keys, "v").withColumn("part", F.spark_partition_id()))
    over = Window.partitionBy(*keys)
    sums = ranged.groupBy(*keys, "part").agg(F.sum("c").alias("inside"), F.sum(F.col("v") * F.col("c")).alias("total"))
    before = F.coalesce(F.sum("inside").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged, sums.withColumns({"n": F.sum("inside").over(over), "before": before})


def _of_range(ranged: DataFrame, hit: DataFrame, keys: list[str]) -> DataFrame:
    """The values of the ranges in ``hit`` (one a group), with its ``before`` and ``k``, and ``upto``: the rows up to each value."""
    own = hit.select(F.col("part").alias("_part"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(keys)), "before", "k")
    own = ranged.join(own, [F.col("part") == F.col("_part"), *(F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(keys))])
    return own.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(*keys).orderBy("v")))


def cvar(df: DataFrame, value: str, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Mean of the worst ceil(alpha n) values (one at least) of each group, as ``cvar``.

    Sums of ranges tell which are wholly among the worst and which one the worst begin in; only
    that one is sorted. So no task sorts a group. Values that are null take no part.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha is in (0, 1]")
    # the worst come first, by their negative values
    ranged, sums = _in_ranges(df.where(F.col(value).isNotNull()), keys, -F.col(value).cast("double"))
    sums = sums.withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(alpha)))).where(F.col("before") < F.col("k"))
    whole = F.col("before") + F.col("inside") <= F.col("k")
    part = _of_range(ranged, sums.where(~whole), keys)
    take = F.greatest(F.lit(0), F.least(F.col("c"), F.col("k") - F.col("upto") + F.col("c")))
    part = part.select(*keys, (F.col("v") * take).alias("total"), take.alias("taken"))
    both = sums.where(whole).select(*keys, "total", F.col("inside").alias("taken")).unionByName(part)
    return both.groupBy(*keys).agg((-F.sum("total") / F.sum("taken")).alias("cvar"))


def value_at_risk(value: str | Column, alpha: float = 0.05) -> Column:
    if not 0 < alpha < 1:
        raise ValueError("alpha is in (0, 1)")
    return F.percentile(value, 1 - alpha)


#: Ranges of time and of score that make the cells of ``concordance``: this many at least, one for so
#: many distinct rows, and no more than make a matrix of cells for the driver (512 x 512 sums).
CUTS = 64
CUT_ROWS = 500_000
CUTS_MOST = 512


def _beaten(t: np.ndarray, x: np.ndarray, wi: np.ndarray, wj: np.ndarray) -> float:
    """Sum over i, and j of a later ``t``, of wi x wj where x_i > x_j, and half of it where they are equal.

    Bit by bit of the rank in ``t``: pairs that first differ in this bit meet in one sorted pass.
    """
    if not len(t):
        return 0.0
    rank, total = np.unique(t, return_inverse=True)[1], 0.0
    for bit in range(int(rank.max()).bit_length()):
        group, late = rank >> (bit + 1), (rank >> bit) & 1 == 1
        order = np.lexsort((x, group))
        g, v, own, other = group[order], x[order], np.where(late, 0.0, wi)[order], np.where(late, wj, 0.0)[order]
        sums = np.r_[0.0, np.cumsum(other)]
        new_group, new_value = np.r_[True, g[1:] != g[:-1]], np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])]
        starts = np.flatnonzero(new_value)
        stops = np.r_[starts[1:], len(g)]
        which = np.cumsum(new_value) - 1
        base = sums[np.flatnonzero(new_group)][np.cumsum(new_group) - 1]
        below, upto = sums[starts][which] - base, sums[stops][which] - base
        total += float((own * (below + upto) / 2).sum())
    return total


def _cell(value: str, cuts: list) -> Column:
    """How many of the sorted ``cuts`` lie at or below the value."""
    return F.size(F.filter(F.lit(np.asarray(cuts, float)), lambda c: c <= F.col(value))) if cuts else F.lit(0)


def concordance(df: DataFrame, time: str, score: str, event: str) -> DataFrame:
    """Harrell's C: of pairs where one has its event first, how often it has the higher score.

    Equal (time, score, event) rows are counted first. Quantiles cut time and score into
    ranges, more for more rows (``CUTS``, ``CUT_ROWS``, ``CUTS_MOST``); pairs of rows that differ in
    both ranges are counted from the cells' sums, the others inside a range of time or of score,
    each sorted in its own task. So no pair of rows is ever made.
    """
    own = df.where(F.col(time).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(time).cast("double").alias("t"), F.col(score).cast("double").alias("x"), F.coalesce(F.col(event).cast("int") != 0, F.lit(False)).alias("e")).agg(F.count("*").cast("double").alias("n"))
    own = own.groupBy("t", "x").agg(F.sum(F.when(F.col("e"), F.col("n")).otherwise(0.0)).alias("i"), F.sum("n").alias("j"))
    own = cut(own)
    cuts = max(CUTS, min(CUTS_MOST, -(-own.count() // CUT_ROWS)))
    shares = [k / cuts for k in range(1, cuts)]
    at = own.agg(F.percentile_approx("t", shares), F.percentile_approx("x", shares)).collect()[0]
    t_cuts, x_cuts = (sorted(set(v or [])) for v in at)
    own = own.withColumns({"tc": _cell("t", t_cuts), "xc": _cell("x", x_cuts)})
    cells = np.zeros((2, len(t_cuts) + 1, len(x_cuts) + 1))
    for r in own.groupBy("tc", "xc").agg(F.sum("i"), F.sum("j")).collect():  # cuts x cuts rows at most
        cells[:, r[0], r[1]] = r[2], r[3]
    later = np.vstack([np.cumsum(cells[1][::-1], axis=0)[::-1][1:], np.zeros((1, cells.shape[2]))])  # j in later ranges of time, by range of score
    lower = np.cumsum(later, axis=1) - later
    wins = float((cells[0] * lower).sum())

    def inside(key: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            t = pdf["t" if key == "tc" else "tc"].to_numpy()
            won = _beaten(t, pdf["x"].to_numpy(), pdf["i"].to_numpy(), pdf["j"].to_numpy())
            _, rank = np.unique(t, return_inverse=True)
            by = np.bincount(rank, pdf["j"])
            after = np.cumsum(by[::-1])[::-1] - by
            return pd.DataFrame({"won": [won], "pairs": [float((pdf["i"].to_numpy() * after[rank]).sum())]})

        return run

    # within a range of time all scores meet; within a range of score only different ranges of time
    same_t = own.groupBy("tc").applyInPandas(inside("tc"), "won double, pairs double").agg(F.sum("won").alias("won"), F.sum("pairs").alias("pairs"))
    same_x = own.groupBy("xc").applyInPandas(inside("xc"), "won double, pairs double").agg(F.sum("won").alias("also"))
    pairs = F.coalesce("pairs", F.lit(0.0)) + float((cells[0] * later.sum(axis=1, keepdims=True)).sum())
    won = F.coalesce("won", F.lit(0.0)) + F.coalesce("also", F.lit(0.0)) + wins
    return same_t.join(same_x).select(F.coalesce(F.try_divide(won, pairs), F.lit(0.5)).alias("c_index"), pairs.cast("long").alias("n_pairs"))  # one row each


def robustness(losses: DataFrame, tol: float = 1e-9) -> DataFrame:
    """``policy, win_rate, mean_regret, max_regret`` from ``policy, draw, loss``; infinite losses are left out."""
    finite = losses.where(F.abs("loss") < float("inf"))
    best = finite.groupBy("draw").agg(F.min("loss").alias("best"))
    own = finite.join(best, "draw").withColumn("regret", F.col("loss") - F.col("best"))
    return own.groupBy("policy").agg(F.avg((F.abs("regret") <= tol).cast("double")).alias("win_rate"), F.avg("regret").alias("mean_regret"), F.max("regret").alias("max_regret"))


def winners(losses: DataFrame) -> DataFrame:
    """The first policy (by ``ord``) of least loss in each draw."""
    return losses.groupBy("draw").agg(F.min_by("policy", F.struct("loss", "ord")).alias("winner"))


def medians_and_ranges(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"))


def policy_summary(outcomes: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Per policy: means, population deviation, person-days per crore of all spend, and CVaR."""
    spend = F.col("planned") + F.col("emergency")
    rows = outcomes.groupBy("policy").agg(
        F.avg("person_days").alias("mean_person_days"), F.stddev_pop("person_days").alias("sd_person_days"),
        F.avg("planned").alias("mean_planned_crore"), F.avg("emergency").alias("mean_emergency_crore"), F.avg(spend).alias("mean_spend_crore"),
        S.lost_per_crore(F.sum("person_days"), F.sum(spend)).alias("person_days_per_crore"),
    )
    return rows.join(cvar(outcomes, "person_days", ["policy"], alpha).withColumnRenamed("cvar", "cvar_person_days"), "policy")


def paired(outcomes: DataFrame, a: str, b: str, value: str = "person_days") -> DataFrame:
    """``s, diff``: policy a minus policy b in the same scenario; both need the same scenarios."""
    x = outcomes.where(F.col("policy") == a).select("s", F.col(value).alias("x"))
    y = outcomes.where(F.col("policy") == b).select("s", F.col(value).alias("y"))
    both = x.join(y, "s", "full")
    missing = F.col("x").isNull() | F.col("y").isNull()
    return both.select("s", F.when(missing, F.raise_error(F.lit("the policies' scenarios differ")).cast("double")).otherwise(F.col("x") - F.col("y")).alias("diff"))


def paired_bootstrap(diffs: DataFrame, n: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """``mean, lo, hi, n``: percentile interval of the mean difference, with numpy's own draws.

    The paired differences of one comparison are resampled in one task (a number per scenario).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values("s")["diff"].to_numpy()
        if not len(d):
            raise ValueError("no paired samples")
        means = d[np.random.default_rng(seed).integers(0, len(d), size=(n, len(d)))].mean(axis=1)
        lo, hi = np.quantile(means, [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame({"mean": [d.mean()], "lo": [lo], "hi": [hi], "n": [n]})

    return diffs.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, "mean double, lo double, hi double, n int")


def portable_uniform(k: Column, rounds: int = 3) -> Column:
    """A uniform number from an integer, the same in any engine: a linear congruence, fed back ``rounds`` times."""
    k = F.pmod(k.cast("long"), F.lit(2147483648))
    for _ in range(rounds):
        k = F.pmod(k * 1103515245 + 12345, F.lit(2147483648))
    return k / F.lit(2147483648.0)


def paired_bootstrap_portable(diffs: DataFrame, n: int, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """The same interval with resamples spread over the cluster: ``n`` means, each of all samples drawn anew."""
    k = diffs.count()
    place = Window.partitionBy().orderBy("s")
    ranked = diffs.select((F.row_number().over(place) - 1).cast("int").alias("i"), "diff")
    draws = diffs.sparkSession.range(n * k).select((F.col("id") % n).alias("b"), F.floor(portable_uniform(F.col("id") + seed) * k).cast("int").alias("i"))
    means = draws.join(ranked, "i").groupBy("b").agg(F.avg("diff").alias("m"))
    return means.agg(F.percentile("m", alpha / 2).alias("lo"), F.percentile("m", 1 - alpha / 2).alias("hi"), F.avg("m").alias("mean"))


def conformal_quantiles(residuals: DataFrame, keys: list[str], residual: str = "residual", alpha: float = 0.1) -> DataFrame:
    """``keys, q``: the ceil((n + 1)(1 - alpha))-th smallest absolute residual, the largest if there are fewer.

    Equal residuals are counted first, and ranges of (keys, residual) dealt to tasks; sums of
    the ranges tell which one holds a group's rank, and only that one is looked into.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha is in (0, 1)")
    ranged, sums = _in_ranges(residuals.where(F.col(residual).isNotNull()), keys, F.abs(residual))
    k = F.least(F.ceil((F.col("n") + 1) * F.lit(1.0 - alpha)), F.col("n"))
    hit = sums.withColumn("k", k).where((F.col("before") < F.col("k")) & (F.col("k") <= F.col("before") + F.col("inside")))
    return _of_range(ranged, hit, keys).where(F.col("upto") >= F.col("k")).groupBy(*keys).agg(F.min("v").alias("q"))


def conformal_by_group(residuals: DataFrame, group: str, residual: str = "residual", alpha: float = 0.1) -> DataFrame:
    """``group, q`` and the pooled quantile in a row with a null group."""
    pooled = conformal_quantiles(residuals, [], residual, alpha).select(F.lit(None).cast(residuals.schema[group].dataType).alias(group), "q")
    return conformal_quantiles(residuals, [group], residual, alpha).unionByName(pooled)


def with_intervals(points: DataFrame, quantiles: DataFrame, group: str, point: str = "point") -> DataFrame:
    """Adds ``lo`` and ``hi``; an unseen group takes the pooled quantile."""
    pooled = quantiles.where(F.col(group).isNull()).select(F.col("q").alias("_pooled"))
    own = quantiles.where(F.col(group).isNotNull()).select(group, F.col("q").alias("_own"))
    wide = points.join(own, group, "left").join(F.broadcast(pooled))  # one row
    q = F.coalesce("_own", "_pooled")
    return wide.withColumns({"lo": F.col(point) - q, "hi": F.col(point) + q}).drop("_own", "_pooled")


def coverage(y: Column, lo: Column, hi: Column) -> Column:
    return F.avg(((y >= lo) & (y <= hi)).cast("double"))


def _scaled_power(a: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """``a`` to the power ``n``, and the power of ten that was taken out of it."""
    if n == 1:
        return a, 0
    half, e = _scaled_power(a, n // 2)
    out, e = half @ half, 2 * e
    if n % 2:
        out = out @ a
    if out.max() > 1e140:
        out, e = out * 1e-140, e + 140
    return out, e


def kolmogorov_p(d: float, n: int, exact: int = 20_000) -> float:
    """P-value of the distance ``d`` of ``n`` values: by the powers of a matrix up to ``exact`` values, asymptotic beyond.

    The matrix has 2 n d rows or so; where n d^2 is above 18 the p-value is below 1e-15, and
    its first asymptotic term is taken.
    """
    if d <= 0.5 / n:
        return 1.0
    if d >= 1:
        return 0.0
    if n * d * d > 18:
        return 2 * math.exp(-2 * n * d * d)
    if n <= exact:
        k = math.ceil(n * d)
        h, m = k - n * d, 2 * k - 1
        i, j = np.indices((m, m))
        step = np.maximum(i - j + 1, 0)
        a = (i - j + 1 >= 0).astype(float)
        a[:, 0] -= h ** np.arange(1, m + 1)
        a[-1, :] -= h ** np.arange(m, 0, -1)
        a[-1, 0] += max(0.0, 2 * h - 1) ** m
        a *= np.cumprod(1.0 / np.maximum(np.arange(m + 1), 1))[step]  # one over the factorials; the last are 0 to double precision
        power, e = _scaled_power(a, n)
        q = float(power[k - 1, k - 1])
        for x in range(1, n + 1):
            q *= x / n
            if q < 1e-140:
                q, e = q * 1e140, e - 140
        return min(1.0, max(0.0, 1 - q * 10.0**e))
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))
