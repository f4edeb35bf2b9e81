"""Allocation policies as column expressions over a state row.

A state row holds ``condition`` (array, by asset) and a policy turns it into ``plan``: an
option's number by asset. Greedy policies sort their candidates by score per cost and fold
over them, taking each that still fits: a later, cheaper one may be taken after one that
doesn't fit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import arrays as A
from causeway.functions import scalars as S
from causeway.operators.lineage import cut

SLACK = 1e-9


@dataclass
class Assets:
    """What doesn't change: types, solo losses, budget and crew."""

    types: list[str]
    benefit: list[float]
    budget: float
    crew: float

    def __post_init__(self):
        unknown = [t for t in self.types if t not in S.BASE_COST_CRORE]
        if unknown:
            raise KeyError(f"unknown structure type {unknown[0]!r}")
        self.cost = [[S.BASE_COST_CRORE[t] * S.COST_MULTIPLE[o] for o in S.OPTIONS] for t in self.types]
        self.labour = [[S.LABOUR_DAYS[t] * S.LABOUR_MULTIPLE[o] for o in S.OPTIONS] for t in self.types]

    def best_option(self, i: int) -> int:
        """The option of most benefit per cost; 0 without a benefit."""
        ratios = [(self.benefit[i] / c if c > 0 else 0.0) for c in self.cost[i]]
        return int(np.argmax(ratios)) if max(ratios) > 0 else 0


def no_plan(assets: Assets) -> Column:
    return F.array_repeat(F.lit(0), len(assets.types))


def take_in_order(items: Column, assets: Assets, budget: float, crew: float, plan: Column | None = None) -> Column:
    """Fold over ``ord, opt, cost, labour`` structs: each that fits what is left is taken."""
    start = F.struct(F.lit(0.0).alias("spent"), F.lit(0.0).alias("used"), (plan if plan is not None else no_plan(assets)).alias("plan"))

    def step(a: Column, i: Column) -> Column:
        fits = (a["spent"] + i["cost"] <= budget + SLACK) & (a["used"] + i["labour"] <= crew + SLACK)
        put = F.transform(a["plan"], lambda p, k: F.when(k == i["ord"], i["opt"]).otherwise(p))
        return F.when(fits, F.struct((a["spent"] + i["cost"]).alias("spent"), (a["used"] + i["labour"]).alias("used"), put.alias("plan"))).otherwise(a)

    return F.aggregate(items, start, step, lambda a: a["plan"])


def ranked(assets: Assets, score: Column, option: Column, budget: float | None = None, crew: float | None = None, only: list[int] | None = None, plan: Column | None = None) -> Column:
    """Greedy by score per cost, ties to the earlier asset. ``score`` and ``option``: arrays by asset."""
    budget, crew = assets.budget if budget is None else budget, assets.crew if crew is None else crew
    at = F.lit(np.arange(len(assets.types)) if only is None else np.array(only, int)).cast("array<int>")
    cost, labour = A.Table(assets.cost), A.Table(assets.labour)

    def item(i: Column) -> Column:
        opt = F.get(option, i).cast("int")
        c = cost.at(i, opt)
        return F.struct(F.try_divide(-F.get(score, i), c).alias("key"), i.alias("ord"), opt.alias("opt"), c.alias("cost"), labour.at(i, opt).alias("labour"), F.get(score, i).alias("score"))

    items = F.filter(F.transform(at, item), lambda x: (x["opt"] > 0) & (x["cost"] > 0) & (x["score"] > 0))
    return take_in_order(F.array_sort(items), assets, budget, crew, plan)


def do_nothing(assets: Assets, condition: Column) -> Column:
    return no_plan(assets)


def random(assets: Assets, condition: Column) -> Column:
    """A fixed shuffle of the assets; each gets its best option while it fits."""
    order = list(range(len(assets.types)))
    np.random.default_rng(0).shuffle(order)
    best = [assets.best_option(i) for i in range(len(order))]
    turn = [i for i in order if best[i]]
    if not turn:
        return no_plan(assets)
    option, cost, labour = F.lit(np.array(best)).cast("array<int>"), A.Table(assets.cost), A.Table(assets.labour)

    def item(i: Column) -> Column:
        opt = F.get(option, i)
        return F.struct(i.alias("ord"), opt.alias("opt"), cost.at(i, opt).alias("cost"), labour.at(i, opt).alias("labour"))

    return take_in_order(F.transform(F.lit(np.array(turn)).cast("array<int>"), item), assets, assets.budget, assets.crew)


def worst_first(assets: Assets, condition: Column) -> Column:
    """Score: the condition, over the cost of the option that suits it."""
    return ranked(assets, condition.cast("array<double>"), condition)


def benefit_cost(assets: Assets, condition: Column) -> Column:
    return ranked(assets, A.doubles(assets.benefit), F.lit(np.array([assets.best_option(i) for i in range(len(assets.types))], int)).cast("array<int>"))


def criticality_weighted(assets: Assets, condition: Column) -> Column:
    return ranked(assets, F.transform(condition, lambda c: c * (1.0 + c)), condition)


def siloed(assets: Assets, condition: Column) -> Column:
    """An equal share of budget and crew for each structure type, then by benefit within it."""
    kinds = sorted(set(assets.types))
    plan = no_plan(assets)
    for kind in kinds:
        own = [i for i, t in enumerate(assets.types) if t == kind]
        plan = ranked(assets, A.doubles(assets.benefit), condition, assets.budget / len(kinds), assets.crew / len(kinds), own, plan)
    return plan


#: A policy turns the assets and the column of their conditions into the column of its plan; ``ranked`` makes greedy ones.
Policy = Callable[[Assets, Column], Column]
BASELINES: dict[str, Policy] = {"do_nothing": do_nothing, "random": random, "worst_first": worst_first, "benefit_cost": benefit_cost, "criticality_weighted": criticality_weighted, "siloed": siloed}


#: Candidates of a group that are folded in one row, at most; larger groups take rounds.
FOLD_MOST = 10_000


def greedy_select(candidates: DataFrame, keys: list[str], budget: str, crew: str) -> DataFrame:
    """The chosen rows of ``keys, ord, key, cost, labour``: greedy by ``key`` descending, ties to the lower ``ord``.

    ``budget`` and ``crew`` are columns that are equal within a group. Rows that don't fit
    what is left are passed over. Small groups are a fold each, over their candidates in
    order; a group of any size is dealt to ranges of the order, and taken in rounds: the
    longest run that fits goes at once, by running sums over the ranges, then what can't fit
    any more leaves. A group without a key is never chosen from.
    """
    own = candidates.where((F.col("cost") > 0) & (F.col("key") > 0)).select(*keys, "ord", "key", "cost", "labour", F.col(budget).alias("b"), F.col(crew).alias("c"))
    large = cut(own.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > FOLD_MOST).select(*keys))
    if large.isEmpty():
        taken = _fold(own, keys)
    else:
        taken = _fold(own.join(large, keys, "left_anti"), keys).unionByName(_in_rounds(own.join(large, keys), keys))
    return candidates.join(taken, [*keys, "ord"])


def _fold(own: DataFrame, keys: list[str]) -> DataFrame:
    item = F.struct((-F.col("key")).alias("k"), "ord", "cost", "labour")
    groups = own.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"), F.max("b").alias("b"), F.max("c").alias("c"))
    start = F.struct(F.lit(0.0).alias("spent"), F.lit(0.0).alias("used"), F.array().cast("array<bigint>").alias("taken"))

    def step(a: Column, i: Column) -> Column:
        fits = (a["spent"] + i["cost"] <= F.col("b") + SLACK) & (a["used"] + i["labour"] <= F.col("c") + SLACK)
        more = F.struct((a["spent"] + i["cost"]).alias("spent"), (a["used"] + i["labour"]).alias("used"), F.concat(a["taken"], F.array(i["ord"].cast("bigint"))).alias("taken"))
        return F.when(fits, more).otherwise(a)

    return groups.select(*keys, F.explode(F.aggregate("items", start, step, lambda a: a["taken"])).alias("ord"))


def _in_rounds(own: DataFrame, keys: list[str]) -> DataFrame:
    """As ``_fold``, of groups that no row could hold. ``b`` and ``c`` are what is left of budget and crew.

    A round takes at least the first candidate of every group that has one which fits.
    """
    order = [F.desc("key"), F.asc("ord")]
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alive = cut(own.repartitionByRange(n, *keys, *order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    inside = Window.partitionBy(*keys, "part").orderBy(*order)
    taken = []
    while True:
        fits = alive.where((F.col("cost") <= F.col("b") + SLACK) & (F.col("labour") <= F.col("c") + SLACK))
        sums = fits.groupBy(*keys, "part").agg(F.sum("cost").alias("sc"), F.sum("labour").alias("sl"))
        starts = sums.select(*keys, "part", *(F.coalesce(F.sum(s).over(before), F.lit(0.0)).alias(o) for s, o in (("sc", "oc"), ("sl", "ol"))))
        run = fits.join(starts, [*keys, "part"]).withColumns({"oc": F.col("oc") + F.sum("cost").over(inside), "ol": F.col("ol") + F.sum("labour").over(inside)})
        marked = cut(run.withColumn("take", (F.col("oc") <= F.col("b") + SLACK) & (F.col("ol") <= F.col("c") + SLACK)).drop("oc", "ol"))
        if marked.isEmpty():
            break
        got = marked.where("take")
        taken.append(got.select(*keys, "ord"))
        spent = got.groupBy(*keys).agg(F.sum("cost").alias("sc"), F.sum("labour").alias("sl"))
        alive = marked.where(~F.col("take")).join(spent, keys).withColumns({"b": F.col("b") - F.col("sc"), "c": F.col("c") - F.col("sl")}).drop("sc", "sl", "take")
    out = own.select(*keys, "ord").limit(0)
    for t in taken:
        out = out.unionByName(t)
    return out.withColumn("ord", F.col("ord").cast("bigint"))
