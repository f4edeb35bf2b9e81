"""The yearly policy simulator: plan, repair, deteriorate, fail, lose access, restore.

A row is a policy in a scenario, with the assets' conditions as an array. A year is a few
array expressions over every row at once: no row needs another, so the work spreads over
policies and scenarios, and only the years follow each other. The loss of a failing set
is looked up by the places of its members, of any number; what isn't known yet is solved
for the distinct sets. Plans of the optimising policies are solved once for each distinct
condition vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import arrays as A
from causeway.functions import scalars as S
from causeway.operators.access import Graph, Roads, subsets
from causeway.operators.lineage import cut
from causeway.plans import policies as P
from causeway.plans.optimize import Planner
from causeway.sources.synthetic import Scenarios, ScenarioTable

#: Up to so many assets the losses of all their sets are worked out beforehand.
ALL_SETS = 12
#: Up to so many pairs of a policy and a condition vector are planned for once each.
FEW_CONDITIONS = 20_000
OPTIMISERS = ("additive_milp", "network_aware")


@dataclass
class Models:
    """What a run needs besides its scenarios; ``condition`` is the first year's."""

    asset_ids: list[str]
    nodes: list[str]
    types: list[str]
    condition: list[int]
    budget: float
    crew: float
    graph: Graph | Roads
    transition: np.ndarray
    fragility: tuple[float, float, float] = (-3.0, 1.2, 2.0)
    premium: float = 1.8
    outage: list[float] | None = None
    opt_rain: np.ndarray | None = None
    opt_seed: int = 0

    def __post_init__(self):
        if self.outage is None:
            self.outage = [S.OUTAGE_DAYS.get(t, S.OUTAGE_OTHER) for t in self.types]
        self.solo = self.graph.solo(self.nodes)
        self.assets = P.Assets(self.types, self.solo, self.budget, self.crew)

    def planner(self) -> Planner:
        if not isinstance(self.graph, Graph):
            raise ValueError("the optimising policies need a graph that goes along")
        return Planner(self.types, self.outage, self.nodes, self.graph, self.opt_rain, self.opt_seed, self.budget, self.crew, self.fragility)


def solved_plans(state: DataFrame, models: Models) -> DataFrame:
    """``policy, condition, plan`` for the distinct condition vectors of the optimising policies."""
    asked = state.where(F.col("policy").isin(*OPTIMISERS)).select("policy", "condition").distinct()
    given = state.sparkSession.sparkContext.broadcast(models.planner())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planner = given.value
        for x in frames:
            plans = [(planner.network_aware if p == "network_aware" else planner.additive)([int(v) for v in c]) for p, c in zip(x.policy, x.condition, strict=True)]
            yield pd.DataFrame({"policy": x.policy, "condition": x.condition, "plan": plans})

    parts = max(1, min(asked.count(), 4 * state.sparkSession.sparkContext.defaultParallelism))
    return asked.repartition(parts).mapInPandas(run, "policy string, condition array<int>, plan array<int>")


def simulate(spark: SparkSession, names: list[str], models: Models, scenarios: Scenarios | ScenarioTable, keep_plans: bool = False, own: dict[str, P.Policy] | None = None) -> DataFrame:
    """``policy, s, person_days, planned, emergency[, plan]`` (the first year's plan) of every policy and scenario.

    ``own``: policies of the caller, by name.
    """
    n, years, known_policies = len(models.types), scenarios.years, P.BASELINES | (own or {})
    unknown = [p for p in names if p not in known_policies and p not in OPTIMISERS]
    if unknown:
        raise KeyError(f"unknown policy {unknown[0]!r}")
    who = spark.createDataFrame([(p,) for p in names], "policy string")
    first = F.lit(np.array(models.condition, int)).cast("array<int>")
    state = scenarios.table(spark).join(F.broadcast(who))  # scenarios x policies
    zero = F.lit(0.0)
    state = state.withColumns({"condition": first, "person_days": zero, "planned": zero, "emergency": zero, "first_plan": F.lit(None).cast("array<int>")})
    cost, major = A.Table(models.assets.cost), A.doubles([c[2] for c in models.assets.cost])
    reset = A.doubles([S.RESET[o] for o in S.OPTIONS])
    cdf = A.matrix(np.cumsum(models.transition, axis=1))
    outage = A.doubles(models.outage)
    table = cut(models.graph.set_losses(subsets(spark, n), models.nodes)) if n <= ALL_SETS else None
    b0, b1, b2 = models.fragility
    def acted(df: DataFrame, solved: DataFrame | None) -> DataFrame:
        """``df`` with ``plan``, ``spent`` and ``repaired``, which the policy and the condition decide."""
        plan = F.lit(None).cast("array<int>")
        for p in names:
            if p in known_policies:
                plan = F.when(F.col("policy") == p, known_policies[p](models.assets, F.col("condition"))).otherwise(plan)
        df = df.withColumn("plan", plan)
        if solved is not None:
            df = df.join(solved, ["policy", "condition"], "left").withColumn("plan", F.coalesce("solved", "plan")).drop("solved")
        return df.withColumns({
            "spent": A.total(F.transform("plan", lambda o, i: cost.at(i, o))),
            "repaired": F.zip_with("condition", "plan", lambda c, o: S.apply_reset(c, F.get(reset, o))),
        })

    for y in range(years):
        solved = cut(solved_plans(state, models)).withColumnRenamed("plan", "solved") if any(p in OPTIMISERS for p in names) else None
        asked = cut(state.select("policy", "condition").distinct()) if table is not None else None
        if asked is not None and asked.count() <= FEW_CONDITIONS:
            state = state.join(F.broadcast(cut(acted(asked, solved))), ["policy", "condition"])
        else:
            state = acted(state, solved)
        # an array goes into a lambda as its argument: read inside by place, it would be worked out for each place
        at = lambda c, y=y: F.get(F.col(c), F.lit(y))
        state = state.withColumns({
            "planned": F.col("planned") + F.col("spent"), "first_plan": F.coalesce("first_plan", "plan"),
            "condition": F.zip_with("repaired", at("det_u"), lambda c, u: A.next_state(F.get(cdf, c), u)),
        }).drop("spent", "repaired")
        chance = F.zip_with("condition", at("rain"), lambda c, r: S.sigmoid(b0 + b1 * c + b2 * F.ln(r)))
        state = state.withColumn("fails", F.zip_with(at("fail_u"), chance, lambda u, p: u < p))
        count = F.size(F.filter("fails", lambda f: f))
        sum_if = lambda values: A.total(F.zip_with(values, F.col("fails"), lambda v, f: F.when(f, v).otherwise(0.0)))
        state = state.withColumn("failed", F.filter(F.transform("fails", lambda f, i: F.when(f, i)), lambda i: i.isNotNull()))
        if table is None:
            state = cut(state)
        known = table if table is not None else cut(models.graph.set_losses(state.select("failed").distinct(), models.nodes))
        state = state.join(F.broadcast(known) if table is not None else known, "failed", "left")
        state = cut(state.withColumns({
            "person_days": F.col("person_days") + F.when(count > 0, sum_if(outage) / count * F.col("loss")).otherwise(0.0),
            "emergency": F.col("emergency") + sum_if(major) * models.premium,
            "condition": F.zip_with("condition", "fails", lambda c, f: F.when(f, 0).otherwise(c)),
        }).drop("failed", "loss", "fails", "plan"))
    out = ["policy", "s", "person_days", "planned", "emergency"]
    return state.select(*out, F.col("first_plan").alias("plan")) if keep_plans else state.select(*out)
