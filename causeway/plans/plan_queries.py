"""Queries of the simulator and the optimisers, over a world made of the driver's tables.

The world: the roads, customers and facilities of the nations; the nations of region 3 are
structures. Each customer is a scenario, whose numbers any engine can repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators import access, markov
from causeway.operators.metrics import policy_summary
from causeway.plans import optimize, policies
from causeway.plans.queries import _LOSS, _SOLO, _U, ASSETS, SUBSETS, _times_sql
from causeway.plans.registry import query, r6, rounded
from causeway.plans.simulate import Models, simulate
from causeway.sources import testdata as T

N, YEARS, SAMPLES = 5, 3, 24
BUDGET, CREW = 0.6, 200.0
POLICIES = list(policies.BASELINES)


def _world(spark, d) -> tuple[access.Graph, list[int], list[str]]:
    graph = access.Graph.collect(T.edges(spark, d), T.homes(spark, d), T.places(spark, d), T.services(spark))
    nodes = sorted(r[0] for r in T.structures(spark, d).collect())
    return graph, nodes, [T.KINDS[n % 3] for n in nodes]


def _models(spark, d) -> Models:
    graph, nodes, kinds = _world(spark, d)
    return Models([f"A{n}" for n in nodes], nodes, kinds, [n % 4 for n in nodes], BUDGET, CREW, graph, markov.default_matrix(1.5))


# --- the simulator -------------------------------------------------------------------------------

_ORDER = np.arange(N)
np.random.default_rng(0).shuffle(_ORDER)
_OPTIONS = "opts AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (1, 1.0, 1.0, 0.5), (2, 4.0, 2.5, 2.0), (3, 12.0, 6.0, 4.0)) t(j, cm, lm, reset))"
_FACTS = f"""facts AS MATERIALIZED (SELECT c_custkey AS s, CAST(y AS INTEGER) AS y, CAST(a AS INTEGER) AS i, exp({_U(f"(c_custkey * {YEARS} + y) * {N} + a")} * 1.2::DOUBLE - 0.4::DOUBLE) AS rain,
    {_U(f"(c_custkey * {YEARS} + y) * {N} + a + {T._KINDS_APART[1]}")} AS det_u, {_U(f"(c_custkey * {YEARS} + y) * {N} + a + {T._KINDS_APART[2]}")} AS fail_u FROM customer, range({YEARS}) t(y), range({N}) u(a))"""
_WORLD = f"""{SUBSETS}, rates AS (SELECT * FROM (VALUES (0, 'culvert', 0.02::DOUBLE, 5.0::DOUBLE, 10.0::DOUBLE), (1, 'minor_bridge', 0.08, 20.0, 30.0), (2, 'major_bridge', 0.25, 60.0, 120.0)) t(k, kind, base, days, outage)),
{_OPTIONS}, struc AS MATERIALIZED (SELECT CAST(i AS INTEGER) AS i, node, kind, base, days, outage, CAST(node % 4 AS INTEGER) AS c0, (SELECT loss FROM subset WHERE mask = 1 << i) AS solo FROM names JOIN rates ON k = node % 3),
priced AS MATERIALIZED (SELECT i, j, base * cm AS cost, days * lm AS labour FROM struc, opts),
m AS (SELECT s, s_next, n / sum(n) OVER (PARTITION BY s) AS p FROM (VALUES
    (0, 0, 3.5), (0, 1, 9.5), (0, 2, 0.5), (0, 3, 0.5), (1, 0, 0.5), (1, 1, 3.5), (1, 2, 9.5), (1, 3, 0.5), (2, 0, 0.5), (2, 1, 0.5), (2, 2, 3.5), (2, 3, 8.0), (3, 0, 0.5), (3, 1, 0.5), (3, 2, 0.5), (3, 3, 10.5)) t(s, s_next, n)),
cdf AS MATERIALIZED (SELECT s, sum(p) OVER (PARTITION BY s ORDER BY s_next) AS c FROM m)"""


def _year_sql(y: int) -> str:
    """One year of all policies and scenarios: candidates, the greedy walk, repair, wear, failure."""
    turn = " ".join(f"WHEN {a} THEN {k}" for k, a in enumerate(_ORDER.tolist()))
    fits = "w.spent + c.cost <= c.budget + 1e-9 AND w.used + c.labour <= c.crew + 1e-9"
    return f"""cand{y} AS (
    SELECT st.policy, st.s, st.i, CASE WHEN policy = 'siloed' THEN a.kind ELSE '' END AS grp, p.j, p.cost, p.labour,
           CASE policy WHEN 'worst_first' THEN st.cond / p.cost WHEN 'criticality_weighted' THEN st.cond * (1.0::DOUBLE + st.cond) / p.cost WHEN 'random' THEN -(CASE st.i {turn} END)::DOUBLE ELSE a.solo / p.cost END AS key,
           CASE WHEN policy IN ('worst_first', 'criticality_weighted') THEN st.cond::DOUBLE ELSE a.solo END AS score,
           CASE WHEN policy = 'siloed' THEN {BUDGET}::DOUBLE / (SELECT count(DISTINCT kind) FROM struc) ELSE {BUDGET}::DOUBLE END AS budget,
           CASE WHEN policy = 'siloed' THEN {CREW}::DOUBLE / (SELECT count(DISTINCT kind) FROM struc) ELSE {CREW}::DOUBLE END AS crew
    FROM st{y} st JOIN struc a USING (i) JOIN priced p ON p.i = st.i AND p.j = CASE WHEN policy IN ('benefit_cost', 'random') THEN 1 ELSE st.cond END
    WHERE policy <> 'do_nothing' AND p.j > 0
), ranked{y} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY policy, s, grp ORDER BY key DESC, i) AS r FROM cand{y} WHERE score > 0),
walk{y} AS (SELECT DISTINCT policy, s, grp, 0::BIGINT AS r, 0.0::DOUBLE AS spent, 0.0::DOUBLE AS used, FALSE AS took FROM ranked{y}
    UNION ALL SELECT w.policy, w.s, w.grp, c.r, CASE WHEN {fits} THEN w.spent + c.cost ELSE w.spent END, CASE WHEN {fits} THEN w.used + c.labour ELSE w.used END, {fits}
    FROM walk{y} w JOIN ranked{y} c ON c.policy = w.policy AND c.s = w.s AND c.grp = w.grp AND c.r = w.r + 1),
done{y} AS MATERIALIZED (SELECT st.policy, st.s, st.i, coalesce(c.cost, 0) AS cost, greatest(0, least(3, round_even(st.cond - coalesce(o.reset, 0), 0))) AS fixed
    FROM st{y} st LEFT JOIN (SELECT c.* FROM ranked{y} c JOIN walk{y} w ON c.policy = w.policy AND c.s = w.s AND c.grp = w.grp AND c.r = w.r WHERE w.took) c ON c.policy = st.policy AND c.s = st.s AND c.i = st.i LEFT JOIN opts o ON o.j = c.j),
worn{y} AS (SELECT d.*, f.rain, f.fail_u, (SELECT least(3, count(*) FILTER (cdf.c <= f.det_u)) FROM cdf WHERE cdf.s = d.fixed) AS cond FROM done{y} d JOIN facts f ON f.s = d.s AND f.i = d.i AND f.y = {y}),
hit{y} AS MATERIALIZED (SELECT *, fail_u < 1 / (1 + exp(-(-3.0::DOUBLE + 1.2::DOUBLE * cond + 2.0::DOUBLE * ln(rain)))) AS fails FROM worn{y}),
sum{y} AS (SELECT policy, s, sum(h.cost) AS planned, count(*) FILTER (fails) AS n, sum(a.outage) FILTER (fails) AS days, coalesce(sum(1::BIGINT << h.i) FILTER (fails), 0)::BIGINT AS mask, coalesce(sum(p.cost) FILTER (fails), 0) * 1.8::DOUBLE AS emergency
    FROM hit{y} h JOIN struc a USING (i) JOIN priced p ON p.i = h.i AND p.j = 2 GROUP BY ALL),
st{y + 1} AS MATERIALIZED (SELECT policy, s, i, CASE WHEN fails THEN 0 ELSE cond END::INTEGER AS cond FROM hit{y})"""


_SIMULATED = f"""WITH RECURSIVE {_WORLD}, {_FACTS}, st0 AS MATERIALIZED (SELECT policy, c_custkey AS s, i, c0 AS cond FROM (SELECT unnest({POLICIES}) AS policy), customer, struc),
{", ".join(map(_year_sql, range(YEARS)))},
runs AS (SELECT policy, s, sum(CASE WHEN n > 0 THEN days / n * loss ELSE 0 END) AS person_days, sum(planned) AS planned, sum(emergency) AS emergency
    FROM ({" UNION ALL ".join(f"SELECT * FROM sum{y}" for y in range(YEARS))}) JOIN subset USING (mask) GROUP BY ALL)"""


def _runs(spark, d) -> DataFrame:
    models = _models(spark, d)
    return simulate(spark, POLICIES, models, T.scenarios(spark, d, len(models.nodes), YEARS))


@query(f"WITH {_FACTS} SELECT s, y, i AS ord, round(rain, 6) AS rain, round(det_u, 6) AS det_u, round(fail_u, 6) AS fail_u FROM facts")
def scenario_facts(spark, d):
    """The scenarios' numbers by year and structure."""
    x = T.scenarios(spark, d, N, YEARS).table(spark).select("s", F.posexplode(F.arrays_zip("rain", "det_u", "fail_u")).alias("y", "v"))
    return rounded(x.select("s", "y", F.posexplode(F.arrays_zip("v.rain", "v.det_u", "v.fail_u")).alias("ord", "w")).select("s", "y", "ord", "w.*"), "rain", "det_u", "fail_u")


@query(f"{_SIMULATED} SELECT policy, s, round(person_days, 4) AS person_days, round(planned, 6) AS planned, round(emergency, 6) AS emergency FROM runs")
def simulate_policies(spark, d):
    """Six policies in every scenario, three years."""
    return rounded(_runs(spark, d), "planned", "emergency").withColumn("person_days", F.round("person_days", 4))


@query(f"""{_SIMULATED}, tail AS (SELECT policy, avg(person_days) AS c FROM (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY person_days DESC) AS i, count(*) OVER (PARTITION BY policy) AS n FROM runs) WHERE i <= greatest(1, ceil(n * 0.1::DOUBLE)) GROUP BY policy)
SELECT policy, round(avg(person_days), 3) AS mean_person_days, round(avg(planned + emergency), 6) AS mean_spend_crore, round(any_value(c), 3) AS cvar_person_days FROM runs JOIN tail USING (policy) GROUP BY policy""")
def simulated_summary(spark, d):
    out = policy_summary(_runs(spark, d))
    return out.select("policy", F.round("mean_person_days", 3).alias("mean_person_days"), r6("mean_spend_crore").alias("mean_spend_crore"), F.round("cvar_person_days", 3).alias("cvar_person_days"))


@query(f"""WITH {_times_sql(_SOLO)}, loss AS ({_LOSS.replace("round(sum(", "sum(", 1).replace(", 6) AS loss", " AS loss", 1)})
SELECT CAST(set_id AS BIGINT) AS node, round(loss * CASE CAST(set_id AS BIGINT) % 3 WHEN 0 THEN 10 WHEN 1 THEN 30 ELSE 120 END, 4) AS cost FROM loss""")
def societal_costs(spark, d):
    """Days of outage times the loss of each structure alone."""
    f = T.structures(spark, d).select(F.col("node").cast("string").alias("set_id"), "node")
    out = access.losses(T.edges(spark, d), T.homes(spark, d), T.places(spark, d), T.services(spark), f.select("set_id"), f)
    node = F.col("set_id").cast("long")
    kind = F.get(F.array(*map(F.lit, T.KINDS)), (node % 3).cast("int"))
    return out.select(node.alias("node"), F.round(access.societal_cost(F.col("loss"), S.outage_days(kind)), 4).alias("cost"))


# --- optimisers ---------------------------------------------------------------------------------------

_OPT = f"""{_WORLD}, draws AS MATERIALIZED (SELECT CAST(r AS INTEGER) AS r, CAST(a AS INTEGER) AS i, exp({_U(f"r * {N} + a")} * 1.2::DOUBLE - 0.4::DOUBLE) AS rain, {_U(f"r * {N} + a + {T._KINDS_APART[1]}")} AS u FROM range({SAMPLES}) t(r), range({N}) v(a)),
plans AS MATERIALIZED (SELECT CAST(id AS INTEGER) AS plan, CAST(a AS INTEGER) AS i, CAST((id >> (2 * a)) & 3 AS INTEGER) AS j FROM range({4**N}) t(id), range({N}) u(a)),
totals AS MATERIALIZED (SELECT plan, sum(cost) AS cost, sum(labour) AS labour FROM plans JOIN priced USING (i, j) GROUP BY plan)"""


def _chance(condition: str) -> str:
    """P(fail) of structure and option in a draw, from its condition."""
    return f"exp(-0.35::DOUBLE * reset) / (1 + exp(-(-3.0::DOUBLE + 1.2::DOUBLE * greatest(0, least(3, round_even({condition} - reset, 0))) + 2.0::DOUBLE * ln(rain))))"


def _planner(spark, d) -> optimize.Planner:
    graph, nodes, kinds = _world(spark, d)
    x = np.arange(SAMPLES * len(nodes), dtype=object).reshape(SAMPLES, len(nodes))

    def number(k):
        for _ in range(3):
            k = (k * 1103515245 + 12345) % 2147483648
        return (k / 2147483648.0).astype(float)

    outage = [S.OUTAGE_DAYS[k] for k in kinds]
    return optimize.Planner(kinds, outage, nodes, graph, np.exp(number(x) * 1.2 - 0.4), 0, BUDGET, CREW, u=number((x + T._KINDS_APART[1]) % 2147483648).T)


@query(f"""WITH {_OPT}, chance AS MATERIALIZED (SELECT d.r, d.i, o.j, d.u < {_chance("a.c0")} AS fails, a.outage FROM draws d JOIN struc a USING (i), opts o),
sets AS (SELECT plan, r, count(*) FILTER (fails) AS n, sum(outage) FILTER (fails) AS days, coalesce(sum(1::BIGINT << i) FILTER (fails), 0)::BIGINT AS mask FROM plans JOIN chance USING (i, j) GROUP BY ALL)
SELECT plan, round(sum(CASE WHEN n > 0 THEN days / n * loss ELSE 0 END) / {SAMPLES} + 1e6 * (greatest(0, any_value(t.cost) - {BUDGET}::DOUBLE) + greatest(0, any_value(t.labour) - {CREW}::DOUBLE)), 3) AS value
FROM sets JOIN subset USING (mask) JOIN totals t USING (plan) GROUP BY plan""")
def plan_objectives(spark, d):
    """The network-aware objective of every plan: options of the structures as digits."""
    planner, nodes = _planner(spark, d), _world(spark, d)[1]
    given = spark.sparkContext.broadcast(planner)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        value = given.value.objective([n % 4 for n in nodes])
        for x in frames:
            yield pd.DataFrame({"plan": x["id"], "value": [round(value([(p >> (2 * a)) & 3 for a in range(len(nodes))]), 3) for p in x["id"].tolist()]})

    return spark.range(4 ** len(nodes)).mapInPandas(run, "plan int, value double")


@query(f"""WITH {_OPT}, states AS (SELECT CAST(v AS INTEGER) AS v, CAST(a AS INTEGER) AS i, (v * 7 + a * 3) % 4 AS c FROM range(16) t(v), range({N}) u(a)),
loss AS MATERIALIZED (SELECT s.v, s.i, o.j, avg({_chance("s.c")}) * any_value(a.outage * a.solo) AS loss FROM states s JOIN struc a USING (i) JOIN draws d USING (i), opts o GROUP BY s.v, s.i, o.j),
sums AS (SELECT v, plan, sum(loss) AS loss, any_value(t.cost) AS cost, any_value(t.labour) AS labour, list(p.j ORDER BY p.i) AS digits FROM plans p JOIN loss USING (i, j) JOIN totals t USING (plan) GROUP BY v, plan),
best AS (SELECT v, arg_min(plan, (round(loss, 7), round(cost, 9), digits)) AS plan FROM sums WHERE cost <= {BUDGET} + 1e-9 AND labour <= {CREW} + 1e-9 GROUP BY v)
SELECT v, i, j AS opt FROM best JOIN plans USING (plan)""")
def additive_plans(spark, d):
    """The additive optimum of several condition vectors, exact under budget and crew."""
    planner, n = _planner(spark, d), len(_world(spark, d)[1])
    given = spark.sparkContext.broadcast(planner)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame([(v, i, o) for v in x["id"].tolist() for i, o in enumerate(given.value.additive([(v * 7 + a * 3) % 4 for a in range(n)]))], columns=["v", "i", "opt"])

    return spark.range(16).mapInPandas(run, "v int, i int, opt int")


@query(f"""WITH {ASSETS}, u AS (SELECT *, 1 / (1 + exp(-(-3 + 1.2 * greatest(0, least(3, round_even(CAST(condition AS DOUBLE) - CASE j WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 2.0 ELSE 4.0 END, 0))))))
    * exp(-0.35 * CASE j WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 2.0 ELSE 4.0 END) * benefit + 1000 * cost AS value FROM costs)
SELECT district, ord, CAST(arg_min(j, (round(value, 6), j)) AS INTEGER) AS opt FROM u GROUP BY district, ord""")
def local_search(spark, d):
    """Each district's structures, searched from no repairs at all; money has a price instead of a limit."""
    a = S.with_costs(T.assets(spark, d))
    after = S.apply_reset(F.col("condition"), F.col("reset"))
    value = S.failure_probability(after, F.lit(1.0)) * F.col("factor") * F.col("benefit") + 1000 * F.col("cost")
    rows = a.groupBy("district", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("opt_ord", value.alias("value")))), lambda v: v["value"]).alias("values"))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("ord")
        values = np.round(np.stack(x["values"]), 6)
        at = np.arange(len(x))
        choice, _ = optimize.local_search(len(x), [0] * len(x), lambda c: float(values[at, c].sum()))
        return pd.DataFrame({"district": x["district"], "ord": x["ord"], "opt": choice})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy("district").applyInPandas(run, f"district {kinds['district']}, ord {kinds['ord']}, opt int")
