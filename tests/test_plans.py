import dataclasses
import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators import metrics
from causeway.operators.access import Graph, Roads
from causeway.plans import experiments as X
from causeway.plans import optimize as O
from causeway.plans import policies as P
from causeway.plans.simulate import Models, simulate
from causeway.sources import files
from causeway.sources.synthetic import make_scenarios


def test_fragility_and_costs(spark):
    df = spark.createDataFrame([(c, r) for c in range(4) for r in (0.5, 1.0, 2.0)], "c int, r double")
    p = {(x["c"], x["r"]): x["p"] for x in df.withColumn("p", S.failure_probability(F.col("c"), F.col("r"))).collect()}
    assert all(0 < v < 1 for v in p.values()) and p[0, 1.0] < p[1, 1.0] < p[3, 1.0] and p[1, 0.5] < p[1, 1.0] < p[1, 2.0]
    with pytest.raises(Exception, match="rain ratios"):
        df.select(S.failure_probability(F.col("c"), F.lit(0.0))).collect()
    table = {(r["structure_type"], r["opt"]): r for r in S.cost_table(spark).collect()}
    assert table["culvert", "major"]["cost"] == 0.08 and table["major_bridge", "replace"]["cost"] == 3.0 and table["culvert", "none"]["cost"] == 0
    with pytest.raises(Exception, match="unknown structure type"):
        S.with_costs(spark.createDataFrame([("tunnel",)], "structure_type string")).collect()


def test_repairs_round_halves_to_even(spark):
    df = spark.createDataFrame([(3, 0.5), (2, 0.5), (1, 0.5), (3, 2.0), (3, 4.0), (2, 0.0), (0, 0.5)], "s int, r double")
    assert [r[0] for r in df.select(S.apply_reset(F.col("s"), F.col("r"))).collect()] == [2, 2, 0, 1, 0, 2, 0]


def test_tails(spark):
    df = spark.createDataFrame([("p", float(v)) for v in (1, 2, 3, 4, 5)], "policy string, v double")
    for a, want in ((0.2, 5.0), (0.4, 4.5), (1.0, 3.0)):
        assert metrics.cvar(df, "v", ["policy"], a).collect()[0]["cvar"] == want == O.cvar([1, 2, 3, 4, 5], a)
    same = spark.createDataFrame([("p", 1.0)] * 7 + [("p", 2.0)] * 3, "policy string, v double")
    assert metrics.cvar(same, "v", ["policy"], 0.5).collect()[0]["cvar"] == pytest.approx(1.6)
    with pytest.raises(ValueError):
        metrics.cvar(df, "v", ["policy"], 0)


def test_tails_of_many_values_sort_one_range_a_group(spark):
    rng = np.random.default_rng(5)
    values = {"a": rng.normal(0, 9, 4000), "b": rng.integers(-3, 4, 700).astype(float), None: rng.exponential(2, 90), "one": np.array([-7.5])}
    rows = [(k, float(v), 1) for k, x in values.items() for v in x] + [("b", None, 1), ("nothing", None, 1)]
    df = spark.createDataFrame(rows, "policy string, v double, c int")
    for alpha in (0.01, 0.05, 0.37, 1.0):
        out = metrics.cvar(df, "v", ["policy"], alpha)
        assert {r["policy"]: r["cvar"] for r in out.collect()} == pytest.approx({k: O.cvar(x, alpha) for k, x in values.items()})
    windows = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in x]
    assert windows and all("windowspecdefinition(policy" in x for x in windows)
    assert metrics.cvar(df.where("false"), "v", ["policy"]).count() == 0
    assert metrics.cvar(df, "v", []).collect()[0]["cvar"] == pytest.approx(O.cvar(np.concatenate(list(values.values()))))


def test_regret_and_pairs(spark):
    loss = np.array([[5, 6, 7, 8.0], [1, 2, 3, 4.0], [2, 3, 4, 9.0]])
    df = spark.createDataFrame([(f"p{i}", d, float(loss[i, d])) for i in range(3) for d in range(4)], "policy string, draw int, loss double")
    r = {x["policy"]: x for x in metrics.robustness(df).collect()}
    assert r["p1"]["win_rate"] == 1 and r["p0"]["max_regret"] == 4
    rng = np.random.default_rng(0)
    rows = [(p, s, float(v), 1.0, 0.0) for p, m in (("a", 1.0), ("b", 0.0)) for s, v in enumerate(rng.normal(m, 0.5, 50))]
    out = spark.createDataFrame(rows, "policy string, s int, person_days double, planned double, emergency double")
    ci = metrics.paired_bootstrap(metrics.paired(out, "a", "b"), 2000).collect()[0]
    assert ci["lo"] > 0 and ci["lo"] < ci["mean"] < ci["hi"]
    with pytest.raises(Exception, match="scenarios differ"):
        metrics.paired(out.where("NOT (policy = 'a' AND s = 3)"), "a", "b").collect()


def chosen(spark, policy, assets, condition):
    df = spark.createDataFrame([(condition,)], "condition array<int>")
    return df.select(policy(assets, F.col("condition"))).collect()[0][0]


def greedy(assets, condition, score):
    """Plain Python of the greedy rule."""
    rows = [(-score[i] / assets.cost[i][c], i, c) for i, c in enumerate(condition) if c and score[i] > 0]
    plan, spent, used = [0] * len(condition), 0.0, 0.0
    for _, i, c in sorted(rows):
        if spent + assets.cost[i][c] <= assets.budget + 1e-9 and used + assets.labour[i][c] <= assets.crew + 1e-9:
            plan[i], spent, used = c, spent + assets.cost[i][c], used + assets.labour[i][c]
    return plan


def test_policies(spark):
    rng = np.random.default_rng(1)
    for _ in range(4):
        types = [str(t) for t in rng.choice(list(S.BASE_COST_CRORE), 7)]
        a = P.Assets(types, [float(x) for x in rng.integers(0, 50, 7)], float(rng.uniform(0.1, 2)), float(rng.uniform(20, 200)))
        cond = [int(c) for c in rng.integers(0, 4, 7)]
        assert chosen(spark, P.do_nothing, a, cond) == [0] * 7
        assert chosen(spark, P.worst_first, a, cond) == greedy(a, cond, cond)
        assert chosen(spark, P.criticality_weighted, a, cond) == greedy(a, cond, [c * (1 + c) for c in cond])
        assert chosen(spark, P.benefit_cost, a, cond) == greedy(a, [1 if b > 0 else 0 for b in a.benefit], a.benefit)
        for f in P.BASELINES.values():
            plan = chosen(spark, f, a, cond)
            assert sum(a.cost[i][o] for i, o in enumerate(plan)) <= a.budget + 1e-9 and sum(a.labour[i][o] for i, o in enumerate(plan)) <= a.crew + 1e-9
    with pytest.raises(KeyError):
        P.Assets(["tunnel"], [1.0], 1, 1)


def brute(inst, budget, crew, value):
    best = None
    for plan in itertools.product(*(range(inst.cost.shape[1]) for _ in range(len(inst.cost)))):
        c, w, loss = inst.take(list(plan))
        if c <= budget + 1e-9 and w <= crew + 1e-9 and (best is None or value(loss) < best[0] - 1e-12):
            best = (value(loss), list(plan))
    return best


def instance(seed, n=5, options=4, s=12):
    rng = np.random.default_rng(seed)
    base = rng.uniform(1, 20, (n, 1, s))
    keep = np.sort(rng.uniform(0.2, 1, (n, options)), axis=1)[:, ::-1]
    keep[:, 0] = 1
    cost = np.sort(rng.uniform(0, 8, (n, options)), axis=1)
    cost[:, 0] = 0
    return O.Instance(cost, cost * 0.7, base * keep[:, :, None])


@pytest.mark.parametrize("seed", range(4))
def test_optimum_against_enumeration(seed):
    inst = instance(seed)
    for budget, crew in ((0, 0), (8, 20), (15, 6), (1000, 1000)):
        plan = O.solve(inst, budget, crew)
        assert inst.feasible(plan, budget, crew) and inst.objective(plan) == pytest.approx(brute(inst, budget, crew, np.mean)[0])
    value = lambda x: x.mean() + 2 * O.tail_term(x, 0.05)
    plan = O.solve(inst, 12, 12, lam=2.0)
    assert value(inst.take(plan)[2]) == pytest.approx(brute(inst, 12, 12, value)[0])
    assert O.solve(inst, 0, 0) == [0] * 5


def test_time_limit():
    inst = instance(3, n=40, s=30)
    plan = O.solve(inst, 60, 60, time_limit=0.05)
    assert inst.feasible(plan, 60, 60) and inst.objective(plan) <= inst.objective([0] * 40)
    assert O.solve(instance(1), 8, 20, time_limit=60) == O.solve(instance(1), 8, 20)


def test_more_structures_than_bits(spark):
    """Seventy parallel culverts, and a policy of the caller's own."""
    n = 70
    edges = [e for i in range(n) for e in (("h", f"s{i}", 1.0), (f"s{i}", "f", 1.0))]
    g = Graph(edges, [("h", 10.0)], [("health", "f")], [("health", 10.0, 1.0)])
    m = Models([f"A{i}" for i in range(n)], [f"s{i}" for i in range(n)], ["culvert"] * n, [3] * n, 1.0, 500.0, g, np.eye(4), (60.0, 0.0, 0.0), opt_rain=np.ones((2, n)))
    first_only = lambda assets, condition: F.transform(condition, lambda c, i: F.when(i < 2, 3).otherwise(0))
    out = {r["policy"]: r for r in simulate(spark, ["do_nothing", "mine"], m, make_scenarios(n, 1, 1, 0), own={"mine": first_only}).collect()}
    assert out["do_nothing"]["person_days"] == pytest.approx(10 * 8.0) and out["mine"]["planned"] == pytest.approx(2 * 0.24)
    planner = m.planner()
    fails = np.eye(n, dtype=bool)
    assert planner.set_losses(fails).tolist() == [0.0] * n and planner.set_losses(np.ones((1, n), bool)).tolist() == [8.0]


def test_roads_as_tables(spark):
    d = X.make_district(n_junctions=8, n_habitations=4, n_structures=3, seed=2)
    m = X.build_models(d, X.Register.default(), 2)
    t = d.tables(spark)
    services = spark.createDataFrame([("health", 60.0, 1.0), ("school", 45.0, 1.0)], "facility_type string, cap_min double, weight double")
    roads = Roads(t["edges"], t["habitations"], t["facilities"], services)
    big = dataclasses.replace(m, graph=roads)
    assert big.solo == pytest.approx(m.solo)
    scen = make_scenarios(3, 2, 3, 0)
    plain = lambda x: {(r["policy"], r["s"]): (round(r["person_days"], 6), round(r["emergency"], 6)) for r in simulate(spark, ["worst_first"], x, scen).collect()}
    assert plain(big) == plain(m)
    with pytest.raises(ValueError):
        simulate(spark, ["network_aware"], big, scen)


def test_local_search_reaches_the_free_optimum():
    inst = instance(9)
    found, value = O.local_search(5, [0] * 5, lambda c: inst.objective(c))
    assert value == pytest.approx(inst.objective(O.solve(inst, 1e9, 1e9)))


def bridge(condition=1, fragility=(-2.0, 1.0, 1.5)):
    g = Graph([("h", "m", 1.2), ("m", "f", 1.2)], [("h", 100.0)], [("health", "f")], [("health", 60.0, 1.0)])
    from causeway.operators.markov import default_matrix

    return Models(["A1"], ["m"], ["minor_bridge"], [condition], 50.0, 200.0, g, default_matrix(), fragility, opt_rain=np.ones((4, 1)))


def test_simulator(spark):
    scen = make_scenarios(1, 3, 12, 0)
    names = ["do_nothing", "worst_first", "network_aware"]
    a = {(r["policy"], r["s"]): r for r in simulate(spark, names, bridge(), scen).collect()}
    assert a == {(r["policy"], r["s"]): r for r in simulate(spark, names, bridge(), scen).collect()} and len(a) == 36
    assert all(r["planned"] == 0 for (p, _), r in a.items() if p == "do_nothing") and sum(r["planned"] for (p, _), r in a.items() if p == "worst_first") > 0
    safe = simulate(spark, ["do_nothing"], bridge(fragility=(-60.0, 0.0, 0.0)), scen).collect()
    assert all(r["person_days"] == r["planned"] == r["emergency"] == 0 for r in safe)
    with pytest.raises(KeyError):
        simulate(spark, ["astrology"], bridge(), scen)
    with pytest.raises(ValueError):
        make_scenarios(2, 3, 4, 0, np.ones((1, 1, 1)))


def test_policies_plan_once_a_condition(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def mine(condition):
        asked.add(1)
        return [0] * len(condition)

    out = simulate(spark, ["mine"], bridge(), make_scenarios(1, 2, 400, 0), own={"mine": lambda assets, condition: mine(condition)})
    assert out.count() == 400 and 0 < asked.value < 100  # four conditions a year, not 400 scenarios


def test_simulator_against_plain_python(spark):
    """A year-by-year replay of one policy in Python."""
    d = X.make_district(n_junctions=12, n_habitations=6, n_structures=5, seed=2)
    d.budget_crore, d.crew_days = 0.4, 150.0
    m = X.build_models(d, X.Register.default(), 2)
    scen = make_scenarios(5, 3, 6, 4)
    got = {r["s"]: r for r in simulate(spark, ["worst_first"], m, scen).collect()}
    cdf = np.cumsum(m.transition, axis=1)
    for s in range(6):
        cond, days, planned, emergency = list(m.condition), 0.0, 0.0, 0.0
        for y in range(3):
            plan = greedy(m.assets, cond, cond)
            planned += sum(m.assets.cost[i][o] for i, o in enumerate(plan))
            cond = [max(0, min(3, round(c - S.RESET[S.OPTIONS[o]]))) for c, o in zip(cond, plan, strict=True)]
            cond = [min(3, int(np.searchsorted(cdf[c], scen.det_u[s, y, i], side="right"))) for i, c in enumerate(cond)]
            b0, b1, b2 = m.fragility
            fails = [i for i, c in enumerate(cond) if scen.fail_u[s, y, i] < 1 / (1 + np.exp(-(b0 + b1 * c + b2 * np.log(scen.rain[s, y, i]))))]
            if fails:
                days += np.mean([m.outage[i] for i in fails]) * m.graph.loss_of([m.nodes[i] for i in fails])
                emergency += sum(m.assets.cost[i][2] * m.premium for i in fails)
                cond = [0 if i in fails else c for i, c in enumerate(cond)]
        assert got[s]["person_days"] == pytest.approx(days) and got[s]["planned"] == pytest.approx(planned) and got[s]["emergency"] == pytest.approx(emergency)


def test_published_network_effects(spark):
    """Two rows of the published table, to float precision."""
    out = X.network_effects(spark, {"redundancies": [1, 2]})["by_redundancy"]
    one, two = (r["policies"] for r in out)
    assert one["do_nothing"]["mean_person_days"] == pytest.approx(26005.333333, abs=1e-4) and one["network_aware"]["mean_person_days"] == pytest.approx(19381.333333, abs=1e-4)
    assert two["network_aware"]["mean_person_days"] == pytest.approx(10794.666667, abs=1e-4) and two["worst_first"]["mean_person_days"] == pytest.approx(8709.333333, abs=1e-4)
    assert two["network_aware"]["person_days_per_crore"] == pytest.approx(3340.4852, abs=1e-3)


def test_published_allocation(spark):
    out = X.allocation(spark)
    rows = {r["policy"]: r for r in out["policies"]}
    assert rows["network_aware"]["mean_person_days"] == pytest.approx(151628.61, abs=0.01) and rows["siloed"]["mean_spend_crore"] == pytest.approx(11.6650, abs=1e-4)
    assert rows["random"]["cvar_person_days"] == pytest.approx(347808.01, abs=0.01) and [r["policy"] for r in out["policies"]][0] == "additive_milp"
    assert out["comparison"]["mean"] == pytest.approx(52807.57, abs=0.01) and out["comparison"]["ci_lo"] == pytest.approx(41031.33, abs=0.01) and out["comparison"]["ci_hi"] == pytest.approx(64767.70, abs=0.01)


def test_api(spark):
    p = X.normalize_params({"budget_crore": -5, "scenarios": 10000, "years": "x", "preset": "evil", "redundancy": 99})
    assert p["budget_crore"] == 0 and p["scenarios"] == 32 and p["years"] == 3 and p["preset"] == "generic" and p["redundancy"] == 4
    loss = X.run_loss({"redundancy": 2, "failed": ["S0", "S1"]})
    assert loss["set_loss"] == pytest.approx(368.0) and loss["sum_solo"] == 0 and loss["corridor_of"]["S2"] == 1
    assert X.run_loss({"redundancy": 2, "failed": ["S1", "S0"]}) is loss
    with pytest.raises(ValueError):
        X.run_loss({"failed": ["S99"]})
    run = X.run_experiment(spark, {"preset": "redundant", "scenarios": 4, "years": 1})
    assert run["ok"] and [r["policy"] for r in run["policies"]] == X.FIVE and X.run_experiment(spark, {"preset": "redundant", "scenarios": 4, "years": 1}) is run
    assert len(run["map"]["structures"]) == run["n_assets"] == 6
    json.dumps(run)


def test_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"seed": 4}')
    assert X.load_config(X.ALLOCATION, str(tmp_path / "c.json"))["seed"] == 4 and X.load_config(X.ALLOCATION)["years"] == 5
    assert files.read_json(tmp_path / "none.json") is None and files.read_text(tmp_path / "none.md") is None
    files.write_results({"a": 1}, tmp_path / "e1", "# t")
    assert files.read_json(tmp_path / "e1/results.json") == {"a": 1} and files.evidence(spark, tmp_path)["experiments"] == {"e1": {"a": 1}}
    df = spark.createDataFrame([(1, {"k": "v"})], "a int, m map<string,string>")
    files.write_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).dtypes == [("a", "int"), ("m", "string")]
    assert files.load_if_present(spark, str(tmp_path / "absent"), "a int").count() == 0
    assert files.table_markdown([{"p": "x", "v": 1.5}], {"p": "", "v": ".2f"}).splitlines()[2] == "| x | 1.50 |"


def test_deterioration_report(spark):
    rng = np.random.default_rng(0)
    rows = [(f"b{i}", y, int(min(3, max(0, (y - 2016 + i % 3) // 2))), float(y - 1990 + i % 30)) for i in range(60) for y in range(2016, 2024)]
    df = spark.createDataFrame(rows, "key string, year int, state4 int, age double")
    out = X.deterioration(df, gbm=False)
    names = {m["model"]: m for m in out["metrics"]}
    assert names["M0 Markov"]["log_loss"] < names["climatology"]["log_loss"] and out["n_pairs"] == 420


def folded(rows, budget, crew):
    """The greedy choice of ``(ord, key, cost, labour)`` rows, one after another."""
    spent, used, out = 0.0, 0.0, set()
    for o, k, c, w in sorted(rows, key=lambda r: (-r[1], r[0])):
        if c > 0 and k > 0 and spent + c <= budget + 1e-9 and used + w <= crew + 1e-9:
            spent, used = spent + c, used + w
            out.add(o)
    return out


@pytest.mark.parametrize("most", [10_000, 0, 150])
def test_greedy_groups_of_any_size(spark, monkeypatch, most):
    monkeypatch.setattr(P, "FOLD_MOST", most)
    rng, rows, limits = np.random.default_rng(5), [], {}
    for g in range(12):
        limits[g] = (float(rng.integers(0, 60)), float(rng.integers(0, 90)))
        rows += [(g, i, float(rng.integers(-1, 9)), float(rng.integers(0, 40)) / 4, float(rng.integers(0, 40)) / 4, *limits[g]) for i in range(int(rng.integers(1, 300)))]
    df = spark.createDataFrame(rows, "g int, ord int, key double, cost double, labour double, budget double, crew double")
    got = P.greedy_select(df, ["g"], "budget", "crew")
    assert got.columns == ["g", "ord", "key", "cost", "labour", "budget", "crew"]
    got = got.groupBy("g").agg(F.collect_set("ord")).collect()
    want = {g: folded([r[1:5] for r in rows if r[0] == g], *limits[g]) for g in limits}
    assert {g: set(o) for g, o in got} == {g: o for g, o in want.items() if o}


def test_greedy_of_one_very_large_group(spark, monkeypatch):
    """No row of the plan holds a group's candidates, and few rounds do."""
    rounds = []
    monkeypatch.setattr(P, "cut", lambda df, own=P.cut: rounds.append(df) or own(df))
    df = spark.range(1_000_000).select(F.lit(1).alias("g"), F.col("id").alias("ord"), ((F.col("id") * 7919) % 1000003 + 1).cast("double").alias("key"), (1 + F.col("id") % 17).cast("double").alias("cost"), (1 + F.col("id") % 5).cast("double").alias("labour"), F.lit(1e5).alias("budget"), F.lit(1e9).alias("crew"))
    got = P.greedy_select(df, ["g"], "budget", "crew")
    i = np.arange(1_000_000)
    order = np.argsort(-((i * 7919) % 1000003 + 1), kind="stable")
    spent, want = 0, []
    for o in order:
        if spent + 1 + o % 17 <= 1e5:
            spent += 1 + o % 17
            want.append(o)
    assert sorted(r["ord"] for r in got.select("ord").collect()) == sorted(want)
    assert len(rounds) <= 12
    assert not any("collect_list" in d._jdf.queryExecution().optimizedPlan().toString() for d in rounds)
