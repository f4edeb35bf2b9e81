"""Queries of the sources, sinks and column functions: files made of the driver's tables are read back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators import markov, metrics, network, survival
from causeway.operators.lineage import shared_folder
from causeway.plans.experiments import normalize_params
from causeway.plans.queries import LOSSES, PANEL, WAYS, _register_values
from causeway.plans.registry import query, r6, rounded
from causeway.register import Register
from causeway.sources import files
from causeway.sources import testdata as T
from causeway.sources.synthetic import make_redundant_district


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- sheets, roads, features -----------------------------------------------------------------


@query("""WITH raw AS (
    SELECT CAST(o_custkey % 50 AS VARCHAR) || '|' || o_orderkey AS key, CAST(2000 + year(o_orderdate) % 100 AS INTEGER) AS year,
           CASE WHEN o_orderkey % 7 <> 0 THEN 1950 + o_custkey % 150 END AS built, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 2 THEN 2000 + o_custkey % 20 END AS rehab,
           least(CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS BIGINT) % 10 END, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey * 7 % 10 END,
                 CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 10 END) AS r,
           CASE WHEN year(o_orderdate) % 2 = 0 AND o_orderkey % 13 <> 0 THEN floor(o_totalprice) END AS adt
    FROM orders)
SELECT key, year, CAST(CASE WHEN r >= 7 THEN 0 WHEN r >= 5 THEN 1 WHEN r >= 3 THEN 2 ELSE 3 END AS INTEGER) AS state4,
       CAST(coalesce(CASE WHEN year >= built THEN year - built END, -1) AS DOUBLE) AS age, CAST(coalesce(CASE WHEN rehab > 0 THEN year - rehab END, -99) AS DOUBLE) AS years_since_rehab,
       CAST(coalesce(adt, -1) AS DOUBLE) AS adt
FROM raw WHERE r IS NOT NULL""")
def inspection_sheets(spark, d):
    """Sheets of all years, with and without a column, as one panel."""
    folder = _folder(spark, "sheets")
    T.write_sheets(spark, d, folder)
    panel = files.load_sheets(spark, folder)
    return panel.select("key", "year", "state4", F.coalesce("age", F.lit(-1.0)).alias("age"), F.coalesce("years_since_rehab", F.lit(-99.0)).alias("years_since_rehab"), F.coalesce("adt", F.lit(-1.0)).alias("adt"))


TAGGED = """ways AS (
    SELECT CAST(c_nationkey AS VARCHAR) AS u, CAST(o_orderkey % 25 AS VARCHAR) AS v, o_orderkey AS ord, o_totalprice + o_orderkey / 1234567.0::DOUBLE AS length_m,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'motorway' WHEN '2-HIGH' THEN 'primary' WHEN '3-MEDIUM' THEN 'residential' WHEN '4-NOT SPECIFIED' THEN 'weird' WHEN '5-LOW' THEN 'track' END AS highway,
           CASE o_orderpriority WHEN '1-URGENT' THEN 80.0 WHEN '2-HIGH' THEN 55.0 WHEN '5-LOW' THEN 15.0 ELSE 30.0 END::DOUBLE AS speed_kph,
           o_orderkey % 6 IN (0, 3) AS is_bridge, o_orderkey % 8 = 0 OR o_orderkey % 9 = 0 AS is_culvert
    FROM orders JOIN customer ON o_custkey = c_custkey
), roads AS (
    SELECT least(u, v) AS src, greatest(u, v) AS dst, *, length_m / 1000.0::DOUBLE / speed_kph * 60.0::DOUBLE AS minutes FROM ways
    QUALIFY row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY length_m / 1000.0::DOUBLE / speed_kph * 60.0::DOUBLE, ord) = 1)"""


@query(f"WITH {TAGGED} SELECT src, dst, round(length_m, 6) AS length_m, highway, speed_kph, is_bridge, is_culvert, round(minutes, 6) AS travel_time_min FROM roads")
def graphml_roads(spark, d):
    """A tagged multigraph out of GraphML files, collapsed to its fastest edges."""
    folder = _folder(spark, "graphml")
    T.write_graphml(spark, d, folder)
    _, edges = files.load_graphml(spark, folder)
    return rounded(edges.select("src", "dst", "length_m", "highway", "speed_kph", "is_bridge", "is_culvert", "travel_time_min"), "length_m", "travel_time_min")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS node_id, n_nationkey + 0.5::DOUBLE AS x, CAST(n_regionkey AS DOUBLE) AS y, 'junction' AS kind FROM nation")
def graphml_nodes(spark, d):
    folder = _folder(spark, "graphml")
    T.write_graphml(spark, d, folder)
    return files.load_graphml(spark, folder)[0]


def _tagged_roads(spark, d):
    w = T.tagged_ways(spark, d)
    listed = lambda c: F.transform(F.split(F.regexp_replace(c, r"^\[|\]$", ""), ","), lambda v: F.btrim(v, F.lit(" '")))
    return network.routable(w.select("u", "v", "ord", "length", *(listed(c).alias(c) for c in ("highway", "bridge", "tunnel", "culvert"))))


@query(f"""WITH {TAGGED}, tagged AS (SELECT src AS edge_u, dst AS edge_v FROM roads WHERE is_bridge OR is_culvert)
SELECT *, 'tag' AS source FROM tagged UNION ALL (SELECT src, dst, 'crossing' FROM roads WHERE highway = 'motorway' AND NOT (is_bridge OR is_culvert))""")
def structures_sink(spark, d):
    """Tagged edges and inferred crossings, written and read again."""
    edges, at = _tagged_roads(spark, d), _folder(spark, "structures")
    files.write_table(files.structures_table(edges, edges.where("highway = 'motorway'")), at)
    return spark.read.parquet(at)


@query("""WITH f AS (SELECT vec_id, label, (CAST(embedding[1] AS DOUBLE) * 1000 + CAST(embedding[3] AS DOUBLE) * 1000) / 2 AS x, (CAST(embedding[2] AS DOUBLE) * 1000 + CAST(embedding[4] AS DOUBLE) * 1000) / 2 AS y FROM embeddings WHERE vec_id % 10 <> 9)
SELECT CASE WHEN label % 6 IN (0, 3) THEN 'health' ELSE 'school' END AS facility_type, round(x, 6) AS x, round(y, 6) AS y, 'f' || vec_id AS name FROM f WHERE label % 6 IN (0, 1, 3, 5)""")
def facilities(spark, d):
    return rounded(network.facilities_of(T.features(spark, d)), "x", "y")


@query("""SELECT round((CAST(embedding[1] AS DOUBLE) * 1000 + CAST(embedding[3] AS DOUBLE) * 1000) / 2, 6) AS x, round((CAST(embedding[2] AS DOUBLE) * 1000 + CAST(embedding[4] AS DOUBLE) * 1000) / 2, 6) AS y,
    'f' || vec_id AS name, CASE WHEN vec_id % 2 = 0 THEN 'village' ELSE 'town' END AS place,
    CAST(coalesce(CASE vec_id % 4 WHEN 0 THEN (1 + vec_id // 1000) * 1000 + vec_id % 1000 WHEN 2 THEN vec_id END, -1) AS DOUBLE) AS population FROM embeddings WHERE vec_id % 10 <> 9""")
def habitations(spark, d):
    return rounded(network.habitations_of(T.features(spark, d)).withColumn("population", F.coalesce("population", F.lit(-1.0))), "x", "y")


@query(f"""WITH {WAYS} SELECT src, dst, round(arg_max(length_m, (ord, length_m)), 6) AS length_m, arg_max(road_class, (ord, length_m)) AS road_class, round(arg_max(travel_time_min, (ord, length_m)), 6) AS travel_time_min FROM timed GROUP BY src, dst""")
def build_network(spark, d):
    """Junctions and roads as a network: the last of repeated roads counts."""
    n = T.read(spark, d, "nation").select(F.col("n_nationkey").alias("node_id"), F.col("n_nationkey").alias("x"), F.col("n_regionkey").alias("y"))
    _, edges = network.build_network(n, T.ways(spark, d).select("u", "v", "length_m", "road_class", F.struct("ord", "length_m").alias("ord")))
    return rounded(edges.select("src", "dst", "length_m", "road_class", "travel_time_min"), "length_m", "travel_time_min")


@query("""WITH homes AS (SELECT o_custkey AS node_id, CAST(count(*) AS DOUBLE) AS population FROM orders GROUP BY 1),
    places AS (SELECT o_custkey AS node_id, arg_max(CASE o_orderpriority WHEN '1-URGENT' THEN 'health' ELSE 'school' END, o_orderkey) AS facility_type FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1),
    structures AS (SELECT s_nationkey AS node_id, arg_max(CASE WHEN s_suppkey % 3 = 0 THEN 'major_bridge' ELSE 'culvert' END, s_suppkey) AS structure_type FROM supplier GROUP BY 1)
SELECT c_custkey AS node_id, round(c_acctbal, 6) AS x, CAST(c_nationkey AS DOUBLE) AS y, c_mktsegment AS kind, coalesce(population, -1) AS population, coalesce(facility_type, '-') AS facility_type, coalesce(structure_type, '-') AS structure_type
FROM customer LEFT JOIN homes ON homes.node_id = c_custkey LEFT JOIN places ON places.node_id = c_custkey LEFT JOIN structures ON structures.node_id = c_custkey""")
def map_nodes(spark, d):
    """Customers as the nodes of a map, with what lies at each."""
    o, s = T.read(spark, d, "orders"), T.read(spark, d, "supplier")
    nodes = T.read(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"), F.col("c_mktsegment").alias("kind"))
    homes = o.select(F.col("o_custkey").alias("node_id"), F.lit(1.0).alias("population"))
    served = S.lookup(F.col("o_orderpriority"), {"1-URGENT": "health", "2-HIGH": "school"})
    places = o.select(F.col("o_custkey").alias("node_id"), served.alias("facility_type"), F.col("o_orderkey").alias("ord"))
    kinds = F.when(F.col("s_suppkey") % 3 == 0, "major_bridge").otherwise("culvert")
    out = network.map_nodes(nodes, homes, places, s.select(F.col("s_nationkey").alias("node_id"), kinds.alias("structure_type"), F.col("s_suppkey").alias("ord")))
    named = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return rounded(out.select("node_id", "x", "y", "kind", F.coalesce("population", F.lit(-1.0)).alias("population"), named("facility_type"), named("structure_type")), "x")


@query("""SELECT event_id, replace(props, ' ', '') AS props, '{"' || event_type || '":' || user_id || '}' AS seen,
    'INTERVAL ' || chr(39) || event_id % 40 || ' 00:00:00' || chr(39) || ' DAY TO SECOND' AS lag, CASE WHEN event_id < 0 THEN '-' END AS nothing FROM events""")
def mixed_columns_sink(spark, d):
    """Columns that Parquet has no plain type for, written as text and read again."""
    at = _folder(spark, "mixed")
    e = T.read(spark, d, "events").select(
        "event_id", F.parse_json("props").alias("props"), F.create_map("event_type", "user_id").alias("seen"),
        F.make_dt_interval((F.col("event_id") % 40).cast("int")).alias("lag"), F.lit(None).alias("nothing"),
    )
    files.write_table(e, at)
    return spark.read.parquet(at)


@query("SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'absent', 0")
def optional_tables(spark, d):
    there = files.load_if_present(spark, f"{d}/nation.parquet", "n_nationkey bigint")
    absent = files.load_if_present(spark, f"{d}/no_such_table.parquet", "n_nationkey bigint")
    one = lambda name, df: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return one("nation", there).union(one("absent", absent))


@query(f"""WITH {LOSSES}, m AS (SELECT policy, median(loss) AS median FROM losses GROUP BY policy) SELECT policy, round(median, 4) AS median, '| ' || policy || ' | ' || printf('%.2f', round(median, 4)) || ' |' AS line FROM m""")
def results_sink(spark, d):
    """A report's JSON and Markdown, written to the shared folder and read again."""
    rows = [{"policy": r["policy"], "median": round(r["median"], 4)} for r in metrics.medians_and_ranges(T.policy_losses(spark, d), "loss", ["policy"]).collect()]
    at = _folder(spark, "results")
    files.write_results({"policies": rows}, at, files.table_markdown(rows, {"policy": "", "median": ".2f"}))
    lines = {x.split(" | ")[0].removeprefix("| "): x for x in files.read_text(f"{at}/results.md").splitlines()[2:]}
    return spark.createDataFrame([(r["policy"], r["median"], lines[r["policy"]]) for r in files.read_json(f"{at}/results.json")["policies"]], "policy string, median double, line string")


# --- column functions -------------------------------------------------------------------------------


@query("""SELECT s_suppkey AS ord, CAST(s_suppkey % 4 AS DOUBLE) AS score, CAST(CASE s_suppkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 30 ELSE 120 END AS DOUBLE) AS days,
    CAST(CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE CASE s_suppkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 30 ELSE 120 END END AS DOUBLE) AS own_days, CAST(30 AS DOUBLE) AS other_days,
    CAST(s_suppkey % 4 = 0 AS DOUBLE) AS x0, CAST(s_suppkey % 4 = 1 AS DOUBLE) AS x1, CAST(s_suppkey % 4 = 2 AS DOUBLE) AS x2, CAST(s_suppkey % 4 = 3 AS DOUBLE) AS x3,
    CAST(CASE WHEN s_suppkey % 5 < 4 THEN s_suppkey % 5 ELSE -1 END AS INTEGER) AS state FROM supplier""")
def structure_attributes(spark, d):
    """Condition scores, outage days with and without an override, selections as vectors, states by name."""
    a = T.assets(spark, d)
    names = F.get(F.array(*map(F.lit, ("Good", "Fair", "Poor", "Severe", "Lost"))), (F.col("ord") % 5).cast("int"))
    x = S.one_hot(S.default_option(F.col("condition")))
    days = S.outage_days(F.col("structure_type"), F.when(F.col("ord") % 5 == 0, 1.0))
    return a.select("ord", S.condition_score(F.col("condition")).alias("score"), S.outage_days(F.col("structure_type")).alias("days"), days.alias("own_days"), S.outage_days(F.lit("tunnel")).alias("other_days"), *(F.get(x, F.lit(j)).alias(f"x{j}") for j in range(4)), F.coalesce(S.state_index(names), F.lit(-1)).alias("state"))


@query("""SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 80 WHEN '2-HIGH' THEN 55 WHEN '3-MEDIUM' THEN 30 WHEN '5-LOW' THEN 12 ELSE 30 END AS DOUBLE) AS speed,
    CASE WHEN o_orderkey % 6 = 3 THEN 'viaduct' WHEN o_orderkey % 6 = 0 THEN 'yes' WHEN o_orderkey % 6 = 1 THEN 'no' WHEN o_orderkey % 6 = 2 THEN '' ELSE '-' END AS bridge, o_orderkey % 6 IN (0, 3) AS is_bridge FROM orders""")
def road_tags(spark, d):
    """Speeds of highway tags, an override among them, and the heads of list tags."""
    w = T.tagged_ways(spark, d)
    head = lambda c: F.btrim(S.first_of(F.split(F.regexp_replace(c, r"^\[|\]$", ""), ",")), F.lit(" '"))
    return w.select(F.col("ord").alias("o_orderkey"), S.highway_speed(head("highway"), {"track": 12.0}).alias("speed"), F.coalesce(head("bridge"), F.lit("-")).alias("bridge"), S.is_yes(head("bridge")).alias("is_bridge"))


@query("""SELECT c_custkey, trim(CAST(c_nationkey AS VARCHAR)) || '|' || c_name AS key, CAST(coalesce(CASE c_custkey % 4 WHEN 0 THEN c_acctbal WHEN 1 THEN c_nationkey END, -1e9) AS DOUBLE) AS number, CAST(-1 AS DOUBLE) AS absent FROM customer""")
def parsed_cells(spark, d):
    """Numbers from text cells, keys from padded ones, and a column that isn't there."""
    c = T.read(spark, d, "customer")
    cell = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" "), F.col("c_acctbal").cast("string"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.col("c_nationkey").cast("string"), F.lit("  "))).when(F.col("c_custkey") % 4 == 2, "N/A").otherwise("NaN")
    key = S.structure_key(F.concat(F.lit("  "), F.col("c_nationkey").cast("string")), F.concat(F.col("c_name"), F.lit(" ")))
    return c.select("c_custkey", key.alias("key"), F.coalesce(S.number(cell), F.lit(-1e9)).alias("number"), F.coalesce(S.number(S.column_or_null(c, "c_no_such_column")), F.lit(-1.0)).alias("absent"))


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'redundant' ELSE 'generic' END AS preset, round(greatest(0, least(5, c_acctbal / 1000)), 6) AS budget_crore,
    round(greatest(-1, least(2, c_nationkey / 5.0::DOUBLE - 2)), 6) AS stress, CAST(least(999, c_custkey) AS INTEGER) AS seed, CAST(CASE WHEN c_custkey % 3 = 0 THEN 8 ELSE greatest(4, least(32, c_nationkey)) END AS INTEGER) AS scenarios,
    CAST(greatest(1, least(5, c_nationkey - 3)) AS INTEGER) AS years, CAST(CASE WHEN c_custkey % 2 = 1 THEN 2 ELSE greatest(1, least(4, c_nationkey)) END AS INTEGER) AS redundancy FROM customer""")
def api_settings(spark, d):
    """Requests of every kind as valid settings."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = []
            for r in x.itertuples():
                body = {"preset": {"BUILDING": "redundant", "MACHINERY": "generic"}.get(r.c_mktsegment, r.c_mktsegment), "budget_crore": r.c_acctbal / 1000, "stress": str(r.c_nationkey / 5 - 2), "seed": r.c_custkey, "scenarios": "abc" if r.c_custkey % 3 == 0 else str(r.c_nationkey), "years": r.c_nationkey - 3}
                out.append({"c_custkey": r.c_custkey} | normalize_params(body | ({} if r.c_custkey % 2 else {"redundancy": r.c_nationkey})))
            yield pd.DataFrame(out)

    c = T.read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    out = c.mapInPandas(run, "c_custkey long, preset string, budget_crore double, stress double, seed int, scenarios int, years int, redundancy int")
    return rounded(out, "budget_crore", "stress")


@query(f"""WITH {_register_values()}, b AS (SELECT max("default") FILTER (name = 'fragility_beta0') AS b0, max("default") FILTER (name = 'fragility_beta1') AS b1, max("default") FILTER (name = 'fragility_beta2') AS b2 FROM register)
SELECT o_orderkey, round(1 / (1 + exp(-(b0 + b1 * (o_orderkey % 4) + b2 * ln((1 + o_custkey % 30) / 10.0::DOUBLE)))), 6) AS p FROM orders, b""")
def fragility_of_register(spark, d):
    register = Register.default()
    betas = [register.value(f"fragility_beta{i}") for i in range(3)]
    o = T.read(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.select("o_orderkey", r6(S.failure_probability(F.col("o_orderkey") % 4, (1 + F.col("o_custkey") % 30) / 10.0, *betas)).alias("p"))


# --- states and times --------------------------------------------------------------------------------


@query(f"WITH {PANEL} SELECT CASE state4 WHEN 0 THEN 'Good' WHEN 1 THEN 'Fair' WHEN 2 THEN 'Poor' ELSE 'Severe' END AS state, count(*) AS n FROM panel GROUP BY 1")
def state_histogram(spark, d):
    return metrics.state_histogram(T.panel(spark, d))


@query(f"""WITH {PANEL}, m AS (SELECT s, s_next, n / sum(n) OVER (PARTITION BY s) AS p FROM (VALUES
    (0, 0, 3.5), (0, 1, 9.5), (0, 2, 0.5), (0, 3, 0.5), (1, 0, 0.5), (1, 1, 3.5), (1, 2, 9.5), (1, 3, 0.5), (2, 0, 0.5), (2, 1, 0.5), (2, 2, 3.5), (2, 3, 8.0), (3, 0, 0.5), (3, 1, 0.5), (3, 2, 0.5), (3, 3, 10.5)) t(s, s_next, n))
SELECT CAST(s_next AS INTEGER) AS s_next, round(sum(p), 4) AS expected FROM panel JOIN m ON s = state4 GROUP BY s_next""")
def default_transition(spark, d):
    """How many structures the stand-in matrix expects in each state a year on."""
    rows = [(s, t, float(p)) for s, row in enumerate(markov.default_matrix(1.5)) for t, p in enumerate(row)]
    m = spark.createDataFrame(rows, "state4 int, s_next int, p double")
    counts = T.panel(spark, d).groupBy("state4").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(m), "state4").groupBy("s_next").agg(F.round(F.sum(F.col("n") * F.col("p")), 4).alias("expected"))


@query(f"""WITH {PANEL}, spells AS (SELECT key, CAST(greatest(1, least(5, coalesce(min(year) FILTER (state4 >= 2), max(year)) - min(year) + 1)) AS INTEGER) AS d, CAST(max(state4) >= 2 AS INTEGER) AS e FROM panel GROUP BY key),
periods AS (SELECT key % 7 AS grp, t, CASE WHEN t = d AND e = 1 THEN 1 ELSE 0 END AS label FROM spells, LATERAL (SELECT unnest(range(1, d + 1)) AS t)),
lt AS (SELECT grp, t, sum(label) / count(*) AS hazard FROM periods GROUP BY ALL),
s AS (SELECT grp, t, product(1 - hazard) OVER (PARTITION BY grp ORDER BY t) AS survival FROM lt)
SELECT grp, coalesce(min(t) FILTER (survival < 0.5), 5)::DOUBLE AS median_time FROM s GROUP BY grp""")
def median_times(spark, d):
    """The first year in which less than half of a group are left."""
    bad = F.min(F.when(F.col("state4") >= 2, F.col("year")))
    spells = T.panel(spark, d).groupBy("key").agg((F.coalesce(bad, F.max("year")) - F.min("year") + 1).alias("duration"), (F.max("state4") >= 2).cast("int").alias("event"))
    table = survival.life_table(spells.withColumn("grp", F.col("key") % 7), 5, ["grp"])
    curve = F.concat(F.array(F.lit(1.0)), F.transform(F.array_sort(F.collect_list(F.struct("t", "survival"))), lambda v: v["survival"]))
    return table.groupBy("grp").agg(curve.alias("s")).select("grp", survival.median_time(F.col("s"), 5).alias("median_time"))


@query("""WITH r AS (SELECT c, i, 'H' || c AS h, 'H' || c || '_j' || i AS j, 'structure:S' || (c * 2 + i) AS s FROM range(3) t(c), range(2) u(i)),
e AS (SELECT h AS a, j AS b, 1200.0::DOUBLE AS m FROM r UNION ALL SELECT j, s, 600 FROM r UNION ALL SELECT s, 'F', 600 FROM r)
SELECT least(a, b) AS src, greatest(a, b) AS dst, m AS length_m, round(m / 1000 / 30 * 60, 6) AS travel_time_min FROM e""")
def redundant_district(spark, d):
    return rounded(make_redundant_district(3, 2).tables(spark)["edges"].select("src", "dst", "length_m", "travel_time_min"), "travel_time_min")
