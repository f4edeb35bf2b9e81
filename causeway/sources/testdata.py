"""The operators' inputs as views over the driver's star-schema tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators import network
from causeway.operators.lineage import cut
from causeway.operators.metrics import portable_uniform
from causeway.operators.panel import SHEET
from causeway.sources.files import filesystem
from causeway.sources.synthetic import ScenarioTable

EVENT_TYPES = ("signup", "view", "click", "purchase", "error")
FLAG_CLASS = {"A": "rural", "N": "state", "R": "national"}
KINDS = ("culvert", "minor_bridge", "major_bridge")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated_orders(read(spark, sf_dir, "orders"))


def rated_orders(orders: DataFrame) -> DataFrame:
    """A rated inspection per order: ``key, year, state4, age``."""
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    deck, sub = F.floor("o_totalprice").cast("long") % 10, F.col("o_orderkey") % 10
    upper = F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") * 7 % 10)
    year = F.year("o_orderdate")
    built = (1950 + F.col("o_custkey") % 50).cast("int")
    return o.select(F.col("o_custkey").alias("key"), year.alias("year"), S.condition_state(deck, upper, sub).alias("state4"), S.age_at(year, built).alias("age"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (key, year): the best state seen."""
    return ratings(spark, sf_dir).groupBy("key", "year").agg(F.min("state4").alias("state4"), F.max("age").alias("age"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in order, as states: ``key, ts, seq, state``."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    kinds = F.array(*(F.lit(x) for x in EVENT_TYPES))
    return e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), (F.array_position(kinds, F.col("event_type")) - 1).cast("int").alias("state"))


def maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cell, block, value``: each user's largest event value of a day."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "value")
    return e.groupBy(F.col("user_id").alias("cell"), F.to_date("ts").alias("block")).agg(F.max("value").alias("value"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A road per line item between its customer's and its supplier's nation: ``u, v, ord, length_m, road_class, speed_kph, travel_time_min``."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    kind = F.create_map(*(F.lit(x) for kv in FLAG_CLASS.items() for x in kv))
    out = j.select(F.col("c_nationkey").alias("u"), F.col("s_nationkey").alias("v"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.col("l_extendedprice").alias("length_m"), F.try_element_at(kind, "l_returnflag").alias("road_class"))
    out = out.withColumn("speed_kph", S.class_speed(F.col("road_class")))
    return out.withColumn("travel_time_min", S.travel_minutes(F.col("length_m"), F.col("speed_kph")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse road graph of nations: the fastest road of a pair, the three fastest at each nation.

    The roads of the pairs are written, a few hundred: whoever reads them again doesn't join the line items again.
    """
    return network.cheapest_neighbours(cut(network.fastest_edges(ways(spark, sf_dir).where("u <> v"))))


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node_id, population``: customers by nation."""
    return read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("node_id")).agg(F.count("*").cast("double").alias("population"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``facility_type, node_id``: nations of region 0 give health care, of region 1 schools."""
    n = read(spark, sf_dir, "nation")
    kind = F.when(F.col("n_regionkey") == 0, "health").when(F.col("n_regionkey") == 1, "school")
    return n.select(kind.alias("facility_type"), F.col("n_nationkey").alias("node_id")).where("facility_type IS NOT NULL")


def services(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("health", 60.0, 1.0), ("school", 45.0, 0.5)], "facility_type string, cap_min double, weight double")


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of region 3 are structures: ``node``."""
    return read(spark, sf_dir, "nation").where("n_regionkey = 3").select(F.col("n_nationkey").alias("node"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, x, y, role``: the first two components in units of a thousandth."""
    e = read(spark, sf_dir, "embeddings")
    at = lambda k: F.get("embedding", F.lit(k)).cast("double") * 1000
    return e.select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), "label")


def polylines(spark: SparkSession, sf_dir: str, first: int) -> DataFrame:
    """``id, label, points``: a line of two points from four components."""
    e = read(spark, sf_dir, "embeddings")
    at = lambda k: F.get("embedding", F.lit(first + k)).cast("double") * 1000
    point = lambda i: F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y"))
    return e.select("vec_id", "label", F.array(point(0), point(1)).alias("points"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as assets of their nation: ``district, ord, structure_type, condition, benefit``."""
    s = read(spark, sf_dir, "supplier")
    kind = F.get(F.array(*(F.lit(k) for k in KINDS)), (F.col("s_suppkey") % 3).cast("int"))
    return s.select(F.col("s_nationkey").alias("district"), F.col("s_suppkey").alias("ord"), kind.alias("structure_type"), (F.col("s_suppkey") % 4).cast("int").alias("condition"), F.greatest("s_acctbal", F.lit(0.0)).alias("benefit"))


def policy_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``policy, s, loss``: discounts by flag and status (policies) and month (scenarios)."""
    li = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_shipdate", "l_extendedprice", "l_discount")
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    loss = F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4)
    return li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("policy"), month.alias("s")).agg(loss.alias("loss"))


def uniform(key):
    return portable_uniform(key)


# --- files made of the tables, to be read by the sources ---------------------------------------


def _text_files(df: DataFrame, folder: str, name: Column, head: str = "", foot: str = "") -> None:
    """Write ``line``s as text files below the shared ``folder``: one for each task, batch and ``name``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        for k, x in enumerate(frames):
            for at, own in x.groupby("name"):
                with system.open_output_stream(f"{root}/{part}-{k}-{at}") as f:
                    f.write("\n".join([*([own["head"].iloc[0]] if own["head"].iloc[0] else []), *own["line"], *([foot] if foot else []), ""]).encode())
            yield pd.DataFrame({"n": [len(x)]})

    rows = df.select("line", name.alias("name"), (F.col("head") if "head" in df.columns else F.lit(head)).alias("head"))
    rows.mapInPandas(run, "n long").write.format("noop").mode("overwrite").save()


def write_sheets(spark: SparkSession, sf_dir: str, folder: str, structure: str = "o_orderkey") -> None:
    """Orders as inspection sheets of a ``structure``, a year a name; every other year's sheets have no traffic column."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    key, cust, yy = F.col("o_orderkey"), F.col("o_custkey"), F.year("o_orderdate") % 100
    text = lambda c: c.cast("string")
    cells = {
        "state_code": F.concat(F.lit(" "), text(cust % 50)), "structure_id": F.concat(F.lit("  "), text(F.col(structure)), F.lit(" ")),
        "year_built": F.when(key % 7 == 0, "N").otherwise(text(1950 + cust % 150)),
        "year_rehab": F.when(key % 3 == 0, "0").when(key % 3 == 1, "").otherwise(text(2000 + cust % 20)),
        "deck": F.when(F.col("o_orderstatus") == "P", "N").otherwise(text(F.floor("o_totalprice") % 10)),
        "super": F.when(key % 11 == 0, "NA").otherwise(text(key * 7 % 10)), "sub": F.when(key % 5 == 0, "N").otherwise(text(cust % 10)), "culvert": F.lit("N"),
    }
    traffic = F.when(key % 13 == 0, "x").otherwise(text(F.floor("o_totalprice")))
    head = ",".join(SHEET[c] for c in cells)
    wide = yy % 2 == 0
    line = F.concat_ws(",", *cells.values())
    rows = o.select(F.when(wide, F.concat_ws(",", line, traffic)).otherwise(line).alias("line"), F.when(wide, f"{head},{SHEET['adt']}").otherwise(head).alias("head"), text(yy).alias("yy"))
    _text_files(rows, folder, F.concat(F.lit("sheet"), F.lpad("yy", 2, "0"), F.lit(".txt")))


def tagged_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagged way per order, from its customer's nation: ``u, v, ord, length`` and the tags as text, as files have them."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    key = F.col("o_orderkey")
    tags = {"1-URGENT": "motorway", "2-HIGH": "['primary', 'service']", "3-MEDIUM": "residential", "4-NOT SPECIFIED": "weird", "5-LOW": "track"}
    bridge = F.when(key % 6 == 0, "yes").when(key % 6 == 1, "no").when(key % 6 == 2, "").when(key % 6 == 3, "['viaduct', 'no']")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").cast("string").alias("u"), (key % 25).cast("string").alias("v"), key.alias("ord"), (F.col("o_totalprice") + key / F.lit(1234567.0)).alias("length"),
        S.lookup(F.col("o_orderpriority"), tags).alias("highway"), bridge.alias("bridge"), F.when(key % 8 == 0, "culvert").when(key % 8 == 1, "yes").alias("tunnel"), F.when(key % 9 == 0, "yes").alias("culvert"),
    )


def write_graphml(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The tagged ways and the nations as GraphML files."""
    names = ("length", "highway", "bridge", "tunnel", "culvert", "x", "y")
    keys = "".join(f'<key id="d{i}" for="{"node" if n in "xy" else "edge"}" attr.name="{n}" attr.type="string"/>' for i, n in enumerate(names))
    head = f'<?xml version="1.0" encoding="utf-8"?>\n<graphml>{keys}\n<graph edgedefault="directed">'
    cell = lambda n, c: F.coalesce(F.concat(F.lit(f'<data key="d{names.index(n)}">'), c.cast("string"), F.lit("</data>")), F.lit(""))
    w = tagged_ways(spark, sf_dir)
    edges = w.select(F.concat(F.lit('<edge source="'), "u", F.lit('" target="'), "v", F.lit('">'), *(cell(n, F.col(n)) for n in names[:5]), F.lit("</edge>")).alias("line"))
    n = read(spark, sf_dir, "nation")
    nodes = n.select(F.concat(F.lit('<node id="'), F.col("n_nationkey").cast("string"), F.lit('">'), cell("x", F.col("n_nationkey") + 0.5), cell("y", F.col("n_regionkey")), F.lit("</node>")).alias("line"))
    _text_files(edges.union(nodes), folder, F.lit("roads.graphml"), head, "</graph>\n</graphml>")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map features from embeddings: ``amenity, place, name, population, points``; every tenth has no geometry."""
    p = polylines(spark, sf_dir, 0)
    i = F.col("vec_id")
    amenity = S.lookup((F.col("label") % 6).cast("string"), {"0": " Hospital ", "1": "school", "2": "cafe", "3": "CLINIC", "5": "kindergarten"})
    grouped = F.concat((F.lit(1) + F.floor(i / 1000)).cast("string"), F.lit(","), F.lpad((i % 1000).cast("string"), 3, "0"))
    population = F.when(i % 4 == 0, grouped).when(i % 4 == 1, "unknown").when(i % 4 == 2, i.cast("string"))
    return p.select(amenity.alias("amenity"), F.when(i % 2 == 0, "village").otherwise("town").alias("place"), F.concat(F.lit("f"), i.cast("string")).alias("name"), population.alias("population"), F.when(i % 10 == 9, F.array().cast(p.schema["points"].dataType)).otherwise(F.col("points")).alias("points"))


# --- worlds and scenarios -------------------------------------------------------------------------

#: The least odd steps between the numbers of a scenario's three kinds.
_KINDS_APART = (0, 700_000_001, 1_400_000_003)


def scenarios(spark: SparkSession, sf_dir: str, n_assets: int, years: int = 3) -> ScenarioTable:
    """A scenario per customer, with numbers that any engine can repeat."""
    s = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s"))
    at = lambda y, a, kind: uniform((F.col("s") * years + y) * n_assets + a + _KINDS_APART[kind])
    nested = lambda f: F.transform(F.sequence(F.lit(0), F.lit(years - 1)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(n_assets - 1)), lambda a: f(y, a)))
    rain = nested(lambda y, a: F.exp(at(y, a, 0) * 1.2 - 0.4))
    return ScenarioTable(s.select("s", rain.alias("rain"), nested(lambda y, a: at(y, a, 1)).alias("det_u"), nested(lambda y, a: at(y, a, 2)).alias("fail_u")), years)
