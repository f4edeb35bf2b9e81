"""Approximate nearest neighbours: NN-descent builds the graph, greedy search answers.

The graph starts from exact neighbours inside blocks of points that lie on the same sides
of random planes. Then, round by round, every point joins its neighbours and the points that
have it as a neighbour with each other: neighbours of neighbours become candidates, and a
candidate nearer than a point's last neighbour replaces it. Only pairs with an entry that
is new since the last round are looked at, so the vectors travel only to points with such
an entry. Rounds are Spark joins of the edge table with the vectors, and end when few
entries change (``ENOUGH``; ``ROUNDS`` at the latest). A point that very many have as a
neighbour hands on a part of them, dealt by hash, each round.

A search keeps, for each query, the ``beam`` nearest points found; each round it visits the
neighbours of the nearest ones not yet expanded, and it ends when all of them are. Queries
that are rows themselves start from their own place in the graph.

Rows with identical vectors are one point of the graph. A point keeps the ids of its rows,
and a hit on it is expanded to them, so equal distances go to the smaller ``vec_id``
however many rows share a vector.

Graph building works on the vectors as they are, in single precision if that is how they
are given, else in double, and computes in double; so no row's size changes what is kept
of another. Distances that are returned are Euclidean, in double precision. Vectors that
are null, empty, zero, or hold null or non-finite components take no part. A distance needs
equal lengths, so vectors of each length are searched by themselves. Rows that share an id
count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import cut, shuffle_partitions

DEGREE, BEAM, EXPAND = 40, 192, 48
#: So many queries' vectors are broadcast at most; more are joined.
BROADCAST_QUERIES = 20_000
#: Points of an initial block; how often blocks are made, from how many planes.
SEED_BLOCK, SEED_PASSES, SEED_PLANES = 512, 3, 12
#: Rounds at most, and the share of entries that ends them when no more are new.
ROUNDS, ENOUGH = 30, 0.01


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``id, x`` (array of double, no negative zeros) of the rows that take part; written to the shared folder."""
    x = F.transform(F.col(embedding).cast("array<double>"), lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v))
    own = df.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), x.alias("x"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    own = own.where(~F.exists("x", bad)).where(F.exists("x", lambda v: v != 0))
    return cut(own.groupBy("id").agg(F.max("x").alias("x")))


def distinct(points: DataFrame, most: int) -> DataFrame:
    """``id, x, members``: each vector once, named by its smallest id, with the ``most`` smallest
    ids of its rows in order. Written to the shared folder.

    A search for k rows never names more than the k + 1 smallest ids of a vector (one may be
    the query), so ``most`` = k + 1 leaves nothing out. The rows are cut to them before the
    shuffle, so a vector of very many rows makes no large task.
    """
    place = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    few = points.select("id", "x", place.alias("place")).where(F.col("place") <= most)
    each = few.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return cut(each.select(F.element_at("members", 1).alias("id"), "x", "members"))


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, told from where most of ``b`` lies:
    points that are near each other and far from 0 would lose their differences' digits."""
    if len(b):
        at = np.median(b, axis=0)
        a, b = a - at, b - at
    with np.errstate(over="ignore", invalid="ignore"):
        d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.where(np.isnan(d), np.inf, np.maximum(d, 0))  # squares beyond double precision are infinite


def kind_of(df: DataFrame, embedding: str = "embedding") -> str:
    """The numpy type that holds the vectors' components without loss."""
    return "<f4" if df.schema[embedding].dataType.elementType.typeName() in ("float", "short", "byte") else "<f8"


def packed(points: DataFrame, kind: str = "<f8") -> DataFrame:
    """``id, v``: the vectors as bytes, numbers of ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("x").flatten().to_numpy(zero_copy_only=False)
            m = flat.reshape(len(b), -1).astype(kind)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in m], pa.binary())], names=["id", "v"])

    return cut(points.select("id", "x").mapInArrow(run, "id long, v binary"))


def _seed(vectors: DataFrame, degree: int, salt: int, kind: str) -> DataFrame:
    """``id, other, d``: exact neighbours inside blocks of points in the order of which sides of
    random planes they lie on."""
    n = shuffle_partitions(vectors.sparkSession)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("v"), kind).astype(np.float64)
            if not len(m):
                continue
            m -= np.median(m, axis=0)  # planes through where the vectors lie
            sides = m @ np.random.default_rng(salt).normal(size=(m.shape[1], SEED_PLANES)) > 0
            along = sides @ (1 << np.arange(SEED_PLANES)[::-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(along.astype(np.int64))], names=["id", "v", "along"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks(end: bool):
            table = pa.Table.from_batches(held).combine_chunks()
            at = 0
            while len(table) - at >= 2 * SEED_BLOCK or end and at < len(table):
                k = SEED_BLOCK if len(table) - at >= 2 * SEED_BLOCK else len(table) - at
                c = table.slice(at, k)
                at += k
                m, ids = _matrix(c.column("v"), kind).astype(np.float64), c.column("id").to_numpy()
                d = _squares(m, m)
                np.fill_diagonal(d, np.inf)
                take = min(degree, k - 1)
                if take:
                    near = np.argpartition(d, take - 1, axis=1)[:, :take]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, take)), pa.array(ids[near].ravel()), pa.array(np.take_along_axis(d, near, 1).ravel())], names=["id", "other", "d"])
            held[:] = table.slice(at).to_batches()

        rows = 0
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= 4 * SEED_BLOCK:
                yield from blocks(False)
                rows = sum(map(len, held))
        if held:
            yield from blocks(True)

    ranged = vectors.mapInArrow(project, "id long, v binary, along long").repartitionByRange(n, "along", "id").sortWithinPartitions("along", "id")
    return ranged.select("id", "v").mapInArrow(run, "id long, other long, d double")


def _best(pairs: DataFrame, degree: int) -> DataFrame:
    """``id, near``: the ``degree`` nearest of ``id, other, d, new``, each once; old wins over new."""
    once = pairs.groupBy("id", "other").agg(F.min(F.struct("new", "d")).alias("e"))
    lists = once.groupBy("id").agg(F.collect_list(F.struct(F.col("e.d").alias("d"), "other", F.col("e.new").alias("new"))).alias("all"))
    return lists.select("id", F.slice(F.array_sort("all"), 1, degree).alias("near"))


def build_graph(vectors: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS, kind: str = "<f8") -> DataFrame:
    """``id, near`` (array of d, other, new) of every vector of ``packed``; written to the shared folder."""
    seeds = _seed(vectors, degree, 1, kind)
    for salt in range(2, SEED_PASSES + 1):
        seeds = seeds.union(_seed(vectors, degree, salt, kind))
    graph = cut(_best(seeds.withColumn("new", F.lit(True)), degree))
    total = graph.count()
    spark = vectors.sparkSession
    for turn in range(rounds):
        edges = graph.select("id", F.explode("near").alias("e")).select("id", F.col("e.other").alias("other"), F.col("e.new").alias("new"))
        # a hub's reverse edges are thinned to about `degree`, by hash, others this round than the next
        hubs = edges.groupBy("other").agg(F.count("*").alias("n")).where(F.col("n") > degree)
        draw = F.pmod(F.xxhash64(F.lit(turn), "id", "other"), F.lit(1 << 20)) / (1 << 20)
        back = edges.join(hubs, "other", "left").where(F.col("n").isNull() | (draw < degree / F.col("n"))).select(F.col("other").alias("id"), F.col("id").alias("other"), "new")
        # dealt by the point alone, which serves the window too: points without a new entry have no pair to look at
        around = edges.union(back).repartition(shuffle_partitions(spark), "id").groupBy("id", "other").agg(F.max("new").alias("new"))
        around = around.withColumn("any", F.max("new").over(Window.partitionBy("id"))).where("any").drop("any")
        last = F.when(F.size("near") >= degree, F.element_at("near", -1)["d"]).otherwise(F.lit(float("inf")))
        ends = vectors.join(graph, "id", "left").select(F.col("id").alias("other"), "v", F.coalesce(last, F.lit(float("inf"))).alias("last"))
        local = around.join(ends, "other").select("id", "other", "new", "v", "last")
        found = local.groupBy("id").applyInArrow(_local_join(kind), "id long, other long, d double").withColumn("new", F.lit(True))
        kept = graph.select("id", F.explode("near").alias("e")).select("id", F.col("e.other").alias("other"), F.col("e.d").alias("d"), F.lit(False).alias("new"))
        graph = cut(_best(found.union(kept), degree))
        spark.sparkContext._jvm.System.gc()  # so that the last round's shuffle files go before the next are written
        fresh = graph.agg(F.sum(F.size(F.filter("near", lambda e: e["new"])))).collect()[0][0] or 0
        if fresh < ENOUGH * degree * max(1, total):
            break
    return graph


def _local_join(kind: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """All pairs around one point that have a new entry and are nearer than either's last neighbour."""
        ids, new, last = (table.column(c).to_numpy() for c in ("other", "new", "last"))
        m = _matrix(table.column("v"), kind).astype(np.float64)
        d = _squares(m, m)
        ok = (new[:, None] | new[None, :]) & (d < last[:, None]) & (ids[:, None] != ids[None, :])
        i, j = np.nonzero(ok)
        return pa.table({"id": pa.array(ids[i]), "other": pa.array(ids[j]), "d": pa.array(d[i, j])})

    return run


def search(graph: DataFrame, points: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """The ``k`` nearest found of each query: ``query_id, rank, vec_id, score``.

    ``queries``: ``query_id, q`` (array of double) and ``start``, the ids to start from.
    The query's own id is no candidate. A search ends, as a point is expanded once for a query.
    """
    near = graph.select("id", F.transform("near", lambda e: e["other"]).alias("near"))
    asked = cut(queries.select("query_id", "q"))
    if asked.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        asked = F.broadcast(asked)
    tries = queries.select("query_id", F.explode("start").alias("id")).distinct()
    state = None  # query_id, found: array of (d, id, done), nearest first
    while True:
        there = tries.join(points, "id").join(asked, "query_id")
        scored = there.mapInArrow(_distances, "query_id long, id long, d double").where("id <> query_id")
        rows = scored.select("query_id", F.struct("d", "id", F.lit(False).alias("done")).alias("e"))
        if state is not None:
            rows = rows.union(state.select("query_id", F.explode("found").alias("e")))
        rows = rows.repartition(shuffle_partitions(graph.sparkSession), "query_id")  # serves both aggregates
        once = rows.groupBy("query_id", F.col("e.id").alias("id")).agg(F.max_by("e", F.col("e.done")).alias("e"))
        best = once.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list("e")), 1, beam).alias("found"))
        # expand the nearest that aren't yet, and mark them
        todo = F.slice(F.transform(F.filter("found", lambda e: ~e["done"]), lambda e: e["id"]), 1, expand)
        best = best.withColumn("todo", todo)
        marked = F.transform("found", lambda e: F.struct(e["d"].alias("d"), e["id"].alias("id"), (e["done"] | F.array_contains("todo", e["id"])).alias("done")))
        step = cut(best.select("query_id", marked.alias("found"), "todo"))
        state = step.select("query_id", "found")
        front = step.select("query_id", F.explode("todo").alias("id"))
        if not front.limit(1).count():
            break
        seen = state.select("query_id", F.explode("found").alias("e")).select("query_id", F.col("e.id").alias("id"))
        tries = front.join(near, "id").select("query_id", F.explode("near").alias("id")).distinct().join(seen, ["query_id", "id"], "left_anti")
    return state.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("pos", "e")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), F.col("e.d").alias("score"))


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not len(b):
            continue
        x, q = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) for c in ("x", "q"))
        d = np.sqrt(((x - q) ** 2).sum(axis=1))
        yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("id"), pa.array(d)], names=["query_id", "id", "d"])


def self_search(df: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: neighbours of the rows whose id is divisible by ``every``,
    among all other rows."""
    points, kind = usable(df), kind_of(df)
    sizes = sorted(r[0] for r in points.groupBy(F.size("x")).count().collect())
    out = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d in sizes:
        out = out.union(_self_search(points.where(F.size("x") == d), kind, every, k))
    return out


def _self_search(points: DataFrame, kind: str, every: int, k: int) -> DataFrame:
    """``self_search`` over vectors of one length.

    Should a query's part of the graph hold fewer than ``k`` points, it is asked again from
    points all over the graph.
    """
    nodes = distinct(points, k + 1)
    graph = build_graph(packed(nodes, kind), kind=kind)
    asked = points.where(F.pmod("id", F.lit(every)) == 0)
    few = asked.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    asked = cut((F.broadcast(asked) if few else asked).join(nodes.select(F.col("id").alias("node"), "x"), "x").select("id", "node"))
    own = nodes.join(asked.select(F.col("node").alias("id")).distinct(), "id", "left_semi").select("id", "x")
    starts = own.join(graph, "id", "left").select(F.col("id").alias("query_id"), F.col("x").alias("q"), F.coalesce(F.transform("near", lambda e: e["other"]), F.array().cast("array<long>")).alias("start"))
    found = cut(search(graph, nodes, cut(starts), k))
    total = nodes.count()
    full = found.groupBy("query_id").count().where(F.col("count") >= min(k, total - 1))
    short = own.join(full.withColumnRenamed("query_id", "id"), "id", "left_anti")
    if short.limit(1).count():
        spread = [r[0] for r in nodes.select("id").orderBy(F.xxhash64("id"), "id").limit(256).collect()]
        again = short.select(F.col("id").alias("query_id"), F.col("x").alias("q"), F.array(*(F.lit(i).cast("long") for i in spread)).alias("start"))
        more = search(graph, nodes, cut(again), k)
        found = cut(found.join(again.select("query_id"), "query_id", "left_anti").union(more))
    # hits and the query's own point become their rows; the k + 1 first hold the k first without the query
    hits = found.select("query_id", "vec_id", "score").union(own.select("id", "id", F.lit(0.0)))
    rows = hits.join(nodes.select(F.col("id").alias("vec_id"), "members"), "vec_id").select(F.col("query_id").alias("node"), "score", F.explode("members").alias("vec_id"))
    tops = rows.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k + 1).alias("top"))
    others = asked.join(F.broadcast(tops) if few else tops, "node").select(F.col("id").alias("query_id"), F.slice(F.filter("top", lambda e: e["vec_id"] != F.col("id")), 1, k).alias("top"))
    out = others.select("query_id", F.posexplode("top").alias("pos", "e"))
    return cut(out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score")))
