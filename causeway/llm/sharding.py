"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

How many rows of each input partition go to each shard is drawn first: row p of the
matrix is multivariate hypergeometric given what the shards still take, so that its rows
sum to the partitions' counts and its columns to the shards' sizes, and every assignment
of rows to shards is equally likely. It is drawn in two levels: the driver draws for blocks
of partitions, of a bounded number, and tasks draw the partitions of each block, which given
the block's row follow the same law. Each partition then permutes its rows and hands out
that many to each shard; after the exchange each shard permutes again. Shard sizes differ
by one at most, however the input lies and whatever it holds.

Only ids, sizes and checksums travel; they are written to the shared folder first, with
each row's partition and place, so that a lost executor can't draw again. Rows are dealt
one by one: repeated rows and equal texts are separate rows, each with its own slot. Null
texts have size 8 and the checksum of nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import cut, wrapped

#: numpy draws hypergeometric numbers from populations below this.
_NUMPY_MOST = 10**9
#: Rows that one task orders in the second permutation, about.
BUCKET_ROWS = 20_000
#: A matrix of so many entries is broadcast at most; a larger one is joined. The driver's own has as many at most.
BROADCAST_ENTRIES = 1 << 20
#: Blocks of partitions that the driver draws for, at most.
BLOCKS = 1024


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad < _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, draws))
    # inversion that walks away from the mode; expected steps follow the standard deviation
    lo, hi = max(0, draws - bad), min(draws, good)
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - p
    up, down, pu, pd = mode, mode, p, p
    while u > 0 and (up < hi or down > lo):
        if up < hi:
            pu *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > lo:
            pd *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode


def matrix(counts: list[int], sizes: list[int], seed: int | list[int] = 0) -> np.ndarray:
    """Rows: partitions, columns: shards; row sums ``counts``, column sums ``sizes``."""
    if sum(counts) != sum(sizes):
        raise ValueError("the shards take as many rows as there are")
    rng, left = np.random.default_rng(seed), list(sizes)
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for p, n in enumerate(counts):
        total, need = sum(left), n
        for k, room in enumerate(left):
            out[p, k] = got = _hypergeometric(rng, room, total - room, need)
            total, need = total - room, need - got
        left = [a - int(b) for a, b in zip(left, out[p], strict=True)]
    return out


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (k < n % shards) for k in range(shards)]


def dealt(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """``_part, _ends`` of ``_part, n``: how many rows of the partition go to the shards up to each one."""
    spark = counts.sparkSession
    last = counts.agg(F.max("_part")).collect()[0][0]
    width = -(-((last or 0) + 1) // max(1, min(BLOCKS, BROADCAST_ENTRIES // shards)))
    blocks = counts.withColumn("_block", F.floor(F.col("_part") / width))
    sums = sorted((r[0], r[1]) for r in blocks.groupBy("_block").agg(F.sum("n")).collect())
    drawn = matrix([n for _, n in sums], shard_sizes(sum(n for _, n in sums), shards), seed)
    sizes = spark.createDataFrame([(b, m.tolist()) for (b, _), m in zip(sums, drawn, strict=True)], "_block long, _sizes array<long>")

    def draw(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("_part")
        own = matrix(x["n"].tolist(), [int(v) for v in x["_sizes"].iloc[0]], [seed, int(x["_block"].iloc[0]) + 1])
        return pd.DataFrame({"_part": x["_part"], "_ends": own.cumsum(axis=1).tolist()})

    return blocks.join(F.broadcast(sizes), "_block").groupBy("_block").applyInPandas(draw, "_part long, _ends array<long>")


def shuffle_into(df: DataFrame, shards: int, seed: int = 0, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of every row (all by default), with ``shard`` and ``slot``.

    Slots are gapless from 0 in each shard and uniformly random. An empty table gives none.
    """
    names = [c for c in columns or df.columns if c not in ("shard", "slot")]
    rows = cut(wrapped(df.select(*names), {"_at": F.monotonically_increasing_id()}), spread=True)
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    counts = cut(rows.groupBy("_part").agg(F.count("*").alias("n")))
    parts, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).collect()[0]
    table = cut(dealt(counts, shards, seed))
    if parts * shards <= BROADCAST_ENTRIES:
        table = F.broadcast(table)
    first = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed), F.lit("first"), "_at"), "_at")
    rows = rows.withColumn("_rank", F.row_number().over(first)).join(table, "_part")
    rows = rows.withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))))
    # the second permutation: order by a random key, in buckets of keys so that no task takes a whole shard
    buckets = max(1, math.ceil(total / shards / BUCKET_ROWS))
    key = F.xxhash64(F.lit(seed), F.lit("second"), "_at")
    rows = rows.withColumns({"_key": key, "_bucket": F.shiftright(F.shiftrightunsigned(key, 33) * buckets, 31).cast("int")})
    rows = rows.select("row", "shard", "_key", "_bucket", "_at")
    sizes = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(F.shiftrightunsigned("_key", 1), "_at")
    rows = rows.withColumn("_in", F.row_number().over(inside)).join(base, ["shard", "_bucket"])
    return rows.select(*(F.col("row").getField(c).alias(c) for c in names), "shard", (F.col("_base") + F.col("_in") - 1).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document.

    The law is ``rows``: counts are at most one apart. So a group of equal texts is dealt like
    any rows - one that holds a third of the table couldn't stay in one shard - and a row's
    shard depends on all others, so ``grown_shard`` is null.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffle_into(slim, shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
