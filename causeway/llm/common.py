"""What the operators of this folder share: checkpoints, word shingles, small sketches."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and line contracts: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 5


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, may fall back to
    a folder of its own.
    """
    sc = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None):
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="causeway-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, spread: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage.

    Slim tables go to a file a core at most, since a file costs more than its rows (on a
    local disk Hadoop starts two processes for each, which share the executor's memory until
    they run); tables of the corpus's size stay ``spread`` over their own partitions, as do
    those whose rows name their task's partition. Where the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``, Spark deletes the files when
    nothing refers to them any more; else they stay until the folder is emptied.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    return (df if spread else df.coalesce(spark.sparkContext.defaultParallelism)).checkpoint()


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of long texts small: what Python workers hold follows them."""
    for key, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        have = spark.conf.get(key).removesuffix("b")
        if not have.isdigit() or not 0 < int(have) <= most:
            spark.conf.set(key, most)


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, and nothing else; lower() is cheaper, and the same for ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def wrapped(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """All columns as one struct ``row`` beside ``keys``: no name of ``df`` can clash with them."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(c.alias(k) for k, c in keys.items()))


def unwrapped(df: DataFrame, names: list[str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns that ``wrapped`` took, with some of them ``changed``."""
    changed = changed or {}
    return df.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in names))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that mixes all bits (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_R = 0x9E3779B97F4A7C15 | 1
_BYTE = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VALUE = _BYTE[_FOLD]
_WORD = np.ones(256, dtype=bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts that lie one after another in ``data``.

    Words are runs of bytes other than ``SPACE``, with A-Z lower-cased. Returns the hashes
    and, for each text, where its words begin (one more entry than texts).
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = _WORD[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < n)]
    start[edges] = inside[edges]
    stop[edges - 1] = inside[edges - 1]
    first, last = np.flatnonzero(start), np.flatnonzero(stop) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * _power(_R, n), out=sums[1:], dtype=np.uint64)
    h = (sums[last] - sums[first]) * _power(pow(_R, -1, 1 << 64), n)[first]
    h = splitmix(h + (last - first).astype(np.uint64))
    return h, np.searchsorted(first, bounds)


def shingle_sets(texts: pa.Array, most: int = 1 << 19):
    """Yield, for each text, the sorted distinct 64-bit hashes of its 5-word shingles.

    A text with one to four words has its whole sequence as the only shingle; a null or
    blank text has none. Texts are taken in runs of about ``most`` bytes, so that memory
    follows the longest text and not the batch.
    """
    texts = texts.cast(pa.large_binary()) if texts.null_count == 0 else texts.fill_null("").cast(pa.large_binary())
    if len(texts) == 0:
        return
    _, off, buf = texts.buffers()
    bounds = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    k = np.uint64(0xD6E8FEB86659FD93)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
        j = min(j, len(texts))
        words, at = word_hashes(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        if len(words) >= SHINGLE:
            s = words[: len(words) - SHINGLE + 1].copy()
            for x in range(1, SHINGLE):
                s *= k
                s += words[x : len(words) - SHINGLE + 1 + x]
            s = splitmix(s)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= SHINGLE:
                yield np.unique(s[a : b - SHINGLE + 1])
            elif b > a:
                h = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for w in words[a:b]:
                        h = h * k + w
                yield splitmix(np.array([h]))
            else:
                yield np.zeros(0, np.uint64)
        i = j
