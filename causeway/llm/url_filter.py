"""URL filter: a memory-mapped array of 64-bit digests, probed by vectorised binary search.

A rule is a host and a path prefix with a verdict. It holds for its host and all
subdomains where the path starts with the rule's path; of several, the longest (host and
path together) wins, of these the one with the longer host, and of equal rules with both
verdicts ``block``. The index holds the xxhash of each rule's text in ascending order, and
the text itself: a hit counts only if the stored text is equal, so that collisions change
nothing.

An index of up to ``MAPPED_BYTES`` goes to every executor through Spark's own file
distribution and is mapped there, so workers of one machine share its pages. Larger rule
tables stay distributed: they are cut into shards by the digest's top bits, the distinct
digests of the probes are sent to the shards, each shard is searched in the same way, and
the hits' texts are compared with the urls they came from.

Urls that are null or have no ``://`` have an empty host and path; no rule fits them.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import shutil
import struct
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import ascii_lower, cut, small_batches

MAPPED_BYTES = 1 << 28
ALLOW, BLOCK = "allow", "block"
#: Probes of a batch that are held at once, about.
PROBES = 1 << 16
#: Parts a rule's text; no url's host holds it.
BAR = "\0"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host (A-Z lower-cased) and the path up to ? or #."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def build(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The index of (verdict, host, path) rules: a header, digests, offsets, verdicts and texts."""
    texts: dict[str, tuple[int, int]] = {}
    longest = 0
    for verdict, host, path in rules:
        if verdict not in (ALLOW, BLOCK):
            raise ValueError(f"unknown verdict {verdict!r}")
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        text, longest = host + BAR + path, max(longest, len(host))
        texts[text] = (max(verdict == BLOCK, texts.get(text, (0, 0))[0]), len(path))
    keyed = sorted((xxhash.xxh64_intdigest(t.encode()), t) for t in texts)
    raw = [t.encode() for _, t in keyed]
    head = json.dumps({"n": len(raw), "host": longest, "paths": sorted({texts[t][1] for t in texts})}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    return b"".join(
        (
            struct.pack("<q", len(head)),
            head,
            np.array([k for k, _ in keyed], "<u8").tobytes(),
            np.cumsum([0, *map(len, raw)]).astype("<i8").tobytes(),
            bytes(texts[t][0] for _, t in keyed),
            *raw,
        )
    )


class Index:
    """A view of a built index; ``raw`` is any buffer, such as a memory map."""

    def __init__(self, raw: np.ndarray):
        (n,) = struct.unpack("<q", raw[:8].tobytes())
        head = json.loads(raw[8 : 8 + n].tobytes())
        self.n, self.host, self.paths, at = head["n"], head["host"], head["paths"], 8 + n
        self.digests = raw[at : at + 8 * self.n].view("<u8")
        at += 8 * self.n
        self.offsets = raw[at : at + 8 * (self.n + 1)].view("<i8")
        at += 8 * (self.n + 1)
        self.verdicts, self.texts = raw[at : at + self.n], raw[at + self.n :]

    def text(self, i: int) -> str:
        return self.texts[self.offsets[i] : self.offsets[i + 1]].tobytes().decode()

    def equal(self, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each digest, where the equal ones begin and end in the index."""
        return np.searchsorted(self.digests, want), np.searchsorted(self.digests, want, "right")

    def find(self, keys: list[str]) -> np.ndarray:
        """The place of each key in the index, or -1."""
        first, stop = self.equal(np.fromiter(map(digest, keys), np.uint64, len(keys)))
        out = np.full(len(keys), -1)
        for i in np.flatnonzero(first < stop):
            out[i] = next((j for j in range(first[i], stop[i]) if self.text(j) == keys[i]), -1)
        return out


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


def domains(host: str, longest: int) -> list[str]:
    """The host and the domains it lies in, those of up to ``longest`` characters: however many
    labels a host has, only as many can be a rule's."""
    first = max(0, len(host) - longest - 1)
    whole = [host] if 0 < len(host) <= longest else []
    return whole + [host[i + 1 :] for i in range(first, len(host)) if host[i] == "."]


def probes(host: str, path: str, lengths: list[int], longest: int) -> list[str]:
    """Every rule text that would fit, the longest first, of equal lengths the longer host."""
    fit = [(len(d) + n, len(d), d + BAR + path[:n]) for d in domains(host, longest) for n in lengths if n <= len(path)]
    return [text for *_, text in sorted(fit, reverse=True)]


def _best(index: Index, hosts: list[str], paths: list[str]) -> tuple[list, list]:
    """Rule text and verdict for each url; one binary search for about ``PROBES`` probes."""
    pairs: dict[tuple[str, str], int] = {}
    longest = max(index.paths, default=0)
    rows = [pairs.setdefault((h, p[:longest]), len(pairs)) for h, p in zip(hosts, paths, strict=True)]
    best: list[int] = []
    keys: dict[str, int] = {}
    tries: list[list[int]] = []

    def search() -> None:
        found = index.find(list(keys)).tolist()
        best.extend(next((found[k] for k in t if found[k] >= 0), -1) for t in tries)
        keys.clear()
        tries.clear()

    for h, p in pairs:
        tries.append([keys.setdefault(k, len(keys)) for k in probes(h, p, index.paths, index.host)])
        if len(keys) >= PROBES:
            search()
    search()
    rule = [None if k < 0 else index.text(k).replace(BAR, "", 1) for k in best]
    verdict = [ALLOW if k < 0 else (ALLOW, BLOCK)[index.verdicts[k]] for k in best]
    return [rule[r] for r in rows], [verdict[r] for r in rows]


@lru_cache(maxsize=64)
def _served(name: str, index: bytes) -> str:
    """A file of the driver, which serves it to executors as long as the driver lives."""
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    with open(path := os.path.join(folder, name), "wb") as f:
        f.write(index)
    return path


def judge(df: DataFrame, index: bytes, url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` (``allow`` then).

    Columns of these names are replaced.
    """
    if len(index) > MAPPED_BYTES:
        raise ValueError("use judge_sharded for rule tables of this size")
    spark = df.sparkSession
    small_batches(spark)
    name = f"url-rules-{hashlib.sha256(index).hexdigest()[:24]}.idx"
    spark.sparkContext.addFile(_served(name, index))
    host, path = host_and_path(F.col(url))
    df = df.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = Index(np.memmap(SparkFiles.get(name), np.uint8, "r"))
        for b in batches:
            rule, verdict = _best(mapped, b.column("host").to_pylist(), b.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=[*b.schema.names, "rule", "verdict"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(apply, f"{schema}, rule string, verdict string")


def judge_sharded(df: DataFrame, rules: DataFrame, url: str = "url", shards: int = 256) -> DataFrame:
    """The same for a rule table (verdict, host, path) too large to be mapped everywhere.

    Rules with a null part fit nothing; another verdict than the two is an error.
    """
    small_batches(df.sparkSession)
    host, path = host_and_path(F.col(url))
    df = df.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    rules = rules.where("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL").select("verdict", ascii_lower(F.col("host")).alias("host"), "path")
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]  # as many as the longest path has characters, at most
    longest = rules.agg(F.max(F.length("host"))).first()[0] or 0
    head = F.substring("path", 1, max(lengths, default=0))

    def shard(d: np.ndarray) -> pa.Array:
        return pa.array((d >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).cast(pa.int32())

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.array([digest(h + BAR + p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, shard(d)], names=[*b.schema.names, "shard"])

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int]] = []

        def out() -> pa.RecordBatch:
            page, d, h, n = (np.array(x, np.uint64) for x in zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(page.view(np.int64)), pa.array(d.view(np.int64)), pa.array(h.astype(np.int32)), pa.array(n.astype(np.int32)), shard(d)], names=["page", "digest", "in_host", "in_path", "shard"])

        for b in batches:
            for page, h, p in zip(*(b.column(c).to_pylist() for c in ("page", "host", "head")), strict=True):
                for d in domains(h, longest):
                    held += [(page, digest(d + BAR + p[:n]), len(d), n) for n in lengths if n <= len(p)]
                    if len(held) >= PROBES:
                        yield out()
        if held:
            yield out()

    def search(keys: pa.Table, own: pa.Table) -> pa.Table:
        index = Index(np.frombuffer(build(zip(*(own.column(c).to_pylist() for c in ("verdict", "host", "path")), strict=True)), np.uint8))
        want = keys.column("digest").to_numpy().view(np.uint64)
        first, stop = index.equal(want)
        rows = [(int(want[i]), *index.text(j).split(BAR, 1), (ALLOW, BLOCK)[index.verdicts[j]]) for i in np.flatnonzero(first < stop) for j in range(first[i], stop[i])]
        d, h, p, v = zip(*rows, strict=True) if rows else ((),) * 4
        return pa.table({"digest": pa.array(np.array(d, np.uint64).view(np.int64)), "rule_host": pa.array(h, pa.string()), "rule_path": pa.array(p, pa.string()), "verdict": pa.array(v, pa.string())})

    # a hot host is one row here; numbered in the shared folder, so that a lost executor changes no number
    pages = cut(df.select("host", head.alias("head")).distinct().withColumn("page", F.monotonically_increasing_id()), spread=True)
    tries = pages.mapInArrow(tried, "page long, digest long, in_host int, in_path int, shard int")
    sides = rules.mapInArrow(dealt, "verdict string, host string, path string, shard int")
    hits = tries.select("digest", "shard").distinct().groupBy("shard").cogroup(sides.groupBy("shard")).applyInArrow(search, "digest long, rule_host string, rule_path string, verdict string")
    same = (F.expr("right(host, in_host)") == F.col("rule_host")) & (F.expr("left(head, in_path)") == F.col("rule_path"))
    fit = tries.drop("shard").join(hits, "digest").join(pages, "page").where(same)
    best = fit.groupBy("host", "head").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), F.struct(F.col("in_host") + F.col("in_path"), "in_host")).alias("best"))
    out = df.withColumn("head", head).join(best, ["host", "head"], "left")
    return out.select(*df.columns, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(ALLOW)).alias("verdict"))
