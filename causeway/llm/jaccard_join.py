"""N-gram Jaccard join: a grouped prefix join over word shingles, exact at its threshold.

Documents with equal shingle sets are one class. Shingles are put in one global order,
rare ones first, by their counts over all documents in a count sketch of bounded size (the
sketch only orders: any order gives the same result). Two sets as similar as the threshold
share a shingle in their prefixes, so prefixes alone are joined. Classes with the same
prefix and size are one group and take part once; group pairs are filtered by size and by
how many prefix shingles they share, then expanded to their members, and members verified
on their whole sets.

A shingle that lies in very many prefixes would make pairs by the square. Its groups form a
cluster around the one whose prefix holds the commonest shingles: every member is verified
against that leader first, and only members not yet connected with it are compared with
the others, in blocks of ``BLOCK`` by ``CHUNK``, with no member left out. So every link is
found or implied, and the components are exact.

Null, blank and empty texts have no shingle and link with nothing. Rows with a null id
form no link and have no component; rows that share an id are one document with several
texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import cut, shingle_sets, shuffle_partitions, small_batches, splitmix
from causeway.llm.components import components

#: Links need a similarity of PERCENT / 100.
PERCENT = 80
#: Counters of the sketch (powers of two; eight a document within these), and of one of its pieces.
SKETCH, SKETCH_MOST, PIECE = 1 << 21, 1 << 24, 1 << 15
#: Longest list whose pairs are enumerated; longer ones form clusters.
LONGEST = 32
BLOCK, CHUNK = 256, 2048
#: Counts from here on are one in ``cut``, whose upper 20 bits hold them.
COMMON = (1 << 20) - 1
#: Bits of the filter that says which documents' sets are wanted (powers of two; eight an id within these).
FILTER_BITS, FILTER_MOST = 1 << 25, 1 << 28
#: Pairs of one document that a task verifies, about.
PAIRS = 4096


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def sized(n: int, least: int, most: int) -> int:
    """Eight for each of ``n``, as a power of two within bounds."""
    return min(most, max(least, 1 << max(0, 8 * n - 1).bit_length()))


def _packed(x: np.ndarray) -> bytes:
    """``x`` in the smallest type that holds it."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if x.max() <= np.iinfo(k).max)
    return np.dtype(kind).itemsize.to_bytes(1, "little") + x.astype(kind).tobytes()


def _pieces(array: np.ndarray, part: int) -> pa.RecordBatch:
    raw = [_packed(array[at : at + PIECE]) for at in range(0, len(array), PIECE)]
    n = len(raw)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([part >> 8] * n, pa.int32()), pa.array(raw, pa.binary())], names=["piece", "lot", "raw"])


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def _summed(pieces: DataFrame, size: int, how, kind=np.uint64) -> np.ndarray:
    """Combine the partitions' arrays piece by piece; what reaches the driver has a bounded size."""
    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(PIECE, np.uint64)
        for raw in table.column("raw"):
            x = _unpack(raw.as_py())
            total[: len(x)] = how(total[: len(x)], x)
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "raw": pa.array([_packed(total)], pa.binary())})

    lots = pieces.groupBy("piece", "lot").applyInArrow(merge, "piece int, raw binary")
    out = np.zeros(size, kind)
    for r in lots.groupBy("piece").applyInArrow(merge, "piece int, raw binary").collect():
        x = _unpack(bytes(r["raw"]))[: size - r["piece"] * PIECE]
        out[r["piece"] * PIECE :][: len(x)] = x
    return out


def shingle_counts(docs: DataFrame, size: int = SKETCH) -> np.ndarray:
    """How many documents' shingles fall on each counter of the sketch, over all documents."""
    shift = np.uint64(64 - (size.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some, n = np.zeros(size, np.int64), [], 0
        for b in batches:
            for h in shingle_sets(b.column(0)):
                some.append(h)
                n += len(h)
                if n > 1 << 20:
                    total += np.bincount((np.concatenate(some) >> shift).astype(np.int64), minlength=size)
                    some, n = [], 0
        if some:
            total += np.bincount((np.concatenate(some) >> shift).astype(np.int64), minlength=size)
        if total.any():
            yield _pieces(total, TaskContext.get().partitionId())

    return _summed(docs.select("text").mapInArrow(run, "piece int, lot int, raw binary"), size, np.add)


def _sign(h: np.ndarray, salt: int) -> int:
    return int(splitmix(h ^ np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64))


def prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """``doc_id, n, s1, s2, ps, cut, prefix`` of every row with an id; written to the shared folder.

    ``s1, s2`` sign the whole set and ``ps`` the prefix; ``cut`` is where the prefix ends in
    the global order: the count and 11 bits of the hash. All counts of ``COMMON`` or more have
    the same ``cut``, without hash bits, since those would put them in another order.
    """
    size = len(counts)
    shift = np.uint64(64 - (size.bit_length() - 1))
    given = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 32) - 1).astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = given.value
        for b in batches:
            rows: list[tuple] = []
            for h in shingle_sets(b.column("text")):
                n = len(h)
                if not n:
                    rows.append((0, 0, 0, 0, 0, None))
                    continue
                c = sketch[(h >> shift).astype(np.int64)]
                first = h[np.lexsort((h, c))[: prefix_length(n)]]
                end = int(first[-1])
                count = int(sketch[end >> int(shift)])
                where = count << 11 | end >> 53 if count < COMMON else COMMON << 11
                rows.append((n, _sign(h, 1), _sign(h, 2), _sign(first, 3), where, first.astype("<u8").tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], names=["doc_id", "n", "s1", "s2", "ps", "cut", "prefix"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    return cut(own.mapInArrow(run, "doc_id long, n int, s1 long, s2 long, ps long, cut int, prefix binary"), spread=True)


def _need(n1, c1, n2, c2):
    """How many prefix shingles a linked pair shares at least.

    The prefix that ends first in the global order is seen whole by the other: of its
    shingles at most n - overlap are missing there. On equal cuts (they are truncated) the
    smaller number holds.
    """
    overlap = -(-PERCENT * (n1 + n2) // (100 + PERCENT))
    one = n1 - -(-PERCENT * n1 // 100) + 1 - n1 + overlap
    two = n2 - -(-PERCENT * n2 // 100) + 1 - n2 + overlap
    return np.maximum(1, np.where(c1 < c2, one, np.where(c1 > c2, two, np.minimum(one, two))))


def lists(groups: DataFrame) -> DataFrame:
    """From ``gid, n, cut, prefix``: pairs of short lists (``b`` not null, ``need``) and the rows of long ones."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 4096):
                c = b.slice(at, 4096)
                parts = [np.frombuffer(x, "<u8") for x in c.column("prefix").to_pylist()]
                if not parts:
                    continue
                k = [len(x) for x in parts]
                h = (np.concatenate(parts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                gid = np.repeat(c.column("gid").to_numpy(), k)
                meta = np.repeat(c.column("n").to_numpy().astype(np.int64) << 32 | c.column("cut").to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(gid), pa.array(meta)], names=["h", "gid", "meta"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "a", "b", "meta", "need"]

        def long_rows(h, gid, meta):
            none = pa.nulls(len(h), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(gid), none, pa.array(meta), pa.nulls(len(h), pa.int32())], names=names)

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the list that the last batch ended in
        going = False  # its first rows are out already
        for b in batches:
            h, gid, meta = (b.column(c).to_numpy() for c in ("h", "gid", "meta"))
            if not len(h):
                continue
            if going and h[0] == held[0][0][0]:
                k = int(np.searchsorted(h != held[0][0][0], True)) if (h != held[0][0][0]).any() else len(h)
                yield long_rows(h[:k], gid[:k], meta[:k])
                h, gid, meta = h[k:], gid[k:], meta[k:]
                if not len(h):
                    continue
                held, going = [], False
            elif going:
                held, going = [], False
            if held:
                h, gid, meta = (np.concatenate([x[i] for x in held] + [y]) for i, y in enumerate((h, gid, meta)))
                held = []
            edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            last = int(edge[-1])
            if len(h) - last > LONGEST:
                yield long_rows(h[last:], gid[last:], meta[last:])
                held, going = [(h[last : last + 1], gid[:0], meta[:0])], True
            else:
                held = [(h[last:], gid[last:], meta[last:])]
            yield from _short(h[:last], gid[:last], meta[:last], edge[:-1], long_rows, names)
        if held and not going:
            h, gid, meta = held[0]
            yield from _short(h, gid, meta, np.zeros(1, np.int64), long_rows, names)

    rows = groups.mapInArrow(explode, "h int, gid long, meta long")
    rows = rows.repartition(shuffle_partitions(groups.sparkSession), "h").sortWithinPartitions("h", "gid")
    return cut(rows.mapInArrow(run, "h int, a long, b long, meta long, need int"), spread=True)


def _short(h, gid, meta, starts, long_rows, names) -> Iterator[pa.RecordBatch]:
    lengths = np.diff(np.r_[starts, len(h)])
    for k in np.unique(lengths[lengths > 1]):
        at = starts[lengths == k]
        if k > LONGEST:
            for s in at:
                yield long_rows(h[s : s + k], gid[s : s + k], meta[s : s + k])
            continue
        i, j = np.triu_indices(int(k), 1)
        step = max(1, 200_000 // len(i))
        for s in range(0, len(at), step):
            one, two = (at[s : s + step, None] + i).ravel(), (at[s : s + step, None] + j).ravel()
            n1, n2 = meta[one] >> 32, meta[two] >> 32
            ok = (100 * np.minimum(n1, n2) >= PERCENT * np.maximum(n1, n2)) & (gid[one] != gid[two])
            one, two, n1, n2 = one[ok], two[ok], n1[ok], n2[ok]
            need = _need(n1, meta[one] & 0xFFFFFFFF, n2, meta[two] & 0xFFFFFFFF).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h[one]), pa.array(gid[one]), pa.array(gid[two]), pa.nulls(len(one), pa.int64()), pa.array(need)], names=names)


def wanted(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of bounded size that holds all ``ids`` (one long column), and some more."""
    mask = np.uint64(bits - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(bits // 8, np.uint8)
        for b in batches:
            x = splitmix(b.column(0).to_numpy().view(np.uint64)) & mask
            np.bitwise_or.at(found, (x >> np.uint64(3)).astype(np.int64), np.uint8(1) << (x & np.uint64(7)).astype(np.uint8))
        at = np.flatnonzero(np.add.reduceat(found, np.arange(0, len(found), PIECE), dtype=np.int64))
        all_pieces = _pieces(found, TaskContext.get().partitionId()) if len(at) else None
        if all_pieces is not None:
            yield all_pieces.take(pa.array(at))

    return _summed(ids.mapInArrow(run, "piece int, lot int, raw binary"), bits // 8, lambda a, x: a | x, np.uint8)


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, shingles`` (sorted 64-bit hashes) of the documents in ``ids``, and of a few others
    (of all, where there are more ids than the filter has room for)."""
    found = wanted(ids, sized(ids.count(), FILTER_BITS, FILTER_MOST))
    given, mask = docs.sparkSession.sparkContext.broadcast(found), np.uint64(8 * len(found) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = given.value
        for b in batches:
            x = splitmix(b.column("doc_id").to_numpy().view(np.uint64)) & mask
            ok = held[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8) & 1
            own = b.filter(pa.array(ok.astype(bool)))
            if len(own):
                raw = [h.astype("<u8").tobytes() for h in shingle_sets(own.column("text"))]
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "shingles"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    return cut(own.mapInArrow(run, "doc_id long, shingles binary"), spread=True)


def similar(both, n1, n2):
    return 100 * both >= PERCENT * (n1 + n2 - both)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``a, b`` whose sets are similar enough.

    A document of very many pairs, such as a cluster's leader, lends its set to several tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                ok.append(len(x) > 0 and similar(both, len(x), len(y)))
            keep = b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
            if len(keep):
                yield keep

    pairs = pairs.select("a", "b")
    busy = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > PAIRS)
    busy = busy.select("id", F.ceil(F.col("n") / PAIRS).cast("int").alias("parts"))
    one = F.lit(0)
    if busy.limit(1).count():
        busy = cut(busy)
        for end, other in (("a", "b"), ("b", "a")):
            parts = busy.select(F.col("id").alias(end), F.col("parts").alias("parts"))
            pairs = pairs.join(parts, end, "left").withColumn(f"{end}_part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        sets = sets.join(busy.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("part", F.explode(F.sequence(one, F.coalesce("parts", F.lit(1)) - 1)))
    else:
        pairs, sets = pairs.withColumns({"a_part": one, "b_part": one}), sets.withColumn("part", one)
    x, y = (sets.select(F.col("doc_id").alias(end), F.col("part").alias(f"{end}_part"), F.col("shingles").alias(c)) for end, c in (("a", "x"), ("b", "y")))
    return pairs.join(x, ["a", "a_part"]).join(y, ["b", "b_part"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _block_links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links between a block of stragglers and a chunk of members: a spanning forest of them."""
    left = np.array(table.column("left").to_pylist(), bool)
    ids = table.column("id").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("shingles")]
    lefts = np.flatnonzero(left)
    rest = np.flatnonzero(~left)
    out: list[tuple[int, int]] = []
    if len(lefts) and len(rest):
        words = np.unique(np.concatenate([sets[i] for i in lefts]))
        table_ = np.zeros((len(words) + 1, len(lefts)), np.uint8)
        for c, i in enumerate(lefts):
            table_[np.searchsorted(words, sets[i]), c] = 1
        n = np.array([len(sets[i]) for i in lefts])
        top = {int(i): int(i) for i in ids}

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        for m in rest:
            h = sets[m]
            at = np.searchsorted(words, h)
            at[(at == len(words)) | (words[np.minimum(at, len(words) - 1)] != h)] = len(words)
            both = table_[at].sum(axis=0, dtype=np.int64)
            for c in np.flatnonzero(similar(both, n, len(h)) & (both > 0)):
                a, b = int(ids[lefts[c]]), int(ids[m])
                if (x := find(a)) != (y := find(b)):
                    top[x] = y
                    out.append((a, b))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def straggler_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the stragglers of each cluster with all its members.

    ``members``: ``leader, id, left``; a straggler (``left``) isn't connected with the leader yet.
    """
    sizes = members.groupBy("leader").agg(F.count_if("left").alias("n_left"), F.count("*").alias("n")).where("n_left > 0")
    sizes = sizes.select("leader", F.ceil(F.col("n_left") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    own = members.join(sizes, "leader")
    lefts = own.where("left").select("leader", "id", F.lit(True).alias("left"), F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    rest = own.select("leader", "id", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"))
    rows = lefts.unionByName(rest).join(sets.withColumnRenamed("doc_id", "id"), "id")
    return rows.groupBy("leader", "block", "chunk").applyInArrow(_block_links, "a long, b long")


def similarity_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``."""
    small_batches(docs.sparkSession)
    table = prefixes(docs, shingle_counts(docs, sized(docs.count(), SKETCH, SKETCH_MOST)))
    full = table.where("n > 0")
    classes = cut(full.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.min("ps").alias("ps")))
    in_groups = cut(classes.join(classes.groupBy("n", "ps").agg(F.min("rep").alias("gid"), F.count("*").alias("size")), ["n", "ps"]).select("gid", "rep", "size"))
    heads = in_groups.where("gid = rep").select("gid")
    firsts = full.select(F.col("doc_id").alias("gid"), "n", "cut", "prefix").join(heads, "gid", "left_semi")
    found = lists(firsts)
    # pairs of groups by their short lists; what lies in long ones may be missing from the count
    long = found.where("b IS NULL").select("h", F.col("a").alias("gid"), F.col("meta").bitwiseAND(0xFFFFFFFF).alias("cut"))
    hidden = long.groupBy("gid").agg(F.count("*").alias("hidden"))
    pairs = found.where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("need").alias("need"))
    pairs = pairs.join(hidden.select(F.col("gid").alias("a"), F.col("hidden").alias("ha")), "a", "left").join(hidden.select(F.col("gid").alias("b"), F.col("hidden").alias("hb")), "b", "left")
    pairs = cut(pairs.where(F.col("shared") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) >= F.col("need")).select("a", "b"))
    # clusters: of long lists, of groups with several classes, and of pairs with such a group
    leaders = long.groupBy("h").agg(F.max(F.struct("cut", "gid")).alias("top")).select("h", F.col("top.gid").alias("leader"))
    rows = long.join(leaders, "h").select("leader", "gid")
    several = in_groups.where("size > 1").select("gid").distinct()
    wide = pairs.join(several.withColumnRenamed("gid", "a"), "a", "left_semi").union(pairs.join(several.withColumnRenamed("gid", "b"), "b", "left_semi").select("a", "b"))
    rows = rows.union(several.select(F.col("gid").alias("leader"), "gid")).union(wide.select("a", "a")).union(wide.select("a", "b"))
    clusters = cut(rows.distinct().join(in_groups.select("gid", "rep"), "gid").select("leader", F.col("rep").alias("id")).distinct())
    tries = pairs.union(clusters.where("leader <> id").select("leader", "id")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tries = cut(tries)
    sets = sets_of(docs, tries.select(F.explode(F.array("a", "b")).alias("id")))
    links = cut(verify(tries, sets))
    named = components(links)
    if clusters.limit(1).count():
        at = named.select(F.col("node").alias("id"), F.col("component").alias("own"))
        top = named.select(F.col("node").alias("leader"), F.col("component").alias("main"))
        members = clusters.join(at, "id", "left").join(top, "leader", "left")
        members = cut(members.select("leader", "id", (F.coalesce("own", "id") != F.coalesce("main", "leader")).alias("left")))
        more = cut(straggler_links(members, sets))
        if more.limit(1).count():
            named = components(links.union(more))
    out = table.select("doc_id", "n", "s1", "s2").join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"], "left")
    out = out.join(named.withColumnRenamed("node", "rep"), "rep", "left")
    whole = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return whole.unionByName(_without_id(docs))


def _without_id(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(h) for h in shingle_sets(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n"])

    none = docs.where("doc_id IS NULL").select("text").mapInArrow(run, "n long")
    null = F.lit(None).cast("long")
    return none.select(null.alias("doc_id"), F.col("n").alias("n_shingles"), null.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents of ``docs`` that are the first of their component; a null id stays.

    Rows that share an id are one document: they stay or go together.
    """
    named = similarity_classes(docs).where("doc_id <> component_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).distinct()
    return docs.join(named, "doc_id", "left_anti")
