"""Benchmark decontamination by size-partitioned MinHash containment, in DataFrame functions alone.

A short item in a long document has a tiny Jaccard similarity, so sketches of equal size
would miss it. Here the items are partitioned by size (doubling classes), and an item's
sketch is the k smallest hashes of its shingles, with k taken from the class's upper size
so that a document which contains at least ``PERCENT`` of the item's shingles must hold
one of them, or as many more as the item is smaller than its class (``need``): no leak is
missed, whatever the document's length. Documents' shingle hashes are probed against the
sketches of all classes in one pass; only the documents that hold enough of a sketch are
read again and verified by the exact containment of the item's shingles, as strings.

Shingles are five words, A-Z lower-cased; an item of fewer words is one shingle of its
whole sequence and is found in documents of just that sequence: a few words inside a long
text are no sign of a leak. Items and documents without words match nothing, and an item
without an id, which no report could name, is left out. A null document id is kept as such; each row is a document of
its own, and repeated rows (equal in id and text) count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import SHINGLE, SPACE, ascii_lower, cut, unwrapped, wrapped

PERCENT = 80
#: Rows and bytes of a table that is broadcast, at most; a larger one is joined.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
_LEAST = -(2**63)


def words_of(text: Column) -> Column:
    clean = ascii_lower(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE)))
    return F.when(F.length(clean) == 0, F.array().cast("array<string>")).otherwise(F.split(clean, "[ \\t\\n\\x0b\\f\\r]+", -1))


def _shingles(words: str, one: str, whole: str) -> Column:
    """``one`` of the words from i on where there are enough, else ``whole``."""
    parts = ", ".join(f"{words}[i + {k}]" for k in range(SHINGLE))
    return F.expr(
        f"CASE WHEN size({words}) >= {SHINGLE} THEN transform(sequence(0, size({words}) - {SHINGLE}), i -> {one.format(parts)})"
        f" WHEN size({words}) > 0 THEN array({whole.format(words)}) ELSE array() END"
    )


def shingle_hashes(words: str) -> Column:
    return _shingles(words, "xxhash64({})", "xxhash64(array_join({}, ' '))").cast("array<bigint>")


def shingle_texts(words: str) -> Column:
    return F.array_distinct(_shingles(words, "concat_ws(' ', {})", "array_join({}, ' ')").cast("array<string>"))


def item_table(items: DataFrame) -> DataFrame:
    """``item_id, shingles, n, sketch, need`` of the items that have words."""
    own = items.where("item_id IS NOT NULL").select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    own = own.select("item_id", shingle_texts("w").alias("shingles"), F.array_sort(F.array_distinct(shingle_hashes("w"))).alias("h")).distinct()
    n = F.size("shingles")
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("int")
    missing = lambda m: m - F.ceil(m * PERCENT / 100).cast("int")
    own = own.select("item_id", "shingles", n.alias("n"), F.slice("h", F.lit(1), missing(upper) + 1).alias("sketch"))
    return own.withColumn("need", F.size("sketch") - missing(F.col("n")))


def _small(df: DataFrame, size: Column | int) -> DataFrame:
    """``df`` for a broadcast, if its rows are few and their bytes (``size`` a row, about) too."""
    size = size if isinstance(size, Column) else F.lit(size)
    rows, total = df.select(size.cast("long").alias("b")).limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).collect()[0]
    return F.broadcast(df) if rows <= BROADCAST_ROWS and total <= BROADCAST_BYTES else df


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``_id, _t, doc_id, item_id, item_shingles, shared``: verified pairs; ``_id, _t`` tell rows apart."""
    table = cut(item_table(items))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("_id"), F.xxhash64(text).alias("_t"))
    sketch = _small(cut(table.select("item_id", "need", F.explode("sketch").alias("h"))), 32)
    probes = keyed.select("_id", "_t", words_of(F.col("text")).alias("w")).select("_id", "_t", F.explode(shingle_hashes("w")).alias("h"))
    hits = probes.join(sketch, "h").groupBy("_id", "_t", "item_id").agg(F.collect_set("h").alias("h"), F.max("need").alias("need"))  # a sketch's hashes at most
    hits = hits.where(F.size("h") >= F.col("need"))
    # one row a document, with the items to verify: at most as many as there are items
    found = cut(hits.groupBy("_id", "_t").agg(F.collect_list("item_id").alias("found")))
    found = _small(found, 32 + 8 * F.size("found"))
    table = _small(table.drop("sketch", "need"), F.expr("16 + aggregate(shingles, 0L, (a, s) -> a + 16 + octet_length(s))"))
    again = keyed.join(found, ["_id", "_t"]).dropDuplicates(["_id", "_t"])
    again = again.select("_id", "_t", "doc_id", "found", words_of(F.col("text")).alias("w")).select("_id", "_t", "doc_id", "found", shingle_texts("w").alias("own"))
    pairs = again.select("_id", "_t", "doc_id", "own", F.explode("found").alias("item_id")).join(table, "item_id")
    shared = pairs.withColumn("shared", F.size(F.array_intersect("shingles", "own")))
    return shared.where(100 * F.col("shared") >= PERCENT * F.col("n")).select("_id", "_t", "doc_id", "item_id", F.col("n").cast("long").alias("item_shingles"), F.col("shared").cast("long").alias("shared"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, item_shingles, shared`` of every leak."""
    return leaks(docs, items).select("doc_id", "item_id", "item_shingles", "shared")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a leak, with their own columns."""
    gone = _small(cut(leaks(docs.select("doc_id", "text"), items).select("_id", "_t").distinct()), 32)
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = wrapped(docs, {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)), "_t": F.xxhash64(text)})
    return unwrapped(marked.join(gone, ["_id", "_t"], "left_anti"), docs.columns)


_WORDS = """list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"""


def sql_shingles(table: str, key: str) -> str:
    """DuckDB's distinct shingles of a table's texts: ``key, s``."""
    return f"""(
    SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT {key}, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT {key}, {_WORDS} AS w FROM {table}) WHERE len(w) >= 5)
    UNION ALL
    SELECT DISTINCT {key}, array_to_string(w, ' ') FROM (SELECT {key}, {_WORDS} AS w FROM {table}) WHERE len(w) BETWEEN 1 AND 4
)"""


#: DuckDB's statement of ``report``: all documents' shingles against all items'.
SQL = f"""
WITH d AS {sql_shingles("documents", "doc_id")}, b AS {sql_shingles("benchmark", "item_id")},
n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id)
SELECT d.doc_id, b.item_id, any_value(n.item_shingles) AS item_shingles, count(*) AS shared
FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY d.doc_id, b.item_id HAVING 100 * count(*) >= 80 * any_value(n.item_shingles)
"""
