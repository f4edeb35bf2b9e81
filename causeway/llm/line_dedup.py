"""Line deduplication that returns keep bitmaps, by DataFrame functions alone.

Lines' 128-bit hashes are range-partitioned together with the document, with a secondary
sort by document and position: a pass of fixed-width rows gives each (line, document) its
positions as 64-bit words, and marks its first. A hot line is spread over many partitions,
since the range goes on into the document; it stays so when the lines that go are found,
as the part of the range is a key of that join. Per line only a count and the largest
document are combined, by part first. What comes back per document is a sparse bitmap of
the lines that go - 64 lines a word, words without a dropped line left out - and not its
text.

A line counts if its key (``SPACE`` stripped at both ends, A-Z lower-cased) has at least
``min_chars`` code points; a key found in ``min_docs`` documents or more keeps its lines
in the largest ``doc_id`` only. Null texts are one empty line. Rows equal in ``doc_id``
and text are one document; rows with the same ``doc_id`` and other texts are documents of
their own that keep and lose lines together by that id. A null ``doc_id`` is smaller than
all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import SPACE, ascii_lower, cut, shuffle_partitions, unwrapped, wrapped

#: 64-bit words of the filter of documents that lose lines: at least, at most.
FILTER_WORDS = (1 << 14, 1 << 20)
#: Stands for a null id where the largest is sought.
_LEAST = -(2**63)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _row_key() -> dict[str, Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)), "_t": F.xxhash64(text)}


def drop_bitmaps(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``_id, _t, drop_words``: for documents that lose lines, the bitmap as a map from
    word number to 64 bits; ``_id`` and ``_t`` are the document's id and text hash."""
    n = shuffle_partitions(docs.sparkSession)
    lines = docs.select(*(c.alias(k) for k, c in _row_key().items()), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    # texts are read once here: the slim rows are written, and the range's bounds sampled from them
    lines = cut(lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "_id", "_t", "pos"), spread=True)
    ranged = lines.repartitionByRange(n, "h1", "h2", "_id", "_t")
    bit = F.expr("shiftleft(1L, pmod(pos, 64))")
    words = ranged.groupBy("h1", "h2", "_id", "_t", F.expr("int(pos div 64)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    # the range serves the window as well: the sorted rows of a (line, document) follow each other in one task
    first = F.row_number().over(Window.partitionBy("h1", "h2", "_id", "_t").orderBy("word")) == 1
    occurrences = cut(words.withColumns({"first": first.cast("int"), "part": F.spark_partition_id()}), spread=True)
    # a line of very many documents lies in many parts of the range, which stay apart in the join
    parts = occurrences.groupBy("h1", "h2", "part").agg(F.sum("first").alias("n"), F.max("_id").alias("keeper"))
    repeated = parts.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"), F.collect_list("part").alias("parts")).where(F.col("n") >= min_docs)
    repeated = repeated.select("h1", "h2", "keeper", F.explode("parts").alias("part"))
    dropped = occurrences.join(repeated, ["h1", "h2", "part"]).where(F.col("_id") != F.col("keeper"))
    gone = dropped.groupBy("_id", "_t", "word").agg(F.bit_or("bits").alias("bits"))
    return gone.groupBy("_id", "_t").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drop_words"))


def _filter(bitmaps: DataFrame, words: int) -> DataFrame:
    """One row, one array of ``words`` 64-bit words: a bit is set for each document of ``bitmaps``."""
    spark = bitmaps.sparkSession
    at, bit = _place(words)
    held = bitmaps.groupBy(at.alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    whole = spark.range(words).join(held, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
    return whole.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"]).alias("filter"))


def _place(words: int) -> tuple[Column, Column]:
    """The word and the bit that stand for a document."""
    h = F.xxhash64("_id", "_t")
    return F.pmod(F.shiftright(h, 6), F.lit(words)), F.pmod(h, F.lit(64)).cast("int")


def with_bitmaps(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``drop_words`` (null where nothing goes).

    Texts don't travel for the sake of documents that lose nothing: a filter of bounded size
    (8 bits a document that loses lines) tells them, and only the others, and the few that
    share a bit with one, are shuffled to meet their bitmaps. Where more documents lose lines
    than the filter has room for, all are.
    """
    bitmaps = cut(drop_bitmaps(docs, min_docs, min_chars))
    rows = wrapped(docs, _row_key())
    losing = bitmaps.count()
    if 8 * losing > 64 * FILTER_WORDS[1]:
        return rows.join(bitmaps, ["_id", "_t"], "left").select("row", "drop_words")
    words = max(FILTER_WORDS[0], 1 << max(0, (losing // 8 - 1).bit_length()))
    at, bit = _place(words)
    loses = F.getbit(F.get(cut(_filter(bitmaps, words)).scalar(), at.cast("int")), bit) == 1
    marked = rows.where(loses).join(bitmaps, ["_id", "_t"], "left").select("row", "drop_words")
    return marked.unionByName(rows.where(~loses).select("row", F.lit(None).cast(bitmaps.schema["drop_words"].dataType).alias("drop_words")))


def kept_text(text: Column, drop_words: Column) -> Column:
    """The lines whose bit isn't set, joined again; the text itself where no bitmap is."""
    lines = lines_of(text)

    def kept(_: Column, i: Column) -> Column:
        word = F.coalesce(F.try_element_at(drop_words, F.shiftright(i, 6)), F.lit(0).cast("long"))
        return F.getbit(word, i.bitwiseAND(63)) == 0

    return F.when(drop_words.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter(lines, kept), "\n"))


def dropped_count(drop_words: Column) -> Column:
    total = F.aggregate(F.map_values(drop_words), F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w))
    return F.coalesce(total, F.lit(0).cast("long"))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``docs`` with their texts cut down; all columns stay, and ``n_chars`` is counted anew."""
    text = kept_text(F.col("row.text"), F.col("drop_words"))
    changed = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return unwrapped(with_bitmaps(docs, min_docs, min_chars), docs.columns, changed)


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every document."""
    marked = with_bitmaps(docs.select("doc_id", "text"))
    text, gone = F.col("row.text"), F.col("drop_words")
    return marked.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(lines_of(text)).cast("long").alias("n_lines"),
        dropped_count(gone).alias("n_dropped"),
        F.sha2(kept_text(text, gone), 256).alias("kept_sha256"),
    )


#: DuckDB's statement of ``digest``.
SQL = """
WITH lines AS (
    SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), repeated AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
