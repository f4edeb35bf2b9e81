"""Fill-in-the-middle texts by escaped marker injection, in DataFrame functions alone.

A delimiter is escaped in the text, ``regexp_replace`` appends it after every unit (a word
with the white space before it; white space at the end is a unit of its own), its count is
the number of units, and ``substring_index`` takes the units up to a rank, between two ranks
and from a rank on, which are unescaped and assembled. Escapes hold no white space, so the
units stay the same. No unit is ever a row or an array's entry: a text of any length costs a
few copies of itself.

Two cuts and two throws come from the hex sha256 of ``seed:doc_id``: repeated ids are cut
by the same numbers, a null id counts as an empty one. A null text is an empty one. Empty
texts, and those that hold one of ``MARKS`` (they could not be told apart again), stay
plain, so that ``restored`` gives back every text exactly. Other columns stay as they are,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import unwrapped, wrapped

#: What stands before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: A unit: possessive, since what white space and words take is never given back.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
#: The delimiter, what begins an escape, and what follows there for these two.
_CUT, _ESCAPE, _ESCAPED_CUT, _ESCAPED_ESCAPE = "\x01", "\x02", "\x03", "\x04"


def escaped(text: Column) -> Column:
    """``text`` without the delimiter."""
    text = F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + _ESCAPED_ESCAPE))
    return F.replace(text, F.lit(_CUT), F.lit(_ESCAPE + _ESCAPED_CUT))


def unescaped(marked: Column) -> Column:
    """The text of ``escaped``, with the delimiters that were put in taken out."""
    text = F.replace(F.replace(marked, F.lit(_CUT), F.lit("")), F.lit(_ESCAPE + _ESCAPED_CUT), F.lit(_CUT))
    return F.replace(text, F.lit(_ESCAPE + _ESCAPED_ESCAPE), F.lit(_ESCAPE))


def _draws(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _up_to(text: str, rank: str) -> Column:
    return F.call_function("substring_index", F.col(text), F.lit(_CUT), F.col(rank).cast("int"))


def cut_texts(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """``row`` (all columns of ``docs``), ``text``, ``n`` (units), ``form``, ``prefix, middle, suffix``.

    ``rate`` percent of the texts are cut, ``suffix_first`` percent of these have form
    ``spm``, the others ``psm``; the parts are null for ``plain`` ones.
    """
    rows = wrapped(docs, {"text": F.coalesce(F.col("text").cast("string"), F.lit(""))})
    first, second, taken, turned = _draws(F.col("row.doc_id"), seed)
    marks = [F.contains("text", F.lit(m)) for m in MARKS]
    plain = (F.length("text") == 0) | marks[0] | marks[1] | marks[2] | (taken % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(turned % 100 < suffix_first, "spm").otherwise("psm"))
    rows = rows.withColumn("marked", F.regexp_replace(escaped(F.col("text")), UNIT, "$0" + _CUT))
    rows = rows.withColumn("n", F.regexp_count("marked", F.lit(_CUT)).cast("long"))
    ranks = {k: c % (F.col("n") + 1) for k, c in (("a", first), ("b", second))}
    rows = rows.withColumns({"low": F.least(*ranks.values()), "high": F.greatest(*ranks.values())})
    # the text ends with a delimiter, so the units after the high rank are the last n - high, and that one
    rows = rows.withColumns({"left": _up_to("marked", "high"), "inner": F.col("low") - F.col("high"), "outer": F.col("high") - F.col("n") - 1})
    parts = {"prefix": _up_to("left", "low"), "middle": _up_to("left", "inner"), "suffix": _up_to("marked", "outer")}
    # the left part has no delimiter at its end: where the low rank is the high one, it is the prefix
    cut = F.col("form") != "plain"
    return rows.select("row", "text", "n", "form", *(F.when(cut, unescaped(c)).alias(k) for k, c in parts.items()))


def assembled(form: Column, text: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    """``text`` if plain, the parts behind their marks in the form's order otherwise."""
    p, s, m = (F.concat(F.lit(mark), part) for mark, part in zip(MARKS, (prefix, suffix, middle), strict=True))
    return F.when(form == "psm", F.concat(p, s, m)).when(form == "spm", F.concat(s, p, m)).otherwise(text)


def restored(form: Column, output: Column) -> Column:
    """The text that ``output`` was assembled from; a text that was cut holds no mark of its own."""
    p, s, m = MARKS
    part = lambda mark, k: F.substring_index(output, mark, k)
    middle = part(m, -1)
    prefix_first, suffix_first = F.substring_index(part(s, 1), p, -1), F.substring_index(part(p, 1), s, -1)
    last = lambda mark: F.substring_index(F.substring_index(output, mark, -1), m, 1)
    return F.when(form == "psm", F.concat(prefix_first, middle, last(s))).when(form == "spm", F.concat(last(p), middle, suffix_first)).otherwise(output)


def fill_middle(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """``docs`` with assembled texts, ``n_chars`` counted anew, and all other columns as they are."""
    out = cut_texts(docs, seed, rate, suffix_first)
    out = out.withColumn("output", assembled(*(F.col(c) for c in ("form", "text", "prefix", "middle", "suffix"))))
    changed = {"text": F.col("output")} | ({"n_chars": F.length("output").cast("long")} if "n_chars" in docs.columns else {})
    return unwrapped(out, docs.columns, changed)


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of every document."""
    out = cut_texts(docs.select("doc_id", "text"))
    out = out.withColumn("output", assembled(*(F.col(c) for c in ("form", "text", "prefix", "middle", "suffix"))))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )


#: DuckDB's statement of ``digest``: units as a list, parts as its slices.
SQL = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
           sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), drawn AS (
    SELECT doc_id, text, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS d FROM units
), cuts AS (
    SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS low, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS high,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50 THEN 'plain'
                WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), parts AS (
    SELECT doc_id, text, n, form, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m, array_to_string(u[high + 1:], '') AS s FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
