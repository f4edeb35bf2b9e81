"""Secret scans through a trigram inverted index, in DataFrame functions alone.

Each rule is a regular expression. ``trigram_query`` derives from it the trigrams that any
match must hold, as an OR of ANDs; the index has a row for each (trigram, document), and the
documents that a rule can match are those whose postings meet all trigrams of one AND. They
are read again and verified by the expression itself. A rule without mandatory trigrams
(``hex``) scans every text. Trigrams are of texts with A-Z lower-cased, so that rules may
take either case.

``build_index`` keeps all trigrams, for rules not known yet, or only those that given rules
ask for: the others' postings would be written to be never read. Postings are slim rows
spread by document; no trigram's list is ever held together, and a frequent trigram is just
many rows. Candidates are told by a filter of bounded size, so that no other text travels.

Spans are code points, end exclusive. A rule's matches are leftmost and don't overlap; a
match whose group is shorter than the rule asks for is dropped after it was taken. Null
texts have no spans. Rows equal in ``doc_id`` and text, and null ids, get the same spans
each; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import re._constants as op
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import ascii_lower, cut, unwrapped, wrapped
from causeway.llm.line_dedup import FILTER_WORDS, _filter, _place, _row_key

#: Strings that a part of an expression may stand for, at most, before it counts as open.
MOST_STRINGS = 64
#: ANDs of a rule's query, at most; beyond, trigrams are left out, which asks for less.
MOST_ANDS = 64
#: Code points of a text that are cut into trigrams together.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Rule:
    """``group`` of a match of ``pattern`` has ``least`` code points or more.

    Patterns hold literals, classes, groups, alternatives and repeats, all written out (no
    flags, anchors or references), and never match an empty text.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(word: str) -> str:
    """A pattern for ``word`` in any mixture of A-Z and a-z."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isascii() and c.isalpha() else c for c in word)


_KEYS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: The three base rules, in the order their kinds are listed.
BASE = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: What the scan finds besides; fixed formats of public services, listed after the base.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("url_login", r"://[^\x00-\x20/:@]+:([^\x00-\x20/:@]+)@", 1, 3),
)
RULES = BASE + MORE


# --- the trigrams that an expression asks for ------------------------------------------------

#: A query: an OR of ANDs of trigrams; one empty AND asks for nothing.
Query = frozenset[frozenset[str]]
_ANY: Query = frozenset([frozenset()])


def _or(queries: Iterable[Query]) -> Query:
    """The ANDs of all; one that asks for more than another is absorbed by it."""
    ands = frozenset().union(*queries)
    return frozenset(a for a in ands if not any(b < a for b in ands))


def _and(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_ANDS:  # either alone is still mandatory
        return max(a, b, key=lambda q: min(map(len, q)))
    return _or([frozenset(x | y for x, y in product(a, b))])


def _of_strings(strings: set[str]) -> Query:
    """Any of ``strings`` is there: all the trigrams of one."""
    ands = _or([frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)])
    return ands if len(ands) <= MOST_ANDS else frozenset([frozenset.intersection(*ands)])


def _class(items: list) -> set[str] | None:
    """The characters of a class, folded, or None if they are too many."""
    out: set[str] = set()
    for what, value in items:
        if what is op.LITERAL:
            out.add(chr(value).lower() if value < 128 else chr(value))
        elif what is op.RANGE and value[1] - value[0] < MOST_STRINGS:
            out |= {chr(c).lower() if c < 128 else chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_STRINGS else None


def _walk(items: Iterable) -> tuple[set[str] | None, Query]:
    """The strings that a sequence stands for, or None and what any match of it asks for."""
    run: set[str] = {""}  # the strings since the last open part
    whole, asked = True, _ANY
    for what, value in items:
        own: set[str] | None = None
        inner = _ANY
        if what is op.LITERAL:
            own = {chr(value).lower() if value < 128 else chr(value)}
        elif what is op.IN:
            own = _class(value)
        elif what is op.SUBPATTERN:
            own, inner = _walk(value[-1])
        elif what is op.BRANCH:
            sides = [_walk(side) for side in value[1]]
            own = set().union(*(s for s, _ in sides)) if all(s is not None for s, _ in sides) else None
            inner = _or(q if s is None else _of_strings(s) for s, q in sides)
        elif what in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, part = value
            once, inner = _walk(part)
            if once is not None and high == 1:
                own = once | ({""} if low == 0 else set())
            elif low > 0:
                inner = inner if once is None else _of_strings(once)
            if low == 0:
                inner = _ANY
        elif what is not op.NOT_LITERAL and what is not op.ANY:
            raise ValueError(f"rules don't take {what}")
        if own is not None and len(run) * len(own) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, own)}
        else:
            asked = _and(_and(asked, _of_strings(run)), inner if own is None else _of_strings(own))
            run, whole = {""}, False
    if whole:
        return run, _ANY
    return None, _and(asked, _of_strings(run))


def trigram_query(pattern: str) -> list[list[str]]:
    """The ANDs of trigrams, one of which a text with a match holds; empty if nothing is mandatory."""
    strings, query = _walk(_parser.parse(pattern))
    query = query if strings is None else _of_strings(strings)
    return [] if frozenset() in query else sorted(sorted(a) for a in query)


# --- the index ---------------------------------------------------------------------------------


def _trigrams(text: Column) -> Column:
    """The distinct trigrams of a text, cut in blocks that overlap by two."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(BLOCK))

    def of_block(at: Column) -> Column:
        chars = F.split(F.substr(text, at + 1, F.lit(BLOCK + 2)), "", -1)
        places = F.when(F.size(chars) >= 3, F.sequence(F.lit(0), F.size(chars) - 3)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(places, lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2))))

    return F.array_distinct(F.flatten(F.transform(starts, of_block)))


def build_index(docs: DataFrame, rules: Iterable[Rule] | None = None) -> DataFrame:
    """``gram, _id, _t``: a row for each trigram of each document (``_id, _t`` are its id and text hash).

    With ``rules`` only their trigrams are kept, found by a search for each in the text.
    """
    folded = docs.select(*(c.alias(k) for k, c in _row_key().items()), ascii_lower(F.coalesce(F.col("text"), F.lit(""))).alias("folded"))
    if rules is None:
        found = _trigrams(F.col("folded"))
    else:
        asked = sorted({g for r in rules for a in trigram_query(r.pattern) for g in a})
        found = F.filter(F.lit(asked) if asked else F.array().cast("array<string>"), lambda g: F.contains("folded", g))
    return cut(folded.select(F.explode(found).alias("gram"), "_id", "_t"), spread=True)


def candidates(index: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """``_id, _t, kinds``: the documents whose postings meet a rule's query, and these rules."""
    spark: SparkSession = index.sparkSession
    terms = [(r.kind, i, g, len(a)) for r in rules for i, a in enumerate(trigram_query(r.pattern)) for g in a]
    terms = F.broadcast(spark.createDataFrame(terms, "kind string, conj int, gram string, need int"))  # as many rows as the rules have trigrams
    met = index.join(terms, "gram").groupBy("_id", "_t", "kind", "conj").agg(F.count_distinct("gram").alias("have"), F.max("need").alias("need"))
    return met.where("have = need").groupBy("_id", "_t").agg(F.collect_set("kind").alias("kinds"))  # as many kinds as rules


# --- spans -------------------------------------------------------------------------------------


def running_sums(x: Column) -> Column:
    """Sums so far, in pieces of the root of the length, as an array that grows entry by entry is copied each time."""
    none = F.array().cast("array<int>")
    width = F.ceil(F.sqrt(F.size(x))).cast("int")
    pieces = F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int")), lambda k: F.slice(x, k * width + 1, width)))
    grow = lambda v, start: F.aggregate(v, F.array(start), lambda a, y: F.concat(a, F.array(F.element_at(a, -1) + y)))
    before = lambda p: grow(F.transform(p, lambda v: F.aggregate(v, F.lit(0), lambda a, y: a + y)), F.lit(0))
    sums = lambda p: F.flatten(F.zip_with(p, F.slice(before(p), 1, F.size(p)), lambda v, s: F.slice(grow(v, s), F.lit(2), F.size(v))))
    return F.coalesce(sums(pieces), none)


def _spans(rule: Rule, order: int, matches: Column, gaps: Column) -> Column:
    """Places of ``matches``, of which ``gaps`` are what stands before each."""
    ends = running_sums(F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m)))
    at = F.zip_with(ends, matches, lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), e.alias("end"), m.alias("match")))
    kept = F.filter(at, lambda s: F.length(F.regexp_extract(s["match"], rule.pattern, rule.group)) >= rule.least) if rule.least else at
    return F.transform(kept, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "order", "kind", "end"))))


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``spans``: ``start, order, kind, end`` by start and order.

    ``order`` is the rule's place in ``rules``.
    """
    indexed = [r for r in rules if trigram_query(r.pattern)]
    found = cut(candidates(build_index(docs.select("doc_id", "text"), indexed), indexed))
    rows = wrapped(docs, _row_key())
    none = F.lit(None).cast("array<string>").alias("kinds")
    n = found.count()
    if 8 * n > 64 * FILTER_WORDS[1]:  # the filter would let nearly all through
        marked = rows.join(found, ["_id", "_t"], "left").select("row", "kinds")
    else:
        words = max(FILTER_WORDS[0], 1 << max(0, (n // 8 - 1).bit_length()))
        at, bit = _place(words)
        may = F.getbit(F.get(cut(_filter(found, words)).scalar(), at.cast("int")), bit) == 1
        marked = rows.where(may).join(found, ["_id", "_t"], "left").select("row", "kinds").unionByName(rows.where(~may).select("row", none))
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = marked.select("row", F.col("row.text").alias("text"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
    hit = {i: (F.lit(True) if r not in indexed else F.array_contains("kinds", r.kind)) & F.rlike(text, F.lit(r.pattern)) for i, r in enumerate(rules)}
    marked = marked.select("row", "text", *(c.alias(f"hit{i}") for i, c in hit.items()))
    parts = {}
    for i, r in enumerate(rules):
        parts[f"m{i}"] = F.when(F.col(f"hit{i}"), F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)))
        parts[f"g{i}"] = F.when(F.col(f"hit{i}"), F.split(text, r.pattern, -1))
    marked = marked.select("row", *(c.alias(k) for k, c in parts.items()))
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    spans = [F.coalesce(_spans(r, i, F.col(f"m{i}"), F.col(f"g{i}")), none) for i, r in enumerate(rules)]
    return marked.select("row", F.array_sort(F.flatten(F.array(*spans))).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` and ``secrets``: an array of ``kind, start, end, secret`` by start (instead of a column of that name)."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    own = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.substr(text, s["start"] + 1, s["end"] - s["start"]).alias("secret"))
    out = with_spans(docs, rules).withColumn("found", F.transform("spans", own))
    return unwrapped(out, [c for c in docs.columns if c != "secrets"] + ["secrets"], {"secrets": F.col("found")})


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, the digest of their spans, and all spans, of every document."""
    out = with_spans(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["order"] == k)).cast("long").alias(f"n_{BASE[k].kind}")
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    return out.select(F.col("row.doc_id").alias("doc_id"), *map(count, range(len(BASE))), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql_rule(order: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
    SELECT row_id, {order} AS ord, '{rule.kind}' AS kind, e - length(m) AS s, e, length(regexp_extract(m, '{pattern}', {rule.group})) >= {rule.least} AS ok FROM (
        SELECT row_id, m, CAST(sum(length(m) + length(g)) OVER (PARTITION BY row_id ORDER BY i) AS BIGINT) AS e FROM (
            SELECT row_id, unnest(m) AS m, unnest(g[1:len(m)]) AS g, unnest(range(len(m))) AS i FROM (
                SELECT row_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM texts WHERE regexp_matches(text, '{pattern}'))))"""


#: DuckDB's statement of ``digest``: every rule over every text.
SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_id FROM documents),
found AS ({" UNION ALL ".join(_sql_rule(i, r) for i, r in enumerate(RULES))}),
kept AS (SELECT * FROM found WHERE ok)
SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < {len(BASE)}), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord), '') AS spans
FROM texts LEFT JOIN kept USING (row_id) GROUP BY row_id, doc_id
"""
