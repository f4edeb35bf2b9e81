"""Fill-in-the-middle texts against a plain version, on awkward rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from causeway.llm import fill_middle
from tests.llm.test_llm import LONG, ODD, docs, empty

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: Delimiter and escapes of the operator, their digits, marks and pieces of marks, many spaces.
HOSTILE = [
    "\x01", "\x02", "\x01\x02 \x02\x01", "\x02\x03 \x02\x04\x03 a", "a\x01b \x01 c\x01", " \x01 ", "<P>", "a <S> b", "x<M>", "<P", "a <S b> <", "P> <M", "<<P> a", "< S> <P >",
    "a b  c\x85d", "😀 😀😀 \U0010ffff", " " * 3000, "a" + " " * 3000, " " * 3000 + "a", "\r\n\r\n a \x0b\x0c b", "$0 \\1 $", "é a", "\x1c \x1d x\x1f y", "﻿ a",
]
ROWS = ODD + [(100 + i, t) for i, t in enumerate(HOSTILE * 12)] + [(None, "one two three four"), (None, "five six"), (-5, "negative id")]


def plain_version(key, text, seed=42, rate=50, suffix_first=80):
    """n, form, prefix, middle, suffix, output."""
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    d = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((d[0] % (len(units) + 1), d[1] % (len(units) + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, len(units))))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or d[2] % 100 >= rate:
        return len(units), "plain", None, None, None, text
    if d[3] % 100 < suffix_first:
        return len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digest(spark):
    got = sorted(map(tuple, fill_middle.digest(docs(spark, ROWS)).collect()), key=str)
    want = []
    for key, text in ROWS:
        n, form, p, m, _, out = plain_version(key, text)
        want.append((key, n, form, None if p is None else len(p), None if m is None else len(m), sha(out), sha(text or "")))
    assert got == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


@pytest.mark.parametrize("rate, suffix_first", [(100, 0), (100, 100), (0, 50), (100, 50)])
def test_every_form_comes_back(spark, rate, suffix_first):
    out = fill_middle.cut_texts(docs(spark, ROWS), 7, rate, suffix_first)
    out = out.withColumn("output", fill_middle.assembled(*(F.col(c) for c in ("form", "text", "prefix", "middle", "suffix"))))
    got = out.select(F.col("row.doc_id"), "text", "n", "form", "prefix", "middle", "suffix", "output", fill_middle.restored(F.col("form"), F.col("output")).alias("again")).collect()
    assert len(got) == len(ROWS)
    for r in got:
        want = plain_version(r["doc_id"], r["text"], 7, rate, suffix_first)
        assert tuple(r)[2:8] == want
        assert r["again"] == r["text"]


def test_other_columns_stay(spark):
    own = docs(spark, ROWS, form="f", n=9, text_="t", output="o", n_chars=0, marked="m", left="l")
    got = fill_middle.fill_middle(own)
    assert got.columns == own.columns
    rows = got.collect()
    assert {(r["form"], r["n"], r["row"], r["left"]) for r in rows} == {("f", 9, 4, "l")}
    assert sorted((r["text"] for r in rows)) == sorted(plain_version(k, t)[5] for k, t in ROWS)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert fill_middle.digest(empty(spark)).count() == 0


def test_no_python_and_no_shuffle(spark):
    plan = fill_middle.digest(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Exchange", "Pandas", "Arrow"))
    assert len(LONG) > 300_000
