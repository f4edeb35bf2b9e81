"""Written field reports above a high-water mark, into rated reports and a quality table.

    python jobs/report_intake.py --tables /data/tables --out /data/reports --config jobs/report_intake.json

A document is a report of its source (a district). A run takes the documents whose id lies
above the mark that the last run left, reads each whole text once, and writes slim rows:
sizes, numbers in the text, the condition state of the lowest rating (a number's last whole
digit, as in inspections), and a digest that tells copies. They go to a folder named by the
mark they lie above, partitioned by language, so that a run repeated after a failure
overwrites its own rows. The quality table is made from the slim rows of all runs: reports,
empty ones, copies, states by language and source, and whether a source passes (its share of
reports that aren't empty is high enough). The mark is written last. Documents without an
id lie above no mark; they are counted in the log. A missing language is ``und``.
"""

from __future__ import annotations

import logging
import sys
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))  # run as a script

from causeway.functions.scalars import rating_state  # noqa: E402
from causeway.schema import STATES  # noqa: E402
from jobs.common import configuration, main, stored, write  # noqa: E402

log = logging.getLogger("jobs.report_intake")
DEFAULTS = {"least_share": 0.95}
REPORTS = "doc_id long, source string, n_chars long, n_lines long, n_numbers long, state4 int, digest string, above long, lang string"
NAMES = [s.lower() for s in STATES]
QUALITY = "source string, n_reports long, n_empty long, n_texts long, n_rated long, " + ", ".join(f"{s} long" for s in NAMES) + ", passes boolean, lang string"
#: Below every id.
START = -(2**63)


def ratings(text: Column) -> Column:
    """The last whole digit of every number in a text."""
    numbers = F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return F.transform(numbers, lambda n: F.right(F.substring_index(n, ".", 1), F.lit(1)).cast("int"))


def rated(docs: DataFrame) -> DataFrame:
    """A slim row for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), "source", F.length(text).cast("long").alias("n_chars"), F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
        ratings(text).alias("r"), F.sha2(text, 256).alias("digest"), F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("und")).alias("lang"),
    )
    return rows.select("doc_id", "source", "n_chars", "n_lines", F.size("r").cast("long").alias("n_numbers"), rating_state(F.array_min("r")).alias("state4"), "digest", "lang")


def quality(reports: DataFrame, least_share: float) -> DataFrame:
    full = F.count_if(F.col("n_chars") > 0)
    states = [F.count_if(F.col("state4") == k).alias(n) for k, n in enumerate(NAMES)]
    # a copy's digest is counted once by language and source, before these are summed
    texts = reports.groupBy("lang", "source", "digest").agg(
        F.count("*").alias("n"), full.alias("full"), F.count("state4").alias("rated"), *states)
    out = texts.groupBy("lang", "source").agg(
        F.sum("n").alias("n_reports"), (F.sum("n") - F.sum("full")).alias("n_empty"), F.count("*").alias("n_texts"), F.sum("rated").alias("n_rated"),
        *(F.sum(n).alias(n) for n in NAMES), (F.sum("full") >= F.lit(least_share) * F.sum("n")).alias("passes"),
    )
    return out.select("source", "n_reports", "n_empty", "n_texts", "n_rated", *NAMES, "passes", "lang")


def run(spark: SparkSession, tables: str, out: str, config: str | None = None) -> None:
    """Take the documents above the mark; ``out`` keeps the tables and the marks."""
    cfg = configuration(spark, DEFAULTS, config)
    last = stored(spark, f"{out}/marks", "mark long").agg(F.max("mark")).first()[0]
    mark = START if last is None else last
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "lang", "source")
    new = docs.where((F.col("doc_id") > mark) if last is not None else F.col("doc_id").isNotNull())
    ids = new.agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).first()  # of the id column alone
    log.info("read %s documents above mark %s of %s; %s have no id", ids["n"], last, tables, docs.where("doc_id IS NULL").count() if last is None else "others")
    if ids["n"]:
        # what arrives while this runs is left for the next one
        taken = rated(new.where(F.col("doc_id") <= ids["top"]))
        write(log, taken, f"{out}/reports/above={mark}", ["lang"])
    reports = stored(spark, f"{out}/reports", REPORTS)
    write(log, quality(reports, cfg["least_share"]), f"{out}/quality", ["lang"])
    if ids["n"]:
        spark.range(1).select(F.lit(ids["top"]).cast("long").alias("mark")).write.mode("overwrite").parquet(f"{out}/marks/above={mark}")
        log.info("mark is %s", ids["top"])


def output(spark: SparkSession, out: str) -> DataFrame:
    """Both tables as they stand, one below the other; ``part`` tells which."""
    reports = stored(spark, f"{out}/reports", REPORTS).drop("above").withColumn("part", F.lit("report"))
    table = stored(spark, f"{out}/quality", QUALITY).withColumn("part", F.lit("quality"))
    return reports.unionByName(table, allowMissingColumns=True)


if __name__ == "__main__":
    main("report_intake", run, "Take new field reports and rate them.")
