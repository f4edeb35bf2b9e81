"""Inspections as they arrive, into a condition panel by year and its yearly transitions.

    python jobs/inspection_panel.py --tables /data/tables --out /data/panel --config jobs/inspection_panel.json

A stream takes each file of ``orders`` (an order is an inspection of its customer's structure)
once, by Spark's own checkpoint, and ends when there is no more. A batch writes its rated
inspections to a folder of its own, which a repeated batch overwrites, and makes anew only
the years it touched: ``panel`` (one row a structure and year: the best state seen) and
``transitions`` (how often each state led to which in the next year, and smoothed shares),
each over these years' partitions alone. So a rerun, and one after a failure at any point,
ends in the same tables. Inspections without a rating, a structure or a date are counted
in the log and left out.
"""

from __future__ import annotations

import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))  # run as a script

from causeway.operators.panel import next_year_pairs  # noqa: E402
from causeway.schema import N_STATES  # noqa: E402
from causeway.sources.testdata import rated_orders  # noqa: E402
from jobs.common import configuration, main, stored, write  # noqa: E402

log = logging.getLogger("jobs.inspection_panel")
DEFAULTS = {"files_a_batch": 1000, "alpha": 0.5}
INSPECTIONS = "key long, state4 int, age int, batch long, year int"
PANEL = "key long, state4 int, age int, year int"
TRANSITIONS = "state4 int, n long, " + ", ".join(f"p{k} double" for k in range(N_STATES)) + ", year int"


def run(spark: SparkSession, tables: str, out: str, config: str | None = None) -> None:
    """Take what is new in ``tables``' orders; ``out`` keeps the tables and the checkpoint."""
    cfg = configuration(spark, DEFAULTS, config)
    source = f"{tables}/orders.parquet"
    # as a pattern, so that the table may be one file as well as a folder of files
    new = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", cfg["files_a_batch"]).parquet(f"{tables}/{{orders.parquet}}")
    batches = []

    def each(df: DataFrame, k: int) -> None:
        take(df, k, out, cfg)
        batches.append(k)

    query = new.writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read what was new of %s in %s batches", source, len(batches))


def take(batch: DataFrame, k: int, out: str, cfg: dict) -> None:
    """One batch: its inspections, then the panel and the transitions of the years in it."""
    spark = batch.sparkSession
    rated = rated_orders(batch).select(F.col("key").cast("long"), "state4", F.col("age").cast("int"), F.lit(k).cast("long").alias("batch"), F.col("year").cast("int"))
    inspections = f"{out}/inspections"
    seen = Observation()
    whole = rated.observe(seen, F.count(F.lit(1)).alias("rows")).where("key IS NOT NULL AND year IS NOT NULL AND state4 IS NOT NULL")
    n = write(log, whole, inspections, ["batch", "year"], dynamic=True)
    log.info("batch %s read %s inspections, left out %s", k, seen.get["rows"], seen.get["rows"] - n)
    if not n:
        return
    kept = stored(spark, inspections, INSPECTIONS)
    years = sorted(r[0] for r in kept.where(F.col("batch") == k).select("year").distinct().collect())  # calendar years
    best = kept.where(F.col("year").isin(years)).groupBy("key", "year").agg(F.min("state4").alias("state4"), F.max("age").alias("age"))
    write(log, best.select("key", "state4", "age", "year"), f"{out}/panel", ["year"], dynamic=True)
    begins = sorted({y - d for y in years for d in (0, 1)})
    panel = stored(spark, f"{out}/panel", PANEL).where(F.col("year").isin(sorted({y + d for y in begins for d in (0, 1)})))
    pairs = next_year_pairs(panel).where(F.col("year").isin(begins))
    write(log, transitions(pairs, cfg["alpha"]), f"{out}/transitions", ["year"], dynamic=True)


def transitions(pairs: DataFrame, alpha: float) -> DataFrame:
    """A row a year and state: ``n`` pairs and the smoothed share of each next state."""
    led = [F.count_if(F.col("y_next") == k) for k in range(N_STATES)]
    shares = [((c + alpha) / (F.count("*") + alpha * N_STATES)).alias(f"p{k}") for k, c in enumerate(led)]
    return pairs.groupBy("year", "state4").agg(F.count("*").alias("n"), *shares).select("state4", "n", *(f"p{k}" for k in range(N_STATES)), "year")


def output(spark: SparkSession, out: str) -> DataFrame:
    """Both tables as they stand, one below the other; ``part`` tells which."""
    panel = stored(spark, f"{out}/panel", PANEL).withColumn("part", F.lit("panel"))
    moves = stored(spark, f"{out}/transitions", TRANSITIONS).withColumn("part", F.lit("transitions"))
    return panel.unionByName(moves, allowMissingColumns=True)


if __name__ == "__main__":
    main("inspection_panel", run, "Take new inspections into the condition panel.")
