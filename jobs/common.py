"""What the jobs share: command line, configuration, counted writes."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def configuration(spark: SparkSession, defaults: dict, path: str | None) -> dict:
    """``defaults``, with a JSON file's entries over them; the file may be remote."""
    own = spark.read.json(path, multiLine=True).first().asDict() if path else {}
    if unknown := sorted(set(own) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | {k: type(defaults[k])(v) for k, v in own.items()}


def stored(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A table that a run has written, or an empty one where none has yet."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def write(log: logging.Logger, df: DataFrame, path: str, by: list[str], dynamic: bool = False) -> int:
    """Write ``df`` as Parquet partitioned ``by``, in files of a sound size however skewed the
    partitions are, over what is there (with ``dynamic``, over the partitions it has rows of);
    returns how many rows that were, and logs it."""
    seen = Observation()
    counted = df.hint("rebalance", *by).observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").partitionBy(*by).option("partitionOverwriteMode", "dynamic" if dynamic else "static").parquet(path)
    n = seen.get["rows"]
    log.info("wrote %s rows to %s", n, path)
    return n


def main(name: str, run: Callable, description: str) -> None:
    """The command line: ``--tables --out [--config]``; creates the session and stops it."""
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--tables", required=True, help="folder or URI of the input tables")
    parser.add_argument("--out", required=True, help="folder or URI of the output, kept from run to run")
    parser.add_argument("--config", help="JSON file with settings")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args.tables, args.out, args.config)
    finally:
        spark.stop()
