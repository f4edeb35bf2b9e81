"""The folder that driver and executors share, and plans whose lineage is cut there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; only a local session may use a folder of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="causeway-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame, spread: bool = False) -> DataFrame:
    """Write ``df`` as a checkpoint of two files a core at most, or of its own partitions where rows are wide."""
    shared_folder(df.sparkSession)
    return df.checkpoint() if spread else df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism).checkpoint()
