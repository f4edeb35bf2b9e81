"""Inspection sheets as a stream: new yearly files join the panel as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from causeway.operators.panel import SHEET, panel_of


def sheet_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The panel rows of sheets that appear in ``folder``; all sheets have the columns of ``SHEET``, in order."""
    text = T.StructType([T.StructField(c, T.StringType()) for c in SHEET.values()])
    raw = spark.readStream.csv(folder, header=True, schema=text, pathGlobFilter="*.txt")
    year = F.regexp_extract(F.col("_metadata.file_name"), r"(\d{2})\.txt$", 1)
    return panel_of(raw.withColumn("year", year.cast("int") + 2000).where(F.length(year) > 0))


def append_panel(panel: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the stream to a Parquet panel partitioned by year; each file is taken once."""
    writer = panel.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("year").outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def state_counts(panel: DataFrame) -> DataFrame:
    """Running counts of states by year, for a streaming or a plain panel."""
    return panel.groupBy("year", "state4").agg(F.count("*").alias("n"))
