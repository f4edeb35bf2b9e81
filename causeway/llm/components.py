"""Connected components of an edge table: smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a``, ``b``; long): the smallest node reachable.

    Each round takes the smallest label among neighbours and then the label's own label,
    so that distances halve; it ends when nothing changed. Labels are written to the shared
    folder after each round. A node with very many edges is a skewed join's key only.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        step = cut(step)
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("top"))
        new = cut(step.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("top", "component")).alias("component")))
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
