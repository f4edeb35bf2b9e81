"""Corpus pipeline: toxicity, line dedup, near duplicates, benchmark decontamination, packing.

Each stage takes what its predecessor kept, written as Parquet and read again; all but the
last return the columns of ``documents`` (``COLUMNS``), and any further column ends in the
first. A document whose lines are all dropped stays as an empty text. Null ids are documents
that no stage but toxicity, line dedup and decontamination takes away.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from causeway.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from causeway.llm.common import checkpoint_dir, read
from causeway.llm.token_counts import remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier fitted on this corpus's labelled rows calls toxic go."""
    model = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.reject(docs.select(*COLUMNS), model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in the largest doc_id only."""
    return line_dedup.dedup_lines(docs.select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the smallest doc_id stays."""
    return jaccard_join.keep_one(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return packing.pack(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what they hand on lies in the shared folder, and goes when
    the next stage has written its own (packing writes its tokens before it returns)."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, last = read(spark, sf_dir, "documents"), ""
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(at := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(at)
        if last:
            remove(last)
        last = at
    out = STAGES[-1][1](spark, docs, sf_dir)
    remove(folder)
    return out
