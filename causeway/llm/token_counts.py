"""Token counts by a separator scan of flat, unindexed token files.

A token file is a run of fixed-width ids; documents end with a separator id, and nothing
says where. Files are cut into blocks of ``BLOCK`` tokens that any executor reads by
itself; a vectorised search gives the separators of each block. Two running sums over the
blocks of a file - separators seen so far, and the last separator's place - stitch the
documents that go over block edges, however many blocks they span. Tokens after the last
separator are a document of their own that isn't ``closed``; an empty file has none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import checkpoint_dir, cut, shuffle_partitions, small_batches
from causeway.llm.tokens import ID, encoder, vocabulary

BLOCK = 1 << 22


def filesystem(uri: str):
    """The pyarrow file system of a URI or an absolute path, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def remove(folder: str) -> None:
    """Delete a folder with all in it, if it is there."""
    from pyarrow import fs

    system, path = filesystem(folder)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def write_token_files(docs: DataFrame, folder: str, vocab=None) -> DataFrame:
    """Write one flat file a partition; returns ``path, ordinal, doc_id`` of what was written.

    The returned table was written with the files: files of task attempts that it doesn't
    name are remains of failed ones.
    """
    vocab = vocab or vocabulary()
    small_batches(docs.sparkSession)
    separator = vocab[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(vocab, special=False), TaskContext.get()
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        name, n, out = f"{task.partitionId()}-{task.taskAttemptId()}.tokens", 0, None
        try:
            for b in batches:
                out = out or system.open_output_stream(f"{root}/{name}")
                for t in b.column("text").to_pylist():
                    out.write(np.append(encode(t), separator).astype(ID).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * len(b), pa.string()), pa.array(np.arange(n, n + len(b))), b.column("doc_id")], names=["path", "ordinal", "doc_id"])
                n += len(b)
        finally:
            if out:
                out.close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut(docs.select("doc_id", "text").mapInArrow(run, f"path string, ordinal long, doc_id {kind}"), spread=True)


def scan(spark: SparkSession, paths: list[str] | DataFrame, separator: int, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """``path, ordinal, start, n_tokens, closed`` of every document in the files; the separator isn't counted."""
    files = paths if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "path string")
    width = np.dtype(dtype).itemsize

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = []
            for p in b.column("path").to_pylist():
                system, path = filesystem(p)
                bytes_ = system.get_file_info(path).size
                if bytes_ % width:
                    raise ValueError(f"{p} doesn't hold whole tokens of {width} bytes")
                n.append(bytes_ // width)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(n, pa.int64())], names=["path", "tokens"])

    known = files.select("path").distinct().mapInArrow(sizes, "path string, tokens long").where("tokens > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(block).cast("long"))
    blocks = known.select("path", F.explode(starts).alias("at"), "tokens").select("path", "at", F.least(F.lit(block), F.col("tokens") - F.col("at")).alias("n"), (F.col("at") + block >= F.col("tokens")).alias("last"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                p, at, n, last = (c[i].as_py() for c in b.columns)
                system, path = filesystem(p)
                with system.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(n * width, at * width), dtype)
                ends = np.flatnonzero(ids == separator).astype(np.int64) + at
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([at], pa.int64()), pa.array([n], pa.int64()), pa.array([last]), pa.array([ends], pa.list_(pa.int64()))], names=["path", "at", "n", "last", "ends"])

    dealt = blocks.repartition(shuffle_partitions(spark), "path", "at")
    found = cut(dealt.mapInArrow(search, "path string, at long, n long, last boolean, ends array<long>"), spread=True)
    # the prefix scan goes over one slim row a block
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    slim = found.select("path", "at", F.size("ends").cast("long").alias("k"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("end"))
    stitched = slim.select("path", "at", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("end").over(before) + 1, F.lit(0)).alias("open"))
    whole = found.join(stitched, ["path", "at"])
    stop = F.col("at") + F.col("n")
    tail = F.when(F.size("ends") > 0, F.element_at("ends", -1) + 1).otherwise(F.col("open"))
    rest = F.when(F.col("last") & (tail < stop), F.array(F.struct(stop.alias("end"), F.lit(False).alias("closed")))).otherwise(F.array().cast("array<struct<end:bigint,closed:boolean>>"))
    ends = F.concat(F.transform("ends", lambda e: F.struct(e.alias("end"), F.lit(True).alias("closed"))), rest)
    rows = whole.select("path", "first", "open", ends.alias("all")).select("path", "first", "open", "all", F.posexplode("all").alias("pos", "doc"))
    start = F.when(F.col("pos") == 0, F.col("open")).otherwise(F.get("all", F.col("pos") - 1)["end"] + 1)
    return rows.select("path", (F.col("first") + F.col("pos")).alias("ordinal"), start.alias("start"), (F.col("doc.end") - start).alias("n_tokens"), F.col("doc.closed").alias("closed"))


def count_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens`` of every document, by writing flat token files and scanning them.

    The files go when they have been scanned: what was found is in the shared folder then.
    """
    vocab = vocabulary()
    folder = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    written = write_token_files(docs, folder, vocab)
    counts = scan(docs.sparkSession, written.select("path"), vocab[2])
    remove(folder)
    return written.join(counts, ["path", "ordinal"]).select("doc_id", "n_tokens")
