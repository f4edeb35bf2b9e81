"""Boosted trees for the next state: all classes together, from histograms of softmax gradients.

Rows are cut into at most ``bins`` ranges a feature and counted first: rows that share all
ranges and the outcome are one row with a weight, whatever the table's size. A level of a
round's trees (one for each class) is one aggregate: every task sums its own rows'
gradients by (class, node, feature, range), the tasks' sums are added, and the driver picks
splits from cells whose number doesn't depend on the rows. Scores lie beside the rows, in
blocks of bounded size, and are written anew every ``KEEP`` rounds, so a level adds a few
trees at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators.lineage import cut
from causeway.schema import N_STATES

#: Rounds after which rows' scores are written.
KEEP = 10
#: Distinct rows a task takes, about: fewer would cost more to start than to sum.
ROWS_A_TASK = 10_000
#: Numbers of all tasks together that the driver adds up itself; beyond, Spark does.
DRIVER_ADDS = 1 << 20
#: The error of a feature's quantiles is one in this many rows.
ACCURACY = 10_000


def cut_points(df: DataFrame, columns: list[str], bins: int) -> list[list[float]]:
    """Sorted values that part each feature into at most ``bins`` ranges: all but the largest
    of up to ``bins`` distinct values, approximate quantiles of more."""
    shares = [k / bins for k in range(1, bins)]
    few = {c: F.array_sort(F.collect_set(c)) for c in columns}
    counts = df.agg(*(F.approx_count_distinct(c, 0.02).alias(c) for c in columns)).first()
    small = [c for c in columns if counts[c] <= 2 * bins]
    found = df.agg(F.lit(0).alias("_"), *(few[c].alias(c) for c in small), *(F.percentile_approx(c, shares, ACCURACY).alias(c) for c in columns if c not in small)).first()
    out = []
    for c in columns:
        values = sorted(set(found[c] or []))
        if c in small:
            values = values[:-1]
            if len(values) >= bins:
                values = sorted({values[len(values) * k // bins] for k in range(1, bins)})
        out.append([float(v) for v in values])
    return out


def bin_of(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted ``cuts`` lie below the value."""
    return F.size(F.filter(F.lit(np.asarray(cuts, float)), lambda c: c < value)).cast("short") if cuts else F.lit(0).cast("short")


class Tree:
    """A full tree of ``depth`` levels: ``feature`` (-1 where a node isn't split) and ``at``
    (the last range that goes left) by node, the root first, and ``leaf`` by last-level node."""

    def __init__(self, depth: int):
        self.feature = np.full(2**depth - 1, -1)
        self.at = np.zeros(2**depth - 1, int)
        self.leaf = np.zeros(2**depth)

    def node(self, x: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row of ranges after ``levels`` levels, from 0 in its level."""
        at = np.zeros(len(x), np.int32)
        for level in range(levels):
            right = np.zeros(len(x), bool)
            for j, own in enumerate(range(2**level - 1, 2 ** (level + 1) - 1)):  # a column a node: no row is picked by place
                if self.feature[own] >= 0:
                    right |= (at == j) & (x[:, self.feature[own]] > self.at[own])
            at = 2 * at + right
        return at


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def best_splits(g: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature and range of each node whose split takes most off the squared error, -1 without one.

    ``g``, ``w``: sums of residuals and weights by (node, feature, range). Of equal gains the
    first feature and range wins; gains below a billionth of the node's weight count as none.
    """
    left_g, left_w = np.cumsum(g, axis=2)[:, :, :-1], np.cumsum(w, axis=2)[:, :, :-1]
    all_g, all_w = g.sum(axis=2, keepdims=True), w.sum(axis=2, keepdims=True)
    right_g, right_w = all_g - left_g, all_w - left_w
    both = (left_w > 0) & (right_w > 0)
    difference = np.where(both, left_g / np.maximum(left_w, 1) - right_g / np.maximum(right_w, 1), 0.0)
    gain = np.round(left_w * right_w * difference**2 / np.maximum(all_w, 1) ** 2, 12).reshape(len(g), -1)
    if not gain.shape[1]:
        return np.full(len(g), -1), np.zeros(len(g), int)
    best = gain.argmax(axis=1)
    top = gain[np.arange(len(g)), best]
    width = g.shape[2] - 1
    return np.where(top > 1e-9, best // width, -1), best % width


class BoostedStates:
    """Adds ``p`` (by state, absent states 0) and ``state`` to rows of the fitted columns.

    Multinomial deviance, as many trees a round as states occur, ``max_depth`` levels each;
    splits by the error of the residuals, leaves by one Newton step for the deviance. Rows
    without an outcome are left out, a null feature is an error (impute it first); one
    outcome alone is predicted with certainty, none with zeros.
    """

    def __init__(self, n_estimators: int = 100, max_depth: int = 3, rate: float = 0.1, bins: int = 64):
        self.n_estimators, self.max_depth, self.rate, self.bins = n_estimators, max_depth, rate, bins

    def fit(self, df: DataFrame, columns: list[str], label: str) -> BoostedStates:
        self.columns, self.rounds = columns, []
        xs = [f"x{i}" for i in range(len(columns))]
        data = df.select(*(F.col(c).cast("double").alias(x) for c, x in zip(columns, xs, strict=True)), F.col(label).cast("int").alias("y")).where("y IS NOT NULL")
        self.cuts = cut_points(data, xs, self.bins)
        binned = data.select("y", *(bin_of(F.col(x), c).alias(x) for x, c in zip(xs, self.cuts, strict=True)))
        rows = cut(binned.groupBy("y", *xs).agg(F.count("*").cast("double").alias("w")))
        found = rows.groupBy("y").agg(F.sum("w"), F.count("*")).collect()
        counts = {r[0]: r[1] for r in found}
        self.classes = sorted(counts)
        self.base = np.log([counts[c] / sum(counts.values()) for c in self.classes])
        if len(self.classes) < 2:
            return self
        place = F.array_position(F.lit(self.classes), F.col("y")) - 1
        rows = rows.select(place.cast("short").alias("k"), "w", *xs).coalesce(max(1, sum(r[2] for r in found) // ROWS_A_TASK))
        blocks = cut(rows.mapInArrow(_pack(len(xs), self.base), BLOCK)).persist()
        self.tasks, done = blocks.rdd.getNumPartitions(), 0
        for r in range(self.n_estimators):
            if r - done == KEEP:
                blocks, old, done = self._scored(blocks, self.rounds[done:]).persist(), blocks, r
                old.unpersist()
            self.rounds.append(self._round(blocks, self.rounds[done:]))
        blocks.unpersist()
        return self

    def _scored(self, blocks: DataFrame, rounds: list[list[Tree]]) -> DataFrame:
        rate, depth, width, k = self.rate, self.max_depth, len(self.columns), len(self.classes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for y, w, x, scores in _unpack(batch, width, k):
                    yield _block(y, w, x, _add(x, scores, rounds, rate, depth))

        return cut(blocks.mapInArrow(run, BLOCK))

    def _round(self, blocks: DataFrame, rounds: list[list[Tree]]) -> list[Tree]:
        """A tree for each class, a level an aggregate; the last level's sums give the leaves, too."""
        trees, k, whole = [Tree(self.max_depth) for _ in self.classes], len(self.classes), max(range(len(self.cuts)), key=lambda f: len(self.cuts[f]))
        for level in range(self.max_depth):
            sums = _histogram(blocks, self.tasks, rounds, trees, level, self.rate, [len(c) + 1 for c in self.cuts])
            own = slice(2**level - 1, 2 ** (level + 1) - 1)
            for tree, (g, h, w) in zip(trees, sums, strict=True):
                tree.feature[own], tree.at[own] = best_splits(g, w)
                if level == self.max_depth - 1:
                    for node, (f, at) in enumerate(zip(tree.feature[own], tree.at[own], strict=True)):
                        for side in (0, 1):
                            part = slice(None) if f < 0 else slice(at + 1, None) if side else slice(at + 1)
                            below = h[node, whole if f < 0 else f, part].sum()
                            tree.leaf[2 * node + side] = (k - 1) / k * g[node, whole if f < 0 else f, part].sum() / below if below > 1e-150 else 0.0
        return trees

    def predict(self, df: DataFrame) -> DataFrame:
        rounds, rate, depth, base, classes = self.rounds, self.rate, self.max_depth, self.base, self.classes
        cuts = [np.asarray(c) for c in self.cuts]

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                values = np.stack(batch.to_list()) if len(batch) else np.zeros((0, len(cuts)))
                x = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, values.T, strict=True)], axis=1)
                p = np.zeros((len(x), N_STATES))
                if classes:
                    p[:, classes] = _softmax(_add(x, np.tile(base, (len(x), 1)), rounds, rate, depth))
                yield pd.Series(list(p))

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        probability = F.pandas_udf(run, "array<double>")
        return df.withColumn("p", probability(F.array(*(F.col(c).cast("double") for c in self.columns)))).withColumn("state", S.arg_max(F.col("p")))


#: A block of distinct rows: classes, weights, ranges and scores, row after row.
BLOCK = "y array<short>, w array<double>, x array<short>, s array<double>"


def _block(y: np.ndarray, w: np.ndarray, x: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    columns = {"y": y.astype(np.int16), "w": w, "x": x.astype(np.int16).ravel(), "s": scores.ravel()}
    return pa.RecordBatch.from_pydict({c: pa.array([v]) for c, v in columns.items()})


def _pack(width: int, base: np.ndarray):
    """Rows ``k, w`` and the ranges, a batch a block, with the scores of no tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(2 + f).to_numpy() for f in range(width)], axis=1)
            yield _block(batch.column(0).to_numpy(), batch.column(1).to_numpy(), x, np.tile(base, (len(x), 1)))

    return run


def _unpack(batch: pa.RecordBatch, width: int, classes: int) -> Iterator[tuple[np.ndarray, ...]]:
    for i in range(batch.num_rows):
        y, w, x, s = (batch.column(c)[i].values.to_numpy() for c in "ywxs")
        yield y, w, np.asfortranarray(x.reshape(-1, width)), s.reshape(-1, classes)  # a feature lies together


def _add(x: np.ndarray, scores: np.ndarray, rounds: list[list[Tree]], rate: float, depth: int) -> np.ndarray:
    """``scores`` and what the trees of ``rounds`` add to them."""
    scores = scores.copy()
    for trees in rounds:
        for c, tree in enumerate(trees):
            scores[:, c] += rate * tree.leaf[tree.node(x, depth)]
    return scores


def _histogram(blocks: DataFrame, tasks: int, rounds: list[list[Tree]], trees: list[Tree], level: int, rate: float, widths: list[int]) -> np.ndarray:
    """By class: sums of residuals, of their slopes and of weights, by (node, feature, range) each."""
    k, nodes, features, width, depth = len(trees), 2**level, len(widths), max(widths), len(trees[0].leaf).bit_length() - 1
    shape, varied = (k, 3, nodes, features, width), [f for f, n in enumerate(widths) if n > 1] or [0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(shape), nodes * width
        for y, w, x, scores in (block for batch in batches for block in _unpack(batch, features, k)):
            p = _softmax(_add(x, scores, rounds, rate, depth))
            for c, tree in enumerate(trees):
                slope = p[:, c] * (1 - p[:, c])  # of either residual, of the class and of the others
                node = tree.node(x, level).astype(np.intp) * width
                for f in varied:
                    for j, v in enumerate((w * ((y == c) - p[:, c]), w * slope, w)):
                        sums[c, j, :, f] += np.bincount(node + x[:, f], v, n).reshape(nodes, width)
        flat = np.moveaxis(sums, 1, 0).reshape(3, -1)
        some = np.flatnonzero(flat[2])
        yield pa.RecordBatch.from_pydict({"cell": some, "g": flat[0][some], "h": flat[1][some], "w": flat[2][some]})

    sums = blocks.mapInArrow(run, "cell long, g double, h double, w double")
    out = np.zeros((3, k * nodes * features * width))
    if tasks * out.size > DRIVER_ADDS:
        sums = sums.groupBy("cell").agg(*(F.sum(c).alias(c) for c in "ghw"))
    cells = sums.toArrow()
    for total, c in zip(out, "ghw", strict=True):
        np.add.at(total, cells["cell"].to_numpy(), cells[c].to_numpy())
    return np.moveaxis(out.reshape(3, k, nodes, features, width), 0, 1)
