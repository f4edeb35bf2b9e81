"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens. Windows of ``window`` tokens are filled
in rounds: a source earns credit for its share of the window and, when its turn comes,
hands over as many whole quanta of tokens as its credit covers; what it couldn't hand over
stays as its deficit for the next window. So after any number of windows each source is
within one quantum of its target. When queues run dry, the others' targets are scaled up.
The windows follow each other without a gap and are cut into sequences of ``length``
tokens, so only the last sequence of all is padded.

The credit of a source after r windows is a closed form, so no window waits for another:
every document finds the windows, sequences and places of its own tokens from its place in
its queue. A queue is the concatenation of the input partitions' parts, whose lengths
travel as one small table (partition, source, tokens); deficits thus carry over partitions
as over windows. Tokens are written once to the shared folder and never shuffled.

Targets default to the sources' own shares of all tokens. Null sources are one queue.
Every source has a queue of its own, however many there are: a number per source is
collected and broadcast. Null or empty texts are documents of one token, the separator.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import cut, small_batches
from causeway.llm.tokens import ID, encoder, vocabulary

LENGTH, WINDOW, QUANTUM = 1024, 32 * 1024, 256
#: Binary digits behind the point of what a weight of one has earned.
DIGITS = 120
#: So many numbers of windows are held at once by a task, about.
HELD = 1 << 22
#: A table of queue parts up to this many rows is broadcast; a larger one is joined.
BROADCAST_PARTS = 200_000


def whole_numbers(targets: list[float]) -> list[int]:
    """Whole numbers in the targets' proportions, whatever their sizes; a target that isn't zero
    stays so. Exact where the largest takes 53 binary digits or fewer."""
    if not all(math.isfinite(t) and t >= 0 for t in targets):
        raise ValueError("targets are finite and not negative")
    parts = [Fraction(repr(float(t))) for t in targets]
    scale = math.lcm(*(p.denominator for p in parts))
    whole = [int(p * scale) for p in parts]
    divisor, most = math.gcd(*whole) or 1, max(whole, default=0)
    if most // divisor < 1 << 53:
        return [w // divisor for w in whole]
    return [max(1, (w << 53) // most) if w else 0 for w in whole]


class Schedule:
    """How many tokens each queue has handed over before window r, in closed form.

    What a weight of one has earned before a window is one number for all queues. It grows
    evenly until a queue runs dry; these phases hold no numbers of single queues. Queues
    with a target of nothing earn by their sizes after all others are dry.
    """

    def __init__(self, totals: list[int], targets: list[float] | None = None, window: int = WINDOW, quantum: int = QUANTUM):
        self.totals, self.quantum, self.window = totals, quantum, window
        weights = whole_numbers(targets) if targets else totals
        self.weights = [w or t for w, t in zip(weights, totals, strict=True)]
        self.late = [not w for w in weights]
        self._t, self._w, self._late = np.array(totals, np.int64), np.array(self.weights, np.float64), np.array(self.late, bool)
        self.windows = 0
        #: of the queues with a target, and of those without: first windows, earned by a weight of one before them, sums of weights
        self.phases = [self._phases([i for i, x in enumerate(self.late) if x == late and totals[i]]) for late in (False, True)]

    def _phases(self, queues: list[int]) -> tuple[list[int], list[int], list[int]]:
        at, earned, whole = [self.windows], [0], [sum(self.weights[i] for i in queues)]
        dry = sorted((-(-(self.totals[i] << DIGITS) // self.weights[i]), self.weights[i]) for i in queues)
        i, live = 0, whole[0]
        while i < len(dry):
            step = (dry[i][0] - earned[-1] - 1) * live // (self.window << DIGITS) + 1
            at.append(at[-1] + step)
            earned.append(earned[-1] - (-step * (self.window << DIGITS) // live))
            while i < len(dry) and dry[i][0] <= earned[-1]:
                live -= dry[i][1]
                i += 1
            whole.append(live)
        self.windows = at[-1]
        return at, earned, whole

    def given(self, r: int) -> list[int]:
        """Tokens of each queue before window ``r``."""
        return self.shares(r).tolist()

    def shares(self, r: int) -> np.ndarray:
        """``given`` as an array."""
        if r >= self.windows:
            return self._t
        late = r >= self.phases[1][0][0]
        at, earned, whole = self.phases[late]
        i = bisect_right(at, r) - 1
        each = earned[i] - (-(r - at[i]) * (self.window << DIGITS) // whole[i])
        x = np.minimum(self._w * (each / (1 << DIGITS)), self._t + 1.0)
        e = np.floor(x).astype(np.int64)
        near = (np.abs(x - np.rint(x)) < 1e-3 + 1e-15 * x) & (x > 0) & (x < self._t + 0.5) & (self._late == late)
        for k in np.flatnonzero(near):  # too near to a whole number for floating point
            e[k] = self.weights[k] * each >> DIGITS
        e = np.where(self._late == late, np.minimum(e, self._t), np.where(self._late, 0, self._t))
        return np.where(e == self._t, e, e // self.quantum * self.quantum)

    def window_of(self, s: int, x: int) -> int:
        """The window that gets token ``x`` of queue ``s``: the first r with given(r + 1) > x."""
        goal = min(self.totals[s], (x // self.quantum + 1) * self.quantum)
        at, earned, whole = self.phases[self.late[s]]
        need = -(-(goal << DIGITS) // self.weights[s])
        i = bisect_left(earned, need) - 1
        return at[i] + (need - earned[i] - 1) * whole[i] // (self.window << DIGITS)


def tokenized(docs: DataFrame, source: str = "source", vocab=None, separator: int = 0) -> DataFrame:
    """``doc_id, queue, part, first, n, ids``: ids with the separator, and where they begin
    among the tokens of this partition and queue. Written to the shared folder."""
    vocab = vocab or vocabulary()
    small_batches(docs.sparkSession)
    has = source in docs.columns
    queue = F.coalesce(F.pmod(F.xxhash64(source), F.lit(1 << 62)), F.lit(-1).cast("long")) if has else F.lit(-1).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(vocab), TaskContext.get().partitionId(), {}
        for b in batches:
            for at in range(0, len(b), 512):
                c = b.slice(at, 512)
                queues = c.column("queue").to_numpy()
                ids = [np.append(encode(t), separator).astype(ID) for t in c.column("text").to_pylist()]
                first = []
                for q, x in zip(queues.tolist(), ids, strict=True):
                    first.append(seen.get(q, 0))
                    seen[q] = first[-1] + len(x)
                yield pa.RecordBatch.from_arrays(
                    [c.column("doc_id"), c.column("queue"), pa.array([part] * len(c), pa.int32()), pa.array(first, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "queue", "part", "first", "n", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select("doc_id", queue.alias("queue"), "text")
    return cut(plain.mapInArrow(run, f"doc_id {kind}, queue long, part int, first long, n long, ids binary"), spread=True)


def pack(
    docs: DataFrame,
    targets: dict[str | None, float] | None = None,
    length: int = LENGTH,
    window: int = WINDOW,
    quantum: int = QUANTUM,
    vocab=None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    window_id`` (and ``ids``, unsigned 16-bit little-endian, on demand)."""
    spark = docs.sparkSession
    tokens = tokenized(docs, vocab=vocab)
    parts = cut(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")))
    sums = sorted((r[0], r[1]) for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect())
    queues, totals = [q for q, _ in sums], [n for _, n in sums]
    wanted = None
    if targets is not None:
        named = spark.createDataFrame([(k, float(v)) for k, v in targets.items()], "s string, v double")
        code = F.coalesce(F.pmod(F.xxhash64("s"), F.lit(1 << 62)), F.lit(-1).cast("long"))
        by = {r[0]: r[1] for r in named.select(code, "v").collect()}
        wanted = [by.get(q, 0.0) for q in queues]
    # the parts' places in their queues: a running sum by queue over partitions
    from pyspark.sql import Window

    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(parts.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    small = bases.count() <= BROADCAST_PARTS
    placed = tokens.join(F.broadcast(bases) if small else bases, ["queue", "part"])
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window_id"]

    given = spark.sparkContext.broadcast((np.array(queues, np.int64), Schedule(totals, wanted, window, quantum)))

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, plan = given.value
        most = max(1, min(2048, HELD // max(1, len(order))))
        known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def edges(r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Of window r: tokens given before and after, and each queue's place among all tokens."""
            if r not in known:
                if len(known) >= most:
                    known.clear()
                a, b = plan.shares(r), plan.shares(r + 1)
                known[r] = a, b, a.sum() + np.cumsum(b - a) - (b - a)
            return known[r]

        for b in batches:
            rows: list[list] = [[] for _ in range(9)]
            doc = b.column("doc_id")
            index: list[int] = []
            slots = np.searchsorted(order, b.column("queue").to_numpy()).tolist()
            for i, (s, base, first, n, raw) in enumerate(zip(slots, *(b.column(c).to_pylist() for c in ("base", "first", "n", "ids")), strict=True)):
                x, done = base + first, 0
                ids = np.frombuffer(raw, ID).astype("<u4")
                while done < n:
                    r = plan.window_of(s, x)
                    a, z, places = edges(r)
                    g = int(places[s]) + x - int(a[s])
                    take = min(n - done, int(z[s]) - x, length - g % length)
                    piece = ids[done : done + take]
                    index.append(i)
                    for c, v in zip(rows, (done, take, zlib.crc32(piece.tobytes()), n, g // length, g % length, r, piece), strict=False):
                        c.append(v)
                    done, x = done + take, x + take
            arrays = [doc.take(pa.array(index, pa.int64())), *(pa.array(c, pa.int64()) for c in rows[:7])]
            if with_ids:
                arrays.append(pa.array([p.astype(ID).tobytes() for p in rows[7]], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=[*out, "ids"][: len(arrays)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in out[1:]) + ", ids binary" * with_ids
    return placed.select("doc_id", "queue", "base", "first", "n", "ids").mapInArrow(cuts, schema)
