"""Toxicity: a linear classifier with a counterfactual penalty on identity terms.

Features of a text are its distinct words (any script, lower-cased, without marks at their
ends) and the words' first three to five letters, each as present or not. A bounded sample
of labelled rows (``SAMPLE``, the first by a hash of the id) gives the features that occur
in ``MIN_DOCS`` rows or more with a log-odds ratio beyond chance, and logistic regression
weighs them. For the penalty, every labelled text that names a group is taken again with
the names of others in its place, and without any; a part of the texts that name none is
taken again with a name as a neutral mention. The loss adds ``pairing`` times the squared
difference of a text's score and its counterfactual's, which keeps the text's label. So a
group's name alone moves no score. Null and empty texts get the score of no feature.

Scores are computed in whole, over every text; labels, language, source and ids are never
inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import cut, small_batches

THRESHOLD = 0.7
#: Labelled rows that a fit sees at most, features it keeps at most, rows a feature must occur in.
SAMPLE, FEATURES, MIN_DOCS = 12_000, 6_000, 3
#: Words whose features a task remembers.
WORDS = 250_000
#: Identity terms, by group, in the languages of the corpus.
IDENTITY = {
    "religion": ["muslim", "jewish", "christian", "hindu", "buddhist", "catholic", "atheist", "musulman", "juif", "chrétien", "judío", "cristiano", "muslimisch", "jüdisch", "christlich"],
    "origin": ["black", "white", "asian", "african", "arab", "latino", "mexican", "chinese", "immigrant", "refugee", "noir", "arabe", "immigré", "schwarz", "ausländer", "negro", "inmigrante"],
    "gender": ["woman", "women", "man", "men", "female", "male", "transgender", "femme", "homme", "frau", "mann", "mujer", "hombre"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "homosexuel", "lesbienne", "schwul", "lesbisch", "homosexual"],
    "ability": ["disabled", "blind", "deaf", "autistic", "handicapé", "aveugle", "behindert", "discapacitado", "ciego"],
    "age": ["old", "young", "elderly", "vieux", "jeune", "alt", "jung", "viejo", "joven"],
}
TERMS = [t for group in IDENTITY.values() for t in group]
_TERM = re.compile(r"(?<!\w)(?:" + "|".join(sorted(TERMS, key=len, reverse=True)) + r")(?!\w)")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def word_features(word: str) -> tuple[int, ...]:
    w = _EDGE.sub("", word)
    if not w:
        return ()
    names = [w, *("^" + w[:k] for k in (3, 4, 5) if len(w) >= k)]
    return tuple(zlib.crc32(n.encode("utf-8", "surrogatepass")) for n in names)


def text_features(text: str | None, cache: dict[str, tuple[int, ...]]) -> set[int]:
    out: set[int] = set()
    if len(cache) > WORDS:
        cache.clear()
    for w in set((text or "").lower().split()):
        f = cache.get(w)
        if f is None:
            f = cache[w] = word_features(w)
        out.update(f)
    return out


def counterfactuals(text: str | None, key: int) -> tuple[str, str] | None:
    """``text`` with other terms in the place of its own (which ones, ``key`` tells), and with none; None if it names none."""
    text = (text or "").lower()
    if not _TERM.search(text):
        return None
    step = 1 + zlib.crc32(str(key).encode()) % (len(TERMS) - 1)
    return _TERM.sub(lambda m: TERMS[(TERMS.index(m[0]) + step) % len(TERMS)], text), _TERM.sub("", text)


class Model:
    """Weights by feature, and the bias."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None, cache: dict[str, tuple[int, ...]]) -> float:
        """``cache`` maps words to those of their features that have a weight."""
        hit: set[int] = set()
        get, weights = cache.get, self.weights
        for w in set((text or "").lower().split()):
            f = get(w)
            if f is None:
                f = cache[w] = tuple(x for x in word_features(w) if x in weights)
            if f:
                hit.update(f)
        z = self.bias + sum(weights[x] for x in sorted(hit))
        return float(1 / (1 + np.exp(-z))) if z >= 0 else float(np.exp(z) / (1 + np.exp(z)))


def select_features(rows: DataFrame, positive: int, negative: int) -> list[int]:
    """Of ``toxic, f`` rows (features as unsigned 32-bit numbers), the features whose log-odds
    ratio is three standard errors from none or more; the ``FEATURES`` clearest at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [np.frombuffer(x, "<u4") for x in b.column("f").to_pylist()]
            y = np.repeat(np.array(b.column("toxic").to_pylist(), np.int64), [len(x) for x in f])
            key, n = np.unique(np.concatenate([np.zeros(0, "<u4"), *f]).astype(np.int64) << 1 | y, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 1), pa.array(n * (1 - (key & 1))), pa.array(n * (key & 1))], names=["f", "n0", "n1"])

    c = rows.mapInArrow(count, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    a, b, p, q = F.col("n1") + 0.5, F.col("n0") + 0.5, F.lit(positive) - F.col("n1") + 0.5, F.lit(negative) - F.col("n0") + 0.5
    z = F.abs((F.log(a / p) - F.log(b / q)) / F.sqrt(1 / a + 1 / b + 1 / p + 1 / q))
    c = c.where(F.col("n0") + F.col("n1") >= MIN_DOCS).withColumn("z", z).where("z >= 3")
    return [r[0] for r in c.orderBy(F.desc("z"), "f").limit(FEATURES).select("f").collect()]


def objective(w: np.ndarray, bias: float, r: np.ndarray, k: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray, pairing: float, ridge: float) -> tuple[float, np.ndarray, float]:
    """The loss and its slopes in the weights and the bias.

    ``r, k``: row and column of each present feature; ``left, right``: rows that are each
    other's counterfactual. The loss is the mean log loss, ``pairing`` times the mean squared
    gap between the scores of counterfactuals, and a ridge.
    """
    n, m = len(y), len(w)
    z = np.clip(np.bincount(r, w[k], n) + bias, -40, 40)
    p = 1 / (1 + np.exp(-z))
    gap, slope = p[left] - p[right], p * (1 - p)
    d = (p - y) / n
    np.add.at(d, left, 2 * pairing * gap * slope[left] / len(left))
    np.add.at(d, right, -2 * pairing * gap * slope[right] / len(right))
    loss = (np.logaddexp(0, z) - y * z).mean() + pairing * (gap**2).mean() + ridge / n * (w @ w) / 2
    return float(loss), np.bincount(k, d[r], m) + ridge / n * w, float(d.sum())


def fit(rows: list[tuple[int, np.ndarray, list[np.ndarray]]], pairing: float = 10.0, ridge: float = 1e-3, steps: int = 300, seed: int = 0) -> Model:
    """``rows``: label and sorted chosen features of each text, and those of its counterfactuals.
    Without both labels, a constant score."""
    y = np.array([r[0] for r in rows], float)
    if len(set(y.tolist())) < 2:
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Model({}, float(np.log(p / (1 - p))))
    pos, neg = y.sum(), len(y) - y.sum()
    of_term = [np.unique(np.array(word_features(t), "<u4")) for t in TERMS]
    names = np.unique(np.concatenate([*(r[1] for r in rows), *(c for r in rows for c in r[2]), *of_term]))
    place = lambda f: np.searchsorted(names, f).astype(np.int32)
    sets, labels, of_term = [place(r[1]) for r in rows], [r[0] for r in rows], [place(t) for t in of_term]
    left, right = [], []

    def add(i: int, features: np.ndarray) -> None:
        left.append(i)
        right.append(len(sets))
        sets.append(features.astype(np.int32))
        labels.append(labels[i])

    for i, r in enumerate(rows):
        for c in r[2]:
            add(i, place(c))
    rng, free = np.random.default_rng(seed), np.array([i for i, r in enumerate(rows) if not r[2]], int)
    for i in rng.permutation(free)[: max(50, len(rows) // 4)]:
        for t in rng.choice(len(TERMS), 2, replace=False):
            add(int(i), np.union1d(sets[i], of_term[t]))
    column = {int(f): i for i, f in enumerate(names)}
    r = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    k = np.concatenate(sets)
    y, m = np.array(labels, float), len(column)
    left, right = np.array(left), np.array(right)
    w, bias, g2, b2 = np.zeros(m), float(np.log(pos / neg)), np.full(m, 1e-8), 1e-8
    for _ in range(steps):  # AdaGrad on the whole sample: deterministic, no step size to tune
        _, gw, gb = objective(w, bias, r, k, y, left, right, pairing, ridge)
        g2 += gw**2
        b2 += gb**2
        w -= 0.3 * gw / np.sqrt(g2)
        bias -= 0.3 * gb / np.sqrt(b2)
    return Model({f: float(w[i]) for f, i in column.items() if w[i]}, float(bias))


def is_held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Model:
    """Fit on at most ``sample`` labelled rows that aren't held out, the first by a hash of their ids."""
    spark = docs.sparkSession
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)))
    picked = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    if not picked:
        return Model({}, 0.0)
    few = spark.createDataFrame([(int(r[0]), int(r[1])) for r in picked], "doc_id long, toxic int")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        pack = lambda t: np.array(sorted(text_features(t, cache)), "<u4").tobytes()
        for b in batches:
            texts = b.column("text").to_pylist()
            others = [counterfactuals(t, d) for t, d in zip(texts, b.column("doc_id").to_pylist(), strict=True)]
            columns = [b.column("doc_id"), b.column("toxic"), pa.array(map(pack, texts), pa.binary()), pa.array([[*map(pack, o or ())] for o in others], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "f", "others"])

    small_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id")
    own = cut(own.mapInArrow(extract, "doc_id long, toxic int, f binary, others array<binary>"), spread=True)
    by = {r[0]: r[1] for r in own.groupBy("toxic").count().collect()}
    chosen = select_features(own, by.get(1, 0), by.get(0, 0)) if len(by) == 2 else []
    terms = {f for t in TERMS for f in word_features(t)}
    kept = np.array(sorted({*chosen, *terms}), "<u4")

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = lambda x: np.intersect1d(np.frombuffer(x, "<u4"), kept, True).tobytes()
        for b in batches:
            f, others = [few(x) for x in b.column("f").to_pylist()], [[few(x) for x in xs] for xs in b.column("others").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(f, pa.binary()), pa.array(others, pa.list_(pa.binary()))], names=b.schema.names)

    got = own.mapInArrow(narrow, own.schema).collect()
    got.sort(key=lambda x: (x[0], bytes(x[2])))
    numbers = lambda x: np.frombuffer(x, "<u4")
    return fit([(x[1], numbers(x[2]), [*map(numbers, x[3])]) for x in got], **options)


def scorer(spark: SparkSession, model: Model):
    """A function from a text column to its score. Only the text goes to a worker, only the score comes back."""
    small_batches(spark)
    given = spark.sparkContext.broadcast((model.weights, model.bias))  # at most FEATURES and the terms'

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted, cache = Model(*given.value), {}
        for texts in batches:
            out = []
            for t in texts:
                if len(cache) > WORDS:
                    cache.clear()
                out.append(fitted.score(t.as_py(), cache))
            yield pa.array(out, pa.float64())

    return run


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names are replaced."""
    scored = docs.drop("score", "predicted").withColumn("score", scorer(docs.sparkSession, model)(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model doesn't call toxic, with their own columns."""
    return docs.where(scorer(docs.sparkSession, model)(F.col("text")) < THRESHOLD)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
