"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. The model of a category is a logistic
regression on the words of a text and on the probabilities of the categories before it;
in training these probabilities are out-of-fold, so later models learn from what earlier
ones say about texts they have not seen. Models are fitted on a bounded sample of the
labelled rows (``MOST_LABELLED``, those whose hash is smallest); every document is scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.llm.common import text_slices
from assayer.llm.suffixes import word_parts

#: Labelled rows that the models are fitted on, at most.
MOST_LABELLED = 5_000
FOLDS = 3
#: Features of one model, documents that a feature needs.
MOST_FEATURES = 1_500
LEAST_DOCUMENTS = 5
#: Standard errors by which a feature's share must differ between the classes.
LEAST_SCORE = 3.5
#: Steps of a fit.
STEPS = 100
#: The labels have one bit. Earlier categories of the chain are labelled texts that hold one of these words; the last category is the label.
CATEGORIES = {
    "insult": frozenset({b"idiot", b"moron", b"loser", b"clown", b"stupid"}),
    "contempt": frozenset({b"worthless", b"pathetic", b"scum", b"trash", b"disgusting"}),
    "toxic": None,
}


def features(text: str | None) -> set[bytes]:
    """Distinct words of a whole text, and beginnings (4 and 6 bytes) that one, two or four distinct words share."""
    words: set[bytes] = set()
    for part in word_parts(text):
        words.update(part)
    starts = Counter([w[:4] for w in words if len(w) > 5])
    starts.update([w[:6] for w in words if len(w) > 7])
    out = words
    out.update([b"^" + w for w in starts])
    out.update([b"2^" + w for w, n in starts.items() if n > 1])
    out.update([b"4^" + w for w, n in starts.items() if n > 3])
    return out


def hashed(words: set[bytes]) -> np.ndarray:
    """Sorted 64-bit hashes of features; training works on these, which takes little memory."""
    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


@dataclass
class Linear:
    """One logistic regression: weights of features (by hash), of earlier probabilities, and a bias."""

    words: dict[int, float]
    earlier: np.ndarray
    bias: float


class Sparse:
    """Sets of feature numbers as rows of a 0/1 matrix, scaled so that each column counts alike."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.columns = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.row_of = np.repeat(np.arange(len(rows)), self.sizes)
        self.height, self.width = len(rows), width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row_of, weights=w[self.columns], minlength=self.height)

    def transposed(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=r[self.row_of], minlength=self.width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[np.ndarray], names: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """Logistic regression on the features that tell most about ``y``; Adam steps, small L2 penalty."""
    positive = max(int(y.sum()), 1)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    of = np.repeat(y, [len(r) for r in rows]) if rows else np.zeros(0)
    hits, seen = np.bincount(flat, weights=of, minlength=len(names)), np.bincount(flat, minlength=len(names))
    negative = max(len(y) - positive, 1)
    share = seen / max(len(y), 1)
    spread = np.sqrt(share * (1 - share) * (1 / positive + 1 / negative)) + 1e-9
    score = np.where(seen >= LEAST_DOCUMENTS, np.abs(hits / positive - (seen - hits) / negative) / spread, 0)
    order = np.argsort(-score, kind="stable")[:MOST_FEATURES]
    order = order[score[order] > LEAST_SCORE]
    number = np.full(len(names), -1)
    number[order] = np.arange(len(order))
    x = Sparse([(c := number[r])[c >= 0] for r in rows], len(order))
    n_earlier = earlier.shape[1]
    w = np.zeros(len(order) + n_earlier + 1)
    w[-1] = np.log(positive / max(len(y) - positive, 1))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        p = sigmoid(x.times(w[: len(order)]) + earlier @ w[len(order) : -1] + w[-1])
        error = (p - y) / max(len(y), 1)
        slope = np.concatenate([x.transposed(error), earlier.T @ error, [error.sum()]])
        slope[:-1] += 3e-4 * w[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Linear({int(names[k]): float(v) for k, v in zip(order.tolist(), w, strict=False)}, w[len(order) : -1], float(w[-1]))


def predict(model: Linear, rows: list[np.ndarray], names: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    weights = np.zeros(len(names))
    if model.words:
        weights[np.searchsorted(names, np.fromiter(model.words, np.uint64, len(model.words)))] = list(model.words.values())
    scores = np.array([weights[r].sum() for r in rows])
    return sigmoid(scores + earlier @ model.earlier + model.bias)


class Chain:
    """Models of all categories in order and the probability from which a text is rejected.

    ``words``: the features that the models may weigh; all others weigh nothing.
    """

    def __init__(self, models: list[Linear], threshold: float, words: Iterable[bytes]):
        self.models, self.threshold = models, threshold
        keyed = sorted((w, xxhash.xxh3_64_intdigest(w)) for w in set(words))
        self.number = {w: k for k, (w, _) in enumerate(keyed)}
        self.weights = np.array([[m.words.get(h, 0.0) for m in models] for _, h in keyed]).reshape(len(keyed), len(models))

    def probabilities(self, text: str | None) -> list[float]:
        found = self.number.keys() & features(text)
        sums = self.weights[sorted(map(self.number.__getitem__, found))].sum(0) if found else np.zeros(len(self.models))
        out: list[float] = []
        for k, m in enumerate(self.models):
            x = sums[k] + m.bias + float(np.dot(m.earlier, out))
            out.append(float(1 / (1 + np.exp(-np.clip(x, -35, 35)))))
        return out


def train(rows: list[np.ndarray], targets: list[np.ndarray]) -> tuple[list[Linear], float]:
    """Models of the chain and its threshold, from hashed features and one 0/1 target per category.

    Without positive rows every text gets the smallest probability and none is rejected.
    """
    names, df = np.unique(np.concatenate(rows) if rows else np.zeros(0, np.uint64), return_counts=True)
    names = names[df >= LEAST_DOCUMENTS]
    for k, row in enumerate(rows):
        at = np.minimum(np.searchsorted(names, row), max(len(names) - 1, 0))
        rows[k] = at[names[at] == row] if len(names) else at[:0]
    folds = np.arange(len(rows)) % FOLDS
    earlier = np.zeros((len(rows), 0))
    models: list[Linear] = []
    y = held_out = np.zeros(len(rows))
    for target in targets:
        y, held_out = target.astype(float), np.zeros(len(rows))
        for k in range(FOLDS):
            fit_on, held = np.flatnonzero(folds != k), np.flatnonzero(folds == k)
            part = fit([rows[i] for i in fit_on], names, earlier[fit_on], y[fit_on])
            held_out[held] = predict(part, [rows[i] for i in held], names, earlier[held])
        models.append(fit(rows, names, earlier, y))
        earlier = np.concatenate([earlier, held_out[:, None]], 1)
    return models, best_threshold(held_out, y)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability of best F1 on out-of-fold predictions, halfway to the next lower one, in 0.05..0.95."""
    if not y.sum():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.concatenate([np.diff(p[order]) != 0, [True]])
    k = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order][k] + below) / 2, 0.05, 0.95))


def fit_chain(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, categories: dict = CATEGORIES) -> Chain:
    """Fit on at most ``most`` labelled documents, those whose hashed doc_id is smallest.

    Hashes of their features come to the driver; the words of the features that the models
    use (at most ``MOST_FEATURES`` per category) are looked up in a second pass over them.
    """
    picked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    picked = F.broadcast(picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))  # bounded by ``most``
    rows = docs.select("doc_id", "text").join(picked, "doc_id").select(F.col("doc_id").cast("long"), F.col("__toxic").cast("long"), "text")

    held = list(categories.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch.column(2)):
                part = batch.slice(start, stop - start)
                found = [features(x) for x in part.column(2).to_pylist()]
                marks = [sum(1 << k for k, words in enumerate(held) if words is None or words & x) for x in found]
                columns = [part.column(0), part.column(1), pa.array(marks, pa.int64()), pa.array([hashed(x).tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "marks", "hashes"])

    got = rows.mapInArrow(run, "doc_id long, toxic long, marks long, hashes binary").toArrow().sort_by([("doc_id", "ascending"), ("hashes", "ascending")])
    toxic, marks = (np.array(got[c].to_pylist(), np.int64) for c in ("toxic", "marks"))
    models, threshold = train([np.frombuffer(x.as_py(), np.uint64) for x in got["hashes"]], [(toxic > 0) & (marks >> k & 1 > 0) for k in range(len(held))])
    del got
    used = {h for m in models for h in m.words}

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = {w for x in batch.column(0) for w in features(x.as_py()) if xxhash.xxh3_64_intdigest(w) in used}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.binary())], names=["word"])

    words = rows.select("text").mapInArrow(named, "word binary").distinct().collect() if used else []
    return Chain(models, threshold, (bytes(r.word) for r in words))


def score(docs: DataFrame, chain: Chain, categories: dict = CATEGORIES) -> DataFrame:
    """Every row with ``p_<category>`` of each category and ``rejected``.

    NULL and empty texts have no words and get the base rates. Input columns named like the new ones are replaced.
    """
    new = StructType.fromDDL(", ".join([*(f"p_{c} double" for c in categories), "rejected boolean"]))
    rows = docs.drop(*new.names)
    place = rows.columns.index("text")
    schema = StructType([*rows.schema.fields, *new.fields])
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = shared.value
        for batch in batches:
            for start, stop in text_slices(batch.column(place)):
                part = batch.slice(start, stop - start)
                p = [by.probabilities(x) for x in part.column(place).to_pylist()]
                columns = [pa.array(c, pa.float64()) for c in zip(*p, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns, pa.array([x[-1] >= by.threshold for x in p])], names=schema.names)

    return rows.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with the columns they came with; ``labelled`` holds the labelled texts."""
    out = score(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text"), fit_chain(labelled, labels))
    return out.where("NOT rejected").select("__row.*")


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, the probability of each category, rejected."""
    return score(docs.select("doc_id", "text"), fit_chain(docs, labels)).drop("text")
