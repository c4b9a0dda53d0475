"""A toxicity classifier that is regularised against identity terms.

Features are the distinct words of a text and their beginnings of 4 to 6 letters, so that inflected
insults share evidence. Only features whose share differs significantly between the labels are kept.
The logistic model minimises

    mean cross entropy + L2 + FAIRNESS * mean (score(x) - score(x with swapped identity terms))^2

where each labelled text that names a group also appears with its group words exchanged for those of
another group. A model that scores by who is named pays for it, so neutral mentions are not flagged.

Model bounds: at most ``SAMPLE_DOCS`` labelled rows per label, those with the smallest MD5 of their
id, and ``MAX_FEATURES`` features. Every text is scored whole.

Cases: a null or empty text scores as a text without features. Labels other than 0 and 1, null
labels, labels without a document and null ids teach nothing; of several labels of a document the
largest counts. Without both labels the score is the share of label 1, or 0. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentloom.llm.shared import is_held_out, sample_ids, ship, stable

SAMPLE_DOCS, MAX_FEATURES = 10_000, 1024
MIN_Z, MIN_DOCS = 5.0, 4
FAIRNESS, L2, STEPS = 8.0, 1e-4, 400
PREFIXES = (4, 5, 6)
# Groups named by one word each; swapping exchanges words of one row.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("black", "white", "asian", "latino"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual"), ("transgender", "cisgender"), ("old", "young"),
    ("immigrants", "natives"), ("femmes", "hommes"), ("frauen", "männer"), ("mujeres", "hombres"),
)
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    if not text:
        return set()
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) >= n}


def swapper(terms: Sequence[Sequence[str]] = IDENTITY_TERMS):
    """A function that exchanges every group word for the next one of its row, or None if there is none."""
    turn = {w: row[(i + 1) % len(row)] for row in terms for i, w in enumerate(row)}

    def swap(text: str | None) -> str | None:
        hit = False

        def other(m: re.Match) -> str:
            nonlocal hit
            word = turn.get(m[0])
            hit = hit or word is not None
            return word or m[0]

        swapped = _WORD.sub(other, text.lower()) if text else ""
        return swapped if hit else None

    return swap


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        return self.of(features(text))

    def of(self, found: set[str]) -> float:
        small, large = (self.weights, found) if len(self.weights) < len(found) else (found, self.weights)
        total = self.bias + sum(self.weights[f] for f in small if f in large)
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -50, 50))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


def _largest(x: np.ndarray) -> float:
    """The largest eigenvalue of ``x.T @ x / len(x)``, by power iteration, a little above."""
    v = np.ones(x.shape[1], dtype=np.float32)
    size = 1.0
    for _ in range(12):
        v = x.T @ (x @ (v / np.float32(size))) / np.float32(len(x))
        size = float(np.linalg.norm(v)) or 1.0
    return 1.05 * size


def fit(x: np.ndarray, y: np.ndarray, first: np.ndarray, second: np.ndarray, fairness: float = FAIRNESS) -> tuple[np.ndarray, float]:
    """Weights and bias. ``x`` are 0/1 rows with labels ``y``; ``first`` and ``second`` are the pairs
    whose scores should agree. Accelerated gradient descent with a fixed number of steps."""
    n, d = x.shape
    w = np.zeros(d + 1, dtype=np.float32)
    v, last = w.copy(), w.copy()
    ones = np.ones((n, 1), dtype=np.float32)
    x = np.hstack([x, ones])
    first, second = (np.hstack([p, np.ones((len(p), 1), dtype=np.float32)]) for p in (first, second))
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    balance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    y = y.astype(np.float32)
    # One over a bound of the curvature.
    curve = 0.25 * balance.max() * _largest(x) + L2
    if len(first):
        curve += fairness * _largest(np.vstack([first, second]))
    rate = np.float32(1.0 / curve)
    for step in range(1, STEPS + 1):
        p = _sigmoid(x @ v)
        grad = x.T @ (balance * (p - y)) / np.float32(n) + np.float32(L2) * np.append(v[:-1], np.float32(0))
        if len(first):
            a, b = _sigmoid(first @ v), _sigmoid(second @ v)
            gap = np.float32(2 * fairness / len(first)) * (a - b)
            grad += first.T @ (gap * a * (1 - a)) - second.T @ (gap * b * (1 - b))
        w = v - rate * grad
        v = w + np.float32((step - 1) / (step + 2)) * (w - last)
        last = w
    return w[:-1], float(w[-1])


def _found(terms: Sequence[Sequence[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swap = swapper(terms)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            swapped = [swap(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sorted(features(t)) for t in texts], pa.list_(pa.string())),
                 pa.array([None if s is None else sorted(features(s)) for s in swapped], pa.list_(pa.string()))],
                names=["toxic", "found", "swapped"])

    return run


def train(docs: DataFrame, labels: DataFrame, terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> Model:
    """From the labelled rows of ``docs(doc_id, text)`` outside the held-out fold."""
    marked = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("toxic in (0, 1) and doc_id is not null")
    marked = marked.where(~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = stable(sample_ids(marked, "toxic", SAMPLE_DOCS, 2).select("doc_id", "toxic"))
    # At most 2 * SAMPLE_DOCS rows of 12 bytes.
    rows = ship(docs).select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    seen = stable(rows.mapInArrow(_found(terms), "toxic int, found array<string>, swapped array<string>"))
    n1, n0 = (seen.where(F.col("toxic") == k).count() for k in (1, 0))
    if not n1 or not n0:
        return Model({}, 50.0 if n1 else -50.0)
    counts = seen.select("toxic", F.explode("found").alias("f")).groupBy("f").agg(
        F.sum("toxic").alias("c1"), F.count(F.lit(1)).alias("c"))
    p = F.col("c") / (n1 + n0)
    # A feature of every text separates nothing: its spread is 0 and z is null.
    z = F.try_divide(F.col("c1") / n1 - (F.col("c") - F.col("c1")) / n0, F.sqrt(p * (1 - p) * (1.0 / n1 + 1.0 / n0)))
    kept = counts.where(F.col("c") >= MIN_DOCS).withColumn("z", z).where(F.abs("z") >= MIN_Z)
    named = sorted({w for row in terms for w in row})
    vocabulary = [r[0] for r in kept.orderBy(F.abs("z").desc(), "f").limit(MAX_FEATURES).select("f").collect()]
    vocabulary = sorted({*vocabulary, *named})
    place = {f: i for i, f in enumerate(vocabulary)}
    words = F.array(*[F.lit(f) for f in vocabulary])
    small = seen.select("toxic", F.array_intersect("found", words).alias("found"), F.array_intersect("swapped", words).alias("swapped"))

    def dense(sets: list) -> np.ndarray:
        out = np.zeros((len(sets), len(vocabulary)), dtype=np.float32)
        for i, found in enumerate(sets):
            out[i, [place[f] for f in found]] = 1.0
        return out

    got = small.collect()  # at most 2 * SAMPLE_DOCS rows of selected features
    got = sorted(got, key=lambda r: (r[0], r[1], r[2] or []))
    pairs = [r for r in got if r[2] is not None]
    weights, bias = fit(dense([r[1] for r in got]), np.array([float(r[0]) for r in got]),
                        dense([r[1] for r in pairs]), dense([r[2] for r in pairs]))
    return Model({f: float(w) for f, w in zip(vocabulary, weights, strict=True) if w}, bias)


def _score(model: Model, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            scores = pa.array([model.score(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, out])

    return run


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``, the score of ``text``; all other columns stay."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    return ship(docs).mapInArrow(_score(model, out), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text)``."""
    model = train(docs, labels)
    scored = score(docs.select(F.col("doc_id").cast("long"), is_held_out().alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
