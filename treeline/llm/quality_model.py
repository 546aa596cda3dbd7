"""Quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled good; unlabelled text is all documents, labels unseen.
Every document is measured once, in a written table. Quantiles of the measures over all documents
cut them into bins. A plain classifier of positives against unlabelled text scores all documents;
the class prior is the smallest ratio of the unlabelled to the positive share above a threshold,
with a margin for chance that shrinks with their numbers. The model is additive over binned measures of a text and minimises
prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) with the logistic loss;
where the second term falls below zero, the step goes up it instead, as its authors propose.

Bounds of the training sample (rows that the gradient sees): POSITIVES labelled and UNLABELLED
documents. Bins, prior and thresholds come from all documents. Every text is measured whole.

Defined results
* Null, empty and wordless texts have all measures 0 and are scored like any.
* No positive label: every score is 0. Repeated rows score alike; a document with a good label
  among several counts as good. Empty table: no row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import written

POSITIVES, UNLABELLED = 4000, 8000
BINS = 6
STEPS, RATE, RIDGE = 300, 0.05, 2e-3
KINDS = {
    "space": b" \t\n\r\x0b\x0c",
    "line": b"\n",
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "stop": b".,;:",
    "loud": b"!?",
    "symbol": b"#*$%&|<>",
    "wide": bytes(range(128, 256)),
}
CLASSES = np.stack([np.isin(np.arange(256), np.frombuffer(k, np.uint8)) for k in KINDS.values()]).astype(np.float64)
MEASURES = len(KINDS) + 9


def measures(text: str | None) -> list[float]:
    """Shares of byte kinds, lengths, and shares of repeated words, word triples and lines."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return [0.0] * MEASURES
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.float64, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    triples = set(zip(words, words[1:], words[2:]))
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        *(CLASSES @ counts / len(data)).tolist(),
        np.log1p(n),
        lengths.mean(),
        lengths.std(),
        lengths.max(),
        len(set(words)) / n,
        len(triples) / max(1, n - 2),
        same / n,
        len(set(lines)) / len(lines),
        n / len(lines),
    ]


@dataclass(frozen=True)
class Model:
    edges: np.ndarray
    weights: np.ndarray
    bias: float

    def margin(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.bias)
        for i in range(rows.shape[1]):
            total += self.weights[i, np.searchsorted(self.edges[i], rows[:, i], side="right")]
        return total

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -50, 50)))


def binned(rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One-hot bins of every measure."""
    size = edges.shape[1] + 1
    out = np.zeros((len(rows), rows.shape[1] * size), np.float32)
    for i in range(rows.shape[1]):
        out[np.arange(len(rows)), i * size + np.searchsorted(edges[i], rows[:, i], side="right")] = 1
    return out


def descend(gradient, size: int) -> np.ndarray:
    """Adam over full batches; `gradient` maps weights (with the bias last) to their gradient."""
    w, mean, square = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, STEPS + 1):
        g = gradient(w) + RIDGE * np.append(w[:-1], 0)
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        w = w - RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def class_prior(positive: np.ndarray, above: np.ndarray, documents: int) -> float:
    """The smallest ratio of shares above a threshold, each moved by its chance error.

    `above` counts the documents that score at least each of thresholds(positive).
    """
    slack = lambda n: np.sqrt(np.log(20) / (2 * n))
    best = 1.0
    for threshold, count in zip(thresholds(positive), above):
        p, u = (positive >= threshold).mean(), count / documents
        best = min(best, (u + slack(documents)) / max(1e-9, p - slack(len(positive)))) if p > 0.1 else best
    return float(np.clip(best, 0.01, 0.99))


def thresholds(positive: np.ndarray) -> np.ndarray:
    return np.quantile(positive, np.linspace(0.0, 0.8, 33))


def design(rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.column_stack([binned(rows, edges), np.ones(len(rows), np.float32)])


def fit_plain(positive: np.ndarray, unlabelled: np.ndarray, edges: np.ndarray) -> Model:
    """Positives against unlabelled rows, by the logistic loss."""
    p, u = design(positive, edges), design(unlabelled, edges)

    def plain(w: np.ndarray) -> np.ndarray:
        return -p.T @ (1 - sigmoid(p @ w)) / len(p) + u.T @ sigmoid(u @ w) / len(u)

    return model_of(descend(plain, p.shape[1]), edges)


def model_of(w: np.ndarray, edges: np.ndarray) -> Model:
    return Model(edges, w[:-1].reshape(len(edges), -1), float(w[-1]))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The two parts of the risk (of positives, and of negatives, which may not be below 0), and the
    gradient to follow: of their sum, or away from a negative part below 0."""
    sp, su = sigmoid(p @ w), sigmoid(u @ w)
    loss = lambda s: -np.log(np.maximum(1e-12, s)).mean()
    negative = loss(1 - su) - prior * loss(1 - sp)
    good = -prior * (p.T @ (1 - sp)) / len(p)
    bad = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)
    return prior * loss(sp), negative, good + bad if negative >= 0 else -bad


def fit_rows(positive: np.ndarray, unlabelled: np.ndarray, edges: np.ndarray, prior: float) -> Model:
    p, u = design(positive, edges), design(unlabelled, edges)
    return model_of(descend(lambda w: risk(w, p, u, prior)[2], p.shape[1]), edges)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and measures of every document, in a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([measures(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["doc_id", "measures"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return written(rows.mapInArrow(run, "doc_id long, measures array<double>"), "measures")


def bin_edges(rows: DataFrame) -> np.ndarray:
    """Quantiles of each measure over all documents."""
    levels = np.linspace(0, 1, BINS + 1)[1:-1].tolist()
    cells = [F.percentile_approx(F.get("measures", F.lit(i)), levels, 10_000) for i in range(MEASURES)]
    return np.array([list(c) for c in rows.agg(*cells).first()], np.float64)


def count_above(rows: DataFrame, model: Model, limits: np.ndarray) -> tuple[np.ndarray, int]:
    """How many documents score at least each limit, and how many there are."""
    held = rows.sparkSession.sparkContext.broadcast((model, limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, edges = held.value
        for batch in batches:
            if batch.num_rows:
                scores = np.sort(one.margin(matrix(batch.column(0))))
                counts = len(scores) - np.searchsorted(scores, edges, side="left")
                columns = [np.arange(-1, len(edges)), np.concatenate([[len(scores)], counts])]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["place", "n"])

    found = rows.select("measures").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    counts = {r.place: r.n for r in found.collect()}
    return np.array([counts.get(i, 0) for i in range(len(limits))]), counts.get(-1, 0)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(rows: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """A model from measured() rows and good labels (doc_id, quality = 1); None without labels."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).select(F.col("doc_id").alias("_id"), F.lit(1).alias("role"))
    web = rows.select("doc_id").filter("doc_id is not null").distinct()
    web = web.orderBy(F.xxhash64(F.lit("web"), F.col("doc_id")), "doc_id").limit(unlabelled)
    ids = good.unionByName(web.select(F.col("doc_id").alias("_id"), F.lit(0).alias("role")))
    # The bounded sample's ids are broadcast.
    seen = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("role", "measures").collect()
    pick = lambda role: np.array(sorted(r.measures for r in seen if r.role == role))
    if not any(r.role == 1 for r in seen):
        return None
    positive, web_rows, edges = pick(1), pick(0), bin_edges(rows)
    plain = fit_plain(positive, web_rows, edges)
    margins = plain.margin(positive)
    prior = class_prior(margins, *count_above(rows, plain, thresholds(margins)))
    return fit_rows(positive, web_rows, edges, prior)


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every measured() row."""
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = held.value.score(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return rows.select("doc_id", "measures").mapInArrow(run, "doc_id long, score double")
