"""Quality classifier: a naive-Bayes-scaled support vector machine on hashed n-gram indicators.

Each indicator of an n-gram is scaled by the log ratio of its smoothed class counts, texts are scaled to unit length,
and a linear hinge-loss model is fitted by dual coordinate descent; the weights are then drawn towards their mean
magnitude (`blend`). The n-grams are words, pairs of words, byte trigrams of the raw text (they see symbols and
capitals) and the repetition patterns of four words in a row.

Cases: a null text has a null score and is kept; an empty text scores the bias alone; whole texts of any length are
read; repeated rows score alike; a score equal to the limit is kept; labelled rows whose digests tie are taken by
identifier; a document with several labels has the largest; a row without identifier is scored; an empty table gives an
empty result; with fewer than two labelled classes there is no model, every score is null and all is kept. Other columns
of the input don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .shared import table
from .toxicity import labelled_sample

MAX_ROWS = 6000
BITS = 20


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (bucket, text) indicators of a column, in text order."""
    n = len(column)
    h, first = kernel.words(column)
    doc = np.repeat(np.arange(n), np.diff(first))
    drop = np.uint64(64 - BITS)
    parts = [(h >> drop, doc)]
    if len(h) > 1:
        same = doc[1:] == doc[:-1]
        pair = kernel.mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])[same]
        parts.append((pair >> drop, doc[:-1][same]))
    if len(h) > 3:
        whole = doc[3:] == doc[:-3]
        a, b, c, d = h[:-3], h[1:-2], h[2:-1], h[3:]
        shape = (a == b) | ((a == c) << 1) | ((a == d) << 2) | ((b == c) << 3) | ((b == d) << 4) | ((c == d) << 5)
        shape = shape[whole].astype(np.uint64)
        parts.append((kernel.mix(shape + np.uint64(0x5E1F)) >> drop, doc[:-3][whole]))
    offs, data = kernel.buffers(column)
    lo, hi = int(offs[0]), int(offs[-1])
    if hi - lo > 2:
        x = data[lo:hi].astype(np.uint32)
        tri = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        of = np.repeat(np.arange(n), np.diff(offs))
        whole = of[2:] == of[:-2]
        t, of = tri[whole], of[:-2][whole]
        t = (t * np.uint32(0x9E3779B1)) ^ (t >> np.uint32(7))
        parts.append(((t * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS), of))
    bucket = np.concatenate([p[0].astype(np.uint64) for p in parts])
    return kernel.distinct(bucket, np.concatenate([p[1] for p in parts]), BITS)


@dataclass
class NbsvmModel:
    """For each bucket the weight with the ratio in it and the squared ratio; the bias."""

    weight: np.ndarray
    square: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        bucket, doc = features(column)
        n = len(column)
        norm = np.sqrt(np.maximum(np.bincount(doc, weights=self.square[bucket], minlength=n), 1e-12))
        return np.bincount(doc, weights=self.weight[bucket], minlength=n) / norm + self.bias


def dual_coordinate_descent(first: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, cost: np.ndarray, d: int, *, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """(w, bias) that minimise |w|^2 / 2 + sum cost_i max(0, 1 - y_i (w.x_i + bias)); rows are first[i]:first[i+1] of (at, x)."""
    w, bias, alpha = np.zeros(d), 0.0, np.zeros(len(y))
    square = np.array([(x[a:b] ** 2).sum() for a, b in zip(first[:-1], first[1:])]) + 1
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            a, b = first[i], first[i + 1]
            j, v = at[a:b], x[a:b]
            g = y[i] * (w[j].dot(v) + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[j] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, bias


def fit_rows(rows: list[np.ndarray], y: np.ndarray, *, smooth: float = 1.0, cost: float = 4.0, blend: float = 0.25, min_df: int = 3) -> NbsvmModel:
    """The fit on the driver: distinct buckets by row, labels 0 and 1."""
    at, first = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    d = 1 << BITS
    doc = np.repeat(np.arange(len(rows)), np.diff(first))
    good = np.bincount(at, weights=y[doc], minlength=d)
    bad = np.bincount(at, weights=1 - y[doc], minlength=d)
    p, q = good + smooth, bad + smooth
    ratio = np.where(good + bad >= min_df, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)
    square = ratio**2
    norm = np.sqrt(np.maximum(np.bincount(doc, weights=square[at], minlength=len(rows)), 1e-12))
    x = ratio[at] / norm[doc]
    n1 = y.sum()
    w, bias = dual_coordinate_descent(first, at, x, 2.0 * y - 1, cost * np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * (len(y) - n1))), d)
    used = np.flatnonzero(w)
    mean = np.abs(w[used]).mean() if len(used) else 0.0
    w = (1 - blend) * w
    w[used] += blend * mean
    return NbsvmModel((w * ratio).astype(np.float32), square.astype(np.float32), float(bias))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_rows: int = MAX_ROWS) -> NbsvmModel | None:
    """The model fitted on at most max_rows labelled texts, or None if a class has none."""
    sample, _ = labelled_sample(docs, labels, label, max_rows)

    def rows(batches):
        for batch in kernel.slices(batches, "text"):
            bucket, doc = features(batch.column("text"))
            b = kernel.bounds(doc, batch.num_rows)
            small = bucket.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([small[i:j].tobytes() for i, j in zip(b[:-1], b[1:])], pa.binary())], ["doc_id", "y", "buckets"])

    # max_rows rows of distinct buckets at most, in one job.
    got = sorted((r["doc_id"], r["y"], bytes(r["buckets"])) for r in sample.mapInArrow(rows, "doc_id long, y int, buckets binary").collect())
    y = np.array([r[1] for r in got], float)
    if not (0 < y.sum() < len(y)):
        return None
    return fit_rows([np.frombuffer(r[2], np.uint32) for r in got], y)


def score(docs: DataFrame, model: NbsvmModel | None, *, keep_from: float = 0.0) -> DataFrame:
    """(doc_id, score, keep) for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in kernel.slices(batches, "text", 1 << 20):
            text = batch.column("text")
            bad = text.is_null().to_numpy(zero_copy_only=False) if m else np.ones(len(text), bool)
            s = m.score(text) if m else np.zeros(len(text))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(s, 6), mask=bad), pa.array((s >= keep_from) | bad)], ["doc_id", "score", "keep"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, keep boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for every document, by the model fitted on the labels."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
