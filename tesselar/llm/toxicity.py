"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector is shared by the ordered thresholds theta_1 < theta_2 < ...,
and the score of a text is its expected grade, the sum of P(grade > k). The labels only say whether a text is toxic,
so toxic training texts are graded 1 to `grades` - 1 by equal shares of their evidence, the summed log odds of their
words. The features are the words whose presence depends on the label by a chi-squared test. The fit maximises the
likelihood of the grades, P(grade = k) = sigmoid(theta_k - w.x) - sigmoid(theta_(k-1) - w.x), less an L1 penalty: the
thresholds are at their optimum for the current weights (Newton steps), and the weights take accelerated proximal steps
(FISTA) on what is left, which is convex. It runs on a bounded, stratified sample, whose rows are weighted back to the
exact class counts of all labels.

Cases: a null text has a null severity and isn't toxic; an empty text has no feature and the severity of the thresholds
alone, by which no text is toxic; whole texts of any length are read; repeated rows get equal scores; a severity equal to
the limit is toxic; labelled rows whose digests tie are taken by identifier; a document with several labels has the
largest; a grade that no training text has shares the threshold of its neighbour; an empty table gives an empty result;
a row without identifier is scored. With no usable label of either class, no text has a severity and none is toxic.
Other columns of the input don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .shared import table

MAX_ROWS = 8000
GRADES = 4
REJECT_AT = 0.25


@dataclass
class OrdinalModel:
    """Sorted 64-bit word hashes with their weights, and the ordered thresholds."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        """Expected grade of each text."""
        n = len(column)
        h, first = kernel.words(column)
        z = np.zeros(n)
        if len(h) and len(self.words):
            doc = np.repeat(np.arange(n), np.diff(first))
            maybe = self._gate()[(h >> np.uint64(48)).astype(np.int64)]
            h, doc = h[maybe], doc[maybe]
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            known = self.words[at] == h
            key, tf = np.unique(doc[known] * len(self.words) + at[known], return_counts=True)
            z = np.bincount(key // len(self.words), weights=self.weights[key % len(self.words)] * (1 + np.log(tf)), minlength=n)
        return _sigmoid(z[:, None] - self.thresholds[None, :]).sum(1)

    def toxic(self, severity: np.ndarray, reject_at: float) -> np.ndarray:
        """Which severities reach reject_at by the text's own words: more than the thresholds alone give."""
        return (severity >= reject_at) & (severity > _sigmoid(-self.thresholds).sum() + 1e-9)

    def _gate(self) -> np.ndarray:
        if not hasattr(self, "_bits"):
            self._bits = np.zeros(1 << 16, bool)
            self._bits[(self.words >> np.uint64(48)).astype(np.int64)] = True
        return self._bits


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(at most max_rows rows (y, text), half of them of each class where there are as many; the exact class counts).

    A document with several labels has the largest; the rows taken are those whose hashed identifier is smallest.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [y.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2) for k in (0, 1)]
    chosen = parts[0].union(parts[1])
    # At most max_rows identifiers of 12 bytes: the bound is the parameter, whatever the input.
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text"), counts


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", grades: int = GRADES, max_rows: int = MAX_ROWS, min_df: int = 3, min_chi2: float = 20.0, l1: float = 1e-4, rounds: int = 500) -> OrdinalModel | None:
    """The model fitted on at most max_rows labelled texts; None if a class has no labelled text."""
    sample, counts = labelled_sample(docs, labels, label, max_rows)

    def bags(batches):
        for batch in kernel.slices(batches, "text"):
            h, first = kernel.words(batch.column("text"))
            each = [np.unique(h[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), *[pa.array([x[k].astype(kind).tobytes() for x in each], pa.binary()) for k, kind in ((0, np.uint64), (1, np.uint32))]],
                ["doc_id", "y", "words", "counts"],
            )

    # max_rows rows of distinct words at most, in one job.
    got = sample.mapInArrow(bags, "doc_id long, y int, words binary, counts binary").collect()
    rows = sorted((r["doc_id"], r["y"], bytes(r["words"]), bytes(r["counts"])) for r in got)
    y = np.array([r[1] for r in rows], int)
    if not (0 < y.sum() < len(y)):
        return None
    bags_ = [(np.frombuffer(r[2], np.uint64), np.frombuffer(r[3], np.uint32)) for r in rows]
    return fit_bags(bags_, y, counts, grades=grades, min_df=min_df, min_chi2=min_chi2, l1=l1, rounds=rounds)


def likelihood(z: np.ndarray, theta: np.ndarray, grade: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(value, gradient by z, gradient by theta, Hessian by theta) of the weighted negative log-likelihood of grades.

    z is w.x of each row; theta are the thresholds between the grades 0, 1, .., in ascending order.
    """
    k = len(theta)
    high, deep = np.append(theta, np.inf)[grade] - z, np.insert(theta, 0, -np.inf)[grade] - z
    a, b = _sigmoid(high), _sigmoid(deep)
    # a - b without cancellation.
    p = np.maximum(a * _sigmoid(-deep) * -np.expm1(deep - high), 1e-300)
    da, db = a * _sigmoid(-high), b * _sigmoid(-deep)
    by_z = weight * (1 - a - b)
    up, low = grade < k, grade > 0
    by_theta = np.bincount(grade[up], weights=(-weight * da / p)[up], minlength=k) + np.bincount(grade[low] - 1, weights=(weight * db / p)[low], minlength=k)
    curve_a, curve_b = -(da * (1 - 2 * a) / p - (da / p) ** 2), db * (1 - 2 * b) / p + (db / p) ** 2
    hessian = np.diag(np.bincount(grade[up], weights=(weight * curve_a)[up], minlength=k) + np.bincount(grade[low] - 1, weights=(weight * curve_b)[low], minlength=k))
    both = up & low
    cross = np.bincount(grade[both], weights=(-weight * da * db / p**2)[both], minlength=k)
    for j in range(1, k):
        hessian[j, j - 1] = hessian[j - 1, j] = cross[j]
    return float(-(weight * np.log(p)).sum()), by_z, by_theta, hessian


def best_thresholds(z: np.ndarray, theta: np.ndarray, grade: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """The ascending thresholds that maximise the likelihood for given z, from theta on."""
    value, _, g, h = likelihood(z, theta, grade, weight)
    for _ in range(rounds):
        step, t = np.linalg.solve(h + 1e-12 * np.eye(len(theta)), g), 1.0
        # What a step can still gain.
        if float(g @ step) < 1e-13:
            break
        while t > 1e-9:
            new = theta - t * step
            if (np.diff(new) > 0).all():
                got = likelihood(z, new, grade, weight)
                if got[0] <= value - 1e-4 * t * float(g @ step):
                    break
            t /= 2
        else:
            break
        theta, (value, _, g, h) = new, got
    return theta


def ordinal_fit(doc: np.ndarray, at: np.ndarray, x: np.ndarray, grade: np.ndarray, weight: np.ndarray, d: int, *, l1: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(w, theta) that minimise the negative log-likelihood plus l1 * |w|, for rows of entries (doc, at, x).

    Every grade from 0 on must have a row.
    """
    n = len(grade)
    share = np.cumsum(np.bincount(grade, weights=weight))[:-1]
    theta = np.log(share / (1 - share))
    w, seen, t = np.zeros(d), np.zeros(d), 1.0
    # The likelihood's curvature by z is a half at most: the step follows from the largest eigenvalue of X' diag(weight) X.
    v, top = np.ones(d), 1e-12
    for _ in range(50):
        v = np.bincount(at, weights=(weight * np.bincount(doc, weights=v[at] * x, minlength=n))[doc] * x, minlength=d)
        top = max(1e-12, float(np.linalg.norm(v)))
        v = v / top
    step = 2.0 / (1.05 * top)
    for _ in range(rounds):
        z = np.bincount(doc, weights=seen[at] * x, minlength=n)
        theta = best_thresholds(z, theta, grade, weight)
        g = np.bincount(at, weights=likelihood(z, theta, grade, weight)[1][doc] * x, minlength=d)
        new = seen - step * g
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * l1)
        moved = np.abs(new - w).max(initial=0.0)
        if (new - w).dot(seen - new) > 0:
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        seen, w, t = new + (t - 1) / t2 * (new - w), new, t2
        if moved < 1e-6:
            break
    return w, best_thresholds(np.bincount(doc, weights=w[at] * x, minlength=n), theta, grade, weight)


def fit_bags(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, counts: dict[int, int], *, grades: int, min_df: int, min_chi2: float, l1: float, rounds: int) -> OrdinalModel:
    """The fit itself, on the driver: bags of distinct word hashes and their counts, with labels 0 and 1."""
    doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    vocab, at = np.unique(np.concatenate([b[0] for b in bags]), return_inverse=True)
    tf = np.concatenate([b[1] for b in bags]).astype(np.int64)
    m, m1 = len(y), y.sum()
    df, df1 = np.bincount(at, minlength=len(vocab)), np.bincount(at, weights=y[doc], minlength=len(vocab))
    chi2 = m * (df1 * m - df * m1) ** 2 / (df * (m - df) * m1 * (m - m1) + 1e-9)
    keep = (df >= min_df) & (chi2 >= min_chi2)
    new = np.cumsum(keep) - 1
    on = keep[at]
    vocab, doc, at, tf = vocab[keep], doc[on], new[at[on]], tf[on]
    x, d, n = 1 + np.log(tf), len(vocab), len(y)

    weight = np.where(y == 1, counts[1] / max(1, y.sum()), counts[0] / max(1, (y == 0).sum()))
    weight = weight / weight.sum()
    pos = np.bincount(at, weights=y[doc], minlength=d)
    neg = np.bincount(at, weights=1 - y[doc], minlength=d)
    odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / ((y == 0).sum() + 1))
    evidence = np.bincount(doc, weights=tf * np.maximum(0, odds[at] - 2), minlength=n)
    grade = np.zeros(n, int)
    cuts = np.quantile(evidence[y == 1], np.arange(1, grades - 1) / (grades - 1)) if grades > 2 else []
    grade[y == 1] = 1 + np.searchsorted(cuts, evidence[y == 1], "left")

    # Grades without a row have no threshold of their own.
    some, level = np.unique(grade, return_inverse=True)
    w, own = ordinal_fit(doc, at, x, level, weight, d, l1=l1, rounds=rounds)
    above = np.searchsorted(some, np.arange(grades - 1), "right") - 1
    theta = np.where(above < len(own), own[np.minimum(above, len(own) - 1)], 1e3)
    used = np.flatnonzero(w)
    return OrdinalModel(vocab[used], w[used], theta)


def score(docs: DataFrame, model: OrdinalModel | None, *, reject_at: float = REJECT_AT) -> DataFrame:
    """(doc_id, severity, toxic) for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in kernel.slices(batches, "text"):
            text = batch.column("text")
            null = text.is_null().to_numpy(zero_copy_only=False)
            s = m.score(text) if m else np.zeros(len(text))
            bad = null if m else np.ones(len(text), bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(s, 6), mask=bad), pa.array((m.toxic(s, reject_at) if m else bad) & ~bad)], ["doc_id", "severity", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, severity double, toxic boolean")


def reject(docs: DataFrame, model: OrdinalModel | None, *, reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of docs, whole, that aren't toxic. Only the text is sent to Python, so no row is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        m, out = held.value, []
        if m is None:
            return pa.array(np.ones(len(text), bool))
        for part in kernel.slices(iter([pa.RecordBatch.from_arrays([text], ["text"])]), "text"):
            s = m.score(part.column(0))
            out.append(~m.toxic(s, reject_at) | part.column(0).is_null().to_numpy(zero_copy_only=False))
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(clean(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document, by the model fitted on the labels."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the toxic ones; the model is fitted on the labelled rows of docs."""
    return reject(docs, fit(docs, table(spark, sf_dir, "labels")))
