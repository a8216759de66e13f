"""Exact dense retrieval: cosines of queries with all documents, as products of blocks of vectors.

Vectors are packed into blocks of `BLOCK` rows; every pair of a block of documents and a block of queries is one matrix
product that gives the block's k best per query, and those meet in a ranked window. Neither side is broadcast by force:
Spark does so while the packed queries are below its threshold, and else pairs the blocks by a Cartesian product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.functions import vectors as V

from .common import small, spread, top

BLOCK = 4096


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(-1, dim) if dim else np.zeros((len(column), 0))


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def blocks(vectors: DataFrame, key: str, *, size: int = BLOCK, normalise: bool = True) -> DataFrame:
    """(keys, m): vectors (key LONG, vec) packed by partition into binaries of 64-bit numbers; null vectors are left out."""

    def pack(batches):
        ids, rows = [], []

        def out():
            keys, m = np.concatenate(ids), np.concatenate(rows)
            return pa.RecordBatch.from_arrays([pa.array([keys.tobytes()]), pa.array([np.ascontiguousarray(m).tobytes()])], ["keys", "m"])

        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(1)
            m = _matrix(column, len(column[0]))
            for at in range(0, len(m), size):
                part = m[at : at + size]
                ids.append(batch.column(0).slice(at, len(part)).to_numpy(zero_copy_only=False).astype(np.int64))
                rows.append(unit(part) if normalise else part)
                held += len(part)
                if held >= size:
                    yield out()
                    ids, rows, held = [], [], 0
        if held:
            yield out()

    some = vectors.where(f"`{key}` IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    return some.select(F.col(key).cast("long"), F.col("vec").cast("array<double>")).mapInArrow(pack, "keys binary, m binary")


def score(vectors: DataFrame, queries: DataFrame, *, k: int | None = None, drop_self: bool = False, normalise: bool = True) -> DataFrame:
    """(qid, doc_id, score): cosines of queries (qid, vec) with vectors (doc_id, vec); with k the k best of each block.

    A query vector of length 0 gives no rows. With drop_self a document isn't its own partner.
    """
    some = queries.where(~V.is_zero(F.col("vec"))) if normalise else queries
    pairs = blocks(spread(vectors), "doc_id", normalise=normalise).crossJoin(blocks(some, "qid", normalise=normalise).toDF("q_keys", "q"))

    def multiply(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, qids = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["q_keys"], np.int64)
                d, q = np.frombuffer(row["m"]).reshape(len(ids), -1), np.frombuffer(row["q"]).reshape(len(qids), -1)
                for at in range(0, len(q), 256):
                    s = q[at : at + 256] @ d.T
                    if drop_self:
                        s[qids[at : at + 256, None] == ids[None, :]] = -np.inf
                    if k is not None and k < len(ids):
                        # All that tie with the k-th stay, so that the choice among equals is made once, over all blocks.
                        least = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
                        i, j = np.nonzero(s >= least[:, None] - 1e-9)
                    else:
                        i, j = np.nonzero(np.isfinite(s))
                    x = s[i, j]
                    ok = np.isfinite(x)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[at + i[ok]]), pa.array(ids[j[ok]]), pa.array(x[ok])], ["qid", "doc_id", "score"])

    return pairs.mapInArrow(multiply, "qid long, doc_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 10, drop_self: bool = False) -> DataFrame:
    """(qid, doc_id, score, rank): the k documents of each query with the highest cosines."""
    return top(score(vectors, queries, k=k, drop_self=drop_self), k)


def score_pairs(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """pairs (qid, doc_id) with `semantic`, their cosine; null where either has no vector."""
    # The pairs are some of each query: they go to the vectors.
    some = vectors.join(small(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
    v = some.select("doc_id", V.l2_normalise(F.col("vec")).alias("dv"))
    q = queries.select("qid", V.l2_normalise(F.col("vec")).alias("qv"))
    return pairs.join(q, "qid", "left").join(v, "doc_id", "left").withColumn("semantic", V.dot(F.col("dv"), F.col("qv"))).drop("dv", "qv")
