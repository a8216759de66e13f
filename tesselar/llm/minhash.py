"""Near-duplicate removal by b-bit MinHash.

A text is the set of its runs of `SHINGLE` words. Of `BANDS` * `ROWS` minima per document, each band of `ROWS` whole
minima is hashed to a key for the candidate search, and of every minimum the low `BITS` bits are packed into a
signature. Documents that share a band are compared by their signatures: from the share of equal slots, counted by
bits, the similarity follows after the chance of equal low bits, 2**-BITS, is taken out. Groups are the connected
components of all links at or above `AT_LEAST`, and the smallest identifier of a group stays.

Documents with equal minima are one node in the search, tied to the smallest identifier among them; see `links`
for what keeps large groups cheap. No bucket or group has a cap.

Cases: a null or wordless text, or a null identifier, takes no part and stays; texts are read whole; a text of fewer
words than a shingle is one shingle; rows that repeat an identifier are one document, with the links of all its texts,
and stay or go together (two rows alike but for nothing both stay); similarities that tie need no order, as all links
of a group count; an empty table gives an empty result; further columns of the input are kept, whatever their names.
Identifiers are whole numbers; others raise ValueError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .links import BLOCK, collapse, linked, ties
from .shared import checkpointed, components, keyed, numbered_ids, table, without_keys

SHINGLE = 3
BANDS = 48
ROWS = 4
BITS = 2
AT_LEAST = 0.45
_CHUNK = 2048


def permutations(n: int, seed: int = 0x5EED) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and masks of n hash functions on 32 bits."""
    x = kernel.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return (x[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> np.uint64(32)).astype(np.uint32)


def minima(hashes: np.ndarray, multiply: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The minimum under each hash function of a text's shingles."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(multiply), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), _CHUNK):
        x = h[None, at : at + _CHUNK] ^ mask[:, None]
        x *= multiply[:, None]
        np.minimum(out, x.min(axis=1), out=out)
    return out


def packed(low: np.ndarray, bits: int) -> np.ndarray:
    """Rows of low bits (n, k) as rows of bytes: plane by plane, so that a slot is equal where all planes agree."""
    planes = [np.packbits((low >> b) & 1, axis=1) for b in range(bits)]
    return np.concatenate(planes, axis=1)


def similarity(signatures: np.ndarray, i: int, js: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Estimated Jaccard similarity of signature i with those of js, corrected for chance collisions."""
    width = signatures.shape[1] // bits
    differs = np.zeros((len(js), width), np.uint8)
    for b in range(bits):
        plane = signatures[:, b * width : (b + 1) * width]
        differs |= plane[js] ^ plane[i]
    equal = 1 - np.bitwise_count(differs).sum(axis=1, dtype=np.int64) / k
    chance = 2.0**-bits
    return np.maximum(0.0, (equal - chance) / (1 - chance))


def sketches(docs: DataFrame, *, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """(doc_id, node, data, bands) of every document with a word: data is the signature, bands are 64-bit keys.

    node is a digest of both: documents with equal minima have the same.
    """
    multiply, mask = permutations(bands * rows)

    def run(batches):
        for batch in kernel.slices(batches, "text"):
            h, first = kernel.words(batch.column("text"))
            g, doc = kernel.grams(h, first, shingle)
            b = kernel.bounds(doc, batch.num_rows)
            some = np.flatnonzero(np.diff(b))
            if not len(some):
                continue
            m = np.stack([minima(g[b[i] : b[i + 1]], multiply, mask) for i in some])
            key = np.zeros((len(some), bands), np.uint64)
            whole = m.reshape(len(some), bands, rows).astype(np.uint64)
            for r in range(rows):
                key = kernel.mix(key * np.uint64(0xD6E8FEB86659FD93) + whole[:, :, r] + np.uint64(1))
            key = kernel.mix(key + np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xA0761D6478BD642F))
            sig = packed(m.astype(np.uint8), bits)
            node = np.zeros(len(some), np.uint64)
            for r in range(bands):
                node = kernel.mix(node * np.uint64(0xD6E8FEB86659FD93) + key[:, r])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(some)),
                    pa.array(node.view(np.int64)),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(sig.shape[1]), len(some), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, bands), pa.int32()), pa.array(key.view(np.int64).ravel())),
                ],
                ["doc_id", "node", "data", "bands"],
            )

    some = numbered_ids(docs).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return some.mapInArrow(run, "doc_id long, node long, data binary, bands array<long>")


def groups(docs: DataFrame, *, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, bits: int = BITS, at_least: float = AT_LEAST, block: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id) for every document that goes: keep_id is the smallest identifier of its group."""
    k = bands * rows
    sketch = checkpointed(sketches(docs, shingle=shingle, bands=bands, rows=rows, bits=bits))
    nodes, copies, counts = collapse(sketch)

    def load(data: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(data.to_pylist()), np.uint8).reshape(len(data), -1)

    keys = nodes.select(F.explode("bands").alias("key"), F.col("node").alias("doc_id"))
    found = linked(keys, nodes.select("node", "rep", "data"), load, lambda d, i, js: similarity(d, i, js, k, bits), at_least, block=block)
    labels = components(found.select("a", "b").unionByName(ties(sketch.select("doc_id", "node"), copies, counts)))
    moved = labels.where("node <> label").select(F.col("node").alias("doc_id"), "label")
    # What equals a representative goes where that one goes: no group of equals passes through the components.
    to = counts.join(moved.withColumnRenamed("doc_id", "rep"), "rep", "left").select("node", "n", F.coalesce("label", "rep").alias("label"))
    equal = keyed(copies, checkpointed(to), ["node"]).where("doc_id <> label").select("doc_id", "label")
    return moved.unionByName(equal).groupBy("doc_id").agg(F.min("label").alias("keep_id"))


def dedup(docs: DataFrame, **how) -> DataFrame:
    """docs, whole rows, with one document of each group."""
    gone = checkpointed(groups(docs, **how).select("doc_id"))
    return without_keys(docs, F.col("doc_id").cast("long"), gone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near copies among all documents, each with the document that stays in its place."""
    return groups(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without near copies."""
    return dedup(docs)
