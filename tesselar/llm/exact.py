"""Exact deduplication through a log-structured merge index of text digests.

Digests (two 64-bit hashes) and identifiers go through two layers of indexes: one for each partition of the scan, so
that a digest leaves it once however many rows have it, and one for each partition by digest. In both, rows enter a
memtable; a full memtable is flushed as a sorted run with a Bloom filter; compaction merges runs of like size and keeps
the smallest identifier of each digest. Lookups go through the filters of the runs and give the hits: digests that more
than one row has, with the identifier that stays. Only the texts of hits are moved, once for each task that has them,
and they are verified byte by byte: rows are copies when digest and text are equal, so a collision of digests never
removes a document. A digest of one text is settled by the index's identifier; those of several are grouped by text.

The digests of hits are broadcast while they fit `shared.MAX_BROADCAST_BYTES`; beyond that joins take over, in which no
task gets the rows of a hot digest.

Cases: a null text is never a copy; empty texts are copies of each other; texts are compared whole; of rows that repeat
an identifier and a text, one stays (any of them, if further columns differ); a null identifier orders last; an empty
table gives an empty result. Other columns of the input are kept as they are, whatever their names. Identifiers are
whole numbers; others raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpointed, in_keys, keyed, numbered_ids, table, whole, without_keys

MEMTABLE_ROWS = 1 << 16
FANOUT = 4
_ROW = np.dtype([("a", "<i8"), ("b", "<i8"), ("id", "<i8"), ("n", "<i8")])


class Run:
    """Rows (digest a, b, smallest identifier, number of rows) sorted by digest, with a Bloom filter."""

    def __init__(self, rows: np.ndarray):
        order = np.lexsort((rows["id"], rows["b"], rows["a"]))
        rows = rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])
        at = np.flatnonzero(new)
        self.rows = rows[at].copy()
        if len(at):
            self.rows["n"] = np.add.reduceat(rows["n"], at)
        self.bits = max(64, 1 << int(np.ceil(np.log2(10 * max(1, len(at))))))
        on = np.zeros(self.bits, np.uint8)
        for k in range(4):
            on[self._slot(self.rows["a"], self.rows["b"], k)] = 1
        self.filter = np.packbits(on, bitorder="little")

    def _slot(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        return ((a.view(np.uint64) + np.uint64(k) * (b.view(np.uint64) | np.uint64(1))) & np.uint64(self.bits - 1)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.rows)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each digest in the run, or -1; the filter spares the search for most absent ones."""
        out = np.full(len(a), -1)
        a, b = np.ascontiguousarray(a), np.ascontiguousarray(b)
        maybe = np.ones(len(a), bool)
        for k in range(4):
            slot = self._slot(a, b, k)
            maybe &= ((self.filter[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)
        at = np.flatnonzero(maybe)
        if len(at) and len(self.rows):
            lo = np.searchsorted(self.rows["a"], a[at], "left")
            while len(at):
                ok = lo < len(self.rows)
                at, lo = at[ok], lo[ok]
                ok = self.rows["a"][lo] == a[at]
                at, lo = at[ok], lo[ok]
                hit = self.rows["b"][lo] == b[at]
                out[at[hit]] = lo[hit]
                at, lo = at[~hit], lo[~hit] + 1
        return out


class Index:
    """The log-structured merge index of one partition."""

    def __init__(self, memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT):
        self.most, self.fanout = memtable_rows, fanout
        self.memtable: list[np.ndarray] = []
        self.held = 0
        self.levels: list[list[Run]] = []

    def add(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, n: np.ndarray | int = 1) -> None:
        """Rows of these digests; n is how many rows each stands for."""
        n = np.broadcast_to(n, len(a))
        for at in range(0, len(a), self.most):
            rows = np.zeros(len(a[at : at + self.most]), _ROW)
            for name, column in zip(("a", "b", "id", "n"), (a, b, ids, n)):
                rows[name] = column[at : at + self.most]
            self.memtable.append(rows)
            self.held += len(rows)
            if self.held >= self.most:
                self.flush()

    def flush(self) -> None:
        if self.held:
            self._push(0, Run(np.concatenate(self.memtable)))
            self.memtable, self.held = [], 0

    def _push(self, level: int, run: Run) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._push(level + 1, Run(np.concatenate([r.rows for r in runs])))

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(smallest identifier, number of rows) of each digest over all runs."""
        best, n = np.full(len(a), np.iinfo(np.int64).max), np.zeros(len(a), np.int64)
        for run in self.runs():
            at = run.find(a, b)
            yes = at >= 0
            best[yes] = np.minimum(best[yes], run.rows["id"][at[yes]])
            n[yes] += run.rows["n"][at[yes]]
        return best, n

    def repeated(self) -> Iterator[np.ndarray]:
        """The digests that more than one row has, each once, with smallest identifier and number of rows.

        Every run looks its digests up in the runs before it, through their filters; none is merged for this.
        """
        self.flush()
        runs = self.runs()
        for k, run in enumerate(runs):
            rows = run.rows.copy()
            new = np.ones(len(rows), bool)
            for other in runs[:k]:
                new &= other.find(rows["a"], rows["b"]) < 0
            rows = rows[new]
            for other in runs[k + 1 :]:
                at = other.find(rows["a"], rows["b"])
                yes = at >= 0
                rows["id"][yes] = np.minimum(rows["id"][yes], other.rows["id"][at[yes]])
                rows["n"][yes] += other.rows["n"][at[yes]]
            rows = rows[rows["n"] > 1]
            if len(rows):
                yield rows

    def compact(self) -> Run:
        """All runs as one."""
        self.flush()
        runs = self.runs()
        self.levels = [[Run(np.concatenate([r.rows for r in runs]) if runs else np.zeros(0, _ROW))]]
        return self.levels[0][0]


def digests(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


_INDEXED = "a long, b long, first_id long, n long"


def _batch(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[k])) for k in ("a", "b", "id", "n")], ["a", "b", "first_id", "n"])


def hits(docs: DataFrame, *, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """(a, b, first_id, n): the digests that more than one row has, with their smallest identifier.

    A null identifier counts as the largest number.
    """
    a, b = digests(F.col("text"))

    def filled(batches) -> Index:
        lsm = Index(memtable_rows)
        for batch in batches:
            lsm.add(*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)))
        return lsm

    def local(batches):
        rows = filled(batches).compact().rows
        for at in range(0, len(rows), memtable_rows):
            yield _batch(rows[at : at + memtable_rows])

    def index(batches):
        for rows in filled(batches).repeated():
            yield _batch(rows)

    some = numbered_ids(docs).where("text IS NOT NULL")
    some = some.select(a.alias("a"), b.alias("b"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("first_id"), F.lit(1).cast("long").alias("n"))
    return some.mapInArrow(local, _INDEXED).repartition("a").mapInArrow(index, _INDEXED)


def find(docs: DataFrame, *, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """(doc_id, keep_id) for every row that goes: an equal text with identifier keep_id stays in its place."""
    indexed = checkpointed(hits(docs, memtable_rows=memtable_rows))
    a, b = digests(F.col("text"))
    may = in_keys(docs.where("text IS NOT NULL"), a, indexed.select("a").distinct()).select(a.alias("a"), b.alias("b"), "doc_id", "text")
    # How many texts a digest has: each comes once from every task, whatever the number of its rows.
    texts = may.groupBy("a", "b", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    per = checkpointed(texts.groupBy("a", "b").agg(F.count("*").alias("texts")))
    collided = checkpointed(per.where("texts > 1").select("a", "b"))
    sure = indexed.join(F.broadcast(collided), ["a", "b"], "left_anti") if not collided.isEmpty() else indexed
    last = F.lit(2**63 - 1)
    named = keyed(may.select("a", "b", "doc_id"), sure, ["a", "b"]).select("doc_id", F.when(F.col("first_id") != last, F.col("first_id")).alias("keep_id"), "a", "b")
    if not collided.isEmpty():
        apart = may.join(F.broadcast(collided), ["a", "b"], "left_semi").join(texts.drop("n"), ["a", "b", "text"])
        named = named.unionByName(apart.select("doc_id", "keep_id", "a", "b"))
    others = named.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "keep_id")
    # Of the rows with the identifier that stays one stays.
    same = named.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("a", "b", "doc_id", "keep_id").agg(F.count("*").alias("n")).where("n > 1")
    again = same.select("doc_id", "keep_id", F.explode(F.sequence(F.lit(2), F.col("n").cast("int")))).select("doc_id", "keep_id")
    return others.unionByName(again)


def dedup(docs: DataFrame, *, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """docs, whole rows, without copies: of equal texts the row with the smallest identifier stays."""
    keys = checkpointed(hits(docs, memtable_rows=memtable_rows).select("a").distinct())
    a, b = digests(F.col("text"))
    others = without_keys(docs, F.when(F.col("text").isNotNull(), a), keys)
    may = whole(in_keys(docs.where("text IS NOT NULL"), a, keys), a=a, b=b, text=F.col("text"), order=F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id")))
    # Grouped by the texts themselves; each task sends one row of a group on.
    kept = may.groupBy("a", "b", "text").agg(F.min_by("whole", "order").alias("whole"))
    return others.unionByName(kept.select("whole.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All copies among the documents, each with the document that stays in its place."""
    return find(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without exact copies."""
    return dedup(docs)


ORACLE_SQL = """
SELECT doc_id, keep_id FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth
  FROM documents WHERE text IS NOT NULL) WHERE nth > 1
"""
