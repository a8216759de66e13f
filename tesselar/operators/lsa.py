"""Latent semantic vectors: TF-IDF and a distributed randomised singular value decomposition.

The rows of the TF-IDF matrix stay distributed; what the driver holds is vocabulary by rank, bounded by `max_features`
and `dim`, whatever the corpus. Each pass maps every core's share of the rows to its part of A'(A X) and adds the parts
by blocks of terms, in single precision on the way; the result is orthonormalised and goes out again. Products run over
blocks of rows that are dense in the terms they have, so that they are matrix products. Rows are made where the texts
are: no text and no count is moved.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tesselar.functions import text as T
from tesselar.session import checkpointed

from .common import ranked, spread
from .lexical import term_counts as counted

#: Terms whose document frequencies a task adds up before it gives them on.
_TERMS = 1 << 18
_PIECE = 1 << 14
_BLOCKS = 16


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of docs (doc_id, text)."""
    words = spread(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("term"))
    return words.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def _texts(docs: DataFrame) -> DataFrame:
    return spread(docs.select("doc_id", "text")).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df) of docs (doc_id, text) whose identifiers don't repeat: each task counts its own, and no text is moved."""

    def run(batches):
        total: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "df"])

        for batch in batches:
            for text in batch.column("text"):
                total.update(counted(text.as_py())[1].keys())
                if len(total) > _TERMS:
                    yield out()
                    total.clear()
        if total:
            yield out()

    return _texts(docs).mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weighted(docs: DataFrame, names: list[str], idf: np.ndarray, *, unit: bool) -> DataFrame:
    """(doc_id, at, w): the rows of `sparse` from texts, terms numbered by their places in names; each row where its text is."""
    held = docs.sparkSession.sparkContext.broadcast(({x.encode(): i for i, x in enumerate(names)}, np.asarray(idf, float)))

    def run(batches):
        known, idfs = held.value
        for batch in batches:
            at, w, size = [], [], [0]
            for text in batch.column("text"):
                some = sorted((known[t], n) for t, n in counted(text.as_py())[1].items() if t in known)
                t = np.array([a for a, _ in some], np.int32)
                x = (1 + np.log(np.array([n for _, n in some], float))) * idfs[t]
                at.append(t)
                w.append(x / np.sqrt(max(x @ x, 1e-12)) if unit else x)
                size.append(size[-1] + len(t))
            lists = [pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate(x) if x else [], kind)) for x, kind in ((at, pa.int32()), (w, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "at", "w"])

    return _texts(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, at array<int>, w array<double>")


def _repeat(docs: DataFrame) -> bool:
    """Whether an identifier is in several rows, which then are one document."""
    return not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def vocabulary(counts: DataFrame, n_docs: int, **bounds) -> DataFrame:
    """(term, df, idf): terms in min_df to max_df_ratio of the documents, the most frequent first, ties by the term."""
    return _kept(counts.groupBy("term").agg(F.count("*").alias("df")), n_docs, **bounds)


def _kept(df: DataFrame, n_docs: int, *, max_features: int = 40_000, max_df_ratio: float = 0.5, min_df: int = 2) -> DataFrame:
    most = max(int(max_df_ratio * n_docs), 1)
    kept = df.where(F.col("df").between(min_df, most))
    best = kept.orderBy(F.col("df").desc(), F.col("term").asc()).limit(max_features)
    return best.select("term", "df", (F.log(F.lit(n_docs + 1.0) / (F.col("df") + 1.0)) + 1).alias("idf"))


def tfidf(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, term, weight): damped term frequency by idf, rows of unit length."""
    w = counts.join(vocab.select("term", "idf"), "term").withColumn("raw", (1 + F.log("tf")) * F.col("idf"))
    length = F.sqrt(F.greatest(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")), F.lit(1e-12)))
    return w.select("doc_id", "term", (F.col("raw") / length).alias("weight"))


def _dense(first: np.ndarray, at: np.ndarray, w: np.ndarray, kind=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """(terms, matrix): sparse rows first[i]:first[i + 1] of (at, w) as a matrix with a column for each term they have."""
    terms, column = np.unique(at, return_inverse=True)
    out = np.zeros((len(first) - 1, len(terms)), kind)
    out[np.repeat(np.arange(len(first) - 1), np.diff(first)), column] = w
    return terms, out


def _rows(batches, piece: int = _PIECE):
    """(ids, first, terms, weights) of batches (doc_id, at, w), in pieces of about `piece` entries."""
    for batch in batches:
        size = np.diff(batch.column("at").offsets.to_numpy())
        lo = 0
        while lo < batch.num_rows:
            hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo:]), piece)))
            part = batch.slice(lo, hi - lo)
            at, w = part.column("at"), part.column("w")
            offs = at.offsets.to_numpy()
            yield part.column("doc_id"), (offs - offs[0]).astype(np.int64), at.flatten().to_numpy(), w.flatten().to_numpy()
            lo = hi


def _gram_times(rows: DataFrame, x: np.ndarray) -> np.ndarray:
    """A'(A x) for the sparse rows (doc_id, at, w)."""
    v, k = x.shape
    step = max(1, -(-v // _BLOCKS))
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(x.astype(np.float32))

    def part(batches):
        m, z = held.value, np.zeros((v, k), np.float32)
        for _, first, at, w in _rows(batches):
            terms, a = _dense(first, at, w, np.float32)
            z[terms] += a.T @ (a @ m[terms])
        for b in range(0, v, step):
            yield pa.RecordBatch.from_arrays([pa.array([b // step], pa.int32()), pa.array([z[b : b + step].tobytes()], pa.binary())], ["block", "z"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[b] = total.get(b, 0) + np.frombuffer(z, np.float32).astype(np.float64)
        for b, z in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([z.tobytes()], pa.binary())], ["block", "z"])

    # One part of vocabulary by rank for each core, not for each partition of the corpus.
    shares = rows.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(part, "block int, z binary")
    # Not by range: for its bounds all shares would be computed twice.
    summed = shares.repartition(_BLOCKS, "block").mapInArrow(add, "block int, z binary")
    got = {r["block"]: np.frombuffer(r["z"]).reshape(-1, k) for r in summed.collect()}
    held.unpersist()
    return np.concatenate([got[b] for b in sorted(got)]) if got else np.zeros((v, k))


def decompose(rows: DataFrame, n_terms: int, rank: int, *, seed: int = 0, oversample: int = 12, power: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(components (terms, rank), singular values) of the sparse rows, by randomised subspace iteration."""
    width = min(rank + oversample, n_terms)
    x, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, width)))
    for _ in range(power):
        x, _ = np.linalg.qr(_gram_times(rows, x))
    values, turn = np.linalg.eigh(x.T @ _gram_times(rows, x))
    order = np.argsort(values)[::-1][:rank]
    return x @ turn[:, order], np.sqrt(np.maximum(values[order], 0))


@dataclass
class Lsa:
    """A fitted model: terms (term, term_id, idf) as a DataFrame, components (terms, dim) on the driver."""

    terms: DataFrame
    components: np.ndarray
    singular: np.ndarray
    name: str = "lsa"

    @property
    def dim(self) -> int:
        return self.components.shape[1]

    def _rows(self, counts: DataFrame, *, unit: bool) -> DataFrame:
        w = tfidf(counts, self.terms) if unit else counts.join(self.terms, "term").select("doc_id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("weight"))
        return sparse(w, self.terms)

    def _embed(self, docs: DataFrame, unit: bool) -> DataFrame:
        repeat = _repeat(docs)
        if repeat:
            rows = self._rows(term_counts(docs), unit=unit)
        else:
            known = self.terms.orderBy("term_id").toArrow()
            rows = weighted(docs, known.column("term").to_pylist(), known.column("idf").to_numpy(), unit=unit)
        held = docs.sparkSession.sparkContext.broadcast(self.components)

        def run(batches):
            for ids, first, at, w in _rows(batches):
                terms, a = _dense(first, at, w)
                v = a @ held.value[terms]
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([ids, lists], ["doc_id", "vec"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        found = rows.mapInArrow(run, f"doc_id {kind}, vec array<double>")
        if not repeat:
            return found
        # A text without a known term has the zero vector.
        zero = F.array_repeat(F.lit(0.0), self.dim)
        return docs.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("vec", zero).alias("vec"))

    def embed_documents(self, docs: DataFrame) -> DataFrame:
        """(doc_id, vec) of docs (doc_id, text), keyed by identifier."""
        return self._embed(docs, True)

    def embed_queries(self, queries: DataFrame) -> DataFrame:
        """(qid, vec) of queries (qid, text), folded in: weighted sums of their terms' components, unit length."""
        return self._embed(queries.withColumnRenamed("qid", "doc_id"), False).withColumnRenamed("doc_id", "qid")

    def save(self, path: str) -> None:
        spark = self.terms.sparkSession
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(self.components)]
        components = spark.createDataFrame(rows, "term_id int, component array<double>")
        self.terms.join(components, "term_id").write.mode("overwrite").parquet(f"{path}/lsa_terms")
        spark.createDataFrame([([float(s) for s in self.singular],)], "singular array<double>").write.mode("overwrite").parquet(f"{path}/lsa_singular")


def load(spark: SparkSession, path: str) -> Lsa:
    table = spark.read.parquet(f"{path}/lsa_terms")
    rows = sorted((r["term_id"], r["component"]) for r in table.select("term_id", "component").toLocalIterator())
    singular = np.array(spark.read.parquet(f"{path}/lsa_singular").first()["singular"])
    return Lsa(table.select("term", "term_id", "idf"), np.array([c for _, c in rows]).reshape(len(rows), len(singular)), singular)


def sparse(weights: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, at, w): rows of (doc_id, term, weight) as arrays of term numbers and weights."""
    each = weights.join(terms.select("term", "term_id"), "term")
    row = F.array_sort(F.collect_list(F.struct("term_id", "weight")))
    return each.groupBy("doc_id").agg(row.alias("r")).select("doc_id", F.col("r.term_id").alias("at"), F.col("r.weight").alias("w"))


def fit(docs: DataFrame, *, dim: int = 256, seed: int = 0, power: int = 4, max_features: int = 40_000, max_df_ratio: float = 0.5, min_df: int = 2) -> Lsa:
    """The model of docs (doc_id, text): min(dim, documents - 1, terms - 1) dimensions, 2 at least where there are terms."""
    n, repeat = docs.count(), _repeat(docs)
    counts = term_counts(docs).persist(StorageLevel.MEMORY_AND_DISK) if repeat else None
    bounds = {"min_df": min_df, "max_df_ratio": max_df_ratio, "max_features": max_features}
    kept = vocabulary(counts, n, **bounds) if repeat else _kept(document_frequencies(docs), n, **bounds)
    # At most max_features rows, so one task may number them.
    terms = ranked(kept.withColumn("all", F.lit(1)), ["all"], F.col("term").asc(), name="nth").select("term", (F.col("nth") - 1).cast("int").alias("term_id"), "idf")
    terms = checkpointed(terms)
    v = terms.count()
    if not v:
        return Lsa(terms, np.zeros((0, 2)), np.zeros(2))
    if repeat:
        rows = sparse(tfidf(counts, terms), terms)
    else:
        known = terms.orderBy("term_id").toArrow()
        rows = weighted(docs, known.column("term").to_pylist(), known.column("idf").to_numpy(), unit=True)
    # In single precision, as the products are.
    rows = rows.select("doc_id", "at", F.col("w").cast("array<float>").alias("w")).persist(StorageLevel.MEMORY_AND_DISK)
    rank = min(dim, v, max(2, min(n, v) - 1))
    components, singular = decompose(rows, v, rank, seed=seed, power=power)
    rows.unpersist()
    if repeat:
        counts.unpersist()
    return Lsa(terms, components, singular)
