"""The search engine: indexes of one corpus and a search that takes a batch of queries as a DataFrame.

A search reads postings twice and vectors once or twice: for the candidates of each leg, and for the full scores of what
either leg nominates. Both are checkpointed (some dozens of rows a query), and everything after works on them alone.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.functions import text as T
from tesselar.functions import vectors as V

from tesselar.session import checkpointed

from . import ann, dense, fusion, lexical, lsa
from .common import small
from .rerank import Reranker

MODES = tuple("bm25 vector rrf hybrid".split())


class Embedder(Protocol):
    """What makes vectors of texts: (doc_id, vec) of documents, (qid, vec) of queries."""

    name: str
    dim: int

    def embed_documents(self, docs: DataFrame) -> DataFrame: ...

    def embed_queries(self, queries: DataFrame) -> DataFrame: ...


class ServiceEmbedder:
    """Vectors from a service or a local model: make_client() gives, on the executors, a function from texts to vectors.

    Texts go in batches of `batch`; kind ("document" or "query") is passed on, prefix is put before queries.
    """

    def __init__(self, name: str, dim: int, make_client, batch: int = 96, prefix: str = ""):
        self.name, self.dim, self.make_client, self.batch, self.prefix = name, dim, make_client, batch, prefix

    def _embed(self, rows: DataFrame, key: str, kind: str, prefix: str) -> DataFrame:
        make, size = self.make_client, self.batch

        def run(parts):
            client = make()
            for part in parts:
                out = []
                texts = [prefix + (t or "") for t in part["text"]]
                for at in range(0, len(texts), size):
                    out += [[float(x) for x in v] for v in client(texts[at : at + size], kind)]
                part["vec"] = out
                yield part[[key, "vec"]]

        made = rows.select(key, "text").mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, vec array<double>")
        return made.select(key, V.l2_normalise(F.col("vec")).alias("vec"))

    def embed_documents(self, docs: DataFrame) -> DataFrame:
        return self._embed(docs, "doc_id", "document", "")

    def embed_queries(self, queries: DataFrame) -> DataFrame:
        return self._embed(queries, "qid", "query", self.prefix)


def _openai(model: str, dim: int):
    def make():
        import openai

        client = openai.OpenAI()
        return lambda texts, kind: [x.embedding for x in client.embeddings.create(model=model, dimensions=dim, input=[" ".join(t.split("\n")) for t in texts]).data]

    return make


def _voyage(model: str):
    def make():
        import voyageai

        client = voyageai.Client()
        return lambda texts, kind: client.embed(texts, model=model, input_type=kind).embeddings

    return make


def _sentence_transformer(model: str):
    def make():
        import sentence_transformers

        encoder = sentence_transformers.SentenceTransformer(model)
        return lambda texts, kind: encoder.encode(texts, show_progress_bar=False)

    return make


#: What encoders of the sentence-transformers library by default expect before a query.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def make_embedder(name: str, *, docs: DataFrame | None = None, dim: int | None = None, make_client=None) -> Embedder:
    """lsa (fitted on docs), openai, voyage or st:<model of sentence-transformers>.

    A service's client is made on the executors, from its package and key there, or by make_client, as for
    ServiceEmbedder. dim is the vectors' length: 256 for lsa, 1024 for services, 768 for st by default.
    """
    if name == "lsa":
        if docs is None:
            raise ValueError("lsa is fitted on docs")
        return lsa.fit(docs, dim=dim or 256)
    if name == "openai":
        return ServiceEmbedder(name, dim or 1024, make_client or _openai("text-embedding-3-large", dim or 1024))
    if name == "voyage":
        return ServiceEmbedder(name, dim or 1024, make_client or _voyage("voyage-3"))
    if name.startswith("st:") and name[3:]:
        return ServiceEmbedder(name, dim or 768, make_client or _sentence_transformer(name[3:]), prefix=QUERY_PREFIX)
    raise ValueError(f"unknown embedder: {name!r}")


@dataclass
class Engine:
    """chunks (doc_id LONG, title, text, doc STRING, project), their inverted index and their vectors."""

    chunks: DataFrame
    index: lexical.LexicalIndex
    vectors: DataFrame | None = None
    embedder: Embedder | None = None
    graph: ann.HnswIndex | None = None

    def search(
        self,
        queries: DataFrame,
        *,
        mode: str = "rrf",
        k: int = 10,
        candidates: int = 60,
        alpha: float = 0.5,
        query_vectors: DataFrame | None = None,
        use_ann: bool | None = None,
        ef: int = 96,
        reranker: Reranker | None = None,
        rerank_depth: int = 25,
        explain: bool = True,
    ) -> DataFrame:
        """The k best hits of each of queries (qid, text), with the trace of their scores.

        (qid, rank, doc_id, score, title, doc, project, bm25, vector, fused, reranked, rationale, dense_fallback, parts,
        and with explain: snippet, terms). Documents that no term and no vector nominates aren't hits.
        """
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}, not {mode!r}")
        use_ann = self.graph is not None if use_ann is None else use_ann
        lex_top = checkpointed(self.index.best(queries, candidates))
        pool, zero, none = lex_top.select("qid", "doc_id"), None, F.lit(None).cast("map<string,double>")
        if mode != "bm25":
            if self.vectors is None:
                raise ValueError("this engine has no vectors")
            if use_ann and self.graph is None:
                raise ValueError("this engine has no graph")
            asked = query_vectors if query_vectors is not None else self.embedder.embed_queries(queries)
            asked = checkpointed(asked.select("qid", "vec").where(~V.is_zero(F.col("vec"))))
            # A query whose vector is zero has the lexical leg as its semantic one.
            zero = checkpointed(queries.select("qid").join(asked.select("qid"), "qid", "left_anti")).withColumn("dense_fallback", F.lit(True))
            found = self.graph.search(asked, k=candidates, ef=ef) if use_ann else dense.search(self.vectors, asked, k=candidates)
            instead = lex_top.join(zero.select("qid"), "qid", "left_semi")
            sem_top = checkpointed(found.select("qid", "doc_id", "score", "rank").unionByName(instead.select("qid", "doc_id", "score", "rank")))
            pool = fusion.pool(lex_top, sem_top)
        # Whichever leg nominated a document, it has its full scores of both.
        worth = checkpointed(self.index.contributions(queries, pairs=pool))
        lex = worth.groupBy("qid", "doc_id").agg(F.sum("contrib").alias("score"))
        if mode != "bm25":
            known = pool.join(zero.select("qid"), "qid", "left_anti")
            cosines = ann.floored(known, sem_top) if use_ann else dense.score_pairs(known, self.vectors, asked)
            same = lex.join(zero.select("qid"), "qid", "left_semi")
            sem = checkpointed(cosines.select("qid", "doc_id", F.col("semantic").alias("score")).unionByName(same))
        if mode == "bm25":
            fused = lex_top.withColumn("parts", none)
        elif mode == "vector":
            fused = sem_top.withColumn("parts", none)
        elif mode == "rrf":
            fused = fusion.rrf({"bm25": lex_top, "vector": sem_top}, limit=candidates)
        else:
            fused = fusion.weighted(fusion.scored_pool(pool, lex, sem), alpha=alpha, limit=candidates)
        hits = fused.where(F.col("rank") <= (max(k, rerank_depth) if reranker else k))
        hits = hits.join(lex.select("qid", "doc_id", F.col("score").alias("bm25")), ["qid", "doc_id"], "left")
        if mode != "bm25":
            hits = hits.join(sem.withColumnRenamed("score", "vector"), ["qid", "doc_id"], "left")
        else:
            hits = hits.withColumn("vector", F.lit(None).cast("double"))
        hits = hits.withColumn("fused", F.col("score")).withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
        # Some hits of each query: they go to the texts.
        hits = self.chunks.select("doc_id", "title", "text", "doc", "project").join(small(hits, 256), "doc_id").join(queries.select("qid", F.col("text").alias("query")), "qid")
        if reranker is None:
            hits = hits.withColumns({"reranked": F.lit(None).cast("double"), "rationale": F.lit("")})
        else:
            asked = hits.where(F.col("rank") <= rerank_depth).withColumn("vector_score", F.coalesce("vector", F.lit(0.0)))
            judged = reranker.rerank(asked.select("qid", "doc_id", "rank", "query", "title", "text", "vector_score"), top_k=k)
            hits = hits.drop("rank").join(judged, ["qid", "doc_id"]).withColumn("score", F.col("reranked"))
        hits = hits.where(F.col("rank") <= k)
        if zero is not None:
            hits = hits.join(zero, "qid", "left").withColumn("dense_fallback", F.coalesce("dense_fallback", F.lit(False)))
        else:
            hits = hits.withColumn("dense_fallback", F.lit(False))
        columns = ["qid", "rank", "doc_id", "score", "title", "doc", "project", "bm25", "vector", "fused", "reranked", "rationale", "dense_fallback", "parts"]
        if explain:
            best = lexical.strongest(worth)
            terms = best.groupBy("qid", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term", "contrib"))), lambda x: F.struct(x["term"].alias("term"), x["contrib"].alias("contrib"))).alias("terms"))
            hits = hits.join(terms, ["qid", "doc_id"], "left").withColumn("snippet", T.snippet(F.col("text"), T.content_words(F.col("query"))))
            columns += ["snippet", "terms"]
        return hits.select(*columns)

    def save(self, path: str) -> None:
        """Parquet tables and meta data under path."""
        spark = self.chunks.sparkSession
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        self.index.save(f"{path}/lexical")
        if self.vectors is not None:
            self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        if isinstance(self.embedder, lsa.Lsa):
            self.embedder.save(path)
        if self.graph is not None:
            self.graph.save(path)
        meta = {"vectors": self.vectors is not None, "embedder": self.embedder.name if self.embedder else None, "graph": self.graph is not None}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str, *, embedder: Embedder | None = None) -> Engine:
    """The engine that was saved under path; one whose vectors a service made needs that embedder again."""
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    if embedder is None and meta["embedder"] == "lsa":
        embedder = lsa.load(spark, path)
    if embedder is None and meta["embedder"]:
        try:
            embedder = make_embedder(meta["embedder"])
        except ValueError:
            raise ValueError(f"this index needs the embedder {meta['embedder']!r}") from None
    vectors = spark.read.parquet(f"{path}/vectors") if meta["vectors"] else None
    return Engine(spark.read.parquet(f"{path}/chunks"), lexical.load(spark, f"{path}/lexical"), vectors, embedder, ann.load(spark, path) if meta["graph"] else None)


def build(chunks: DataFrame, *, embedder: Embedder | str | None = "lsa", stem: bool = False, use_ann: bool = False, ann_m: int = ann.M, ann_ef: int = ann.EF_BUILD, dim: int = 256) -> Engine:
    """The engine of chunks (doc_id LONG, title, text, doc, project). A graph is built if asked for and worth it."""
    docs = chunks.select("doc_id", T.indexable(F.col("title"), F.col("text")).alias("text"))
    index = lexical.build(docs, stem=stem)
    if isinstance(embedder, str):
        embedder = make_embedder(embedder, docs=docs, dim=dim if embedder == "lsa" else None)
    vectors = embedder.embed_documents(docs) if embedder is not None else None
    graph = None
    if use_ann and vectors is not None and vectors.count() >= ann.LEAST_ROWS:
        graph = ann.build(vectors, m=ann_m, ef=ann_ef)
    return Engine(chunks, index, vectors, embedder, graph)


def documents_as_chunks(documents: DataFrame) -> DataFrame:
    """Documents as chunks of one each: their source as title, their language as project."""
    return documents.select("doc_id", F.col("source").alias("title"), "text", F.col("doc_id").cast("string").alias("doc"), F.col("lang").alias("project"))
