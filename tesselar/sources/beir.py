"""Retrieval benchmarks in the BEIR layout: corpus.jsonl, queries.jsonl and qrels/<split>.tsv in a local folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.operators.common import ranked

#: Public datasets: documents, test queries, and whether a query may be a document of the corpus.
_TABLE = """
nfcorpus 3633 323
scifact 5183 300
arguana 8674 1406 self
scidocs 25657 1000
fiqa 57638 648
trec-covid 171332 50
webis-touche2020 382545 49
quora 522931 10000 self
nq 2681468 3452
dbpedia-entity 4635922 400
hotpotqa 5233329 7405
fever 5416568 6666
climate-fever 5416593 1535
msmarco 8841823 6980 dev
"""


@dataclass(frozen=True)
class Spec:
    name: str
    n_docs: int
    n_queries: int
    split: str = "test"
    drops_self_matches: bool = False


REGISTRY = {f[0]: Spec(f[0], int(f[1]), int(f[2]), "dev" if "dev" in f else "test", "self" in f) for f in map(str.split, _TABLE.strip().splitlines())}
SMALL_SUITE = tuple(list(REGISTRY)[:5])


@dataclass
class Dataset:
    """documents (doc_id, title, text), queries (qid, text), qrels (qid, doc_id, rel), all identifiers strings."""

    name: str
    documents: DataFrame
    queries: DataFrame
    qrels: DataFrame
    drops_self_matches: bool = False

    def to_chunks(self) -> DataFrame:
        """One chunk per document, its title kept as title."""
        return self.documents.select("doc_id", "title", "text", F.col("doc_id").alias("doc"), F.lit(self.name).alias("project"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file of JSON objects; blank lines are skipped, any other that can't be read is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rel) of a tab-separated file. A header, short rows and scores that aren't numbers are skipped.

    Of rows that repeat a pair the last in the file counts.
    """
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select(F.get(parts, 0).alias("qid"), F.get(parts, 1).alias("doc_id"), F.expr("try_cast(get(split(value, '\t'), 2) AS double)").cast("int").alias("rel"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    some = rows.where("rel IS NOT NULL AND doc_id IS NOT NULL")
    return ranked(some, ["qid", "doc_id"], F.col("block").desc(), F.col("line").desc(), k=1).select("qid", "doc_id", "rel")


def load(spark: SparkSession, name: str, folder: str, *, split: str | None = None, max_docs: int | None = None) -> Dataset:
    """The dataset in folder. Only judged queries are kept; one that is judged but has no text is an error.

    max_docs takes the first documents by identifier, their judgements, and the queries that keep a relevant one.
    """
    if name not in REGISTRY:
        raise KeyError(f"{name!r} is no dataset of the registry")
    spec = REGISTRY[name]
    documents = read_jsonl(spark, f"{folder}/corpus.jsonl", "_id string, title string, text string")
    documents = documents.select(F.col("_id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    texts = read_jsonl(spark, f"{folder}/queries.jsonl", "_id string, text string").select(F.col("_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"))
    qrels = read_qrels(spark, f"{folder}/qrels/{split or spec.split}.tsv")
    if max_docs is not None:
        documents = documents.orderBy("doc_id").limit(max_docs)
        qrels = qrels.join(documents.select("doc_id"), "doc_id", "left_semi").select("qid", "doc_id", "rel")
        alive = qrels.groupBy("qid").agg(F.max("rel").alias("best")).where("best > 0")
        qrels = qrels.join(alive, "qid", "left_semi")
    missing = qrels.select("qid").distinct().join(texts, "qid", "left_anti")
    first = missing.first()
    if first is not None:
        raise ValueError(f"{missing.count()} judged queries have no text, such as {first['qid']!r}")
    return Dataset(name, documents, texts.join(qrels, "qid", "left_semi"), qrels, spec.drops_self_matches)
