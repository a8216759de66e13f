"""Published nDCG@10 of public retrieval benchmarks.

Columns: BM25 of Thakur et al. 2021 (Table 2), BM25 of Kamalloo et al. 2024 (Table 3) with title and body as fields,
the same with both as one text, and the dense encoder bge-base-en-v1.5 by its model card.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = ("thakur2021", "kamalloo-multifield", "kamalloo-flat", "bge-base-en-v1.5")
DENSE = ("bge-base-en-v1.5",)
PRIMARY = "kamalloo-flat"
_TABLE = """
arguana .315 .414 .397 .63605
bioasq .465 .465 .522 -
climate-fever .213 .213 .165 -
cqadupstack .299 .299 .302 -
dbpedia-entity .313 .313 .318 -
fever .753 .753 .651 -
fiqa .236 .236 .236 .40646
hotpotqa .603 .603 .633 -
msmarco .228 - - -
nfcorpus .325 .325 .322 .37389
nq .329 .329 .305 -
quora .789 .789 .789 -
robust04 .408 .407 .407 -
scidocs .158 .158 .149 .21731
scifact .665 .665 .679 .74039
signal1m .330 .330 .330 -
trec-covid .656 .656 .595 -
trec-news .398 .398 .395 -
webis-touche2020 .367 .367 .442 -
"""
ROWS = [(f[0], s, float(v)) for f in map(str.split, _TABLE.strip().splitlines()) for s, v in zip(SOURCES, f[1:]) if v != "-"]


def published(dataset: str, source: str = PRIMARY):
    """The value of a source, or None."""
    return next((v for d, s, v in ROWS if (d, s) == (dataset, source)), None)


def table(spark: SparkSession) -> DataFrame:
    """(dataset, source, ndcg), lexical and dense sources alike."""
    return spark.createDataFrame(ROWS, "dataset string, source string, ndcg double")


def spread(spark: SparkSession) -> DataFrame:
    """(dataset, spread): how far the published lexical values lie apart, where there are two or more."""
    lexical = table(spark).where(~F.col("source").isin(*DENSE))
    return lexical.groupBy("dataset").agg((F.max("ndcg") - F.min("ndcg")).alias("spread"), F.count("*").alias("n")).where("n >= 2").drop("n")


def compare(measured: DataFrame, source: str = PRIMARY) -> DataFrame:
    """measured (dataset, measured) with the published value of a source and the difference; nulls where there is none."""
    known = table(measured.sparkSession).where(F.col("source") == source).select("dataset", F.col("ndcg").alias("published"))
    return measured.join(F.broadcast(known), "dataset", "left").withColumn("delta", F.col("measured") - F.col("published"))


def mean_absolute_deviation(comparison: DataFrame) -> DataFrame:
    """One row (n, deviation) over the datasets that have a published value."""
    return comparison.where("delta IS NOT NULL").agg(F.count("*").alias("n"), F.avg(F.abs("delta")).alias("deviation"))
