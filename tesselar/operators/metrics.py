"""Ranking metrics to trec_eval semantics, as windows over a run and its judgements.

A run is (qid, doc_id, score), judgements are (qid, doc_id, rel). Documents rank by score, and equal scores by the
document's name in descending order of strings. Every judged query counts, with 0 where nothing was retrieved.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked

K_VALUES = (1, 3, 5, 10, 100, 1000)
METRICS = ("ndcg", "recall", "precision", "map", "mrr")


def rank_documents(run: DataFrame) -> DataFrame:
    """run with each document's place."""
    return ranked(run, ["qid"], F.col("score").desc(), F.col("doc_id").cast("string").desc())


def _dcg(rel, rank):
    return F.greatest(rel, F.lit(0)) / F.log2(rank + 1)


def per_query(qrels: DataFrame, run: DataFrame, k_values: Sequence[int] = K_VALUES) -> DataFrame:
    """(qid, k, ndcg, recall, precision, map, mrr) for every judged query and cut-off."""
    judged = qrels.select("qid", F.col("doc_id").cast("string").alias("doc"), "rel")
    totals = judged.groupBy("qid").agg(F.sum(F.when(F.col("rel") > 0, 1).otherwise(0)).alias("relevant"))
    ideal = ranked(judged, ["qid"], F.col("rel").desc())
    ks = F.broadcast(qrels.sparkSession.createDataFrame([(int(k),) for k in k_values], "k int"))
    best = ideal.crossJoin(ks).where("rank <= k").groupBy("qid", "k").agg(F.sum(_dcg(F.col("rel"), F.col("rank"))).alias("idcg"))

    # Only what is retrieved and judged adds to a metric; ranks come from the whole run.
    placed = rank_documents(run).select("qid", F.col("doc_id").cast("string").alias("doc"), "rank")
    found = placed.join(judged, ["qid", "doc"])
    nth = F.sum(F.when(F.col("rel") > 0, 1).otherwise(0)).over(Window.partitionBy("qid").orderBy("rank"))
    found = found.withColumn("nth", nth).crossJoin(ks).where("rank <= k")
    hit = F.col("rel") > 0
    sums = found.groupBy("qid", "k").agg(
        F.sum(_dcg(F.col("rel"), F.col("rank"))).alias("dcg"),
        F.sum(F.when(hit, 1).otherwise(0)).alias("hits"),
        F.sum(F.when(hit, F.col("nth") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
    )
    every = totals.crossJoin(ks).join(best, ["qid", "k"], "left").join(sums, ["qid", "k"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return every.select(
        "qid",
        "k",
        zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.when(F.col("idcg") > 0, F.col("idcg")))).alias("ndcg"),
        zero(F.when(F.col("relevant") > 0, F.col("hits") / F.when(F.col("relevant") > 0, F.col("relevant")))).alias("recall"),
        zero(F.when(F.col("k") > 0, F.col("hits") / F.when(F.col("k") > 0, F.col("k")))).alias("precision"),
        zero(F.when(F.col("relevant") > 0, F.col("precisions") / F.when(F.col("relevant") > 0, F.col("relevant")))).alias("map"),
        zero(1 / F.col("first")).alias("mrr"),
    )


def evaluate(qrels: DataFrame, run: DataFrame, k_values: Sequence[int] = K_VALUES) -> DataFrame:
    """(k, n_queries, ndcg, recall, precision, map, mrr): means over all judged queries."""
    if qrels.isEmpty():
        raise ValueError("there are no judgements")
    return per_query(qrels, run, k_values).groupBy("k").agg(F.count("*").alias("n_queries"), *[F.avg(m).alias(m) for m in METRICS])


def single_target(ranks: DataFrame, *, k_values: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """One row of means for queries with one target each: rank is the target's place or null, doc_rank that of its file.

    recall_at_k for each k, mrr and ndcg cut at 10, doc_recall_10.
    """
    at = F.col("rank")
    in10 = at <= 10
    out = [F.avg(F.coalesce((at <= k).cast("double"), F.lit(0.0))).alias(f"recall_at_{k}") for k in k_values]
    out += [F.avg(F.when(in10, 1 / at).otherwise(0.0)).alias("mrr"), F.avg(F.when(in10, 1 / F.log2(at + 1)).otherwise(0.0)).alias("ndcg")]
    out.append(F.avg(F.coalesce((F.col("doc_rank") <= 10).cast("double"), F.lit(0.0))).alias("doc_recall_10"))
    return ranks.agg(F.count("*").alias("n"), *out)


def paired_bootstrap(a: DataFrame, b: DataFrame, *, iterations: int = 10_000, seed: int = 0, metric: str = "ndcg") -> DataFrame:
    """One row (delta, p_value, n): the mean of b less a over the queries of both, and its two-sided bootstrap p.

    Draws of `iterations` resamples are spread over tasks, each with a generator of its own; what is broadcast is one
    number per query.
    """
    spark = a.sparkSession
    both = a.select("qid", F.col(metric).alias("x")).join(b.select("qid", F.col(metric).alias("y")), "qid")
    diff = np.array([r["d"] for r in both.select((F.col("y") - F.col("x")).alias("d"), "qid").orderBy("qid").toLocalIterator()])
    schema = "delta double, p_value double, n long"
    if not len(diff):
        return spark.createDataFrame([(0.0, 1.0, 0)], schema)
    held, observed, chunk = spark.sparkContext.broadcast(diff), float(diff.mean()), 500

    def draw(parts):
        for part in parts:
            for i in part["id"]:
                d = held.value
                rng = np.random.default_rng([seed, int(i)])
                n = min(chunk, iterations - int(i) * chunk)
                other = 0
                for at in range(0, n, 50):
                    means = d[rng.integers(0, len(d), (min(50, n - at), len(d)))].mean(axis=1)
                    other += int((means <= 0).sum() if observed >= 0 else (means >= 0).sum())
                yield pd.DataFrame({"other": [other]})

    counted = spark.range(-(-iterations // chunk)).mapInPandas(draw, "other long").agg(F.sum("other").alias("other"))
    return counted.select(F.lit(observed).alias("delta"), F.least(2 * F.col("other") / iterations, F.lit(1.0)).alias("p_value"), F.lit(len(diff)).cast("long").alias("n"))


def neighbour_recall(exact: DataFrame, approximate: DataFrame, k: int) -> DataFrame:
    """One row (n_queries, k, recall): the share of the exact k nearest that an approximate search found."""
    truth = exact.where(F.col("rank") <= k).select("qid", "doc_id")
    hits = truth.join(approximate.where(F.col("rank") <= k).select("qid", "doc_id"), ["qid", "doc_id"], "left_semi").agg(F.count("*").alias("hits"))
    n = truth.agg(F.countDistinct("qid").alias("n_queries"), F.count("*").alias("wanted"))
    return n.crossJoin(hits).select("n_queries", F.lit(k).alias("k"), F.try_divide("hits", "wanted").alias("recall"))
