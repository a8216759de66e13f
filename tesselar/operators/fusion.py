"""Fusion of a lexical and a semantic leg."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.functions.vectors import NORMALISERS

from .common import ranked

K_RRF = 60


def rrf(legs: dict[str, DataFrame], *, limit: int = 50, k: int = K_RRF, weights: dict[str, float] | None = None) -> DataFrame:
    """(qid, doc_id, score, rank, parts): reciprocal rank fusion of legs (qid, doc_id, rank).

    A document scores the sum over legs of weight / (k + rank); ties go by the rank in the first leg, then the next.
    """
    weights = weights or {}
    parts = [
        leg.select("qid", "doc_id", F.lit(name).alias("leg"), F.col("rank").alias("leg_rank"), (F.lit(float(weights.get(name, 1.0))) / (k + F.col("rank"))).alias("part"))
        for name, leg in legs.items()
    ]
    by_leg = [F.min(F.when(F.col("leg") == name, F.col("leg_rank"))).alias(f"rank_{name}") for name in legs]
    # Parts are added in the order of the legs, whatever order rows come in.
    in_order = [F.coalesce(F.max(F.when(F.col("leg") == name, F.col("part"))), F.lit(0.0)) for name in legs]
    fused = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("qid", "doc_id")
        .agg(reduce(lambda a, b: a + b, in_order).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("leg", "part")))).alias("parts"), *by_leg)
    )
    order = [F.round("score", 12).desc(), *[F.col(f"rank_{name}").asc_nulls_last() for name in legs], F.col("doc_id").asc()]
    return ranked(fused, ["qid"], *order, k=limit).select("qid", "doc_id", "score", "rank", "parts")


def pool(*legs: DataFrame) -> DataFrame:
    """(qid, doc_id): the documents that any leg nominates."""
    return reduce(DataFrame.union, [leg.select("qid", "doc_id") for leg in legs]).distinct()


def scored_pool(candidates: DataFrame, lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """candidates with their full scores from both legs, whichever nominated them; 0 where a leg has none."""
    named = candidates.join(lexical.select("qid", "doc_id", F.col("score").alias("lexical")), ["qid", "doc_id"], "left")
    named = named.join(semantic.select("qid", "doc_id", F.col("score").alias("semantic")), ["qid", "doc_id"], "left")
    return named.select("qid", "doc_id", F.coalesce("lexical", F.lit(0.0)).alias("lexical"), F.coalesce("semantic", F.lit(0.0)).alias("semantic"))


def weighted(candidates: DataFrame, *, alpha: float | list[float] = 0.5, normaliser: str = "minmax", limit: int = 50) -> DataFrame:
    """(qid, [alpha,] doc_id, score, rank, parts): alpha * semantic + (1 - alpha) * lexical, normalised over the pool.

    candidates is (qid, doc_id, lexical, semantic). A list of alphas gives one ranking for each from one pass.
    """
    if normaliser not in NORMALISERS:
        raise ValueError(f"unknown normaliser: {normaliser!r}")
    norm = NORMALISERS[normaliser]
    n = candidates.select("qid", "doc_id", norm(F.col("lexical")).alias("nl"), norm(F.col("semantic")).alias("ns"))
    several = isinstance(alpha, list)
    n = n.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in (alpha if several else [alpha])])))
    mixed = n.withColumn("score", F.col("alpha") * F.col("ns") + (1 - F.col("alpha")) * F.col("nl"))
    parts = F.create_map(F.lit("vector"), F.col("alpha") * F.col("ns"), F.lit("bm25"), (1 - F.col("alpha")) * F.col("nl"))
    out = ranked(mixed, ["qid", "alpha"], F.round("score", 9).desc(), F.col("doc_id").asc(), k=limit).withColumn("parts", parts)
    return out.select("qid", *(["alpha"] if several else []), "doc_id", "score", "rank", "parts")
