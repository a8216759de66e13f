"""What operators share: spreading small inputs, ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselar.session import checkpointed


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df over all cores, by the columns `by` if any are given, if its plan is estimated at too few bytes to fill them.

    It is the optimiser's estimate that decides: no job runs for it, and a large table is left as it is.
    """
    spark = df.sparkSession
    parts = 2 * spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(parts, *by) if size < parts * split else df


#: Bytes of a table that a join is told to broadcast.
SMALL_BYTES = 8 << 20


def small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """df, checkpointed and marked for broadcast if its rows, counted, fit: row_bytes is what one takes at most.

    Where a table is cut down to a bounded number of rows for each query, the optimiser still estimates it by what it
    was cut from, and would move the other side of a join.
    """
    held = checkpointed(df)
    return F.broadcast(held) if held.count() * row_bytes <= SMALL_BYTES else held


def ranked(df: DataFrame, by: list[str], *order: Column, k: int | None = None, name: str = "rank") -> DataFrame:
    """df with each row's place, from 1, among the rows of its group; the first k of each.

    With a k the sort is cut off in each partition before the shuffle (WindowGroupLimit).
    """
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.where(F.col(name) <= k)


def top(scores: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score, rank): the k best of each query; equal scores (to 9 places) by identifier."""
    return ranked(scores, ["qid"], F.round("score", 9).desc(), F.col("doc_id").asc(), k=max(0, k))
