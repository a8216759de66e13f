"""What the operators of this subpackage have in common: size-checked filters and joins, and components."""

from __future__ import annotations

import gc
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from tesselar.session import checkpointed, remove, shared_folder  # noqa: F401

#: Keys that a filter may broadcast, in bytes of 8-byte digests. Beyond it the filter is a shuffled semi join.
MAX_BROADCAST_BYTES = 16 << 20
#: Rows of tables that a join may broadcast, in bytes: the driver builds a hash table of them, which takes several times that.
MAX_JOIN_BYTES = 4 << 20
#: A group of more rows than this is hot: its rows aren't sent to one task.
HOT_ROWS = 1 << 17


def numbered_ids(docs: DataFrame, column: str = "doc_id") -> DataFrame:
    """docs, if its identifiers are whole numbers; operators that order or number documents by them take no others."""
    kind = docs.schema[column].dataType
    if not isinstance(kind, (ty.IntegralType, ty.NullType)):
        raise ValueError(f"{column} must be a whole number, not {kind.simpleString()}: map other identifiers to 64-bit numbers first")
    return docs


def sized(df: DataFrame, row_bytes: int, *, max_bytes: int = MAX_JOIN_BYTES) -> DataFrame:
    """df, marked for broadcast if its rows are counted and fit: row_bytes is what one takes at most."""
    return F.broadcast(df) if df.count() * row_bytes <= max_bytes else df


def keyed(rows: DataFrame, groups: DataFrame, on: list[str], *, size: str = "n", row_bytes: int = 96, max_bytes: int = MAX_JOIN_BYTES, hot: int = HOT_ROWS, few: bool = True) -> DataFrame:
    """rows joined to groups, which has one row for each key `on` and in `size` how many of rows have it.

    Groups that fit max_bytes are broadcast, unless `few` says that they'll be many in earnest. Beyond it only those with
    more than `hot` rows are, of which there are few (all rows / hot at most, counted too), and the others are shuffled:
    no task gets a key with more rows than that.
    """
    if few and groups.count() * row_bytes <= max_bytes:
        return rows.join(F.broadcast(groups), on)
    large = groups.where(F.col(size) > hot)
    if large.isEmpty():
        return rows.join(groups, on)
    large = sized(large, row_bytes, max_bytes=max_bytes)
    cold = rows.join(large.select(*on), on, "left_anti")
    return rows.join(large, on).unionByName(cold.join(groups.where(F.col(size) <= hot), on))


def _by_keys(df: DataFrame, key: Column, keys: DataFrame, inside: bool, max_bytes: int) -> DataFrame:
    n = keys.count()
    if n * 8 > max_bytes:
        name = "__tsl_key"
        return (
            df.withColumn(name, key)
            .join(keys.toDF(name), name, "left_semi" if inside else "left_anti")
            .select(*[F.col(f"`{c}`") for c in df.columns])
        )
    held = df.sparkSession.sparkContext.broadcast(np.sort(keys.toArrow().column(0).to_numpy().astype(np.int64, copy=False)))

    @F.arrow_udf("boolean")
    def member(h: pa.Array) -> pa.Array:
        known, null = held.value, h.is_null().to_numpy(zero_copy_only=False)
        x = h.fill_null(0).to_numpy(zero_copy_only=False)
        if not len(known):
            return pa.array(np.full(len(x), not inside))
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        return pa.array(((known[at] == x) & ~null) == inside)

    return df.where(member(key))


def in_keys(df: DataFrame, key: Column, keys: DataFrame, *, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Rows of df whose 64-bit key is among keys (one LONG column without duplicates or nulls); a null key is not.

    The keys are counted first. While they fit max_bytes they go to the executors as one sorted array, and only
    key itself is sent to Python, never the rest of the row; beyond that the same rows come from a semi join, of which
    adaptive execution splits what is skewed.
    """
    return _by_keys(df, key, keys, True, max_bytes)


def without_keys(df: DataFrame, key: Column, keys: DataFrame, *, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The other rows of df, those with a null key among them."""
    return _by_keys(df, key, keys, False, max_bytes)


def whole(df: DataFrame, **columns: Column) -> DataFrame:
    """df with each row packed into the one column `whole`, beside further columns that no name of df can clash with.

    `.select("whole.*")` gives the rows back.
    """
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("whole"), *[c.alias(n) for n, c in columns.items()])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node of its connected component.

    Each round takes the smallest label of the neighbours and then the label of that label (pointer jumping), so
    the number of rounds grows with the logarithm of a component's diameter. Nothing is gathered on the driver.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")))
    while True:
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy("a")
            .agg(F.min("label").alias("seen"))
        )
        lower = labels.join(near, labels.node == near.a).select(
            "node", F.col("label").alias("old"), F.least("label", "seen").alias("label")
        )
        up = lower.select(F.col("node").alias("at"), F.col("label").alias("up"))
        new = checkpointed(
            lower.join(up, lower.label == up.at, "left").select(
                "node", "old", F.least("label", F.coalesce("up", "label")).alias("label")
            ),
            loop=True,
        )
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels


def release(spark: SparkSession) -> None:
    """Have shuffle files and checkpoints deleted that only tables no longer in use have: Spark does so when its driver collects garbage."""
    gc.collect()
    # What Python no longer has is given up by a thread of Py4J's.
    time.sleep(0.3)
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name in sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
