"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's token budget is its share of the total under the target weights, by default proportional to its tokens to
the power `tempering`. Whole epochs come first: every document of a source that fits n times into its budget is taken
n times. What is left is filled by weighted sampling without replacement: document i has the exponential key
-ln(u_i) / w_i, where u_i comes from a digest of its identifier and w_i is its quality weight, and the documents of the
source are taken in ascending order of their keys while the running sum of their tokens stays within the rest.

The running sum has no single-task sort of a source: keys are first counted in `BINS` monotone bins per source, and
only the bin in which the rest runs out is sorted. What a source keeps is then everything up to one cutoff, so that
applying the sample to wide rows is a map, not a join on documents: the plan, one row for each source, is counted and
goes to the rows while it fits `shared.MAX_BROADCAST_BYTES` (about 150,000 sources with names of ten letters). A table of
more sources than that is joined by source; none of its sources can be hot unless its rows are.

Tokens are runs of anything but space, tab and line ends. A weight is 1 / (1 + 4 * symbols / tokens), with the symbols
#$%&*|!<>{}=~^; a column of weights may be given instead, where a null or a weight not above 0 counts as 1e-6.

Cases: a null source is a source of its own; a null or empty text has no tokens and weight 1, and stays if its turn
comes before the budget runs out; texts are read whole; a null identifier is sampled as the identifier ''; rows that
repeat an identifier in a source share key and order, and stay or go by their tokens; keys that tie go by identifier,
then tokens; a source without tokens is kept once; a remainder of 0 takes nothing; an empty table gives an empty result;
other columns are kept, whatever their names. Identifiers may be of any type. Target weights that name no source of the
table, or none above 0, raise ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import MAX_BROADCAST_BYTES, checkpointed, table, whole

TEMPERING = 0.7
SEED = 11
BINS = 4096
_SYMBOLS = "#$%&*|!<>{}=~^"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def quality_weight(text: Column, n: Column) -> Column:
    symbols = F.coalesce(F.length(text) - F.length(F.translate(text, _SYMBOLS, "")), F.lit(0))
    return 1 / (1 + 4 * symbols / F.greatest(n, F.lit(1)))


def sampling_key(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    """-ln(u) / w with u in (0, 1) from the first 52 bits of a digest of seed and identifier."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) * F.lit(2.0**-52)
    w = F.coalesce(F.when(weight > 0, weight), F.lit(1e-6))
    return -F.log(u) / w


def prepared(docs: DataFrame, *, weight: str | None = None, seed: int = SEED) -> DataFrame:
    """(source, doc_id, n_tokens, key) of each row of docs, in columns named mix_*."""
    n = tokens(F.col("text"))
    w = F.col(f"`{weight}`") if weight else quality_weight(F.col("text"), n)
    rows = docs.select("source", "doc_id", n.alias("mix_tokens"), w.alias("weight"))
    return rows.select("source", "doc_id", "mix_tokens", sampling_key(F.col("doc_id"), F.col("weight"), seed).alias("mix_key"))


def by_source(df: DataFrame, left: str, plan: DataFrame, how: str = "inner", *, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """df with the row of plan, a frame by mix_source, that has the same source; null is a source.

    The plan's size, its names included, is measured; it is broadcast if it fits max_bytes.
    """
    size = plan.select(F.sum(F.coalesce(F.octet_length("mix_source"), F.lit(0)) + 96)).first()[0] or 0
    named = plan.withColumnRenamed("mix_source", "other_source")
    named = F.broadcast(named) if size <= max_bytes else named
    return df.join(named, F.col(left).eqNullSafe(F.col("other_source")), how).drop("other_source")


def plan(rows: DataFrame, *, targets: dict[str, float] | None = None, budget: int | None = None, tempering: float = TEMPERING) -> DataFrame:
    """(mix_source, epochs, cut_bin, cut_key, cut_id, cut_tokens) for each source of prepared rows.

    A row is in the fractional part if (key, identifier, tokens) is at most the cutoff; a null cut_key takes nothing.
    """
    bin_ = F.floor(BINS * F.col("mix_key") / (1 + F.col("mix_key")))
    binned = rows.groupBy(F.col("source").alias("mix_source"), bin_.alias("bin")).agg(F.sum("mix_tokens").alias("in_bin"))
    totals = binned.groupBy("mix_source").agg(F.sum("in_bin").alias("total"))
    if targets is not None:
        if not any(v > 0 for v in targets.values()):
            raise ValueError("no target weight is above 0")
        pairs = [x for k, v in targets.items() for x in (F.lit(k), F.lit(float(max(v, 0))))]
        share = F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(F.col("mix_source"), F.lit("\0"))), F.lit(0.0))
        if totals.where(share > 0).isEmpty() and not totals.isEmpty():
            raise ValueError("the target weights name no source of the table")
    else:
        share = F.pow(F.col("total").cast("double"), F.lit(tempering))
    every = totals.withColumn("share", share)
    sums = every.agg(F.sum("share").alias("shares"), F.sum("total").alias("all"))
    wanted = F.lit(float(budget)) if budget is not None else F.col("all").cast("double")
    quota = F.floor(wanted * F.col("share") / F.col("shares"))
    budgets = checkpointed(
        every.crossJoin(F.broadcast(sums)).select(
            "mix_source",
            F.when(F.col("total") > 0, F.floor(quota / F.col("total"))).otherwise(F.lit(1)).cast("long").alias("epochs"),
            F.when((F.col("total") > 0) & (quota % F.col("total") > 0), quota % F.col("total")).otherwise(F.lit(-1)).cast("long").alias("rest"),
        )
    )

    order = Window.partitionBy("mix_source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = binned.withColumn("before", F.coalesce(F.sum("in_bin").over(order), F.lit(0)))
    # The bin in which the rest runs out: the last that begins within it.
    edge = by_source(before, "mix_source", budgets).where("before <= rest").groupBy("mix_source").agg(F.max_by(F.struct("bin", "before", "rest"), "bin").alias("e"))
    edge = checkpointed(edge.select("mix_source", F.col("e.bin").alias("edge_bin"), "e.before", "e.rest"))
    cuts = by_source(rows, "source", edge).where(bin_ == F.col("edge_bin"))
    inside = Window.partitionBy("source").orderBy("mix_key", "doc_id", "mix_tokens").rowsBetween(Window.unboundedPreceding, 0)
    fits = cuts.withColumn("sum", F.col("before") + F.sum("mix_tokens").over(inside)).where("sum <= rest")
    last = fits.groupBy(F.col("source").alias("mix_source")).agg(F.max(F.struct("mix_key", "doc_id", "mix_tokens")).alias("c"))
    # If not even the first row of that bin fits, c is null: all earlier bins are taken and nothing of this one.
    ends = by_source(by_source(budgets, "mix_source", edge.select("mix_source", "edge_bin"), "left"), "mix_source", checkpointed(last), "left")
    return ends.select("mix_source", "epochs", F.col("edge_bin").alias("cut_bin"), F.col("c.mix_key").alias("cut_key"), F.col("c.doc_id").alias("cut_id"), F.col("c.mix_tokens").alias("cut_tokens"))


def copies(key: Column, doc_id: Column, n: Column) -> Column:
    """How many times a row joined to its source's plan is taken."""
    b = F.floor(BINS * key / (1 + key))
    in_bin = F.coalesce(F.struct(key.alias("mix_key"), doc_id.alias("doc_id"), n.alias("mix_tokens")) <= F.struct(F.col("cut_key").alias("mix_key"), F.col("cut_id").alias("doc_id"), F.col("cut_tokens").alias("mix_tokens")), F.lit(False))
    some = (b < F.col("cut_bin")) | ((b == F.col("cut_bin")) & F.col("cut_key").isNotNull() & in_bin)
    return (F.col("epochs") + F.when(F.coalesce(some, F.lit(False)), 1).otherwise(0)).cast("long")


def sample(docs: DataFrame, *, weight: str | None = None, seed: int = SEED, **how) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the rows that are taken at least once."""
    rows = checkpointed(prepared(docs, weight=weight, seed=seed))
    return (
        by_source(rows, "source", checkpointed(plan(rows, **how)))
        .select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), copies(F.col("mix_key"), F.col("doc_id"), F.col("mix_tokens")).alias("copies"))
        .where("copies > 0")
    )


def mix(docs: DataFrame, *, weight: str | None = None, seed: int = SEED, **how) -> DataFrame:
    """The rows of docs, whole, each as many times as it is taken."""
    p = checkpointed(plan(checkpointed(prepared(docs, weight=weight, seed=seed)), **how))
    n = tokens(F.col("text"))
    rows = whole(docs, source=F.col("source"), doc_id=F.col("doc_id"), n_tokens=n, weight=F.col(f"`{weight}`") if weight else quality_weight(F.col("text"), n))
    keyed = rows.withColumn("key", sampling_key(F.col("doc_id"), F.col("weight"), seed))
    taken = by_source(keyed, "source", p).withColumn("copies", copies(F.col("key"), F.col("doc_id"), F.col("n_tokens"))).where("copies > 0")
    return taken.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are taken, and how many times, at tempered weights and a budget of all tokens."""
    return sample(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as mixed; a document of a source that is taken in several epochs repeats."""
    return mix(docs)


def sql(source: str) -> str:
    """DuckDB SQL for (row of source, mix_copies), as a chain of CTEs that ends in `mixed`; source is a relation's name."""
    return f"""
mix_a AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS mix_tokens FROM {source}),
mix_b AS (SELECT *, -ln((('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) * pow(2.0, -52))
  / (1 / (1 + 4 * coalesce(length(text) - length(translate(text, '{_SYMBOLS}', '')), 0)::DOUBLE / greatest(mix_tokens, 1))) AS mix_key FROM mix_a),
mix_t AS (SELECT source, sum(mix_tokens) AS total FROM mix_b GROUP BY source),
mix_q AS (SELECT source, total, floor((SELECT sum(total) FROM mix_t) * pow(total::DOUBLE, {TEMPERING}) / (SELECT sum(pow(total::DOUBLE, {TEMPERING})) FROM mix_t)) AS quota FROM mix_t),
mix_r AS (SELECT b.*, CASE WHEN total > 0 THEN floor(quota / total) ELSE 1 END AS epochs, CASE WHEN total > 0 THEN quota::BIGINT % total ELSE -1 END AS rest,
  sum(mix_tokens) OVER (PARTITION BY b.source ORDER BY mix_key, doc_id, mix_tokens ROWS UNBOUNDED PRECEDING) AS running
  FROM mix_b b JOIN mix_q q ON b.source IS NOT DISTINCT FROM q.source),
mixed AS (SELECT * EXCLUDE (epochs, rest, running), (epochs + CASE WHEN running <= rest AND rest > 0 THEN 1 ELSE 0 END)::BIGINT AS mix_copies FROM mix_r)"""


ORACLE_SQL = f"WITH {sql('documents')} SELECT doc_id, source, mix_tokens::BIGINT AS n_tokens, mix_copies AS copies FROM mixed WHERE mix_copies > 0"
