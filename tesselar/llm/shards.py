"""Sharding by balanced label propagation.

Documents are linked by the lines they share: a line (any but a blank one) of n documents links each two
of them with a weight of 1 / (n - 1), so that very common lines tell little. Links are never laid out as pairs: a line
counts its documents by shard, and a document weighs the shards by the counts of its lines, less itself. This is the
exact vote of all its neighbours, whatever n. Lines are counted before they are moved, and a hot line's documents stay
where they are: its counts go to them.

Linked documents begin in a shard drawn from their rarest line. In every round each one finds the shard with the most
weight; of those that would gain, a half drawn by digest may move. A shard takes newcomers, highest gains first (in
`LEVELS` levels, by digest within a level), while others leave it for where they come from, and beyond that while it has
room below its quota, so no quota is ever exceeded. Who is within a quota follows from counts in bins of that order; only
the bin in which the quota ends is sorted. Rounds end after `ROUNDS`, or when no more than `STILL` of the linked documents
move. Documents without links fill what is left, by exact ranks of their digests: shards end with sizes that differ by
one at most, unless rounding left a shard one above.

Cases: rows that repeat an identifier are one document with the lines of all its texts, and share its shard; a null or
empty text has no lines, hence no links; texts and lines are read whole; a row without identifier gets the shard of its
text's digest, outside the quotas; ties go to the document's own shard, then to the smaller shard, then by digest and
identifier; with fewer documents than shards some stay empty; an empty table gives an empty result; other columns of the
input don't matter. Identifiers are whole numbers; others raise ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import checkpointed, keyed, numbered_ids, sized, table

SHARDS = 16
ROUNDS = 8
STILL = 0.002
MIN_CHARS = 1
LEVELS = 64
_BINS = 4096


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(line, doc_id, n): the lines, by hash, that more than one document has, with how many have them."""
    cut = F.filter(F.split("text", "\n", -1), lambda x: (F.length(x) >= min_chars) & x.rlike(r"\S"))
    some = numbered_ids(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    each = checkpointed(some.select(F.explode(F.array_distinct(F.transform(cut, lambda x: F.xxhash64(x)))).alias("line"), "doc_id"))
    if not some.groupBy("doc_id").count().where("count > 1").isEmpty():
        each = each.distinct()
    counts = checkpointed(each.groupBy("line").agg(F.count("*").alias("n")).where("n > 1"))
    return keyed(each, counts, ["line"]).select("line", "doc_id", "n")


def _within(rows: DataFrame, by: list[str], quota: DataFrame) -> DataFrame:
    """The rows of each group `by` that come first by (bin, digest, doc_id), as many as quota (by, most) says.

    Rows are counted by bin; what lies in bins before the one in which the quota ends is in without a sort.
    """
    counts = rows.groupBy(*by, "bin").agg(F.count("*").alias("here"))
    order = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    # Groups times bins, whatever the corpus.
    before = counts.withColumn("before", F.coalesce(F.sum("here").over(order), F.lit(0)))
    edges = checkpointed(before.join(F.broadcast(quota), by).where("before < most"))
    placed = rows.join(sized(edges, 64), [*by, "bin"])
    nth = F.row_number().over(Window.partitionBy(*by, "bin").orderBy("digest", "doc_id"))
    last = placed.where("before + here > most").withColumn("nth", nth).where("before + nth <= most").drop("nth")
    return placed.where("before + here <= most").unionByName(last).select(*rows.columns)


def _bin(high: Column, digest: Column) -> Column:
    """high, a number below 64, and then eight bits of the digest, which rows with an equal high are sorted by."""
    return (high * 256 + F.shiftrightunsigned(digest, 55)).cast("long")


def _ranks(ids: DataFrame, seed: int) -> DataFrame:
    """(doc_id, rank): each identifier's exact place, from 0, in the order of digests, without a sort in one task."""
    h = ids.select("doc_id", F.xxhash64(F.lit(seed), F.col("doc_id")).alias("h"))
    h = checkpointed(h.withColumn("bin", F.pmod(F.shiftrightunsigned(F.col("h"), 48), F.lit(_BINS)).cast("int")))
    # At most _BINS rows, whatever the corpus.
    counts = h.groupBy("bin").agg(F.count("*").alias("n"))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("bin").orderBy("h", "doc_id")) - 1
    return h.join(F.broadcast(offsets), "bin").select("doc_id", (F.col("offset") + inside).alias("rank"))


def _fill(ids: DataFrame, room: list[int], seed: int) -> DataFrame:
    """(doc_id, shard) of identifiers that take the room of the shards one after another, in the order of digests."""
    bounds, at = [], 0
    for r in room[:-1]:
        at += r
        bounds.append(at)
    shard = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col("rank"))) if bounds else F.lit(0)
    return _ranks(ids, seed).select("doc_id", shard.cast("int").alias("shard"))


def _sizes(labels: DataFrame, shards: int) -> list[int]:
    got = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return [got.get(s, 0) for s in range(shards)]


def targets(n: int, held: list[int]) -> list[int]:
    """Final sizes of the shards: as even as can be when each keeps what it holds."""
    shards = len(held)
    out = [n // shards] * shards
    for s in sorted(range(shards), key=lambda s: (-held[s], s))[: n % shards]:
        out[s] += 1
    out = [max(a, b) for a, b in zip(out, held)]
    over = sum(out) - n
    while over > 0:
        s = max(range(shards), key=lambda s: (out[s] - held[s] > 0, out[s], -s))
        out[s] -= 1
        over -= 1
    return out


def quotas(flows: dict[tuple[int, int], int], sizes: list[int], cap: int) -> dict[tuple[int, int], int]:
    """How many may move from a to b: as many as come back, and more, largest flows first, while b has room."""
    out = {}
    sizes = list(sizes)
    for (a, b), n in flows.items():
        out[a, b] = min(n, flows.get((b, a), 0))
    for (a, b), n in sorted(flows.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - out[a, b], max(0, cap - sizes[b]))
        out[a, b] += more
        sizes[a] -= more
        sizes[b] += more
    return out


def propose(links: DataFrame, labels: DataFrame, turn: Column, shards: int) -> DataFrame:
    """(doc_id, shard, best, gain) of the documents that would gain by moving and whose turn it is."""
    placed = links.select("line", "doc_id").join(labels, "doc_id")
    counted = [F.count(F.when(F.col("shard") == k, 1)).alias(f"c{k}") for k in range(shards)]
    by_line = checkpointed(placed.groupBy("line").agg(F.count("*").alias("n"), *counted).where("n > 1"))
    each = keyed(placed, by_line, ["line"], row_bytes=48 + 8 * shards)
    vote = lambda k: (F.col(f"c{k}") - F.when(F.col("shard") == k, 1).otherwise(0)) / (F.col("n") - 1)
    votes = each.groupBy("doc_id", "shard").agg(*[F.round(F.sum(vote(k)), 9).alias(f"w{k}") for k in range(shards)])
    best = F.array_max(F.array(*[F.struct(F.col(f"w{k}").alias("w"), (F.col("shard") == k).alias("own"), F.lit(-k).alias("minus")) for k in range(shards)]))
    now = F.element_at(F.array(*[F.col(f"w{k}") for k in range(shards)]), F.col("shard") + 1)
    moves = votes.select("doc_id", "shard", best.alias("m"), now.alias("now")).select("doc_id", "shard", (-F.col("m.minus")).cast("int").alias("best"), (F.col("m.w") - F.col("now")).alias("gain"))
    return moves.where((F.col("best") != F.col("shard")) & (F.col("gain") > 0) & turn)


def level(gain: Column) -> Column:
    """The level of a gain, 0 for the highest."""
    return (LEVELS - 1 - F.floor(LEVELS * gain / (1 + gain))).cast("int")


def assign(docs: DataFrame, *, shards: int = SHARDS, rounds: int = ROUNDS, still: float = STILL, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, shard) of every document: each identifier once, and each row without identifier."""
    spark = docs.sparkSession
    ids = checkpointed(numbered_ids(docs).where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
    n = ids.count()
    cap = -(-n // shards)
    links = checkpointed(shared_lines(docs, min_chars))
    digest = F.xxhash64("doc_id")
    first = links.groupBy("doc_id").agg(F.min(F.struct("n", "line")).alias("rarest")).select("doc_id", F.xxhash64("rarest.line").alias("h"))
    first = first.select("doc_id", F.pmod("h", F.lit(shards)).cast("int").alias("shard"), digest.alias("digest"), _bin(F.shiftrightunsigned("h", 58), digest).alias("bin"))
    first = checkpointed(first)
    quota = spark.createDataFrame([(s, cap) for s in range(shards)], "shard int, most long")
    labels = checkpointed(_within(first, ["shard"], quota).select("doc_id", "shard"))
    sizes = _sizes(labels, shards)
    over = first.join(labels.select("doc_id"), "doc_id", "left_anti").select("doc_id")
    if sum(sizes) < first.count():
        labels = checkpointed(labels.union(_fill(over, [cap - s for s in sizes], 1)))
        sizes = _sizes(labels, shards)
    linked = sum(sizes)
    for k in range(rounds if linked else 0):
        turn = F.pmod(F.xxhash64(F.lit(k), F.col("doc_id")), F.lit(2)) == 0
        moves = propose(links, labels, turn, shards).select("doc_id", "shard", "best", digest.alias("digest"), _bin(level(F.col("gain")), digest).alias("bin"))
        moves = checkpointed(moves)
        flows = {(r["shard"], r["best"]): r["n"] for r in moves.groupBy("shard", "best").agg(F.count("*").alias("n")).collect()}
        allowed = quotas(flows, sizes, cap)
        moved = sum(allowed.values())
        if not moved:
            break
        # shards * shards numbers, whatever the corpus.
        limit = spark.createDataFrame([(a, b, q) for (a, b), q in sorted(allowed.items()) if q], "shard int, best int, most long")
        taken = _within(moves, ["shard", "best"], limit).select("doc_id", "best")
        labels = checkpointed(labels.join(taken, "doc_id", "left").select("doc_id", F.coalesce("best", "shard").alias("shard")), loop=True)
        for (a, b), q in allowed.items():
            sizes[a] -= q
            sizes[b] += q
        if moved <= still * linked:
            break
    room = [t - s for t, s in zip(targets(n, sizes), sizes)]
    loose = _fill(ids.join(labels, "doc_id", "left_anti"), room, 2)
    nameless = docs.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int").alias("shard"))
    return labels.union(loose).union(nameless)


def cut(docs: DataFrame, labels: DataFrame, *, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row (weight, cut_weight): the weight of all links, and of those between different shards."""
    placed = shared_lines(docs, min_chars).join(labels, "doc_id")
    by_line = placed.groupBy("line", "n", "shard").agg(F.count("*").alias("c")).groupBy("line", "n").agg(F.sum(F.col("c") * F.col("c")).alias("squares"))
    return by_line.agg(F.sum(F.col("n") / 2).alias("weight"), F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2 / (F.col("n") - 1)).alias("cut_weight"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return assign(table(spark, sf_dir, "documents"))
