"""Line deduplication within one edit by a deletion-neighbourhood join.

All lines but blank ones (nothing or only white space) are compared over the whole corpus: for equality whatever their
length, and within an edit from `NEAR_CHARS` characters on. In shorter lines one edit makes another word ("Die.", "Que."
and "Qui."), so equality is all that tells them to be the same. Two lines are within `BOUND` edits only if
a deletion variant of one (up to `BOUND` characters taken out, or none) equals one of the other. All variants are
emitted as hashed keys, equal keys are joined, and the edit distance of what they join is verified. A line goes if an
earlier line, by (doc_id, line number), is within the bound, and it names the earliest such line: an equal one, or one
at distance `BOUND` or less, whether or not that line itself goes.

A line of n characters has n + 1 variants, so equal lines are one first, and for a bound of 1 two exact filters come
before: one edit lies within one of q segments, so two lines within it also agree when the right segment is taken out
of both (one character more of the longer line). Lines that share no such key at q = 2 and then at q = `FINE` have no
partner and emit no variants. The filters drop no pair within the bound; a bound of 2 or more goes without them.

Cases: a null or empty text has no lines; lines are cut at line feeds and read whole, whatever their length; blank
lines stay; ties can't occur but among rows that repeat an identifier, which keep and lose lines alike; a
null identifier orders last; an empty table gives an empty result; other columns of the input don't matter. Identifiers
are whole numbers; others raise ValueError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .links import shared_keys
from .shared import checkpointed, in_keys, keyed, numbered_ids, table

MIN_CHARS = 1
NEAR_CHARS = 12
BOUND = 1
FINE = 16


def _gaps(line: str, begin: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Hashes of the line with the characters begin[i]:end[i] taken out, each with its salt."""
    points = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    n = len(points)
    power, inverse = kernel.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    return kernel.mix(total[begin] + (total[n] - total[end]) * inverse[end - begin] + kernel.mix(salt.astype(np.uint64)))


def segment_keys(line: str, q: int) -> np.ndarray:
    """Keys of the line with one of q segments taken out, as the shorter or equal line of a pair and as the longer."""
    n, out = len(line), []
    for m, more in ((n, 0), (n - 1, 1)):
        cut = m * np.arange(q + 1) // q
        out.append(_gaps(line, cut[:-1], cut[1:] + more, m * q + np.arange(q)))
    return np.unique(np.concatenate(out))


def variants(line: str, bound: int = BOUND) -> np.ndarray:
    """Hashes of all strings that come from the line by taking out at most `bound` characters."""
    n = len(line)
    at = np.arange(n)
    zero = np.zeros(1, np.int64)
    out = [_gaps(line, zero, zero, np.array([n]))]
    if bound >= 1:
        out.append(_gaps(line, at, at + 1, np.full(n, n - 1)))
    if bound >= 2:
        for k in range(n):
            out.append(variants(line[:k] + line[k + 1 :], bound - 1))
    return np.unique(np.concatenate(out))


def lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_no, line) of all lines that are compared; line numbers count from 0."""
    cut = numbered_ids(docs).where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return cut.where((F.length("line") >= min_chars) & F.col("line").rlike(r"\S"))


def _place() -> Column:
    """The order of occurrences."""
    return F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").cast("long").alias("doc_id"), F.col("line_no").cast("int").alias("line_no"))


def _keyed(rows: DataFrame, make) -> DataFrame:
    """(key, doc_id) of the keys that `make` gives for each line of rows (doc_id, line); doc_id stands for the line."""

    def run(batches):
        for batch in batches:
            # By bytes: a line has about as many variants as characters.
            for part in kernel.slices(iter([batch]), "line", 1 << 16):
                keys = [make(t) for t in part.column(1).to_pylist()]
                n = [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), part.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))], ["key", "doc_id"])

    return rows.select("doc_id", "line").mapInArrow(run, "key long, doc_id long")


def near_pairs(distinct: DataFrame, bound: int = BOUND) -> DataFrame:
    """(h, other, distance) both ways, for all pairs of the distinct lines (h, line) at distance 1 to bound."""
    rows = distinct.select(F.col("h").alias("doc_id"), "line")
    if bound == 1:
        fine = checkpointed(shared_keys(_keyed(rows, lambda t: segment_keys(t, FINE))).select("doc_id").distinct())
        rows = in_keys(rows, F.col("doc_id"), fine)
    same = checkpointed(shared_keys(_keyed(rows, lambda t: variants(t, bound))))
    pairs = same.join(same.select("key", F.col("doc_id").alias("other")), "key").where("doc_id < other").select("doc_id", "other").distinct()
    # One hash may stand for several lines: all of them are verified.
    text = distinct.select("h", "line")
    a = pairs.join(text.select(F.col("h").alias("doc_id"), F.col("line").alias("line_a")), "doc_id")
    both = a.join(text.select(F.col("h").alias("other"), F.col("line").alias("line_b")), "other")
    found = both.withColumn("distance", F.levenshtein("line_a", "line_b", bound)).where("distance > 0")
    one = found.select(F.col("doc_id").alias("h"), "other", "line_a", "line_b", "distance")
    return one.union(found.select(F.col("other").alias("h"), F.col("doc_id").alias("other"), F.col("line_b"), F.col("line_a"), "distance"))


def find(docs: DataFrame, *, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS, bound: int = BOUND) -> DataFrame:
    """(doc_id, line_no, keep_doc_id, keep_line_no, distance) of every line that goes.

    Lines of min_chars or more go if they equal an earlier one, lines of near_chars or more also if they're within the bound.
    """
    all_lines = lines(docs, min_chars)
    h, g, n = F.xxhash64("line"), F.xxhash64(F.lit("second"), F.col("line")), F.length("line")
    info = [h.alias("h"), g.alias("g"), _place().alias("place")]
    if bound == 1:
        half, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
        info.append(
            F.when(
                n >= near_chars,
                F.array(
                    F.xxhash64(F.lit(0), n, F.substring(F.col("line"), F.lit(1), half)),
                    F.xxhash64(F.lit(1), n, F.substring(F.col("line"), half + 1, n)),
                    F.xxhash64(F.lit(0), n - 1, F.substring(F.col("line"), F.lit(1), less)),
                    F.xxhash64(F.lit(1), n - 1, F.substring(F.col("line"), less + 2, n)),
                ),
            ).alias("halves")
        )
    rows = all_lines.select(*info)
    by_line = checkpointed(rows.groupBy("h", "g").agg(F.min("place").alias("first"), F.count("*").alias("n"), *([F.first("halves").alias("halves")] if bound == 1 else [])))
    texts = all_lines.where(n >= near_chars).select(h.alias("h"), g.alias("g"), "line")
    if bound == 1:
        coarse = checkpointed(shared_keys(by_line.select(F.explode("halves").alias("key"), F.col("h").alias("doc_id"))).select("doc_id").distinct())
        texts = in_keys(texts, F.col("h"), coarse)
    distinct = checkpointed(texts.groupBy("h", "g").agg(F.first("line").alias("line")))
    pairs = near_pairs(distinct, bound)
    firsts = by_line.select("h", "g", "first")
    # The line behind a hash is told by its second hash.
    named = pairs.select("h", F.xxhash64(F.lit("second"), F.col("line_a")).alias("g"), F.col("other").alias("oh"), F.xxhash64(F.lit("second"), F.col("line_b")).alias("og"), "distance")
    near = named.join(firsts.select(F.col("h").alias("oh"), F.col("g").alias("og"), "first"), ["oh", "og"]).groupBy("h", "g").agg(F.min(F.struct("first", "distance")).alias("near"))
    judged = checkpointed(
        by_line.select("h", "g", "first", "n")
        .join(near, ["h", "g"], "left")
        .where("n > 1 OR near IS NOT NULL")
        .select("h", "g", "n", F.when(F.col("near.first") < F.col("first"), F.col("near")).otherwise(F.struct("first", F.lit(0).alias("distance"))).alias("keep"))
    )
    may = in_keys(all_lines.select(h.alias("h"), g.alias("g"), _place().alias("place")), F.col("h"), judged.select("h").distinct())
    # A line that a third of all documents have stays where it is: its verdict goes to it.
    return (
        keyed(may, judged, ["h", "g"])
        .where("place <> keep.first")
        .select("place.doc_id", "place.line_no", F.col("keep.first.doc_id").alias("keep_doc_id"), F.col("keep.first.line_no").alias("keep_line_no"), F.col("keep.distance").alias("distance"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the documents that repeat an earlier line, but for one edit at most."""
    return find(table(spark, sf_dir, "documents"))


#: Two lines are within an edit if taking out one character at the same place makes them equal, or if one is a variant of the other.
ORACLE_SQL = f"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
every AS (SELECT * FROM l WHERE regexp_matches(line, '\\S')),
d AS (SELECT line, min({{'d': doc_id, 'n': line_no}}) AS first FROM every GROUP BY line),
cut AS (SELECT line, first, i, substr(line, 1, i - 1) || substr(line, i + 1) AS v FROM (SELECT line, first, unnest(range(1, length(line) + 1)) AS i FROM d WHERE length(line) >= {NEAR_CHARS})),
lower_ AS (SELECT v, i, min(first) AS first FROM cut GROUP BY ALL),
near AS (
  SELECT c.line, o.first FROM cut c JOIN lower_ o ON o.v = c.v AND o.i = c.i
  UNION ALL SELECT c.line, o.first FROM cut c JOIN d o ON o.line = c.v AND length(o.line) >= {NEAR_CHARS}
  UNION ALL SELECT o.line, c.first FROM cut c JOIN d o ON o.line = c.v AND length(o.line) >= {NEAR_CHARS}),
best AS (SELECT line, min(first) AS first FROM near GROUP BY line),
keep AS (SELECT d.line, CASE WHEN best.first < d.first THEN best.first ELSE d.first END AS first, best.first IS NOT NULL AND best.first < d.first AS other FROM d LEFT JOIN best USING (line))
SELECT doc_id, line_no, first.d AS keep_doc_id, first.n AS keep_line_no, other::INT AS distance FROM every JOIN keep USING (line) WHERE doc_id <> first.d OR line_no <> first.n
"""
