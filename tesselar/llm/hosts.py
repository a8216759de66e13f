"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted by host, registered domain and public suffix. Each level's rate is
shrunk towards its parent's posterior mean through a beta prior whose strength is fitted to the data: the overdispersion
rho of the beta-binomial is found by moments over all labelled children of the level, and the strength is 1 / rho - 1;
a level that can't tell (fewer than two such children, or none with two labels) has the weakest prior, 1. Posterior variances
go down the levels with the means. A page is
kept unless the upper bound of its host's posterior lies below the required share of good pages, so a host goes only
when its record is surely bad; hosts without any label have their domain's posterior.

Suffixes are the last label of a host and those of `SUFFIXES`, or the rules of a file in the format of the public suffix
list (`read_suffixes`: rules of any length, wildcards and exceptions). An address (IPv4, or IPv6 in brackets) is its own
domain and suffix.

Cases: a null URL, or one without a host, is kept and has nulls for all else; URLs are read whole; a null outcome counts
for nothing; a page with several outcomes has the smallest; an upper bound equal to the limit keeps; an empty table
gives an empty result; without any outcome there are no bounds and all is kept; repeated pages repeat in the result, and
each counts. Other columns of the input don't matter. Page numbers may be of any type that outcomes share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpointed, keyed, table

#: Public suffixes of two labels where no list is given; every other suffix is the last label then.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ne.jp", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "co.za", "com.ar", "com.sg", "com.hk", "com.tw")
MIN_GOOD = 0.8
Z = 1.645
_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)"
_ADDRESS = r"^(?:\[.*\]|\d{1,3}(?:\.\d{1,3}){3})$"
_NUMBER = r"/(\d{1,18})/?(?:[?#].*)?$"


def read_suffixes(path: str) -> tuple[str, ...]:
    """The rules of a file in the format of the public suffix list, internationalised ones in both spellings."""
    rules = []
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            rule = line.split("//", 1)[0].strip().lower()
            if rule:
                rules += [rule] if rule.isascii() else [rule, ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in rule.split("."))]
    return tuple(rules)


def host_of(url: Column) -> Column:
    """The host in lower case without a final dot, or null."""
    host = F.rtrim(F.regexp_extract(F.lower(F.trim(url)), _HOST, 1), F.lit("."))
    return F.when(host != "", host)


def _suffix_labels(host: Column, suffixes: tuple[str, ...]) -> Column:
    """How many labels of a host are its public suffix: the longest rule's, or one less than an exception's."""
    by: dict[tuple[str, int], list[str]] = {}
    for rule in suffixes:
        kind, bare = ("!", rule[1:]) if rule[0] == "!" else ("*", rule[2:]) if rule[:2] == "*." else ("", rule)
        by.setdefault((kind, bare.count(".") + 1), []).append(bare)
    found = F.lit(1)
    n = F.size(F.split(host, r"\."))
    for (kind, k), rules in by.items():
        fits = F.substring_index(host, ".", -k).isin(*rules)
        if kind != "!":
            found = F.greatest(found, F.when(fits & (n > k) if kind else fits, F.lit(k + (kind == "*"))).otherwise(F.lit(1)))
    for (kind, k), rules in by.items():
        if kind == "!":
            found = F.when(F.substring_index(host, ".", -k).isin(*rules), F.lit(k - 1)).otherwise(found)
    return found


def _last(host: Column, k: Column) -> Column:
    """The last k labels of a host, or all of them; an address is one label."""
    labels = F.split(host, r"\.")
    n = F.least(k, F.size(labels))
    return F.when(host.rlike(_ADDRESS), host).otherwise(F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    return _last(host, _suffix_labels(host, suffixes))


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The suffix and the label before it; the host itself if it has no more labels."""
    return _last(host, _suffix_labels(host, suffixes) + 1)


def _shrunk(level: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """level (.., n, k, parent's key `on`) with m and var, its posterior mean and variance, and s, its prior's strength.

    What the parent's mean is unsure of stays unsure in a child, the more so the fewer labels of its own it has.
    """
    x = level.join(parent.select(on, F.col("m").alias("pm"), F.col("var").alias("pvar")), on)
    v = F.col("pm") * (1 - F.col("pm"))
    over = x.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("pm"), 2)).alias("between"),
        F.sum(v).alias("expected"),
        F.sum(v * (F.col("n") - 1)).alias("room"),
        F.count("*").alias("children"),
    )
    able = (F.col("children") > 1) & (F.col("room") > 0)
    fitted = F.when(able, (F.col("between") - F.col("expected")) / F.when(able, F.col("room")))
    rho = F.least(F.greatest(F.coalesce(fitted, F.lit(0.5)), F.lit(0.001)), F.lit(0.5))
    strength = over.select((1 / rho - 1).alias("s"))
    total = F.col("s") + F.col("n")
    out = x.crossJoin(F.broadcast(strength)).withColumn("m", (F.col("s") * F.col("pm") + F.col("k")) / total)
    return out.withColumn("var", F.pow(F.col("s") / total, 2) * F.col("pvar") + F.col("m") * (1 - F.col("m")) / (total + 1)).drop("pm", "pvar")


def reputation(pages: DataFrame, outcomes: DataFrame, *, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, domain, suffix, pages, n, k, mean, upper) for every host of pages; outcomes is (page_id, good 0 or 1).

    mean and upper are null if there is no outcome at all.
    """
    o = outcomes.where(F.col("page_id").isNotNull() & F.col("good").isin(0, 1)).groupBy("page_id").agg(F.min("good").alias("good"))
    seen = pages.select("page_id", host_of(F.col("url")).alias("host")).where("host IS NOT NULL").join(o, "page_id", "left")
    hosts = seen.groupBy("host").agg(F.count("*").alias("pages"), F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("k"))
    # Every level is read several times below; each is written once.
    hosts = checkpointed(hosts.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes)))
    domains = checkpointed(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes_ = checkpointed(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("root", F.lit(1)))
    root = suffixes_.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where("n > 0").select(F.lit(1).alias("root"), "n", ((F.col("k") + 1) / (F.col("n") + 2)).alias("m"))
    root = root.withColumn("var", F.col("m") * (1 - F.col("m")) / (F.col("n") + 3))
    s = checkpointed(_shrunk(suffixes_, checkpointed(root), "root"))
    d = checkpointed(_shrunk(domains, s, "suffix"))
    h = _shrunk(hosts, d, "domain").select("host", F.col("m").alias("mean"), F.least(F.col("m") + z * F.sqrt("var"), F.lit(1.0)).alias("upper"))
    return hosts.join(h, "host", "left").select("host", "domain", "suffix", "pages", "n", "k", "mean", "upper")


def decide(pages: DataFrame, outcomes: DataFrame, *, min_good: float = MIN_GOOD, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(page_id, host, domain, suffix, labelled, good, posterior_mean, upper_bound, keep) for every page."""
    r = checkpointed(reputation(pages, outcomes, z=z, suffixes=suffixes))
    rated = F.col("mean").isNotNull()
    judged = r.select(
        "host",
        "domain",
        "suffix",
        "pages",
        F.when(rated, F.col("n")).alias("labelled"),
        F.when(rated, F.col("k")).alias("good"),
        F.round("mean", 6).alias("posterior_mean"),
        F.round("upper", 6).alias("upper_bound"),
        F.coalesce(F.round("upper", 6) >= min_good, F.lit(True)).alias("keep"),
    )
    p = pages.select("page_id", host_of(F.col("url")).alias("host"))
    columns = ["page_id", *[c for c in judged.columns if c != "pages"]]
    # A host that a third of all pages have isn't sent to one task.
    named = keyed(p.where("host IS NOT NULL"), judged, ["host"], size="pages", row_bytes=512).select(*columns)
    return named.unionByName(p.where("host IS NULL").withColumn("keep", F.lit(True)), allowMissingColumns=True).select(*columns)


def document_of(url: Column) -> Column:
    """The number that ends the path of a URL, or null."""
    found = F.regexp_extract(url, _NUMBER, 1)
    return F.when(found != "", found.cast("long"))


def outcomes_from_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, good): the quality labels of the documents that the URLs of pages name."""
    named = pages.select("page_id", document_of(F.col("url")).alias("doc_id")).where("doc_id IS NOT NULL")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("good"))
    return named.join(known, "doc_id").select("page_id", "good")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reputation and decision for every page, from the quality labels of the documents that their URLs name."""
    pages = table(spark, sf_dir, "pages")
    return decide(pages, outcomes_from_labels(pages, table(spark, sf_dir, "labels")))


_SUF = "(" + ", ".join(f"'{s}'" for s in SUFFIXES) + ")"


def _level_sql(name: str, level: str, parent: str, on: str) -> str:
    return f"""
{name}_x AS (SELECT l.*, p.m AS pm, p.var AS pvar, p.m * (1 - p.m) AS v FROM {level} l JOIN {parent} p ON l.{on} = p.{on}),
{name}_o AS (SELECT sum(n * pow(k::DOUBLE / n - pm, 2)) AS b, sum(v) AS e, sum(v * (n - 1)) AS room, count(*) AS c FROM {name}_x WHERE n > 0),
{name}_s AS (SELECT 1 / least(greatest(coalesce(CASE WHEN c > 1 AND room > 0 THEN (b - e) / room END, 0.5), 0.001), 0.5) - 1 AS s FROM {name}_o),
{name}_m AS (SELECT x.* EXCLUDE (v, pm), s, (s * pm + k) / (s + n) AS m FROM {name}_x x, {name}_s),
{name} AS (SELECT * EXCLUDE (pvar), pow(s / (s + n), 2) * pvar + m * (1 - m) / (s + n + 1) AS var FROM {name}_m)"""


#: page_id and good of what is known of pages.
_KNOWN = f"""
named AS (SELECT page_id, nullif(regexp_extract(url, '{_NUMBER}', 1), '')::BIGINT AS doc_id FROM pages),
known AS (SELECT page_id, quality AS good FROM named JOIN labels USING (doc_id))"""


def sql(known: str = _KNOWN) -> str:
    """DuckDB SQL for decide() on the relation `pages`; known is a CTE with the name `known` for (page_id, good)."""
    return f"""
WITH {known},
o AS (SELECT page_id, min(good) AS good FROM known WHERE good IN (0, 1) AND page_id IS NOT NULL GROUP BY 1),
p0 AS (SELECT page_id, rtrim(regexp_extract(lower(trim(url)), '{_HOST}', 1), '.') AS h FROM pages),
p AS (SELECT page_id, CASE WHEN h <> '' THEN h END AS host, CASE WHEN regexp_matches(h, '{_ADDRESS}') THEN [h] ELSE string_split(h, '.') END AS parts FROM p0),
q AS (SELECT page_id, host, CASE WHEN array_to_string(parts[-2:], '.') IN {_SUF} THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix,
  CASE WHEN array_to_string(parts[-2:], '.') IN {_SUF} THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain FROM p),
hosts AS (SELECT host, domain, suffix, count(good) AS n, coalesce(sum(good), 0)::BIGINT AS k FROM q LEFT JOIN o USING (page_id) WHERE host IS NOT NULL GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k, 1 AS root FROM domains GROUP BY suffix),
root0 AS (SELECT 1 AS root, sum(n)::DOUBLE AS n, (sum(k)::DOUBLE + 1) / (sum(n)::DOUBLE + 2) AS m FROM suffixes HAVING sum(n) > 0),
roots AS (SELECT root, m, m * (1 - m) / (n + 3) AS var FROM root0),
{_level_sql("s", "suffixes", "roots", "root")},
{_level_sql("d", "domains", "s", "suffix")},
{_level_sql("h", "hosts", "d", "domain")},
r AS (SELECT host, n, k, m, least(m + {Z} * sqrt(var), 1.0) AS u FROM h)
SELECT q.page_id, q.host, CASE WHEN q.host IS NOT NULL THEN q.domain END AS domain, CASE WHEN q.host IS NOT NULL THEN q.suffix END AS suffix,
  n AS labelled, k AS good, round(m, 6) AS posterior_mean, round(u, 6) AS upper_bound, coalesce(round(u, 6) >= {MIN_GOOD}, true) AS keep
FROM q LEFT JOIN r ON q.host = r.host"""


ORACLE_SQL = sql()
