"""Feature-based re-ranking of candidates, and a protocol for judges that live elsewhere.

Candidates are (qid, doc_id, rank, query, title, text, vector_score). All features are Column expressions.
"""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from tesselar.functions import text as T

from .common import ranked

WEIGHTS = {"vector": 0.18, "coverage": 0.34, "title": 0.12, "phrase": 0.22, "proximity": 0.14}
UNKNOWN_IDF = 3.0


class Reranker(Protocol):
    """Takes candidates and gives (qid, doc_id, rank, reranked, rationale), the top_k of each query."""

    name: str

    def rerank(self, candidates: DataFrame, top_k: int = 10) -> DataFrame: ...


def bigrams(words: Column) -> Column:
    """The distinct pairs of neighbouring words."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(n > 1, pairs).otherwise(F.array().cast("array<string>")))


def phrase(query_words: Column, doc_tokens: Column) -> Column:
    mine = bigrams(query_words)
    return F.size(F.array_intersect(mine, bigrams(doc_tokens))) / F.greatest(F.size(mine), F.lit(1))


def title_share(query_words: Column, title_tokens: Column) -> Column:
    return F.size(F.filter(query_words, lambda w: F.array_contains(title_tokens, w))) / F.greatest(F.size(query_words), F.lit(1))


def proximity(query_words: Column, doc_tokens: Column) -> Column:
    """1 if the distinct words of the query stand side by side, less the wider the smallest window that has them all is.

    If some never occur, 0.35 of the share that does; 0 if fewer than two are wanted or fewer than two places match.
    One pass over the places that match keeps where each word occurred last: a window that ends here begins at the
    earliest of these.
    """

    def of(want: Column) -> Column:
        n = F.size(want)
        at = F.filter(F.transform(doc_tokens, lambda t, i: F.struct(i.alias("i"), F.array_position(want, t).alias("p"))), lambda x: x["p"] > 0)
        start = F.struct(F.array_repeat(F.lit(-1), n).alias("last"), F.lit(2**31 - 1).alias("best"))

        def step(state: Column, x: Column) -> Column:
            last = F.transform(state["last"], lambda v, j: F.when(j == x["p"] - 1, x["i"]).otherwise(v))
            # Bound once: the new list is looked at twice.
            return F.get(F.transform(F.array(last), lambda y: F.struct(y.alias("last"), F.when(F.array_min(y) >= 0, F.least(state["best"], x["i"] - F.array_min(y) + 1)).otherwise(state["best"]).alias("best"))), 0)

        def value(places: Column) -> Column:
            end = F.aggregate(places, start, step)
            found = F.get(F.transform(F.array(end), lambda e: F.when(F.array_min(e["last"]) >= 0, F.least(F.lit(1.0), n / e["best"])).otherwise(0.35 * F.size(F.filter(e["last"], lambda v: v >= 0)) / n)), 0)
            return F.when((n < 2) | (F.size(places) < 2), F.lit(0.0)).otherwise(found)

        return F.get(F.transform(F.array(at), value), 0)

    return F.get(F.transform(F.array(F.array_distinct(query_words)), of), 0)


def coverage(candidates: DataFrame, terms: DataFrame | None) -> DataFrame:
    """candidates (.., qid, words, toks) with `coverage`: the share of the query's information that a document has.

    terms is (term, idf); an unknown word counts as UNKNOWN_IDF. Words of queries get their idf once per query.
    """
    queries = candidates.groupBy("qid").agg(F.first("words").alias("words"))
    each = queries.select("qid", F.posexplode("words").alias("pos", "term"))
    each = each.join(terms.select("term", "idf"), "term", "left") if terms is not None else each.withColumn("idf", F.lit(None).cast("double"))
    known = each.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "term", F.coalesce("idf", F.lit(UNKNOWN_IDF)).alias("idf")))).alias("information"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x["idf"])
    out = candidates.join(known, "qid", "left")
    info = F.col("information")
    has = F.filter(info, lambda x: F.array_contains(F.col("toks"), x["term"]))
    return out.withColumn("coverage", F.coalesce(F.when(total(info) > 0, total(has) / F.when(total(info) > 0, total(info))), F.lit(0.0))).drop("information")


class LocalReranker:
    """Weighs coverage, phrases, proximity, title and cosine; needs no network. terms is (term, idf) of an index."""

    name = "local"

    def __init__(self, terms: DataFrame | None = None, weights: dict[str, float] | None = None):
        self.terms, self.weights = terms, weights or WEIGHTS

    def features(self, candidates: DataFrame) -> DataFrame:
        """candidates with one column for each feature."""
        c = candidates.withColumns(
            {
                "words": T.content_words(F.coalesce("query", F.lit(""))),
                "toks": T.tokens(F.coalesce("text", F.lit(""))),
                "title_toks": T.tokens(F.coalesce("title", F.lit(""))),
            }
        )
        c = coverage(c, self.terms)
        return c.withColumns(
            {
                "phrase": phrase(F.col("words"), F.col("toks")),
                "proximity": proximity(F.col("words"), F.col("toks")),
                "title_share": title_share(F.col("words"), F.col("title_toks")),
                "vector": F.least(F.greatest(F.coalesce("vector_score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)),
            }
        ).drop("words", "toks", "title_toks")

    def rerank(self, candidates: DataFrame, top_k: int = 10) -> DataFrame:
        scored = self.features(candidates)
        column = lambda n: F.col("title_share" if n == "title" else n)
        names = ("coverage", "phrase", "proximity", "title", "vector")
        score = sum((self.weights[n] * column(n) for n in names[1:]), self.weights["coverage"] * F.col("coverage"))
        worth = F.array_sort(F.array(*[F.struct((-self.weights[n] * column(n)).alias("minus"), F.lit(i).alias("i"), F.lit(n).alias("name"), column(n).alias("value")) for i, n in enumerate(names)]))
        why = F.array_join(F.transform(F.slice(worth, 1, 2), lambda x: F.format_string("%s=%.2f", x["name"], x["value"])), ", ")
        scored = scored.withColumns({"reranked": score, "rationale": why}).withColumnRenamed("rank", "incoming")
        best = ranked(scored, ["qid"], F.round("reranked", 9).desc(), F.col("incoming").asc(), k=top_k)
        return best.select("qid", "doc_id", "rank", "reranked", "rationale")


JUDGE_GUIDE = """You judge how well passages answer a query. Give every passage a whole number from 0 to 10:
10 answers it fully and directly, 7 mostly, 4 is related but leaves the question open, 0 has nothing to do with it.
Judge what a passage says, not how it is written. Give one sentence of reason for each."""


def _record(**fields) -> dict:
    """The JSON schema of an object with just these fields."""
    return {"additionalProperties": False, "required": list(fields), "properties": fields, "type": "object"}


_VERDICT = _record(**{f: dict(type="integer") for f in ("index", "relevance")}, reason=dict(type="string"))
JUDGE_SCHEMA = _record(verdicts=dict(items=_VERDICT, type="array"))



class JudgeReranker:
    """Asks a judge for the relevance of candidates, in batches.

    ask(guide, schema, payload) is made on the executors by make_client() and returns {"verdicts": [{"index", "relevance",
    "reason"}, ...]}, or None for a refusal, which is an error. Texts are cut to `most_chars` characters for the judge.
    Candidates it leaves out vanish; equal scores keep their incoming order.
    """

    name = "judge"
    #: It asks a service, so that reports may bound how many queries it gets.
    remote = True

    def __init__(self, make_client, batch: int = 8, most_chars: int = 1200):
        self.make_client, self.batch, self.most_chars = make_client, batch, most_chars

    def rerank(self, candidates: DataFrame, top_k: int = 10) -> DataFrame:
        make, size, most = self.make_client, self.batch, self.most_chars
        id_type = candidates.schema["qid"].dataType, candidates.schema["doc_id"].dataType
        schema = ty.StructType([ty.StructField("qid", id_type[0]), ty.StructField("doc_id", id_type[1]), ty.StructField("incoming", ty.LongType()), ty.StructField("reranked", ty.DoubleType()), ty.StructField("rationale", ty.StringType())])

        def judge(rows: pd.DataFrame) -> pd.DataFrame:
            ask, out = make(), []
            rows = rows.sort_values("rank")
            for lo in range(0, len(rows), size):
                part = rows.iloc[lo : lo + size]
                payload = {"query": part["query"].iloc[0], "passages": [{"index": i, "title": r.title or "", "text": (r.text or "")[:most]} for i, r in enumerate(part.itertuples())]}
                answer = ask(JUDGE_GUIDE, JUDGE_SCHEMA, payload)
                if answer is None:
                    raise RuntimeError("the judge refused")
                for v in answer["verdicts"]:
                    if 0 <= v["index"] < len(part):
                        r = part.iloc[v["index"]]
                        out.append((r["qid"], r["doc_id"], int(r["rank"]), v["relevance"] / 10, v.get("reason", "")))
            return pd.DataFrame(out, columns=["qid", "doc_id", "incoming", "reranked", "rationale"])

        judged = candidates.select("qid", "doc_id", "rank", "query", "title", "text").groupBy("qid").applyInPandas(judge, schema)
        return ranked(judged, ["qid"], F.col("reranked").desc(), F.col("incoming").asc(), k=top_k).select("qid", "doc_id", "rank", "reranked", "rationale")


def make_reranker(name: str, *, terms: DataFrame | None = None, make_client=None) -> Reranker | None:
    """none, local, or judge; judge needs make_client."""
    if name == "none":
        return None
    if name == "local":
        return LocalReranker(terms)
    if name == "judge":
        if make_client is None:
            raise ValueError("a judge needs make_client")
        return JudgeReranker(make_client)
    raise ValueError(f"unknown reranker: {name!r}")


def default_reranker(terms: DataFrame | None = None, *, make_client=None, prefer_judge: bool = True) -> Reranker:
    """The judge if there is a client for it and it is preferred, else the local one."""
    return JudgeReranker(make_client) if make_client is not None and prefer_judge else LocalReranker(terms)


def ceiling(pool: DataFrame, targets: DataFrame, depth: int = 25) -> DataFrame:
    """One row (n, ceiling): the share of targets (qid, doc_id) among the first `depth` of the pool."""
    found = pool.where(F.col("rank") <= depth).select("qid", "doc_id").distinct().withColumn("found", F.lit(1.0))
    return targets.join(found, ["qid", "doc_id"], "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("found", F.lit(0.0))).alias("ceiling"))
