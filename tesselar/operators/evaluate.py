"""Evaluation: inverse-cloze queries, ablations over ranking modes, parameter sweeps, neighbour fidelity."""

from __future__ import annotations

import json
import time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.functions import text as T
from tesselar.functions import vectors as V

from . import ann, dense, fusion, metrics, rerank
from .common import ranked, small, spread, top
from .lexical import LexicalIndex, build

MODES = tuple("bm25 vector rrf hybrid".split())
#: The grid of BM25 parameters.
K1S, BS = ([float(x) for x in g.split()] for g in ("0.6 0.9 1.2 1.5 1.8", "0.3 0.4 0.6 0.75 0.9"))
VARIANTS = ("verbatim", "hard", "keyword")


def corpus_idf(chunks: DataFrame) -> DataFrame:
    """(term, idf) of content words of chunks (doc_id, title, text): log((1 + n) / (1 + df))."""
    words = spread(chunks).select("doc_id", F.explode(F.array_distinct(T.content_words(T.indexable(F.col("title"), F.col("text"))))).alias("term"))
    n = chunks.agg(F.count("*").alias("n"))
    return words.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))).alias("idf"))


def eligible_sentences(chunks: DataFrame, *, min_words: int = 10) -> DataFrame:
    """(doc_id, pos, sentence): sentences of prose with at least min_words words and five content words."""
    each = spread(chunks.select("doc_id", "text")).select("doc_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")), min_words=min_words)).alias("pos", "sentence"))
    return each.where(T.looks_like_prose(F.col("sentence")) & (F.size(T.content_words(F.col("sentence"))) >= 5))


def first_sentences(chunks: DataFrame, *, min_words: int = 10) -> DataFrame:
    """(doc_id, pos, sentence): the first eligible sentence of each row of chunks, as `eligible_sentences` has them, or nulls.

    Later sentences are looked at only where no earlier one is eligible. A filter on the outcome would look twice.
    """
    fits = lambda x: T.looks_like_prose(x["sentence"]) & (F.size(T.content_words(x["sentence"])) >= 5)

    def first(each: Column) -> Column:
        placed = F.transform(each, lambda s, i: F.struct(i.alias("pos"), s.alias("sentence")))
        parts = lambda xs: [F.slice(xs, 1, 2), F.slice(xs, 3, 8), F.slice(xs, 11, F.greatest(F.size(xs), F.lit(1)))]
        return F.get(F.transform(F.array(placed), lambda xs: F.coalesce(*[F.get(F.filter(part, fits), 0) for part in parts(xs)])), 0)

    found = first(T.sentences(F.coalesce("text", F.lit("")), min_words=min_words))
    return spread(chunks.select("doc_id", "text")).select("doc_id", found.alias("s")).select("doc_id", "s.pos", "s.sentence")


def pick(candidates: DataFrame, *, seed: int | None = 0) -> DataFrame:
    """One sentence of each document: drawn by a digest of seed and place, or the first with no seed."""
    by = F.coalesce("pos", F.lit(2**31 - 1)) if seed is None else F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("pos"))
    return candidates.groupBy("doc_id").agg(F.min_by(F.struct("pos", "sentence"), F.struct(by, F.col("pos"))).alias("s")).select("doc_id", "s.pos", "s.sentence")


def _words_of(sentence: Column, variant: str, seed: int, drop_rate: float) -> Column:
    if variant == "hard":
        words = T.content_words(sentence)
        keep = F.greatest(F.lit(3), F.round(F.size(words) * (1 - drop_rate)).cast("int"))
        drawn = F.array_sort(F.transform(words, lambda w, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), i.cast("string"), sentence)).alias("h"), w.alias("w"))))
        return F.transform(F.slice(drawn, 1, keep), lambda x: x["w"])
    return F.split(T.clean_query(sentence), " ")


def ict_queries(chunks: DataFrame, *, n: int | None = 200, variant: str = "verbatim", min_words: int = 10, keywords: int = 3, seed: int | None = 0, drop_rate: float = 0.45) -> DataFrame:
    """(qid, text, target, sentence, variant): queries made of a sentence of the document they should find.

    verbatim cleans the sentence, hard drops a share of its content words and shuffles the rest, keyword keeps the
    most informative ones. Queries of fewer than three words are left out; n draws that many by digest, None keeps all.
    """
    if variant not in VARIANTS:
        raise ValueError(f"variant is one of {VARIANTS}, not {variant!r}")
    eligible = first_sentences if seed is None else eligible_sentences
    chosen = pick(eligible(chunks, min_words=min_words), seed=seed)
    if variant == "keyword":
        words = chosen.select("doc_id", F.explode(F.array_distinct(T.content_words(F.col("sentence")))).alias("term"))
        known = words.join(corpus_idf(chunks), "term", "left").withColumn("idf", F.coalesce("idf", F.lit(8.0)))
        best = ranked(known, ["doc_id"], F.round("idf", 9).desc(), F.col("term").asc(), k=keywords, name="place")
        text = best.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("t")).select("doc_id", F.array_join(F.col("t.term"), " ").alias("text"))
        queries = chosen.join(text, "doc_id")
    else:
        queries = chosen.withColumn("text", F.array_join(_words_of(F.col("sentence"), variant, seed or 0, drop_rate), " "))
    queries = queries.where(F.size(F.split("text", " ")) >= 3)
    if n is not None:
        queries = queries.orderBy(F.md5(F.concat(F.lit(f"{seed or 0}:"), F.col("doc_id").cast("string"))), "doc_id").limit(n)
    return queries.select(F.col("doc_id").alias("qid"), "text", F.col("doc_id").alias("target"), "sentence", F.lit(variant).alias("variant"))


def mask(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """chunks with the sentences of queries (target, sentence) taken out of their texts.

    Texts are squeezed first, as sentences are: otherwise one across a line end would stay and give its query away.
    """
    removed = queries.groupBy(F.col("target").alias("doc_id")).agg(F.collect_list("sentence").alias("removed"))
    # Queries are few, and go to the texts.
    out = chunks.join(small(removed, 1024), "doc_id", "left")
    masked = F.aggregate(F.coalesce("removed", F.array().cast("array<string>")), T.squeezed(F.col("text")), lambda t, s: F.replace(t, s, F.lit(" ")))
    return out.withColumn("text", F.when(F.col("removed").isNull(), T.squeezed(F.col("text"))).otherwise(T.squeezed(masked))).select(*chunks.columns)


def target_ranks(run: DataFrame, queries: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(qid, rank, doc_rank): the place of each query's target in a ranked run, and of its group's first member.

    groups is (doc_id, group); without it every document is its own group.
    """
    wanted = queries.select("qid", F.col("target").alias("doc_id"))
    exact = run.select("qid", "doc_id", "rank").join(wanted, ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("rank"))
    if groups is None:
        near = exact.select("qid", F.col("rank").alias("doc_rank"))
    else:
        mine = wanted.join(groups, "doc_id").select("qid", "group")
        theirs = run.select("qid", "doc_id", "rank").join(groups, "doc_id")
        near = theirs.join(mine, ["qid", "group"], "left_semi").groupBy("qid").agg(F.min("rank").alias("doc_rank"))
    return wanted.select("qid").join(exact, "qid", "left").join(near, "qid", "left")


def semantic_leg(lexical: DataFrame, vectors: DataFrame, query_vectors: DataFrame, *, depth: int) -> DataFrame:
    """(qid, doc_id, score): the cosines of all that either leg nominates down to depth; where a query has no vector, its lexical scores."""
    some = query_vectors.where(~V.is_zero(F.col("vec")))
    pool = fusion.pool(top(lexical, depth), dense.search(vectors, some, k=depth)).join(some.select("qid"), "qid", "left_semi")
    known = dense.score_pairs(pool, vectors, some).where("semantic IS NOT NULL").select("qid", "doc_id", F.col("semantic").alias("score"))
    return known.unionByName(lexical.join(some.select("qid"), "qid", "left_anti").select("qid", "doc_id", "score"))


def modes(lexical: DataFrame, semantic: DataFrame, *, alphas: list[float], depth: int, normaliser: str = "minmax", which: tuple[str, ...] = MODES) -> dict[str, DataFrame]:
    """Ranked runs (qid, doc_id, score, rank) by name, from full scores of both legs, which are reused across modes."""
    lex, sem = top(lexical, depth), top(semantic, depth)
    out = {}
    if "bm25" in which:
        out["bm25"] = lex
    if "vector" in which:
        out["vector"] = sem
    if "rrf" in which:
        out["rrf"] = fusion.rrf({"bm25": lex, "vector": sem}, limit=depth).drop("parts")
    if "hybrid" in which:
        pool = fusion.scored_pool(fusion.pool(lex, sem), lexical, semantic)
        every = fusion.weighted(pool, alpha=list(alphas), normaliser=normaliser, limit=depth).drop("parts")
        out |= {f"hybrid_{a:g}": every.where(F.col("alpha") == float(a)).drop("alpha") for a in alphas}
    return out


def reranked(run: DataFrame, queries: DataFrame, chunks: DataFrame, reranker: rerank.Reranker, *, depth: int = 25, k: int = 10) -> DataFrame:
    """(qid, doc_id, rank, score): the first `depth` of each query of a run in the order of a re-ranker, k of them."""
    pool = run.where(F.col("rank") <= depth).join(chunks.select("doc_id", "title", "text"), "doc_id").join(queries.select("qid", F.col("text").alias("query")), "qid")
    out = reranker.rerank(pool.select("qid", "doc_id", "rank", "query", "title", "text", F.lit(0.0).alias("vector_score")), top_k=k)
    return out.select("qid", "doc_id", "rank", F.col("reranked").alias("score"))


def ablation(
    lexical: DataFrame,
    semantic: DataFrame,
    queries: DataFrame,
    *,
    groups: DataFrame | None = None,
    depth: int = 50,
    alphas: tuple[float, ...] = (0.3, 0.5, 0.7),
    reranker: rerank.Reranker | None = None,
    chunks: DataFrame | None = None,
    rerank_depth: int = 25,
    rerank_from: str | None = None,
) -> DataFrame:
    """(system, n, recall_at_1, .., mrr, ndcg, doc_recall_10, ceiling) of every mode on queries with one target each.

    With a re-ranker one more system re-ranks `rerank_from`, by default the hybrid whose alpha has the best nDCG; its
    ceiling is the share of targets in the pool that it was given, above which no order of the pool can get.
    """
    runs = modes(lexical, semantic, alphas=list(alphas), depth=max(depth, rerank_depth if reranker else 0))
    single = lambda run: metrics.single_target(target_ranks(run, queries, groups))
    rows = [single(run.where(F.col("rank") <= depth)).select(F.lit(name).alias("system"), "*", F.lit(None).cast("double").alias("ceiling")) for name, run in runs.items()]
    if reranker is not None:
        if chunks is None:
            raise ValueError("a re-ranker needs the chunks")
        if rerank_from is None:
            hybrids = reduce(DataFrame.unionByName, [r for r, name in zip(rows, runs) if name.startswith("hybrid")])
            # One row for each alpha.
            rerank_from = hybrids.orderBy(F.round("ndcg", 9).desc(), "system").first()["system"]
        pool = runs[rerank_from]
        reach = rerank.ceiling(pool, queries.select("qid", F.col("target").alias("doc_id")), rerank_depth).select("ceiling")
        after = single(reranked(pool, queries, chunks, reranker, depth=rerank_depth))
        rows.append(after.crossJoin(reach).select(F.lit(f"{rerank_from} + {reranker.name}").alias("system"), *rows[0].columns[1:]))
    return reduce(DataFrame.unionByName, rows)


def _seconds(df: DataFrame) -> float:
    """What computing all of df takes on the clock."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def measure_ann(vectors: DataFrame, queries: DataFrame, *, k: int = 10, efs: tuple[int, ...] = (32, 64, 128, 256), m: int = ann.M, ef_build: int = ann.EF_BUILD, shards: int | None = None) -> DataFrame:
    """(ef, k, recall, n_docs, n_queries, n_zero, dim, build_seconds, exact_ms, ms, speedup) of graphs against exact search.

    Both search the same batch of queries (qid, vec); times are a query's share of the clock for the whole batch. Queries
    whose vector is zero have no nearest neighbours: they are counted and left out; ValueError if there are no others.
    """
    spark = vectors.sparkSession
    some = queries.where(~V.is_zero(F.col("vec"))).persist()
    n, every = some.count(), queries.count()
    if not n:
        raise ValueError("every query has the zero vector: there is nothing to compare")
    began = time.perf_counter()
    graph = ann.build(vectors, m=m, ef=ef_build, shards=shards)
    graph.nodes = graph.nodes.persist()
    n_docs = graph.nodes.count()
    built = time.perf_counter() - began
    exact = dense.search(vectors, some, k=k).persist()
    exact_ms = 1000 * _seconds(exact) / n
    dim = len(some.first()["vec"])
    rows = []
    for ef in efs:
        found = graph.search(some, k=k, ef=ef).persist()
        ms = 1000 * _seconds(found) / n
        rows.append((ef, k, metrics.neighbour_recall(exact, found, k).first()["recall"], n_docs, n, every - n, dim, built, exact_ms, ms, exact_ms / ms))
        found.unpersist()
    for df in (some, graph.nodes, exact):
        df.unpersist()
    return spark.createDataFrame(rows, "ef int, k int, recall double, n_docs long, n_queries long, n_zero long, dim int, build_seconds double, exact_ms double, ms double, speedup double")


def ann_crossover(datasets: dict[str, tuple[DataFrame, DataFrame]], *, n_queries: int = 200, **how) -> DataFrame:
    """measure_ann for each dataset (vectors, query vectors) by name, with `dataset`: where graphs begin to pay."""
    parts = [measure_ann(v, q.orderBy("qid").limit(n_queries), **how).withColumn("dataset", F.lit(name)) for name, (v, q) in datasets.items()]
    return reduce(DataFrame.unionByName, parts)


def stemming(docs: DataFrame, queries: DataFrame, qrels: DataFrame, *, depth: int = 100, iterations: int = 10_000) -> DataFrame:
    """One row: vocabulary, build time, nDCG@10 and recall@100 of a plain and a stemmed index, delta and p of the nDCG."""
    got, per = {}, {}
    for name in ("plain", "stemmed"):
        began = time.perf_counter()
        index = build(docs, stem=name == "stemmed")
        got[f"vocab_{name}"] = index.frequencies().count()
        got[f"build_{name}_s"] = time.perf_counter() - began
        scores = metrics.per_query(qrels, top(index.score(queries), depth).select("qid", "doc_id", "score"), (10, 100)).persist()
        means = {r["k"]: r for r in scores.groupBy("k").agg(F.avg("ndcg").alias("ndcg"), F.avg("recall").alias("recall")).collect()}
        got |= {f"ndcg10_{name}": means[10]["ndcg"], f"recall100_{name}": means[100]["recall"]}
        per[name] = scores.where("k = 10")
        index.release()
    test = metrics.paired_bootstrap(per["plain"], per["stemmed"], iterations=iterations)
    return test.select(*[F.lit(v).alias(n) for n, v in got.items()], "delta", "p_value", "n")


def drop_self(run: DataFrame) -> DataFrame:
    """run without the document that is the query itself, places closed up; a query may keep one place fewer."""
    others = run.where(F.col("doc_id").cast("string") != F.col("qid").cast("string"))
    return ranked(others.withColumnRenamed("rank", "was"), ["qid"], F.col("was").asc()).drop("was")


def run_dataset(qrels: DataFrame, lexical: DataFrame, semantic: DataFrame, *, depth: int = 1000, alpha: float = 0.5, sweep: bool = True, self_matches: bool = True, iterations: int = 10_000) -> dict[str, DataFrame]:
    """The benchmark of one dataset: `means` by mode and cut-off, `sweep` of alpha, `significance` against bm25.

    The sweep ranks over pools of min(depth, 100), which is enough for a cut-off of 10.
    """
    clean = (lambda r: r) if self_matches else drop_self
    runs = {n.split("_")[0]: clean(r) for n, r in modes(lexical, semantic, alphas=[alpha], depth=depth).items()}
    means = [metrics.evaluate(qrels, r.select("qid", "doc_id", "score")).withColumn("mode", F.lit(n)) for n, r in runs.items()]
    out = {"means": reduce(DataFrame.unionByName, means)}
    at10 = {n: metrics.per_query(qrels, r.select("qid", "doc_id", "score"), (10,)) for n, r in runs.items()}
    tests = [metrics.paired_bootstrap(at10["bm25"], p, iterations=iterations).withColumn("mode", F.lit(n)) for n, p in at10.items() if n != "bm25"]
    out["significance"] = reduce(DataFrame.unionByName, tests)
    if sweep:
        alphas = [round(0.1 * i, 1) for i in range(11)]
        swept = modes(lexical, semantic, alphas=alphas, depth=min(depth, 100), which=("hybrid",))
        rows = [metrics.evaluate(qrels, clean(r).select("qid", "doc_id", "score"), (10,)).select(F.lit(n[7:]).cast("double").alias("alpha"), "ndcg") for n, r in swept.items()]
        out["sweep"] = reduce(DataFrame.unionByName, rows)
    return out


def best_alpha(sweep: DataFrame) -> DataFrame:
    """The row (alpha, ndcg) of the best alpha, the smallest of equals."""
    return sweep.orderBy(F.round("ndcg", 9).desc(), F.col("alpha").asc()).limit(1)


def param_grid(index: LexicalIndex, queries: DataFrame, qrels: DataFrame, *, k1s=K1S, bs=BS, depth: int = 100) -> DataFrame:
    """(k1, b, ndcg) at 10 over the grid, all settings from one pass over the postings."""
    scored = index.score_grid(queries, [(k, b) for k in k1s for b in bs], k=depth)
    name = lambda q: F.concat_ws("|", F.col("k1"), F.col("b"), q.cast("string"))
    grid = queries.sparkSession.createDataFrame([(float(k), float(b)) for k in k1s for b in bs], "k1 double, b double")
    run = ranked(scored.withColumn("qid", name(F.col("qid"))), ["qid"], F.round("score", 9).desc(), F.col("doc_id").asc(), k=depth).select("qid", "doc_id", "score")
    wanted = qrels.crossJoin(F.broadcast(grid)).withColumn("qid", name(F.col("qid")))
    per = metrics.per_query(wanted.select("qid", "doc_id", "rel"), run, (10,))
    parts = F.split("qid", r"\|")
    return per.groupBy(F.get(parts, 0).cast("double").alias("k1"), F.get(parts, 1).cast("double").alias("b")).agg(F.avg("ndcg").alias("ndcg"))


def relevant_count(qrels: DataFrame) -> DataFrame:
    """One row (relevant_per_query): the mean number of relevant documents over judged queries."""
    per = qrels.groupBy("qid").agg(F.sum((F.col("rel") > 0).cast("int")).alias("n"))
    return per.agg(F.avg("n").alias("relevant_per_query"))


def format_table(report: DataFrame, value: str = "ndcg", name: str = "mode") -> str:
    """A text table of a small report, a star on its best row."""
    rows = [(str(r[name]), float(r[value])) for r in report.select(name, value).collect()]
    best = max((v for _, v in rows), default=None)
    width = max([len(name), *(len(n) for n, _ in rows)])
    return "\n".join([f"{name:<{width}}  {value}", *(f"{n:<{width}}  {v:.4f}{' *' if v == best else ''}" for n, v in rows)])


def write_report(reports: dict[str, DataFrame], path: str) -> None:
    """A JSON file of small reports, by name; numbers to five places."""
    tidy = lambda v: round(v, 5) if isinstance(v, float) else v
    with open(path, "w") as out:
        json.dump({n: [{k: tidy(v) for k, v in r.asDict().items()} for r in df.collect()] for n, df in reports.items()}, out, indent=1)
