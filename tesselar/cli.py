"""Command line: index, search, eval, benchmark and serve."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tesselar.operators import chunk, dense, evaluate, lexical, search
from tesselar.operators.rerank import Reranker, make_reranker
from tesselar.plans import baselines
from tesselar.server import HOST, PORT, search_one, serve
from tesselar.session import importable
from tesselar.sources import beir, files


def _chunks(spark, args):
    docs = files.read(spark, args.roots, exclude=tuple(args.exclude), max_files=args.max_files)
    made = chunk.numbered(chunk.chunk(docs, max_tokens=args.max_tokens, overlap=args.overlap, min_tokens=args.min_tokens))
    return made.select(F.col("id").alias("doc_id"), "title", "text", F.col("doc_id").alias("doc"), "project")


def _factory(name: str | None):
    """The function behind `module:function`, or None."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _reranker(args, terms) -> Reranker | None:
    return make_reranker(args.rerank, terms=terms, make_client=_factory(args.judge))


def index(spark, args) -> None:
    chunks = _chunks(spark, args).persist()
    search.build(chunks, embedder=None if args.embedder == "none" else args.embedder, stem=args.stem, use_ann=args.ann, dim=args.dim).save(args.out)
    print(f"{chunks.select('doc').distinct().count()} documents, {chunks.count()} chunks -> {args.out}")


def find(spark, args) -> None:
    engine = search.load(spark, args.index)
    how = {n: getattr(args, n) for n in ("k", "mode", "alpha", "candidates", "rerank_depth")}
    hits = search_one(engine, args.query, reranker=_reranker(args, engine.index.terms()), **how)
    if args.json:
        print(json.dumps(hits, ensure_ascii=False, indent=1))
        return
    for h in hits:
        print(f"{h['rank']}. {h['score']:.4f}  {h['title']}  [{h['doc']}]\n   {h['snippet']}\n   " + ", ".join(f"{t} {c}" for t, c in h["terms"]))


def run_eval(spark, args) -> None:
    engine = search.load(spark, args.index)
    reports = {}
    for variant in args.variant.split(","):
        queries = evaluate.ict_queries(engine.chunks, n=args.n, variant=variant, seed=args.seed).persist()
        chunks = evaluate.mask(engine.chunks, queries)
        masked = search.build(chunks, embedder=args.embedder, dim=args.dim, use_ann=args.ann)
        reranker = _reranker(args, masked.index.terms())
        if getattr(reranker, "remote", False):
            queries = queries.orderBy("qid").limit(args.rerank_queries).persist()
            print(f"{queries.count()} queries at most go to the judge")
        q = queries.select("qid", "text")
        vectors = masked.embedder.embed_queries(q).persist()
        lex, sem = masked.index.score(q), dense.score(masked.vectors, vectors)
        groups = engine.chunks.select("doc_id", F.col("doc").alias("group"))
        report = evaluate.ablation(lex, sem, queries, groups=groups, reranker=reranker, chunks=chunks, rerank_depth=args.rerank_depth).persist()
        print(f"{variant}: {queries.count()} queries\n{evaluate.format_table(report, name='system')}")
        for r in report.where("ceiling IS NOT NULL").collect():
            print(f"the first {args.rerank_depth} hold {r['ceiling']:.1%} of the targets: no order of them finds more")
        reports[f"{variant}.ablation"] = report
        if masked.graph is not None:
            reports[f"{variant}.ann"] = evaluate.measure_ann(masked.vectors, vectors.orderBy("qid").limit(100))
            reports[f"{variant}.ann"].show()
        masked.index.release()
    if args.out:
        evaluate.write_report(reports, args.out)


def verdicts(spark, name: str, reports: dict, dense_model: str | None = None) -> list[str]:
    """What a benchmark's figures of one dataset mean: significance, the tuned alpha, the gap to what is published."""
    out = []
    for r in reports["significance"].collect():
        out.append(f"{r['mode']} against bm25: {r['delta']:+.4f}, p = {r['p_value']:.3f}, {'significant' if r['p_value'] < 0.05 else 'not significant'}")
    if "sweep" in reports:
        best = evaluate.best_alpha(reports["sweep"]).first()
        out.append(f"best alpha {best['alpha']:g}: {best['ndcg']:.4f}, chosen on the judgements it is measured by, so no fair result")
    means = {r["mode"]: r["ndcg"] for r in reports["means"].where("k = 10").collect()}
    known = baselines.published(name)
    if known is not None and "bm25" in means:
        gap = means["bm25"] - known
        line = f"bm25 {means['bm25']:.4f}, published {known:.3f} ({baselines.PRIMARY}), {gap:+.4f}"
        spread = {r["dataset"]: r["spread"] for r in baselines.spread(spark).collect()}.get(name)
        out.append(line + (f"; published values lie {spread:.3f} apart" if spread is not None and abs(gap) < spread else ""))
    encoder = baselines.published(name, dense_model) if dense_model else None
    if encoder is not None and "vector" in means:
        out.append(f"vector {means['vector']:.4f}, published {encoder:.5f} ({dense_model}), {means['vector'] - encoder:+.4f}")
    return out


def benchmark(spark, args) -> None:
    out, measured = {}, []
    for name in beir.SMALL_SUITE if args.dataset == "small" else [args.dataset]:
        data = beir.load(spark, name, f"{args.folder}/{name}", max_docs=args.max_docs)
        docs = data.documents.select("doc_id", F.concat("title", F.lit("\n"), "text").alias("text"))
        # Numbers for the vectors' blocks; names stay the identifiers of runs.
        keys = docs.select("doc_id").withColumn("id", F.xxhash64("doc_id"))
        queries = data.queries.withColumn("id", F.xxhash64("qid")).persist()
        index_ = lexical.build(docs, stem=args.stem)
        lex = index_.score(queries.select("qid", "text"))
        model = search.make_embedder(args.embedder, docs=docs, dim=args.dim if args.embedder == "lsa" else None)
        v = model.embed_documents(docs).join(keys, "doc_id").select(F.col("id").alias("doc_id"), "vec")
        qv = model.embed_queries(queries.select("qid", "text")).join(queries.select("qid", "id"), "qid").select(F.col("id").alias("qid"), "vec")
        numbered = lex.join(queries.select("qid", F.col("id").alias("q")), "qid").join(keys, "doc_id").select(F.col("q").alias("qid"), F.col("id").alias("doc_id"), "score")
        raw = evaluate.semantic_leg(numbered, v, qv, depth=args.depth).select(F.col("qid").alias("q"), F.col("doc_id").alias("d"), "score")
        sem = raw.join(keys, raw.d == keys.id).drop("id").join(queries.select("qid", "id"), F.col("q") == F.col("id")).select("qid", "doc_id", "score")
        reports = evaluate.run_dataset(data.qrels, lex, sem, depth=args.depth, self_matches=not data.drops_self_matches)
        at10 = reports["means"].where("k = 10").persist()
        print(name + "\n" + evaluate.format_table(at10))
        print("\n".join(verdicts(spark, name, reports, args.embedder[3:].rpartition("/")[2] or None)))
        measured += [(name, r["ndcg"]) for r in at10.where("mode = 'bm25'").collect()]
        if args.ann:
            reports["ann"] = evaluate.measure_ann(v, qv.orderBy("qid").limit(200))
            reports["ann"].show()
        if args.ab_stem:
            reports["stemming"] = evaluate.stemming(docs, queries.select("qid", "text"), data.qrels)
            reports["stemming"].show(vertical=True)
        out |= {f"{name}.{k}": r for k, r in reports.items()}
        index_.release()
    every = baselines.compare(spark.createDataFrame(measured, "dataset string, measured double"))
    every.show()
    baselines.mean_absolute_deviation(every).show()
    if args.out:
        evaluate.write_report(out, args.out)


#: Options by command: name, default (its type is the option's), choices.
_OPTIONS = {
    "index": [("max-tokens", chunk.MAX_TOKENS), ("overlap", chunk.OVERLAP), ("min-tokens", chunk.MIN_TOKENS), ("dim", 256), ("embedder", "lsa")],
    "search": [("mode", "rrf", search.MODES), ("k", 8), ("alpha", 0.5), ("candidates", 60), ("rerank", "none", ("none", "local", "judge")), ("rerank-depth", 25), ("judge", "")],
    "eval": [("n", 250), ("variant", "verbatim"), ("seed", 0), ("dim", 256), ("embedder", "lsa"), ("rerank", "none", ("none", "local", "judge")), ("rerank-depth", 25), ("rerank-queries", 40), ("judge", "")],
    "benchmark": [("dim", 256), ("depth", 1000), ("embedder", "lsa")],
    "serve": [("host", HOST), ("port", PORT)],
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tesselar")
    sub = p.add_subparsers(required=True)
    run = {"index": index, "search": find, "eval": run_eval, "benchmark": benchmark, "serve": lambda spark, args: serve(search.load(spark, args.index), args.host, args.port)}
    takes = {"index": ["roots"], "search": ["index", "query"], "eval": ["index"], "benchmark": ["dataset", "folder"], "serve": ["index"]}
    for name, action in run.items():
        a = sub.add_parser(name)
        for t in takes[name]:
            a.add_argument(t, **({"nargs": "+"} if t == "roots" else {}))
        for option, default, *choices in _OPTIONS[name]:
            dashes = "-" if len(option) == 1 else "--"
            a.add_argument(dashes + option, default=default, type=type(default), **({"choices": choices[0]} if choices else {}))
        if name in ("index", "eval", "benchmark"):
            a.add_argument("--out", required=name == "index")
        if name in ("index", "benchmark"):
            a.add_argument("--stem", action="store_true")
        if name in ("index", "eval", "benchmark"):
            a.add_argument("--ann", action="store_true")
        if name == "index":
            a.add_argument("--max-files", type=int)
            a.add_argument("--exclude", action="append", default=[])
        if name == "benchmark":
            a.add_argument("--max-docs", type=int)
            a.add_argument("--ab-stem", action="store_true")
        if name == "search":
            a.add_argument("--json", action="store_true")
        a.set_defaults(run=action)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(importable(spark or SparkSession.builder.appName("tesselar").getOrCreate()), args)


if __name__ == "__main__":
    main()
