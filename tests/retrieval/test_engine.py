import inspect
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselar import cli

from tesselar.functions import plain
from tesselar.functions import vectors as V
from tesselar.operators import ann, chunk, dense, evaluate, fusion, lexical, lsa, rerank, search
from tesselar.operators.common import ranked, spread, top
from tesselar.plans import catalog

TEXTS = [
    "The cat sat on the warm mat near the window and slept through the long afternoon.",
    "Dogs chase cats around the garden while the gardener waters the roses every morning.",
    "Inverted indexes map terms to postings so that search engines answer queries quickly.",
    "Vector search compares embeddings by cosine similarity to find related passages.",
    "The gardener planted roses and tulips along the garden path in early spring.",
    "Search engines combine lexical scores with vector similarity for hybrid ranking.",
    "",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "garden roses roses"), (2, "vector search"), (3, "zzz qqq"), (4, "")], "qid long, text string").cache()


def brute_bm25(query, texts, k1=1.5, b=0.75):
    toks = [plain.tokens(t) for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    out = {}
    for i, t in enumerate(toks):
        s = 0.0
        for w in set(plain.tokens(query)):
            df, tf = sum(w in x for x in toks), t.count(w)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (0.5 + df)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
        if s:
            out[i] = s
    return out


def test_bm25_equals_brute_force(spark, docs, queries):
    ix = lexical.build(docs)
    got = {}
    for r in ix.score(queries).collect():
        got.setdefault(r.qid, {})[r.doc_id] = r.score
    for q, text in ((1, "garden roses roses"), (2, "vector search")):
        assert got[q] == pytest.approx(brute_bm25(text, TEXTS))
    assert 3 not in got and 4 not in got
    parts = ix.explain(queries, ix.score(queries)).groupBy("qid", "doc_id").agg(F.sum("contrib").alias("s")).collect()
    assert all(r.s == pytest.approx(got[r.qid][r.doc_id]) for r in parts)
    grid = {(r.k1, r.b, r.qid, r.doc_id): r.score for r in ix.score_grid(queries, [(0.9, 0.4), (1.5, 0.75)]).collect()}
    assert {d: s for (k, _, q, d), s in grid.items() if k == 0.9 and q == 1} == pytest.approx(brute_bm25("garden roses", TEXTS, 0.9, 0.4))


def test_stemmed_index_matches_forms(spark, docs):
    q = spark.createDataFrame([(1, "indexing engine")], "qid long, text string")
    assert {r.doc_id for r in lexical.build(docs, stem=True).score(q).collect()} == {2, 5}
    assert lexical.build(docs).score(q).count() == 0


def test_index_round_trip(spark, docs, queries, tmp_path):
    ix = lexical.build(docs, stem=True)
    ix.save(str(tmp_path))
    again = lexical.load(spark, str(tmp_path))
    key = lambda r: (r.qid, r.doc_id)
    a, b = (sorted(i.score(queries).collect(), key=key) for i in (ix, again))
    assert again.stem and [key(r) for r in a] == [key(r) for r in b] and [r.score for r in a] == pytest.approx([r.score for r in b])


def test_dense_equals_numpy(spark):
    x = np.random.default_rng(3).standard_normal((300, 16))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)] + [(900, None)], "doc_id long, vec array<double>")
    q = v.where("doc_id < 20").withColumnRenamed("doc_id", "qid").union(spark.createDataFrame([(77, [0.0] * 16)], "qid long, vec array<double>"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in dense.search(v, q, k=7, drop_self=True).collect():
        got.setdefault(r.qid, {})[r.rank] = r.doc_id
    s = u[:20] @ u.T
    s[np.arange(20), np.arange(20)] = -9
    assert all([got[i][k + 1] for k in range(7)] == np.argsort(-s[i])[:7].tolist() for i in range(20)) and 77 not in got
    pairs = dense.score_pairs(spark.createDataFrame([(0, 5), (1, 900)], "qid long, doc_id long"), v, q).orderBy("qid").collect()
    assert pairs[0].semantic == pytest.approx(u[0] @ u[5]) and pairs[1].semantic is None


def test_rrf(spark):
    leg = lambda ids: spark.createDataFrame([(1, d, i) for i, d in enumerate(ids, 1)], "qid long, doc_id long, rank int")
    got = fusion.rrf({"bm25": leg([5, 1, 2]), "vector": leg([1, 5, 9])}).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [5, 1, 2, 9]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 62) and got[0].parts == {"bm25": 1 / 61, "vector": 1 / 62}


def test_weighted_extremes(spark):
    pool = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate([(0.0, 9.0), (9.0, 0.0), (1.0, 1.0), (0.0, 0.0)])], "qid long, doc_id long, lexical double, semantic double")
    best = lambda a, n="minmax": fusion.weighted(pool, alpha=a, normaliser=n).where("rank = 1").first().doc_id
    assert (best(0.0), best(1.0), best(0.0, "zscore")) == (1, 0, 1)
    flat = pool.withColumn("lexical", F.lit(3.0)).withColumn("semantic", F.lit(0.1))
    assert {r.score for r in fusion.weighted(flat).collect()} == {0.0}
    with pytest.raises(ValueError):
        fusion.weighted(pool, normaliser="rank")


def brute_window(wanted, tokens):
    want = set(wanted)
    at = [i for i, t in enumerate(tokens) if t in want]
    if len(want) < 2 or len(at) < 2:
        return 0.0
    spans = [j - i + 1 for i in range(len(tokens)) for j in range(i, len(tokens)) if want <= set(tokens[i : j + 1])]
    return min(1.0, len(want) / min(spans)) if spans else 0.35 * len({tokens[i] for i in at}) / len(want)


def test_proximity_equals_brute_force(spark):
    r = random.Random(5)
    rows = [([r.choice("abcx") for _ in range(r.randint(0, 4))], [r.choice("abcdefg") for _ in range(r.randint(0, 14))]) for _ in range(300)]
    df = spark.createDataFrame(rows, "w array<string>, t array<string>")
    for x in df.select("w", "t", rerank.proximity(F.col("w"), F.col("t")).alias("p")).collect():
        assert x.p == pytest.approx(brute_window(x.w, x.t)), x


def candidates(spark):
    rows = [(1, 10, 1, "garden roses spring", "Other", "Nothing to see here at all.", 0.1), (1, 11, 2, "garden roses spring", "Garden roses", "Garden roses bloom in spring.", 0.9)]
    return spark.createDataFrame(rows, "qid long, doc_id long, rank int, query string, title string, text string, vector_score double")


def test_local_reranker(spark):
    got = rerank.LocalReranker().rerank(candidates(spark)).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [11, 10] and got[0].reranked - got[1].reranked > 0.2
    assert got[0].rationale.startswith("coverage=1.00, ")


def test_judge(spark):
    def make():
        return lambda guide, schema, payload: {"verdicts": [{"index": p["index"], "relevance": 8 if "bloom" in p["text"] else 2, "reason": "r"} for p in payload["passages"]]}

    got = rerank.JudgeReranker(make, batch=1).rerank(candidates(spark), 5).orderBy("rank").collect()
    assert [(r.doc_id, r.reranked) for r in got] == [(11, 0.8), (10, 0.2)]
    with pytest.raises(Exception, match="refused"):
        rerank.JudgeReranker(lambda: lambda *a: None).rerank(candidates(spark)).collect()
    assert rerank.make_reranker("none") is None and isinstance(rerank.default_reranker(), rerank.LocalReranker)
    with pytest.raises(ValueError):
        rerank.make_reranker("other")


def test_chunker():
    text = "intro para\n\n# A\nbody a\n### Deep\nx\n```\n# not a heading\n```\n## B\n\n\n# C\nlast"
    assert [(t, n) for t, _, n in chunk.sections(text)] == [("", 1), ("A", 3), ("A > Deep", 5), ("C", 13)]
    para = lambda n, w: " ".join([w] * n)
    parts = [para(5, "a"), para(5, "b"), para(3, "c"), para(30, "d"), para(2, "e")]
    got = chunk.windows("\n\n".join(parts), 12, 4)
    # The three words of c fit the overlap and go on, and the next paragraph joins them whatever its length.
    assert got == ["\n\n".join(p) for p in (parts[:2], parts[2:3], parts[2:4], parts[4:])]


def test_chunk_table(spark):
    docs = spark.createDataFrame([("a/x.md", "a", "x", "# T\n" + "word " * 30), ("a/y.md", "a", "y", "few words"), ("b", "b", None, None)], "doc_id string, project string, title string, text string")
    got = chunk.numbered(chunk.chunk(docs)).collect()
    assert [(r.id, r.doc_id, r.title, r.start_line, r.n_tokens) for r in got] == [(0, "a/x.md", "x > T", 1, 30)]


@pytest.fixture(scope="module")
def topics(spark):
    r = random.Random(7)
    words = [[f"t{t}w{i}" for i in range(40)] for t in range(6)]
    shared = [f"s{i}" for i in range(12)]
    rows = [(i, " ".join(r.choice(words[i % 6] if r.random() < 0.7 else shared) for _ in range(r.randint(25, 80)))) for i in range(180)]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def test_lsa(spark, topics):
    model = lsa.fit(topics, dim=8)
    v = {r.doc_id: np.array(r.vec) for r in model.embed_documents(topics).collect()}
    assert len(v) == 180 and all(np.linalg.norm(x) == pytest.approx(1) for x in v.values())
    m = np.stack([v[i] for i in range(180)])
    same = np.equal.outer(np.arange(180) % 6, np.arange(180) % 6)
    s = m @ m.T
    assert s[same].mean() > 0.8 > 0.3 > s[~same].mean()
    # A text folds in where it lies as a document; an unknown one has no direction.
    q = topics.where("doc_id < 12").withColumnRenamed("doc_id", "qid").union(spark.createDataFrame([(99, "unknown")], "qid long, text string"))
    f = {r.qid: np.array(r.vec) for r in model.embed_queries(q).collect()}
    assert not f[99].any()
    assert all(f[i] @ v[i] > 0.999 for i in range(12))
    # Against the full decomposition of the same matrix.
    counts = lsa.term_counts(topics)
    w = lsa.tfidf(counts, model.terms).join(model.terms, "term").collect()
    a = np.zeros((180, model.components.shape[0]))
    for r in w:
        a[r.doc_id, r.term_id] = r.weight
    assert model.singular[:6] == pytest.approx(np.linalg.svd(a, compute_uv=False)[:6], rel=1e-2)


def test_graph_recall(spark, tmp_path):
    x = np.random.default_rng(7).standard_normal((900, 24))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "doc_id long, vec array<double>").cache()
    q = v.where("doc_id % 15 = 0").withColumnRenamed("doc_id", "qid")
    graph = ann.build(v, shards=3, ef=60)
    graph.save(str(tmp_path))
    graph = ann.load(spark, str(tmp_path))
    from tesselar.operators.metrics import neighbour_recall

    assert graph.shards == 3
    assert neighbour_recall(dense.search(v, q, k=10), graph.search(q, k=10, ef=64), 10).first().recall >= 0.9
    assert graph.nodes.select(F.max(F.transform("links", lambda x: F.size(x))[0])).first()[0] <= 2 * ann.M


def test_engine_modes_and_fallback(spark, docs, queries, tmp_path):
    chunks = docs.select("doc_id", F.lit("t").alias("title"), "text", F.col("doc_id").cast("string").alias("doc"), F.lit("p").alias("project"))
    engine = search.build(chunks, dim=4)
    engine.save(str(tmp_path))
    engine = search.load(spark, str(tmp_path))
    for mode in search.MODES:
        hits = engine.search(queries, mode=mode, k=3).collect()
        assert all(r.terms and r.snippet for r in hits if r.bm25 > 0)
        assert {r.qid for r in hits} <= {1, 2} and {r.doc_id for r in hits if r.qid == 1 and r.rank == 1} <= {1, 4}
    zero = spark.createDataFrame([(1, [0.0] * 4), (2, [0.0] * 4)], "qid long, vec array<double>")
    hits = engine.search(queries, mode="hybrid", k=3, query_vectors=zero).collect()
    lex = {(r.qid, r.rank): r.doc_id for r in top(engine.index.score(queries), 3).collect()}
    assert hits and all(r.dense_fallback for r in hits) and {(r.qid, r.rank): r.doc_id for r in hits} == lex
    hits = engine.search(queries, k=2, reranker=rerank.LocalReranker(engine.index.terms())).collect()
    assert all(r.reranked == r.score and r.terms and r.snippet for r in hits if r.bm25 > 0)
    with pytest.raises(ValueError):
        engine.search(queries, mode="best")


def test_masking_takes_the_sentence_out(spark):
    text = "Some words stand here first. The quick brown fox jumps over the\nlazy dog near the quiet river bank. And more follows."
    chunks = spark.createDataFrame([(1, "", text), (2, "", "nothing")], "doc_id long, title string, text string")
    for variant in evaluate.VARIANTS:
        q = evaluate.ict_queries(chunks, variant=variant, seed=3)
        masked = {r.doc_id: r.text for r in evaluate.mask(chunks, q).collect()}
        assert q.count() == 1 and "quick brown fox" not in masked[1] and "And more follows." in masked[1] and masked[2] == "nothing"
    with pytest.raises(ValueError):
        evaluate.ict_queries(chunks, variant="other")


def test_vector_functions(spark):
    r = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(V.norm(F.col("v")).alias("n"), V.is_zero(F.col("v")).alias("z"), V.l2_normalise(F.col("v")).alias("u")).collect()
    assert (r[0].n, r[0].z, r[0].u) == (5.0, False, [0.6, 0.8]) and r[1].z and r[1].u == [0.0, 0.0]


def test_registered_lsa_has_the_default_dimensions():
    assert {catalog.LSA_DIM} == {inspect.signature(f).parameters["dim"].default for f in (lsa.fit, search.build)}


def test_semantic_leg_scores_what_only_terms_nominate(spark):
    lex = spark.createDataFrame([(1, 10, 2.0), (1, 11, 1.0), (2, 11, 3.0)], "qid long, doc_id long, score double")
    v = spark.createDataFrame([(10, [0.6, 0.8]), (11, [0.0, 1.0]), (12, [1.0, 0.0])], "doc_id long, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "qid long, vec array<double>")
    sem = evaluate.semantic_leg(lex, v, q, depth=1)
    assert sorted((r.qid, r.doc_id, round(r.score, 9)) for r in sem.collect()) == [(1, 10, 0.6), (1, 12, 1.0), (2, 11, 3.0)]
    runs = evaluate.modes(lex, sem, alphas=[0.5], depth=1, which=("vector",))
    assert sorted((r.qid, r.doc_id) for r in runs["vector"].collect()) == [(1, 12), (2, 11)]


def test_parameter_grid_gives_on_what_can_be_best(spark, docs, queries):
    ix, grid = lexical.build(docs), [(0.9, 0.4), (1.5, 0.75), (2.0, 0.0)]
    every = {(r.k1, r.b, r.qid, r.doc_id): r.score for r in ix.score_grid(queries, grid).collect()}
    some = {(r.k1, r.b, r.qid, r.doc_id): r.score for r in ix.score_grid(queries, grid, k=1).collect()}
    assert some and all(every[x] == pytest.approx(v) for x, v in some.items())
    assert all(any(x[:3] == y[:3] and some[y] == pytest.approx(v) for y in some) for x, v in every.items() if v == max(w for z, w in every.items() if z[:3] == x[:3]))


def test_frequencies_of_wanted_terms(spark, docs, tmp_path):
    ix = lexical.build(docs)
    ix.save(str(tmp_path))
    wanted = spark.createDataFrame([("roses",), ("garden",), ("garden",), ("unknown",)], "term string")
    for index in (ix, lexical.load(spark, str(tmp_path))):
        assert {(r.term, r.df) for r in index.terms(wanted).collect()} == {("roses", 2), ("garden", 2)}
        assert index.frequencies().count() == ix.postings.select("term").distinct().count()
    ix.release()
    assert not ix.postings.is_cached


def test_spreading_starts_no_job(spark, docs):
    shuffled = docs.groupBy("doc_id").agg(F.first("text").alias("text"))
    spark.sparkContext.setJobGroup("spread", "")
    spread(shuffled, "doc_id")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("spread")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs
    assert spread(docs).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_chunks_are_numbered_across_ranges(spark):
    r = random.Random(2)
    rows = [(f"d{r.randrange(60)}", r.randrange(4), r.randrange(4)) for _ in range(400)]
    rows = sorted(set(rows))
    got = chunk.numbered(spark.createDataFrame(rows, "doc_id string, section int, window int").repartition(5)).collect()
    assert [(x.doc_id, x.section, x.window) for x in sorted(got, key=lambda x: x.id)] == rows and sorted(x.id for x in got) == list(range(len(rows)))


def test_passages_meet_the_documents_that_contain_them(spark, tmp_path):
    text = ["alpha beta gamma delta", "xalpha beta gammax", "alpha  beta gamma", "one", "", None, "gamma delta one two"]
    spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    asked = ["alpha beta gamma", "gamma delta", "one", "beta gamma delta", "no such thing"]
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.qid, r.doc_id) for r in catalog.qrels(spark, str(tmp_path)).collect()}
    assert got == {(q, i) for q, a in enumerate(asked) for i, t in enumerate(text) if t and a in t} and len(got) == 7


def test_embedders_by_name(spark, docs):
    def make():
        return lambda texts, kind: [[float(len(t)), 1.0 if kind == "query" else 2.0] for t in texts]

    st = search.make_embedder("st:some/model", dim=2, make_client=make)
    q = spark.createDataFrame([(1, "abc")], "qid long, text string")
    n = len(search.QUERY_PREFIX) + 3
    assert st.dim == 2 and st.embed_queries(q).first().vec == pytest.approx([n / math.hypot(n, 1), 1 / math.hypot(n, 1)])
    assert {search.make_embedder(x).dim for x in ("openai", "voyage")} == {1024} and search.make_embedder("st:m").name == "st:m"
    assert search.make_embedder("lsa", docs=docs, dim=3).dim == 3
    for bad in ("other", "st:", "lsa"):
        with pytest.raises(ValueError):
            search.make_embedder(bad)


def test_ablation_with_a_reranker(spark, docs):
    chunks = docs.where("text <> ''").select("doc_id", F.lit("").alias("title"), "text")
    q = spark.createDataFrame([(0, "cat sat mat", 0), (1, "garden roses dogs", 1), (4, "tulips spring", 0)], "qid long, text string, target long")
    lex = lexical.build(chunks).score(q)
    got = {r.system: r for r in evaluate.ablation(lex, lex, q, alphas=(0.5,), reranker=rerank.LocalReranker(), chunks=chunks, rerank_depth=2).collect()}
    assert set(got) == {"bm25", "vector", "rrf", "hybrid_0.5", "hybrid_0.5 + local"}
    last = got["hybrid_0.5 + local"]
    assert last.ceiling == pytest.approx(2 / 3) and last.recall_at_1 == pytest.approx(2 / 3) and got["bm25"].ceiling is None
    with pytest.raises(ValueError):
        evaluate.ablation(lex, lex, q, reranker=rerank.LocalReranker())


def test_graph_fidelity_and_times(spark):
    x = np.random.default_rng(3).standard_normal((300, 8))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "doc_id long, vec array<double>").cache()
    q = v.where("doc_id < 10").withColumnRenamed("doc_id", "qid").union(spark.createDataFrame([(99, [0.0] * 8)], "qid long, vec array<double>"))
    got = evaluate.ann_crossover({"small": (v, q)}, efs=(16, 256), ef_build=40, shards=2).orderBy("ef").collect()
    assert [(r.dataset, r.ef, r.n_docs, r.n_queries, r.n_zero, r.dim) for r in got] == [("small", e, 300, 10, 1, 8) for e in (16, 256)]
    assert got[1].recall >= 0.95 and all(r.ms > 0 and r.speedup == pytest.approx(r.exact_ms / r.ms) for r in got)
    with pytest.raises(ValueError):
        evaluate.measure_ann(v, q.where("qid = 99"))


def test_stemming_compared(spark, docs):
    q = spark.createDataFrame([(1, "indexing engine"), (2, "garden rose")], "qid long, text string")
    judged = spark.createDataFrame([(1, 2, 1), (2, 4, 1)], "qid long, doc_id long, rel int")
    r = evaluate.stemming(docs, q, judged, iterations=200).first()
    assert r.vocab_stemmed < r.vocab_plain and r.ndcg10_stemmed > r.ndcg10_plain and r.delta == pytest.approx(r.ndcg10_stemmed - r.ndcg10_plain) and r.n == 2


def test_verdicts_of_a_report(spark):
    frame = spark.createDataFrame
    reports = {
        "significance": frame([("hybrid", 0.02, 0.01), ("rrf", 0.0, 0.6)], "mode string, delta double, p_value double"),
        "sweep": frame([(0.2, 0.7), (0.4, 0.71)], "alpha double, ndcg double"),
        "means": frame([("bm25", 10, 0.670), ("vector", 10, 0.74)], "mode string, k int, ndcg double"),
    }
    said = cli.verdicts(spark, "scifact", reports, "bge-base-en-v1.5")
    assert "p = 0.010, significant" in said[0] and "not significant" in said[1] and "0.4: 0.7100" in said[2]
    assert "-0.0090; published values lie 0.014 apart" in said[3] and "-0.0004" in said[4]


@pytest.mark.parametrize("name", ["chunk_sections", "ict_hard", "ict_keyword", "rerank_local", "search_rrf", "bm25_stemmed_topk", "bm25_param_grid"])
def test_queries_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(catalog.ORACLES[name])
    got = [tuple(r[c] for c in want.columns) for r in catalog.QUERIES[name](spark, sf_dir).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr) and got


def test_index_for_known_queries(spark, docs):
    r = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["a.b", "x-y_z", "Ünï", "the"]
    texts = [" ".join(r.choices(words, k=r.randint(0, 30))) for _ in range(400)] + [None, TEXTS[0], TEXTS[0]]
    rows = list(enumerate(texts)) + [(5, texts[5]), (400, "")]
    many = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame([(i, " ".join(r.choices(words, k=4))) for i in range(30)] + [(30, "b"), (31, None), (32, "zzz")], "qid long, text string")
    grid = [(0.6, 0.3), (1.5, 0.75)]
    for stem in (False, True):
        whole, some = lexical.build(many, stem=stem, keep=False), lexical.asked(many, q, stem=stem)
        near = lambda df: {(x.qid, x.doc_id): (round(x.score, 9), x.rank) for x in df.collect()}
        assert near(some.best(q, 7)) == near(whole.best(q, 7)) and near(some.best(q.where("qid < 3"), 500)) == near(whole.best(q.where("qid < 3"), 500))
        pairs = whole.best(q, 3)
        terms = lambda ix: {(x.qid, x.doc_id, x.place, x.term, round(x.contrib, 9)) for x in ix.explain(q, pairs).collect()}
        assert terms(some) == terms(whole)
        assert {(x.term, x.df, round(x.idf, 9)) for x in some.terms(some.query_terms(q)).collect()} == {(x.term, x.df, round(x.idf, 9)) for x in whole.terms(whole.query_terms(q)).collect()}
        best = lambda ix: {(x.k1, x.b, x.qid, x.doc_id, x.rank) for x in ranked(ix.score_grid(q, grid, k=3), ["k1", "b", "qid"], F.round("score", 9).desc(), F.col("doc_id").asc(), k=3).collect()}
        assert best(some) == best(whole)
    known = {(x.term, x.df) for x in lexical.vocabulary(many).collect()}
    assert known == {(x.term, x.df) for x in lexical.build(many, keep=False).frequencies().collect()}


def test_known_queries_move_no_texts(spark, sf_dir):
    """Neither tokens nor postings are shuffled or held, and texts go to no join."""
    for name in ("bm25_topk", "weighted_fusion_minmax", "bm25_param_grid", "bm25_stemmed_topk", "bm25_idf", "ndcg_at_k"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "InMemoryRelation" not in plan and "toks" not in "".join(x for x in plan.splitlines() if "SortMergeJoin" in x), name


def test_first_sentences_are_the_first_eligible(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "No prose; x == y. " * 30 + "The old man and the young woman were walking along the river bank yesterday.")], "doc_id long, text string"))
    first = {r.doc_id: (r.pos, r.sentence) for r in evaluate.first_sentences(rows).where("pos IS NOT NULL").collect()}
    assert first == {r.doc_id: (r.pos, r.sentence) for r in evaluate.pick(evaluate.eligible_sentences(rows), seed=None).collect()} and first


def test_judgements_against_containment(spark, tmp_path):
    texts = [(0, "one two three four"), (1, "a\tone two  three b"), (2, None), (3, ""), (4, "xone two three"), (5, "two")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(0, "one two three"), (1, "two"), (2, ""), (3, None), (4, "ne two  thr"), (5, "one two three")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(q, d) for q, p in asked for d, t in texts if p is not None and t is not None and p in t}
    found = catalog.qrels(spark, str(tmp_path))
    assert {(r.qid, r.doc_id) for r in found.collect()} == want
    assert "Exchange" not in found.select("qid", "doc_id")._jdf.queryExecution().executedPlan().toString() or "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_lsa_rows_come_from_texts(spark, docs):
    """Vocabulary and rows without a shuffle of counts are those of the counted terms, and repeated identifiers still make one document."""
    counts, n = lsa.term_counts(docs), len(TEXTS)
    vocab = lsa.vocabulary(counts, n, min_df=1).orderBy("term").toPandas()
    assert {(r.term, r.df) for r in lsa.document_frequencies(docs).collect()} == {(r.term, r.df) for r in counts.groupBy("term").agg(F.count("*").alias("df")).collect()}
    terms = spark.createDataFrame([(t, i, float(x)) for i, (t, x) in enumerate(zip(vocab["term"], vocab["idf"]))], "term string, term_id int, idf double")
    want = {r.doc_id: (r.at, pytest.approx(r.w)) for r in lsa.sparse(lsa.tfidf(counts, terms), terms).collect()}
    rows = lsa.weighted(docs, list(vocab["term"]), vocab["idf"].to_numpy(), unit=True)
    assert {r.doc_id: (r.at, r.w) for r in rows.collect() if r.at} == want
    assert "Window" not in rows._jdf.queryExecution().toString()
    twice = lsa.fit(docs, dim=2, min_df=1).embed_documents(docs.union(docs.where("doc_id = 1")))
    assert twice.count() == n


def test_products_of_lsa_are_computed_once(spark):
    assert "repartitionByRange" not in inspect.getsource(lsa._gram_times)
