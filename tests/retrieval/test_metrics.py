import math
import random

import pytest

from tesselar.operators import metrics

QRELS, RUN = "qid string, doc_id string, rel int", "qid string, doc_id string, score double"


def close(x):
    return pytest.approx(x, abs=1e-4)


def value(spark, qrels, ranking, k, metric):
    q = spark.createDataFrame([("q", d, r) for d, r in qrels.items()], QRELS)
    run = spark.createDataFrame([("q", d, float(-i)) for i, d in enumerate(ranking)], RUN)
    return metrics.per_query(q, run, (k,)).first()[metric]


def test_worked_by_hand(spark):
    binary, ranking = dict.fromkeys(("d1", "d2", "d3"), 1), "d1 x1 d2 x2 d3".split()
    assert value(spark, binary, ranking, 10, "ndcg") == close(0.8854)
    assert value(spark, binary, ranking, 10, "map") == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    assert value(spark, binary, ranking, 10, "precision") == pytest.approx(0.3)
    assert value(spark, binary, ["x", "d3"], 10, "mrr") == 0.5
    # Gains are linear, and the ideal counts all judgements, retrieved or not.
    assert value(spark, dict(zip("abcd", (2, 1, 2, 0))), list("bda"), 10, "ndcg") == close(0.5317)
    assert value(spark, {f"r{i}": 1 for i in range(10)}, ["r0"], 10, "ndcg") == close(0.2201)


def test_ties_go_by_name_descending(spark):
    run = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 1.0), ("q", "c", 2.0), ("q", "9", 0.0), ("q", "10", 0.0)], RUN)
    assert [r.doc_id for r in metrics.rank_documents(run).orderBy("rank").collect()] == ["c", "b", "a", "9", "10"]


def brute(qrels, run, k):
    order = sorted(run.items(), key=lambda x: (x[1], x[0]), reverse=True)[:k]
    rels = [qrels.get(d, 0) for d, _ in order]
    dcg = lambda rs: sum(max(r, 0) / math.log2(i + 2) for i, r in enumerate(rs))
    ideal = dcg(sorted(qrels.values(), reverse=True)[:k])
    n = sum(r > 0 for r in qrels.values())
    hits, ap = 0, 0.0
    for i, r in enumerate(rels, 1):
        if r > 0:
            hits += 1
            ap += hits / i
    rr = next((1 / i for i, r in enumerate(rels, 1) if r > 0), 0.0)
    return dcg(rels) / ideal if ideal else 0.0, hits / n if n else 0.0, hits / k, ap / n if n else 0.0, rr


def test_random_with_ties(spark):
    r = random.Random(11)
    qrels, runs = {}, {}
    for q in range(25):
        docs = [f"d{i}" for i in range(60)]
        qrels[f"q{q}"] = {d: r.randint(0, 3) for d in r.sample(docs, r.randint(1, 14))}
        runs[f"q{q}"] = {d: round(r.random(), 1) for d in r.sample(docs, r.randint(1, 39))}
    del runs["q3"]
    q = spark.createDataFrame([(k, d, v) for k, x in qrels.items() for d, v in x.items()], QRELS)
    run = spark.createDataFrame([(k, d, v) for k, x in runs.items() for d, v in x.items()], RUN)
    got = metrics.per_query(q, run, (1, 5, 10, 100)).collect()
    assert len(got) == 100
    for row in got:
        assert [row[m] for m in metrics.METRICS] == pytest.approx(brute(qrels[row.qid], runs.get(row.qid, {}), row.k)), row
    means = {m.k: m for m in metrics.evaluate(q, run, (10,)).collect()}
    assert means[10].n_queries == 25
    with pytest.raises(ValueError):
        metrics.evaluate(q.limit(0), run)


def test_bootstrap(spark):
    rows = lambda x, n=100, p="q": spark.createDataFrame([(f"{p}{i}", x) for i in range(n)], "qid string, ndcg double")
    same = metrics.paired_bootstrap(rows(0.5), rows(0.5), iterations=500).first()
    assert (same.delta, same.p_value, same.n) == (0.0, 1.0, 100)
    better = metrics.paired_bootstrap(rows(0.5), rows(0.7), iterations=1200).first()
    assert better.delta == pytest.approx(0.2) and better.p_value == 0.0
    assert metrics.paired_bootstrap(rows(0.5), rows(0.7, p="z"), iterations=500).first().n == 0


def test_single_target(spark):
    got = metrics.single_target(spark.createDataFrame([("a", 1, 1), ("b", None, 4), ("c", 3, 3)], "qid string, rank int, doc_rank int")).first()
    assert got.recall_at_1 == pytest.approx(1 / 3) and got.recall_at_5 == pytest.approx(2 / 3)
    assert got.mrr == pytest.approx((1 + 1 / 3) / 3) and got.doc_recall_10 == 1.0
