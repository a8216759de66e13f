"""Every operator and pipeline stage over nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import numpy as np
import pytest

from tesselar.llm import bpe, exact, fingerprint, hosts, lines, minhash, mixing, quality, shards, toxicity


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_exact(hostile):
    kept = exact.dedup(hostile)
    assert kept.columns == hostile.columns
    got = rows(kept)
    # Copies of 1 go, as do one empty text and the second row without identifier; nulls stay.
    assert len(got) == 18 - 4
    assert sorted(r[0] for r in got if r[0] is not None) == [1, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13, 13]
    assert all(r[5].startswith("key") and r[7].startswith("a") for r in got)
    assert sorted(rows(exact.find(hostile)), key=str) == [(2, 1), (2, 1), (5, 4), (None, None)]
    assert rows(exact.dedup(hostile.limit(0))) == [] == rows(exact.find(hostile.limit(0)))


def test_minhash(hostile):
    assert {(a, b) for a, b in rows(minhash.groups(hostile))} >= {(2, 1), (3, 1), (8, 7)}
    kept = minhash.dedup(hostile)
    assert kept.columns == hostile.columns
    ids = [r[0] for r in rows(kept)]
    assert ids.count(None) == 3 and {1, 4, 5, 6, 7, 9, 10, 12} <= set(ids) and not {2, 3, 8} & set(ids)
    assert rows(minhash.dedup(hostile.limit(0))) == []


def test_mixing(hostile):
    mixed = mixing.mix(hostile)
    assert mixed.columns == hostile.columns
    taken = rows(mixing.sample(hostile))
    assert mixed.count() == sum(r[3] for r in taken)
    assert all(r[3] >= 1 for r in taken)
    assert rows(mixing.mix(hostile.limit(0))) == [] == rows(mixing.sample(hostile.limit(0)))
    with pytest.raises(ValueError):
        mixing.mix(hostile, targets={"nowhere": 1.0}).count()
    with pytest.raises(ValueError):
        mixing.mix(hostile, targets={"s1": 0.0}).count()
    only = mixing.mix(hostile, targets={"s1": 1.0})
    assert {r[3] for r in rows(only)} == {"s1"}


def test_bpe(hostile):
    out = {(i, r.doc_id): r for i, r in enumerate(bpe.encode(hostile).collect())}
    assert len(out) == 18
    for (_, i), r in out.items():
        if i == 6:
            assert r.tokens is None and r.n_tokens is None and r.round_trip is None
        if i in (4, 5):
            assert r.tokens == [] and r.n_tokens == 0
        assert r.round_trip in (True, None)
    back = sorted(rows(bpe.decode(bpe.encode(hostile))), key=str)
    assert back == sorted(rows(hostile.select("doc_id", "text")), key=str)
    assert rows(bpe.encode(hostile.limit(0))) == []


def test_toxicity_and_quality(hostile, labels):
    for module, reject, score in ((toxicity, toxicity.reject, toxicity.score), (quality, None, quality.score)):
        model = module.fit(hostile, labels)
        scored = rows(score(hostile, model))
        assert len(scored) == 18
        assert all(r[1] is None for r in scored if r[0] == 6)
        none = module.fit(hostile, labels.limit(0))
        assert none is None
        assert all(r[1] is None for r in rows(score(hostile, none)))
        assert rows(score(hostile.limit(0), model)) == []
        if reject:
            assert reject(hostile, none).count() == 18
            kept = reject(hostile, model)
            assert kept.columns == hostile.columns and {None, 6} <= {r[0] for r in rows(kept)}


def test_empty_texts_have_the_thresholds_severity(hostile, labels):
    model = toxicity.fit(hostile, labels)
    by = {r.doc_id: r for r in toxicity.score(hostile, model).collect()}
    assert by[4].severity == by[5].severity == pytest.approx((1 / (1 + np.exp(model.thresholds))).sum(), abs=1e-6) and not by[4].toxic
    own = quality.fit(hostile, labels)
    assert {r.doc_id: r.score for r in quality.score(hostile, own).collect()}[4] == pytest.approx(own.bias, abs=1e-6)


def test_identifiers_that_arent_numbers(spark):
    docs = spark.createDataFrame([("d0", "one text", "s"), ("d1", "one text", "s")], "doc_id string, text string, source string")
    for run in (minhash.groups, exact.find, exact.dedup, lines.find, fingerprint.fingerprint, shards.assign):
        with pytest.raises(ValueError, match="whole number"):
            run(docs)
    assert mixing.mix(docs).count() >= 1


def test_lines(hostile):
    got = rows(lines.find(hostile))
    assert got and all(r[0] is not None or r[2] is not None for r in got)
    assert {r[0] for r in got} >= {2, 3, 8}
    assert rows(lines.find(hostile.limit(0))) == []


def test_fingerprint(hostile):
    got = fingerprint.fingerprint(hostile).collect()
    assert len(got) == 18
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[6].digest is None and by[4].digest == "" and by[9].n_features == 0
    assert by[8].linked_id == 7 and by[8].score > 90
    assert by[2].linked_id in (1, 3) and by[1].linked_id is not None
    assert rows(fingerprint.fingerprint(hostile.limit(0))) == []


def test_shards(hostile):
    got = rows(shards.assign(hostile, shards=3))
    named = [r for r in got if r[0] is not None]
    assert sorted(r[0] for r in named) == list(range(1, 14)) and len(got) == 13 + 3
    sizes = [sum(r[1] == s for r in named) for s in range(3)]
    assert max(sizes) - min(sizes) <= 1
    by = dict(named)
    assert by[1] == by[2] and by[7] == by[8]
    assert rows(shards.assign(hostile.limit(0))) == []


def test_hosts(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.example.com/x", "k"), (2, None, "k"), (3, "", "k"), (4, "no host", "k"), (5, "https://u:p@A.Example.com.:80/" + "y" * 100_000, None), (5, "https://u:p@A.Example.com.:80/", None), (None, "http://b.co.uk", "k"), (6, "http://localhost", "k")],
        "page_id long, url string, host string",
    )
    outcomes = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (None, 0), (6, None), (6, 7)], "page_id long, good int")
    got = hosts.decide(pages, outcomes).collect()
    assert len(got) == 8
    by = {r.page_id: r for r in got}
    assert by[2].host is None and by[2].keep and by[4].keep and by[3].domain is None
    assert by[5].host == "a.example.com" and by[5].domain == "example.com" and by[5].labelled == 3
    assert by[None].domain == "b.co.uk" and by[None].suffix == "co.uk"
    assert hosts.decide(pages.limit(0), outcomes).collect() == []
    assert all(r.keep and r.upper_bound is None for r in hosts.decide(pages, outcomes.limit(0)).collect())


def test_stages(spark, hostile, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    documents = hostile
    for start, least in ((documents, [14, 12, 10, 1, 1]), (documents.limit(0), [0] * 5)):
        docs = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            if k < 4:
                assert docs.columns == documents.columns, name
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert docs.count() >= least[k], (name, docs.count())
            assert least[k] or docs.isEmpty()
