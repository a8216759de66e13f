import json
import urllib.request

import pytest
from pyspark.sql import functions as F

from tesselar import cli, server
from tesselar.operators import evaluate, lexical, search
from tesselar.plans import baselines
from tesselar.sources import beir, files
from tesselar.streaming.search import search_stream


def corpus(folder):
    (folder / "notes" / ".hidden").mkdir(parents=True)
    (folder / "notes" / "node_modules").mkdir()
    (folder / "notes" / "a b+c-d.md").write_text("# Garden\n\n" + "roses and tulips grow in the garden near the old stone wall every spring " * 3)
    (folder / "notes" / "two_words.MD").write_bytes(b"# Search\n\nvector search \xff compares passages " + b"by cosine similarity of their embeddings " * 5)
    for name in ("blank.md", "skip.py", ".hidden/x.md", "node_modules/y.md", "draft-z.txt"):
        (folder / "notes" / name).write_text("  \n" if name == "blank.md" else "some text here " * 20)
    return str(folder / "notes")


def test_files(spark, tmp_path):
    root = corpus(tmp_path)
    got = {r.doc_id: r for r in files.read(spark, [root], exclude=("DRAFT",)).collect()}
    assert set(got) == {"notes/a b+c-d.md", "notes/two_words.MD"}
    assert got["notes/a b+c-d.md"].title == "a b+c d" and got["notes/two_words.MD"].project == "notes"
    assert "�" in got["notes/two_words.MD"].text
    assert [r.doc_id for r in files.read(spark, [root + "/skip.py"]).collect()] == ["skip.py"]
    assert files.read(spark, [root], max_files=1).count() == 1


def benchmark(folder, qrels="query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td2\t0\nq2\td5\t2.0\nq2\td5\t1\nq2\tbad\tx\nshort\n"):
    (folder / "qrels").mkdir(parents=True)
    (folder / "corpus.jsonl").write_text("\n".join(json.dumps(dict(_id=f"d{i}", text=f"text number w{i} of many", title=f"T{i}")) for i in range(1, 6)) + "\n\n")
    (folder / "queries.jsonl").write_text("\n".join(json.dumps({"_id": q, "text": t}) for q, t in (("q1", "w1"), ("q2", "w5"), ("q3", "none"))))
    (folder / "qrels" / "test.tsv").write_text(qrels)
    return str(folder)


def test_benchmark_loader(spark, tmp_path):
    folder = benchmark(tmp_path / "a")
    data = beir.load(spark, "nfcorpus", folder)
    assert data.documents.count() == 5 and {r.qid for r in data.queries.collect()} == {"q1", "q2"}
    assert {tuple(r) for r in data.qrels.collect()} == {("q1", "d1", 1), ("q1", "d2", 0), ("q2", "d5", 1)}
    cut = beir.load(spark, "nfcorpus", folder, max_docs=2)
    assert {r.qid for r in cut.queries.collect()} == {"q1"}
    with pytest.raises(ValueError, match="no text"):
        beir.load(spark, "nfcorpus", benchmark(tmp_path / "b", "q9\td1\t1\n"))
    with pytest.raises(KeyError):
        beir.load(spark, "unknown", folder)
    assert len(beir.REGISTRY) == 14 and beir.REGISTRY["msmarco"].split == "dev"
    assert {n for n, s in beir.REGISTRY.items() if s.drops_self_matches} == {"arguana", "quora"} and beir.SMALL_SUITE[-1] == "fiqa"


def test_baselines(spark):
    assert {r.dataset: round(r.spread, 3) for r in baselines.spread(spark).collect()}["arguana"] == 0.099
    got = baselines.compare(spark.createDataFrame([("scifact", 0.7), ("other", 0.1)], "dataset string, measured double"))
    assert {r.dataset: r.delta for r in got.collect()} == {"scifact": pytest.approx(0.021), "other": None}
    assert baselines.mean_absolute_deviation(got).first().n == 1 and baselines.published("msmarco") is None


def test_self_matches(spark):
    run = spark.createDataFrame([("q1", "q1", 9.0, 1), ("q1", "d2", 5.0, 2), ("q1", "d3", 1.0, 3)], "qid string, doc_id string, score double, rank int")
    assert [(r.doc_id, r["rank"]) for r in evaluate.drop_self(run).orderBy("rank").collect()] == [("d2", 1), ("d3", 2)]


def test_command_line_server_and_stream(spark, tmp_path, capsys):
    out = str(tmp_path / "index")
    cli.main(["index", corpus(tmp_path), "--out", out, "--min-tokens", "5", "--dim", "4", "--exclude", "draft"], spark)
    cli.main(["search", out, "garden roses", "--json", "-k", "2", "--rerank", "local"], spark)
    said = capsys.readouterr().out
    hits = json.loads(said[said.index("[\n") if "[\n" in said else said.index("[") :])
    assert hits[0]["title"] == "a b+c d > Garden" and hits[0]["terms"]
    engine = search.load(spark, out)
    web = server.serve_in_background(engine)
    get = lambda path: json.loads(urllib.request.urlopen(f"http://127.0.0.1:{web.server_port}{path}").read())
    assert get("/api/meta")["documents"] == 2
    assert get("/api/search?q=garden&mode=bm25")["hits"][0]["doc"] == "notes/a b+c-d.md"
    assert "error" in get("/api/search?q=x&mode=none")
    for path, status in (("/api/search?q=", 400), ("/nothing", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            get(path)
        assert e.value.code == status
    web.shutdown()
    queries = tmp_path / "queries"
    spark.createDataFrame([(1, "garden")], "qid long, text string").write.json(str(queries))
    stream = search_stream(engine, spark.readStream.schema("qid long, text string").json(str(queries)), str(tmp_path / "hits"), str(tmp_path / "check"), once=True, mode="bm25", k=3)
    stream.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "hits")).count() == 1


def test_run_dataset(spark, tmp_path):
    data = beir.load(spark, "nfcorpus", benchmark(tmp_path / "a"))
    docs = data.documents.select("doc_id", F.concat_ws("\n", "title", "text").alias("text"))
    lex = lexical.build(docs).score(data.queries)
    out = evaluate.run_dataset(data.qrels, lex, lex, depth=10, iterations=100)
    means = {(r["mode"], r.k): r for r in out["means"].collect()}
    assert means["bm25", 10].ndcg == 1.0 == means["hybrid", 10].mrr
    assert out["sweep"].count() == 11 and evaluate.best_alpha(out["sweep"]).first().alpha == 0.0
    assert {r["mode"] for r in out["significance"].collect()} == {"vector", "rrf", "hybrid"}
    path = str(tmp_path / "report.json")
    evaluate.write_report({"means": out["means"]}, path)
    assert "*" in evaluate.format_table(out["means"].where("k = 10")) and json.load(open(path))["means"]
    ix = lexical.build(docs)
    grid = evaluate.param_grid(ix, data.queries, data.qrels, k1s=(0.9, 1.5), bs=(0.4,))
    assert sorted((r.k1, r.b) for r in grid.collect()) == [(0.9, 0.4), (1.5, 0.4)]
