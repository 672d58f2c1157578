import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import records, report, targets
from paperloom.sources import preparation as P

HOP = {
    "corpus": [{"title": "Alpha", "url": "http://a/", "body": "Graph walks find sparse trees in large networks of papers."}, {"title": "Beta", "url": "http://b", "body": "Ranking lists are fused by their ranks in a second step."}],
    "queries": [
        {"query": "What do graph walks find?", "question_type": "q", "answer": "sparse trees", "evidence_list": [{"fact": "Graph walks find sparse trees", "url": "http://a", "title": ""}, {"fact": "Ranking lists are fused", "url": "", "title": "beta"}]},
        {"query": "Nothing known?", "question_type": "q", "answer": "", "evidence_list": []},
    ],
}


def given(benchmark, file):
    return json.dumps(HOP[file.key]).encode()


def test_prepare_and_run(spark, tmp_path):
    root = str(tmp_path)
    assert not P.is_prepared(root, "multihop")
    made = P.prepare(spark, "multihop", root, ways=(lambda b, f: None, given))
    assert made.manifest["counts"] == {"chunks": 2, "papers": 2, "cases": 1, "cases_with_gold": 1} and P.is_prepared(root, "multihop")
    again = P.prepare(spark, "multihop", root, ways=())  # what is there is not fetched again
    assert again.manifest["raw_sha256"] == made.manifest["raw_sha256"]
    held = P.load_prepared(spark, root, "multihop")
    c = held.cases.first()
    assert len(c["gold_chunk_ids"]) == 2 and c["expected_scope"] == "global"
    docs = held.chunks.select(F.col("chunk_id").alias("doc_id"), "paper_id", "text")
    run = targets.run_suite(targets.LexicalTarget(docs), held.cases.withColumn("gold_triples", F.lit(None).cast("array<struct<subject string, predicate string, object string, chunk_id string, confidence double>>")), "retrieval")
    assert {r["metric"]: r["value"] for r in run.values.collect()}["recall@10"] == 0.5
    assert P.run_options(root, "multihop", "retrieval")["ks"] == [1, 3, 5, 10]
    assert P.prepare(spark, "multihop", root, limit=0, ways=()).manifest["counts"]["cases"] == 0


def test_a_missing_file_says_where_to_put_it(tmp_path, spark):
    def down(b, f):
        raise OSError("no network")

    with pytest.raises(P.AcquisitionError, match="no network") as e:
        P.acquire(P.REGISTRY["qasper"], str(tmp_path), (down,))
    assert str(P.raw_path(str(tmp_path), "qasper", "qasper")) in str(e.value)
    only = P.raw_path(str(tmp_path), "graph", "questions")
    only.parent.mkdir(parents=True)
    only.write_text("[]")
    assert set(P.acquire(P.REGISTRY["graph"], str(tmp_path), ())) == {"questions"}
    for call in (lambda: P.prepare(spark, "other", str(tmp_path)), lambda: P.run_options(str(tmp_path), "qasper", "extraction"), lambda: P.register(P.Benchmark("x", "none", ()))):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(FileNotFoundError):
        P.load_prepared(spark, str(tmp_path), "qasper")


def test_a_run_is_read_back(spark, tmp_path, rows):
    v = spark.createDataFrame([("1", "mrr", 1 / 3), ("2", "mrr", 1.0)], "case_id string, metric string, value double")
    tags = spark.createDataFrame([("1", "local")], "case_id string, tag string")
    report.write_run(str(tmp_path / "r"), {"run_id": "r"}, v, tags)
    manifest, agg, by_tag, values = report.read_run(spark, str(tmp_path / "r"))
    assert manifest == {"run_id": "r"} and rows(values) == rows(v) and rows(by_tag)[0][:2] == ("local", "mrr") and agg.first()["mean"] == pytest.approx(2 / 3, abs=1e-6)


def test_report_has_headline_and_failures(spark):
    v = spark.createDataFrame([("1", "mrr", 0.5), ("1", "recall@5", 1.0)], "case_id string, metric string, value double")
    empty = spark.createDataFrame([], "metric string, least double, most double, max_regression double")
    fails = spark.createDataFrame([("2", "http_503: busy"), ("1", None)], "case_id string, error string")
    out = report.render({"run_id": "r"}, v, spark.createDataFrame([("1", "t")], "case_id string, tag string"), empty, spark.createDataFrame([], "metric string, mean double"), failures=fails)
    assert "## Headline\n\n- recall@5: 1.0000\n- mrr: 0.5000" in out and "## Failures\n\n- 2: http_503: busy" in out


def test_payloads_under_any_name(spark, rows):
    df = spark.createDataFrame([("c1", "p", " ", "3", "t"), (None, "p", "x", "4", "t"), ("c2", None, "x", "bad", "")], "chunkId string, paper_id string, text string, chunkIndex string, content string")
    got = records.chunk_records(df)
    assert [tuple(r) for r in got.orderBy("chunk_id").collect()] == [("c1", "p", "t", None, 3, None), ("c2", None, "x", None, None, None)]
    assert json.loads(records.corpus_rows(got).orderBy("value").first()["value"]) == {"chunk_id": "c1", "paper_id": "p", "text": "t", "chunk_index": 3}


def test_scopes_of_vector_requests(spark):
    df = spark.createDataFrame([("p", True), ("q", None)], "paper_id string, in_global_corpus boolean")
    assert df.where(records.scope_filter("selected", "q")).count() == 1 and df.where(records.scope_filter("global")).count() == 1
    for scope, paper in (("selected", None), ("global", "p"), ("other", None)):
        with pytest.raises(ValueError):
            records.scope_filter(scope, paper)
