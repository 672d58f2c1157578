import json

import pytest
from pyspark.sql import functions as F

from paperloom.functions.vectors import TermHashing
from paperloom.operators import targets as T
from paperloom.plans import evaluation

CASES = "case_id string, question string, paper_id string, gold_chunk_ids array<string>, gold_paper_ids array<string>, grades map<string,int>, expected_scope string, gold_answer string, must_include array<string>, gold_triples array<struct<subject string, predicate string, object string, chunk_id string, confidence double>>, tags array<string>"
DOCS = [("a:0", "a", "Graph walks find sparse trees. They are short.", 0), ("a:1", "a", "Nothing of note here.", 1), ("b:0", "b", "Sparse trees are pruned early. Then they grow.", 2), ("b:1", "b", "Sparse trees are pruned early. Then they grow.", 3), ("c:0", "c", "Ranking of lists by scores.", 4)]


def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id string, paper_id string, text string, place int")


def cases(spark):
    return spark.createDataFrame(
        [
            ("1", "graph walks", "a", ["a:0"], ["a"], None, "selected", "Graph walks find sparse trees.", ["sparse"], [("graph walks", "FIND", "trees", "a:0", 0.9)], ["local"]),
            ("2", "sparse trees pruned", None, ["b:0", "b:1"], ["b"], {"b:1": 2}, "global", "", [], [], ["global"]),
            ("3", "zebra", "a", ["a:1"], ["a"], None, "unknown", None, None, None, []),
        ],
        CASES,
    )


def values(run):
    return {(r["case_id"], r["metric"]): round(r["value"], 4) for r in run.values.collect()}


def test_lexical_run_by_hand(spark):
    triples = spark.createDataFrame([("a:0", "Graph_Walks", "find", "trees", None)], "chunk_id string, subject string, predicate string, object string, confidence double")
    run = T.run_suite(T.build_target({"options": {"docs": corpus(spark), "triples": triples}}), cases(spark))
    v = values(run)
    assert v["1", "recall@1"] == v["1", "mrr"] == v["1", "routing.accuracy"] == v["1", "answer_token_f1"] == v["1", "must_include"] == v["1", "triple_f1"] == 1.0
    assert (v["2", "recall@1"], v["2", "recall@3"], v["2", "routing.accuracy"], v["2", "paper_hit@5"]) == (0.5, 1.0, 1.0, 1.0)
    assert v["3", "recall@5"] == v["3", "mrr"] == 0.0 and ("3", "routing.accuracy") not in v and v["3", "has_citation"] == 0.0
    r = {x["case_id"]: x for x in run.responses.collect()}
    assert r["1"]["ranked"] == ["a:0"] and r["1"]["scope"] == "selected" and r["1"]["answer"] == "Graph walks find sparse trees." and r["1"]["triples"][0]["confidence"] == 0.7
    assert r["2"]["ranked"] == ["b:0", "b:1", "a:0"] and r["3"]["ranked"] is None and r["3"]["answer"] == "" and r["3"]["scope"] == "global"
    agg = {x["metric"]: x["mean"] for x in run.aggregate().collect()}
    assert agg["operational.case_count"] == 3 and agg["operational.error_rate"] == 0 and agg["recall@3"] == pytest.approx(2 / 3)


def test_equal_scores_are_in_order_of_the_corpus(spark):
    back = corpus(spark).withColumn("place", -F.col("place"))
    r = T.LexicalTarget(back, order="place").respond(cases(spark)).where("case_id = '2'").first()
    assert r["ranked"] == ["b:1", "b:0", "a:0"]


def test_versions_in_force(spark):
    every = corpus(spark).withColumn("version", F.lit(1)).unionByName(corpus(spark).withColumn("version", F.lit(0)).withColumn("text", F.lit("graph walks zebra")))
    live = corpus(spark).select("doc_id", "paper_id", F.lit(1).alias("version"))
    a, b = (t.respond(cases(spark)).orderBy("case_id").collect() for t in (T.LexicalTarget(corpus(spark)), T.LexicalTarget(every.unionByName(every), live)))
    assert a == b


def test_suites_and_limits(spark):
    t = T.LexicalTarget(corpus(spark))
    kinds = {s: {m for _, m in values(T.run_suite(t, cases(spark), s, limit=1))} for s in T.SUITES}
    assert "mrr" in kinds["retrieval"] and "has_citation" not in kinds["retrieval"] and "triple_recall" in kinds["extraction"] and kinds["full"] >= kinds["retrieval"] | kinds["generation"] | kinds["extraction"]
    assert T.run_suite(t, cases(spark).limit(0)).values.count() == 0
    for call in (lambda: T.run_suite(t, cases(spark), "other"), lambda: T.build_target({"type": "other"})):
        with pytest.raises(ValueError, match="other"):
            call()


def test_hybrid_takes_neighbours(spark):
    e = TermHashing(64)
    points = corpus(spark).select(F.col("doc_id").alias("id"), e.udf()("text").alias("embedding"), F.col("paper_id").alias("grp"), F.lit(True).alias("is_global"))
    near = spark.createDataFrame([("b", "c"), ("c", "b")], "grp string, related string")
    r = {x["case_id"]: x for x in T.HybridTarget(points, near, corpus(spark).select(F.col("doc_id").alias("id"), "text"), e.udf(), top_k=2).respond(cases(spark)).collect()}
    assert r["1"]["ranked"][0] == "a:0" and r["1"]["scope"] == "selected" and set(r["2"]["ranked"]) == {"b:0", "b:1"} and len(r) == 3


def test_a_service_that_fails_is_an_error_row(spark):
    body = {"answer": "A.", "scope": "global", "citations": ["a:0", {"chunkId": "b:0"}, {"chunk_id": "c:0"}, ""], "retrieved": [{"chunkId": "b:0", "rank": 2, "text": "t2", "paperId": "b"}, {"chunk_id": "a:0", "rank": 1, "text": "t1", "paper_id": "a"}], "triples": [{"subject": "s", "predicate": "p", "object": "o", "chunkId": "a:0"}]}

    def ask(question, paper):
        if question == "zebra":
            raise OSError("down")
        return (200, json.dumps(body)) if paper == "a" else (503, "busy")

    run = T.run_suite(T.RemoteTarget(ask), cases(spark))
    r = {x["case_id"]: x for x in run.responses.collect()}
    assert r["1"]["ranked"] == ["a:0", "b:0"] and r["1"]["evidence"] == ["t2", "t1"] and r["1"]["citations"] == ["a:0", "b:0", "c:0"] and r["1"]["triples"][0]["chunk_id"] == "a:0" and r["1"]["error"] is None
    assert r["2"]["error"] == "http_503: busy" and r["3"]["error"].startswith("transport_error") and r["2"]["latency_ms"] is not None
    agg = {x["metric"]: x["mean"] for x in run.aggregate().collect()}
    assert agg["operational.error_rate"] == pytest.approx(2 / 3, abs=1e-6) and {c for c, _ in values(run)} == {"1"}
    bad = {x["case_id"]: x["error"] for x in T.RemoteTarget(lambda q, p: (200, "<html>" if p else "[1]")).respond(cases(spark)).collect()}
    assert all(e.startswith("invalid_json") for e in bad.values())


def test_a_judge_that_fails_does_not_apply(spark):
    def ask(question, evidence, answer):
        if question.startswith("sparse"):
            raise OSError("down")
        return {"faithfulness": 0.5, "relevance": 1, "note": "fine", "sure": True}

    run = T.run_suite(T.LexicalTarget(corpus(spark)), cases(spark), "generation", judge=T.HookJudge("hook", ask))
    v = {k: x for k, x in values(run).items() if k[1].startswith("judge.")}
    assert v == {("1", "judge.faithfulness"): 0.5, ("1", "judge.relevance"): 1.0, ("2", "judge.error"): 1.0, ("3", "judge.faithfulness"): 0.0, ("3", "judge.relevance"): 0.0}
    assert run.manifest["judge"] == "hook" and T.run_suite(T.LexicalTarget(corpus(spark)), cases(spark), "retrieval").manifest["judge"] is None


def test_a_run_writes_no_table_of_all_pairs(spark, monkeypatch):
    def pairs(*_, **__):
        raise AssertionError("all pairs")

    monkeypatch.setattr(T.lexical, "bm25_scores", pairs)
    r = {x["case_id"]: x["ranked"] for x in T.LexicalTarget(corpus(spark), top_k=2).respond(cases(spark)).collect()}
    assert r == {"1": ["a:0"], "2": ["b:0", "b:1"], "3": None}


def test_the_summary_of_a_run_needs_no_scores_of_all_pairs(spark, monkeypatch):
    monkeypatch.delattr(T.lexical, "bm25_scores")
    agg = {x["metric"]: x["mean"] for x in T.run_suite(T.LexicalTarget(corpus(spark)), cases(spark), "retrieval").aggregate().collect()}
    assert agg["operational.case_count"] == 3 and agg["recall@3"] == pytest.approx(2 / 3)


def test_the_summary_writes_rows_by_documents_and_not_by_pairs(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i:03}", i, "p", f"alpha beta w{i}", 3) for i in range(400)], "doc_id string, version int, paper_id string, text string, len int")
    told = spark.createDataFrame([(f"c-{50 * i}", f"alpha w{i}", "p", [f"d{i:03}"], ["p"], None, "selected", None, None, None, []) for i in range(20)], CASES)
    monkeypatch.setattr(evaluation, "corpus", lambda *_: (docs.drop("len"), docs.drop("text")))
    monkeypatch.setattr(evaluation, "cases", lambda *_: told)
    written = []

    def counted(df, cut=T.cut):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(T, "cut", counted)
    monkeypatch.setattr(T.lexical, "cut", counted)
    mean = {r["metric"]: r["mean"] for r in evaluation.run_bm25_summary(spark, "").collect()}
    assert mean["recall@1"] == mean["mrr"] == mean["routing.accuracy"] == 1.0 and mean["precision@10"] == 0.1 and mean["operational.case_count"] == 20
    assert 400 <= max(written) < 20 * 400 / 4
