import pytest
from pyspark.sql import functions as F

from paperloom.operators import metrics as M

CASE = "case_id string, ranked array<string>, papers array<string>, gold_chunk_ids array<string>, gold_paper_ids array<string>, grades map<string,int>, expected_scope string, scope string"


def values(df, case="c"):
    return {r["metric"]: r["value"] for r in df.where(F.col("case_id") == case).collect()}


def retrieval(spark, ranked, gold=(), grades=None, **more):
    row = ("c", ranked, more.get("papers"), list(gold), more.get("gold_papers"), grades, more.get("expected", "unknown"), more.get("scope", "global"))
    return values(M.retrieval_metrics(spark.createDataFrame([row], CASE)))


def test_recall_precision_and_rank(spark):
    v = retrieval(spark, ["c1", "c2", "c3", "c4"], ["c1", "c4"])
    assert v["recall@3"] == 0.5 and v["recall@5"] == 1.0 and v["precision@5"] == 0.4 and v["hit@1"] == 1 and v["mrr"] == 1.0
    assert v["ap"] == pytest.approx((1 + 2 / 4) / 2)
    v = retrieval(spark, ["a", "b", "g"], ["g"])
    assert v["mrr"] == pytest.approx(1 / 3, abs=1e-6) and v["precision@5"] == 0.2
    assert retrieval(spark, ["a"], ["g"])["mrr"] == 0


def test_not_applicable_is_left_out(spark):
    v = retrieval(spark, None)
    assert "recall@5" not in v and "ndcg@5" not in v and "routing.accuracy" not in v and v["precision@5"] == 0


def test_ndcg_prefers_the_better_grade_first(spark):
    best = retrieval(spark, ["c1", "c2"], grades={"c1": 3, "c2": 1})["ndcg@5"]
    swapped = retrieval(spark, ["c2", "c1"], grades={"c1": 3, "c2": 1})["ndcg@5"]
    assert best == 1.0 and 0 < swapped < 1


def test_routing_and_papers(spark):
    v = retrieval(spark, ["a"], papers=["p", "q"], gold_papers=["q"], expected="selected", scope="global")
    assert v["paper_hit@5"] == 1 and v["routing.accuracy"] == 0


def test_generation(spark):
    row = ("c", "what is graph search", "Graph search walks edges", ["graph search walks", ""], "graph search walks nodes", ["a", "b"], ["a", "c"], ["a", "c"], ["GRAPH", "missing"])
    s = "case_id string, question string, answer string, evidence array<string>, gold_answer string, citations array<string>, ranked array<string>, gold_chunk_ids array<string>, must_include array<string>"
    v = values(M.generation_metrics(spark.createDataFrame([row, ("e", "q", None, None, None, None, None, None, None)], s)))
    assert v["groundedness_lexical"] == 0.75 and v["answer_token_f1"] == 0.75 and v["citation_validity"] == 0.5 and v["citation_precision"] == 0.5 and v["citation_recall"] == 0.5
    assert v["must_include"] == 0.5 and v["has_citation"] == 1
    assert v["judge.relevance"] == 1.0
    e = values(M.generation_metrics(spark.createDataFrame([("e", "q", None, None, None, None, None, None, None)], s)), "e")
    assert e == {"has_citation": 0.0, "judge.faithfulness": 0.0, "judge.relevance": 0.0}


def test_triples_are_multisets(spark):
    t = "case_id string, subject string, predicate string, object string, chunk_id string"
    p = spark.createDataFrame([("c", "A", "uses", "B", "x"), ("c", "A", "uses", "B", None), ("c", "S", "likes", "T", "y")], t)
    g = spark.createDataFrame([("c", "a", "Uses", "b", None), ("c", "s", "has", "t", None)], t)
    v = values(M.triple_metrics(p, g))
    assert v["triple_precision"] == pytest.approx(1 / 3, abs=1e-6) and v["triple_recall"] == 0.5 and v["relaxed_recall"] == 1.0 and v["entity_coverage"] == 1.0
    assert v["evidence_attachment"] == pytest.approx(2 / 3, abs=1e-6)


def test_means_skip_nan_and_null(spark, rows):
    m = spark.createDataFrame([("a", "x", 1.0), ("b", "x", float("nan")), ("c", "x", 0.0), ("a", "y", float("nan"))], "case_id string, metric string, value double")
    assert rows(M.macro_mean(m)) == [("x", 0.5, 2)]
    tags = spark.createDataFrame([("a", "t"), ("a", "t"), ("c", "u")], "case_id string, tag string")
    assert rows(M.by_tag(m, tags)) == [("t", "x", 1.0, 1), ("u", "x", 0.0, 1)]


def test_operational(spark):
    r = spark.createDataFrame([(10.0, None), (20.0, None), (30.0, None), (99.0, "e")], "latency_ms double, error string")
    v = {x["measure"]: x["value"] for x in M.operational(r).collect()}
    assert v["latency_p50"] == 20 and v["error_rate"] == 0.25 and v["case_count"] == 4 and v["latency_max"] == 30
    assert {x["measure"] for x in M.operational(r.limit(0)).collect()} == {"case_count"}


def test_gates(spark):
    rules = spark.createDataFrame([("a", 0.5, None, None), ("b", None, 0.1, None), ("c", None, None, 0.03), ("latency", None, None, 1.0), ("z", 0.1, None, None)], "metric string, least double, most double, max_regression double")
    agg = spark.createDataFrame([("a", 0.5), ("b", 0.2), ("c", 0.5), ("latency", 5.0)], "metric string, mean double")
    base = spark.createDataFrame([("c", 0.53), ("latency", 3.0)], "metric string, mean double")
    assert {r["metric"]: r["reason"] for r in M.gates(rules, agg, base).collect()} == {"a": "ok", "b": "above maximum", "c": "ok", "latency": "regression", "z": "missing"}


def test_ranks(spark):
    df = spark.createDataFrame([([(2, "b"), (1, "a"), (3, "a")],), ([(None, "b"), (1, "a"), (2, "b")],)], "r array<struct<rank:int,chunk_id:string>>")
    assert [r[0] for r in df.select(M.resolve_ranks(F.col("r"))).collect()] == [["a", "b"], ["b", "a"]]


def test_percentiles_equal_numpy(spark):
    import numpy as np

    g = np.random.default_rng(5)
    for values in (g.normal(size=501).tolist(), [3.0] * 7 + [1.0, 2.0], [4.0]):
        df = spark.createDataFrame([(x,) for x in [*values, None, float("nan")]], "v double").repartition(3)
        got = M.percentiles(df, "v", (0.0, 0.5, 0.95, 1.0))
        assert got == pytest.approx({q: float(np.quantile(values, q)) for q in got})
    assert M.percentiles(df.limit(0), "v", (0.5,)) == {0.5: None}
