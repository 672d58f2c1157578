import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import similarity as S
from paperloom.operators.lexical import bm25_best, bm25_scores, extractive_answers, route, routed_hits, top_k


def points(spark, n=40, seed=3):
    r = np.random.default_rng(seed)
    m = r.normal(size=(n, 8)).round(3)
    df = spark.createDataFrame([(i, [float(x) for x in m[i]], i % 4, i % 2 == 0) for i in range(n)], "id bigint, embedding array<float>, grp int, is_global boolean").repartition(3)
    return df, m.astype(np.float32).astype(float)


@pytest.mark.parametrize(("scope", "skip"), [(None, None), ("selected", None), ("global", "self"), (None, "group")])
def test_search_equals_brute_force(spark, scope, skip):
    p, m = points(spark)
    q = p.where("id % 10 = 0").select(F.col("id").alias("query_id"), "embedding", "grp")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {(r["query_id"], r["id"]): r["rank"] for r in S.vector_scores(q, p, 3, scope, skip).collect()}
    want = {}
    for i in range(0, 40, 10):
        c = [j for j in range(40) if (scope != "selected" or j % 4 == i % 4) and (scope != "global" or j % 2 == 0) and (skip is None or j != i) and (skip != "group" or j % 4 != i % 4)]
        for k, j in enumerate(sorted(c, key=lambda j: (-round(float(u[i] @ u[j]), 6), j))[:3]):
            want[i, j] = k + 1
    assert got == want


def test_wrong_length_is_an_error_and_nulls_are_skipped(spark):
    p, _ = points(spark)
    q = p.limit(1).select(F.col("id").alias("query_id"), "embedding", "grp")
    more = spark.createDataFrame([(99, None, 0, True)], p.schema)
    assert S.vector_scores(q, p.unionByName(more), 50).count() == 40
    with pytest.raises(Exception, match="dimensions"):
        S.vector_scores(q, spark.createDataFrame([(1, [1.0], 0, True)], p.schema), 1).collect()


def test_store_variant_can_return_fewer(spark):
    p, _ = points(spark)
    q = p.where("id < 5").select(F.col("id").alias("query_id"), "embedding", "grp")
    assert S.knn_links(q, p, 3, -1.0).count() == 15
    assert S.knn_links(q, p, 3, -1.0, fetch_first=True).count() <= 15


def test_rrf(spark, rows):
    r = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 11, 1)], "query_id bigint, id bigint, rank int")
    assert [x[1] for x in rows(S.rrf(r).orderBy("rank"))] == [10, 11]
    assert S.rrf(r).orderBy("rank").first()["id"] == 11


def test_bm25_by_hand(spark):
    d = spark.createDataFrame([("d1", "graph graph search", "p"), ("d2", "search engine", "q"), ("d3", "", "p"), ("d4", None, "q")], "doc_id string, text string, paper_id string")
    q = spark.createDataFrame([("q", "graph graph", "p"), ("n", "nothing", "p")], "query_id string, text string, paper_id string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in bm25_scores(q, d).collect()}
    idf, avg = np.log(1 + (4 - 1 + 0.5) / 1.5), 5 / 4
    assert got == {("q", "d1"): pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg)), abs=1e-6)}
    assert {r["query_id"]: r["scope"] for r in route(bm25_scores(q, d), d, q).collect()} == {"q": "selected", "n": "global"}
    a = extractive_answers(top_k(bm25_scores(q, d)), d).collect()
    assert [(r["answer"], r["citations"]) for r in a] == [("graph graph search.", "d1")]


@pytest.mark.parametrize("skip", [None, "self", "group"])
def test_blocks_give_the_same_lists(spark, skip):
    p, _ = points(spark)
    p = p.unionByName(p.where("id = 3").withColumn("id", F.lit(99).cast("bigint")))  # a tie
    q = p.select(F.col("id").alias("query_id"), "embedding", "grp")
    one, many = (sorted(map(tuple, S.vector_lists(q, p, 3, S.SCOPES, skip, -0.5, query_block=n).collect())) for n in (4096, 7))
    assert one == many and {r[0] for r in one} == set(S.SCOPES) - ({"selected"} if skip == "group" else set())


def test_only_some_papers(spark):
    p, _ = points(spark)
    q = p.where("id = 0").select(F.col("id").alias("query_id"), "embedding", "grp")
    got = S.vector_lists(q, p, 50, papers=p.select("grp").where("grp IN (1, 2)"))
    assert {r["grp"] for r in got.collect()} == {1, 2} and got.count() == 20
    assert S.vector_lists(q.limit(0), p, 3).count() == 0 and S.vector_lists(q, p.limit(0), 3).count() == 0
    for bad in ({"k": 0}, {"k": 1, "scopes": ("none",)}):
        with pytest.raises(ValueError):
            S.vector_lists(q, p, **bad)


def test_best_scores_are_enough_for_hits_and_routes(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    docs = [(f"d{i:03}", f"p{i % 7}", " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 9])))) for i in range(300)]
    docs += [("n", "p1", None)]
    asked = [(f"q{i}", " ".join(r.choice([*vocab, "zebra"]) for _ in range(4)), r.choice(["p0", "p1", "gone", None])) for i in range(25)] + [("none", "", "p0")]
    d = spark.createDataFrame(docs, "doc_id string, paper_id string, text string").repartition(3)
    q = spark.createDataFrame(asked, "query_id string, text string, paper_id string")
    every = d.withColumn("version", F.lit(1)).unionByName(d.withColumn("version", F.lit(0)).withColumn("text", F.lit("w1 w2 w3")))
    live = d.select("doc_id", "paper_id", F.lit(1).alias("version"))
    whole = bm25_scores(q, d)
    for best in (bm25_best(q, d, k=3), bm25_best(q, every.unionByName(every), live, 3)):
        best = best.cache()
        assert best.count() < whole.count() / 4
        for made in (lambda s: top_k(s, 3), lambda s: route(s, d, q), lambda s: routed_hits(s, d, q, route(s, d, q), 3)):
            assert sorted(map(str, made(best).collect())) == sorted(map(str, made(whole).collect()))


def test_answers_come_without_the_scores_of_all_pairs(spark, monkeypatch):
    from paperloom.operators import lexical
    from paperloom.plans import search

    def pairs(*_, **__):
        raise AssertionError("all pairs")

    monkeypatch.setattr(lexical, "bm25_scores", pairs)
    assert search.bm25_extractive_answer(spark, "/root/testdata/sf0.01").count() == 2
