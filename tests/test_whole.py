"""Compact results against the pairs they stand for, listed one by one over whole tables."""

import math
import random
from collections import Counter
from pathlib import Path

import pytest

from paperloom.operators import graph as G
from paperloom.operators import testgen as T
from paperloom.plans import catalog
from paperloom.plans.network import _G
from test_queries import DATA, duck, normal  # noqa: F401

needs_tables = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")

#: Every chunk of a citing with every chunk of a cited paper.
WHOLE = _G + ", cce AS (SELECT DISTINCT a.chunk_id source, b.chunk_id target FROM cites JOIN cur_chunks a ON a.paper_id = src JOIN cur_chunks b ON b.paper_id = dst) "


def small(spark):
    chunks = spark.createDataFrame([("p1:0", "p1"), ("p1:1", "p1"), ("p2:0", "p2"), ("p2:1", "p2"), ("p2:2", "p2"), ("p2:3", "p2"), ("p3:0", "p3"), ("x", None)], "chunk_id string, paper_id string")
    cite = spark.createDataFrame([("p1", "p2"), ("p2", "p1"), ("p3", "p2"), ("p3", "gone")], "src string, dst string")
    return chunks, cite


def test_counted_links_equal_listed_ones(spark):
    chunks, cite = small(spark)
    assert G.count_cites_chunk_edges(chunks, cite).first()["n"] == G.cites_chunk_edges(chunks, cite).count() == 20
    assert G.count_cites_chunk_edges(chunks.limit(0), cite).first()["n"] == 0


@needs_tables
def test_graph_summary_counts_every_link(spark, duck):  # noqa: F811
    got = {r["measure"]: r["n"] for r in catalog.queries()["graph_summary"](spark, str(DATA)).collect()}
    assert got["links:cites"] == duck.execute(WHOLE + "SELECT count(*) FROM cce").fetchone()[0] > 5000


def test_compact_links_hold_every_pair(spark, rows):
    chunks, cite = small(spark)
    compact = G.compact_links(G.paper_pairs(chunks, cite), chunks)
    every = rows(G.cites_chunk_edges(chunks, cite))
    assert rows(G.listed_links(compact).select("source", "target")) == every and len(every) == 20
    assert compact.where("kind = 'cites'").agg({"n": "sum"}).first()[0] == 20
    for n in (1, 5, 9, 40):
        assert rows(G.first_cites_chunk_edges(chunks, cite, n)) == every[:n]


@needs_tables
@pytest.mark.parametrize("name", ["cites_chunk_edges", "cross_paper_links"])
def test_links_of_all_papers(spark, duck, name):  # noqa: F811
    got = catalog.queries()[name](spark, str(DATA))
    links = G.listed_links(got).select("source", "target").distinct()
    n, low, high, sources = duck.execute(WHOLE + "SELECT count(*), min(source || ' ' || target), max(source || ' ' || target), count(DISTINCT source) FROM cce").fetchone()
    found = links.selectExpr("count(*)", "min(source || ' ' || target)", "max(source || ' ' || target)", "count(DISTINCT source)").first()
    assert tuple(found) == (n, low, high, sources) and n > 5000
    assert got.where("kind = 'cites'").agg({"n": "sum"}).first()[0] == n


@needs_tables
def test_multi_hop_takes_the_first_links_of_all(spark, duck):  # noqa: F811
    first = duck.execute(WHOLE + ", d AS (SELECT source, target FROM cce a WHERE source < target OR NOT EXISTS (FROM cce b WHERE b.source = a.target AND b.target = a.source)) SELECT source || ',' || target FROM d ORDER BY source, target LIMIT 20").fetchall()
    assert [r["gold_chunk_ids"] for r in catalog.queries()["testgen_multi_hop"](spark, str(DATA)).orderBy("case_id").collect()] == [x for (x,) in first]


def test_entity_members_hold_every_edge(spark, rows):
    m = spark.createDataFrame([("a", "p", "X"), ("b", "q", "X"), ("c", "p", "X"), ("a", "p", "X"), ("a", "p", "Y"), ("c", "p", "Y"), ("d", None, "X")], "chunk_id string, paper_id string, entity string")
    got = G.shared_entity_members(m)
    assert rows(got) == [("X", "p", "a", 1), ("X", "p", "c", 1), ("X", "q", "b", 2)]
    assert rows(G.shared_entity_edges(got)) == rows(G.shared_entity_edges(m)) == [("a", "b", "X"), ("b", "c", "X")]


@needs_tables
def test_shared_entities_of_all_chunks(spark, duck):  # noqa: F811
    sql = _G + "SELECT a.entity, a.paper_id, a.chunk_id, count(*) n_linked FROM mentions a JOIN mentions b ON a.entity = b.entity AND a.paper_id <> b.paper_id GROUP BY ALL"
    df = catalog.queries()["shared_entity_edges"](spark, str(DATA))
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(["entity", "paper_id", "chunk_id", "n_linked"], duck.execute(sql).fetchall())


@needs_tables
def test_generated_questions_have_the_key_terms(spark):
    want = {r["chunk_id"]: r["terms"].split(",") for r in catalog.queries()["key_terms"](spark, str(DATA)).collect()}
    for r in catalog.queries()["testgen_cases"](spark, str(DATA)).collect():
        assert all(t in r["question"] for c in r["gold_chunk_ids"].split(",") for t in want.get(c, ["this topic"])) or "{" not in r["question"]


def test_key_terms_of_some_chunks_have_the_statistics_of_all(spark, rows):
    c = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(("alpha bravo charlie delta", "alpha bravo charlie", "alpha bravo", "alpha delta delta"))], "chunk_id string, text string")
    every = rows(T.key_terms(c))
    assert rows(T.key_terms(c, only=c.where("chunk_id = 'c0'"))) == [r for r in every if r[0] == "c0"] and [r[0] for r in every] == ["c0", "c1"]


def terms_by_hand(texts, skip=1, take=2):
    """Key terms of tokens, by the rule in plain Python."""
    df = Counter(t for x in texts for t in set(x))
    out = []
    for x in texts:
        tf = Counter(x)
        rank = lambda pool: sorted(pool, key=lambda t: (-round(tf[t] * math.log(1 + len(texts) / (df[t] + 0.5)), 6), t))  # noqa: B023, E731
        topic = [t for t in tf if len(t) >= 5 and t not in T.FUNCTION_WORDS]
        chosen = None
        for pool in ([t for t in topic if df[t] >= 2], topic, list(tf)):
            left = rank(pool)[skip : skip + take]
            if pool and len(left) >= min(take, len(pool)):
                chosen = left
                break
        out.append(chosen)
    return out


def test_key_terms_equal_the_rule_by_hand(spark):
    r = random.Random(3)
    words = ["alpha", "bravo", "could", "while", "delta", "echo", "fox", "golfing", "hotel", "india", "which"]
    texts = [[r.choice(words) for _ in range(r.randint(1, 9))] for _ in range(60)]
    df = spark.createDataFrame([(f"{i:02}", " ".join(t)) for i, t in enumerate(texts)] + [("e", ""), ("n", None)], "chunk_id string, text string")
    got = {x["chunk_id"]: x["terms"] for x in T.key_terms(df.limit(0).unionByName(df.where("text <> ''"))).collect()}
    want = {f"{i:02}": t for i, t in enumerate(terms_by_hand(texts)) if t}
    assert got == want and len(want) > 30
