import pytest
from pyspark.sql import functions as F

from paperloom.functions.vectors import TermHashing
from paperloom.operators import indexing as I
from paperloom.operators.store import VersionedTable

PAPERS = "paper_id string, title string, authors array<string>, published_at timestamp, source_version string, content_hash string"
MD = "# Intro\n\nSome words of the paper on graphs.\n\n# References\n\n[1] arXiv:2001.00001 and arXiv:2401.00001"


def batch(spark):
    papers = spark.createDataFrame(
        [("arxiv:2401.00001", "T", ["A. One", " ", "B. Two"], None, "v1", "h"), ("arxiv:2401.00002", "", [], None, "v1", "h"), ("arxiv:2401.00003", "U", None, None, "v1", "h"), ("arxiv:2401.00004", "W", [], None, "v1", "h"), ("arxiv:2401.00005", "R", [], None, "v1", "h")], PAPERS
    ).withColumn("b", F.lit("clash"))
    bodies = spark.createDataFrame(
        [("arxiv:2401.00001", MD, None), ("arxiv:2401.00001", "old", None), ("arxiv:2401.00002", MD, None), ("arxiv:2401.00003", None, "HTTPError: 500"), ("arxiv:2401.00004", "  ", None), ("arxiv:2401.00005", "# References\n\n[1] x y z", None)], "paper_id string, text string, error string"
    )
    return papers, bodies


def test_outcomes_by_stage(spark, rows):
    load = I.plan_load(*batch(spark), base=True)
    got = {r["paper_id"][-1]: (r["ok"], r["stage"], r["error"], r["n_chunks"], r["n_points"], r["n_skipped"]) for r in load.outcomes.collect()}
    assert got == {"1": (True, None, None, 2, 1, 1), "2": (False, "graph", "missing: title", 2, 1, 1), "3": (False, "fetch", "HTTPError: 500", 0, 0, 0), "4": (False, "preprocess", "no chunks", 0, 0, 0), "5": (False, "vector", "nothing to embed", 1, 0, 1)}
    assert {r["paper_id"][-1] for r in load.papers.collect()} == {"1", "5"} and load.points.count() == 1 and all(r["in_global_corpus"] for r in load.points.collect())
    assert rows(load.cites) == [("arxiv:2401.00001", "arxiv:2001.00001")] and load.next_chunk.count() == 1
    assert [(r["author_order"], r["name"]) for r in load.authors.orderBy("author_order").collect()] == [(0, "A. One"), (2, "B. Two")]
    s = load.summary().first()
    assert (s["n_papers"], s["n_ok"], s["n_failed"], s["all_failed"], s["n_chunks"], s["n_points"]) == (5, 1, 4, False, 2, 1)
    assert dict(rows(I.outcome_counts(load.outcomes))) == {"written": 1, "graph": 1, "fetch": 1, "preprocess": 1, "vector": 1}
    empty = I.plan_load(*(x.limit(0) for x in batch(spark)))
    assert empty.outcomes.count() == 0 and empty.points.count() == 0


def test_a_global_paper_stays_global(spark):
    first = I.plan_load(*batch(spark), base=True)
    again = I.plan_load(*batch(spark), old_points=first.points)
    assert [r["in_global_corpus"] for r in again.points.collect()] == [True]


def test_single_paper_raises(spark):
    assert I.single_paper(*batch(spark), "arxiv:2401.00001").papers.count() == 1
    for p, why in (("arxiv:2401.00002", "graph"), ("nobody", "unknown")):
        with pytest.raises(ValueError, match=why):
            I.single_paper(*batch(spark), p)


def test_loads_are_idempotent_and_drop_stale_rows(spark, tmp_path, rows):
    tables = {n: VersionedTable(spark, str(tmp_path / n), k, 4) for n, k in I.KEYS.items()}
    papers, bodies = batch(spark)
    for _ in range(2):
        I.write_load(I.plan_load(papers, bodies, base=True), tables)
    assert tables["chunks"].read().count() == 3 and tables["points"].read().count() == 1 and tables["cites"].read().count() == 1
    p = {r["paper_id"]: (r["processing_status"], r["is_global"]) for r in tables["papers"].read().collect()}
    assert p["arxiv:2001.00001"] == ("reference_only", False) and p["arxiv:2401.00001"] == ("completed", True)
    short = spark.createDataFrame([("arxiv:2401.00001", "# Intro\n\nOther words now.", None), ("arxiv:2001.00001", "# Intro\n\nThe cited one, at last.", None)], "paper_id string, text string, error string")
    more = papers.drop("b").where("paper_id = 'arxiv:2401.00001'").unionByName(spark.createDataFrame([("arxiv:2001.00001", "C", [], None, "v1", "h")], PAPERS))
    I.write_load(I.plan_load(more, short), tables)
    assert rows(tables["chunks"].read().where("paper_id = 'arxiv:2401.00001'").select("text")) == [("Other words now.",)] and tables["chunks"].read().count() == 3
    p = {r["paper_id"]: (r["processing_status"], r["is_global"]) for r in tables["papers"].read().collect()}
    assert p["arxiv:2001.00001"] == ("completed", False) and p["arxiv:2401.00001"] == ("completed", True)


def test_two_writers_both_get_through(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"], 2)
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    other, real, met = VersionedTable(spark, t.path, ["k"], 2), t._claim, []

    def claim(number, line):
        if not met:
            met.append(1)
            other.upsert(spark.createDataFrame([(3, "c"), (1, "z")], "k int, v string"))
        return real(number, line)

    monkeypatch.setattr(t, "_claim", claim)
    t.upsert(spark.createDataFrame([(2, "y")], "k int, v string"))
    assert sorted(map(tuple, t.read().collect())) == [(1, "z"), (2, "y"), (3, "c")]


def test_seed_and_unseed(spark, rows):
    c = spark.createDataFrame([("p:0", "p", None, "one two", None, None), ("q:0", "q", 0, "three", "s", "New")], "chunk_id string, paper_id string, chunk_index int, text string, section string, title string")
    s = I.seed(c, spark.createDataFrame([("p", "q"), ("p", "p")], "source_paper_id string, target_paper_id string"), TermHashing(16))
    old = spark.createDataFrame([("p", "Old", "completed", False)], "paper_id string, title string, processing_status string, is_global boolean")
    merged = I.seeded_papers(old, s["papers"])
    assert rows(merged.select("paper_id", "title", "processing_status", "is_global")) == [("p", "Old", "completed", True), ("q", "New", "benchmark", True)]
    papers, chunks, n = I.unseed(merged, s["chunks"])
    assert rows(papers.select("paper_id")) == [("p",)] and rows(chunks.select("chunk_id")) == [("p:0",)] and n.first()["removed"] == 2
    assert s["cites"].count() == 1 and s["points"].count() == 2 and len(s["points"].first()["embedding"]) == 16


def test_links_need_both_nodes(spark, rows):
    nodes = spark.createDataFrame([("a", "n1"), ("b", "n2"), ("a", "n1"), (None, "n3")], "chunk_id string, node_id string")
    links = spark.createDataFrame([("a", "b", "cites", None), ("a", "x", "vector", 0.5), ("b", "a", "vector", 0.4)], "source string, target string, type string, score double")
    assert rows(I.inject_links(nodes, links)) == [("n1", "n2", "cites", 0.9), ("n2", "n1", "vector", 0.4)]
