import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom.operators import chunking as C
from paperloom.operators import quality, store, testgen
from paperloom.operators.evidence import conversion_report, match_evidence
from paperloom.streaming.incremental import load_incrementally, windowed_latency


def test_upsert_twice_changes_nothing(spark, rows):
    t = spark.createDataFrame([("a", "old", 1, True), ("b", "old", 1, False), (None, "old", 1, False)], "k string, v string, made int, flag boolean")
    u = spark.createDataFrame([("a", "new", 2, False), ("c", "new", 2, True), ("c", "newer", 2, True)], "k string, v string, made int, flag boolean")
    once = store.merge_upsert(t, u, ["k"], keep=["made"], sticky=["flag"])
    assert rows(once) == [(None, "old", 1, False), ("a", "new", 1, True), ("b", "old", 1, False), ("c", "newer", 2, True)]
    assert rows(store.merge_upsert(once, u, ["k"], keep=["made"], sticky=["flag"])) == rows(once)
    assert rows(store.merge_upsert(t, u.limit(0), ["k"])) == rows(t)


def test_stale_rows_of_touched_owners_go(spark, rows):
    t = spark.createDataFrame([("p", "1"), ("p", "2"), ("q", "3")], "o string, k string")
    assert rows(store.delete_stale(t, spark.createDataFrame([("p", "1")], "o string, k string"), "o", "k")) == [("p", "1"), ("q", "3")]
    assert rows(store.replace_for(t, spark.createDataFrame([("p", "9")], "o string, k string"), "o")) == [("p", "9"), ("q", "3")]


def test_versioned_table_and_stream(spark, rows, tmp_path):
    t = store.VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=3)
    assert t.read() is None
    t.upsert(spark.createDataFrame([(i, "a") for i in range(20)], "k int, v string"))
    before = t.folders()
    t.upsert(spark.createDataFrame([(3, "b")], "k int, v string"))
    assert sum(before[b] != f for b, f in t.folders().items()) == 1
    assert rows(t.read()) == sorted([(i, "b" if i == 3 else "a") for i in range(20)], key=lambda r: str(r[0]))
    t.upsert(spark.createDataFrame([], "k int, v string"))
    assert t.read().count() == 20
    src = tmp_path / "in"
    spark.range(5).selectExpr("id AS k", "'x' AS v").write.parquet(str(src))
    for _ in range(2):
        load_incrementally(spark, str(src), "k bigint, v string", str(tmp_path / "s"), str(tmp_path / "c"), ["k"])
    assert store.VersionedTable(spark, str(tmp_path / "s"), ["k"]).read().count() == 5


def test_windows(spark, rows):
    e = spark.createDataFrame([("2024-01-01 01:00:00", "view", 1.0), ("2024-01-01 02:00:00", "error", 9.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp_ntz("ts"))
    assert rows(windowed_latency(e)) == [("2024-01-01", 2, 1, 1.0)]


def test_quality(spark, rows):
    d = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None)], "k string, v string")
    assert rows(quality.duplicate_keys(d, ["k"])) == [("a", 2)]
    assert rows(quality.outside(d, "v", ["y"])) == [(None, 1), ("x", 2)]
    assert rows(quality.dangling(d, "v", d, "k")) == [("x",)]
    assert rows(quality.childless(d, "k", d.where("k = 'a'"), "k")) == [("b",)]


MD = "Pre\n\nIntroduction\n------------\ntext\n\n```\ncode\n-----\n# no\n```\n\n- item\n---\n\n## **2 Method** ##\nbody\n\n# Empty\n\n# References\n[1] x"


def test_sections():
    assert [(t, level) for t, level, _ in C.sections(MD)] == [("Front Matter", 0), ("Introduction", 2), ("2 Method", 2), ("References", 1)]
    assert C.sections(None) == [] and C.sections("  \n") == []


def test_promotion_wants_a_late_mark():
    body = "word " * 200
    titles = lambda t: [title for title, _, _ in C.sections_with_references(t)]
    assert C.reference_mark("References\n" + body) is None and titles("References\n" + body) == ["Front Matter"]
    assert C.sections_with_references(body + "\nReferences\nA. B.")[-1] == ("References", 2, "A. B.")
    assert C.sections_with_references("x **References** [1] A\n" + body)[1] == ("References", 2, f"[1] A\n{body.strip()}")
    assert titles("# One\na\nBibliography [1] A\n\n# Two\nb") == ["One", "References", "Two"]
    assert titles("a References [1] x\nb references [2] y") == ["Front Matter", "References"] and C.sections_with_references("a References [1] x\nb references [2] y")[0][2].endswith("\nb")
    assert titles("```\nReferences [1] x") == ["Front Matter"] and titles(None) == []


@pytest.mark.parametrize("size", [40, 100])
def test_recursive_split_keeps_limits_and_text(size):
    text = "\n\n".join(" ".join(f"word{i}{j}." for j in range(12)) for i in range(6)) + " " + "y" * 250
    out = C.recursive_split(text, size, 10)
    assert all(0 < len(p) <= size for p in out)
    assert set("".join(text.split())) == set("".join("".join(out).split()))
    assert C.recursive_split("short", size, 10) == ["short"]


def test_chunks_and_plain_split(spark):
    c = C.chunk_papers(spark.createDataFrame([("p", MD), ("n", None), ("e", "")], "paper_id string, text string")).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in c] == list(range(len(c))) and c[-1]["is_references"] and all(r["char_count"] == len(r["text"]) for r in c)
    long = "z" * 3000
    assert [len(x) for x in C.split_text(long, 1200, 150)] == [1200, 1200, 900] and C.split_text("tiny") == [] and C.split_text(None) == []
    assert C.split_text("a" * 50 + "\n\n" + "b" * 50) == ["a" * 50 + "\n\n" + "b" * 50]


def test_evidence_tiers(spark, rows):
    c = spark.createDataFrame([("c1", "p", 0, "Graph search walks over edges."), ("c2", "q", 0, "Exact  Text"), ("c3", "p", 1, "short part"), ("c4", "p", 2, "")], "chunk_id string, paper_id string, chunk_index int, text string")
    e = spark.createDataFrame([("1", "p", "exact text"), ("2", "p", "search walks"), ("3", "p", "a very short part of it"), ("4", "p", "edges graph walks zzzz"), ("5", "p", "unrelated"), ("6", None, "GRAPH search"), ("7", "p", " "), ("8", "p", "FLOAT SELECTED: Table 1")], "evidence_id string, paper_id string, text string")
    m = match_evidence(e, c)
    assert rows(m.select("evidence_id", "chunk_id", "tier")) == [("1", "c2", 1), ("2", "c1", 2), ("3", "c3", 3), ("4", "c1", 4), ("6", "c1", 2)]
    assert rows(conversion_report(e, m)) == [(8, 5, 0.625, True)]
    assert rows(conversion_report(e.limit(0), m.limit(0))) == [(0, 0, 1.0, False)]


def test_generated_cases_are_stable(spark, rows):
    c = spark.createDataFrame([("p1:a", "p1", "kernel methods estimate density kernel"), ("p1:b", "p1", "kernel density functions everywhere"), ("p2:a", "p2", "sparse kernel density estimate")], "chunk_id string, paper_id string, text string")
    assert [r["chunk_id"] for r in testgen.round_robin(c, 3).orderBy("turn", "paper_id").collect()] == ["p1:a", "p2:a", "p1:b"]
    one = rows(testgen.single_hop(c, 2))
    assert one == rows(testgen.single_hop(c.repartition(3), 2)) and [x[3] for x in one] == [["p1:a"], ["p2:a"]]
    links = spark.createDataFrame([("p1:a", "p2:a", "cites", 0.5), ("p2:a", "p1:a", "cites", 0.9)], "source string, target string, type string, score double")
    m = rows(testgen.multi_hop(links, c, 5))
    assert len(m) == 1 and m[0][0] == "gen-mh-0000" and m[0][3] == ["p2:a", "p1:a"] and m[0][4] == ["p1", "p2"] and m[0][5] == {"p2:a": 3, "p1:a": 3}
    g = testgen.generate(links, c, 4, 0.5).collect()
    assert sorted(x["case_id"] for x in g) == ["gen-mh-0000", "gen-sh-0001", "gen-sh-0002", "gen-sh-0003"]
    assert testgen.split_sizes(5, 0.5) == (2, 3)
    assert isinstance(pd.DataFrame(m), pd.DataFrame)
