from pyspark.sql import functions as F

from paperloom.operators import graph as G


def frames(spark):
    chunks = spark.createDataFrame([("p1:0", "p1", 0), ("p1:1", "p1", 1), ("p1:2", "p1", 25), ("p2:0", "p2", 0), ("p3:0", "p3", None), ("x", None, 1)], "chunk_id string, paper_id string, chunk_index int")
    edges = spark.createDataFrame([("p1", "p2"), ("p1", "p2"), ("p2", "p3"), ("p3", "p3"), ("p4", "p1"), ("p1", "gone")], "source_paper_id string, target_paper_id string")
    papers = spark.createDataFrame([(f"p{i}", f"t{i}") for i in range(1, 5)], "paper_id string, title string")
    return chunks, G.cites(edges), papers


def test_next_edges_do_not_depend_on_the_block_size(spark, rows):
    chunks, _, _ = frames(spark)
    want = [("p1:0", "p1:1"), ("p1:1", "p1:2")]
    assert rows(G.next_edges(chunks)) == want and rows(G.next_edges(chunks, block=1)) == want and rows(G.next_edges(chunks, block=10)) == want
    assert G.next_edges(chunks.limit(0)).count() == 0


def test_cites_and_stubs(spark, rows):
    _, cite, papers = frames(spark)
    assert rows(cite) == [("p1", "gone"), ("p1", "p2"), ("p2", "p3"), ("p4", "p1")]
    assert rows(G.stubs(cite, papers)) == [("gone", "gone", "reference_only")]


def test_expansion_goes_both_ways(spark, rows):
    chunks, cite, papers = frames(spark)
    seeds = chunks.where("chunk_id = 'p1:0'").select("chunk_id")
    assert rows(G.citation_expand(seeds, chunks, cite, papers)) == [("p1:0", "p1", "cited_by", "p4"), ("p1:0", "p1", "cites", "p2")]
    assert G.citation_expand(seeds, chunks, cite, papers, limit=1).count() == 1


def test_khop_equals_a_breadth_first_search(spark, rows):
    _, cite, _ = frames(spark)
    seeds = spark.createDataFrame([("p1",)], "seed string")
    assert rows(G.khop(seeds, cite, 1)) == [("p1", "gone", 1), ("p1", "p2", 1), ("p1", "p4", 1)]
    assert rows(G.khop(seeds, cite, 9)) == [("p1", "gone", 1), ("p1", "p2", 1), ("p1", "p3", 2), ("p1", "p4", 1)]


def test_subgraph_keeps_papers_without_children(spark, rows):
    chunks, cite, papers = frames(spark)
    authors = spark.createDataFrame([("p1", 0, "A")], "paper_id string, author_order int, name string")
    got = rows(G.subgraph(papers.where("paper_id IN ('p2', 'p4')"), papers, authors, chunks, cite))
    assert got == [("p2", "chunk", 0, "p2:0"), ("p2", "cites", 0, "p3"), ("p2", "paper", 0, "t2"), ("p4", "cites", 0, "p1"), ("p4", "paper", 0, "t4")]


def test_links(spark, rows):
    chunks, cite, _ = frames(spark)
    links = G.cites_chunk_edges(chunks, cite).withColumn("type", F.lit("cites"))
    assert rows(links.select("source", "target"))[:2] == [("p1:0", "p2:0"), ("p1:1", "p2:0")]
    more = spark.createDataFrame([("p1:0", "p1:1", "next", 0.5), ("p1:0", "p1:1", "next", 0.1), ("a", "a", "next", 1.0)], "source string, target string, type string, score double")
    merged = G.merge_links(links, more)
    assert merged.where("type = 'next'").count() == 1
    assert dict(rows(G.graph_summary(chunks, merged)))["links across papers"] == 4
    assert rows(G.cross_paper_links(more, chunks)) == []


def test_shared_entities(spark, rows):
    m = spark.createDataFrame([("a", "p", "X"), ("b", "q", "X"), ("c", "p", "X"), ("a", "p", "X")], "chunk_id string, paper_id string, entity string")
    assert rows(G.shared_entity_edges(m)) == [("a", "b", "X"), ("b", "c", "X")]
    seeds = spark.createDataFrame([("a",)], "chunk_id string")
    assert rows(G.entity_expand(seeds, m)) == [("a", "q", 1)]
