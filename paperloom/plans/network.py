"""Graph and vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.vectors import TermHashing
from paperloom.operators import graph, similarity
from paperloom.plans.search import CASES, CHUNKS, PAPERS, asked, cases, current_chunks, current_papers
from paperloom.sources.tables import table


def _cites(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cites(table(spark, sf, "citation_edges"))


def _seed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select(F.explode("gold_chunk_ids").alias("chunk_id")).where(F.col("chunk_id").isNotNull()).distinct()


def _asked_papers(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("paper_id").where(F.col("paper_id").isNotNull()).distinct()


def _case_papers(spark: SparkSession, sf: str) -> DataFrame:
    """The papers of all cases, for look-ups."""
    return cases(spark, sf).select("paper_id").where(F.col("paper_id").isNotNull()).distinct()


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of the current chunks; they are read off the texts in the scan, which are not shuffled."""
    c = current_chunks(spark, sf, "paper_id", graph.entities_in(F.col("text")).alias("entities"))
    return c.select("chunk_id", "paper_id", F.explode("entities").alias("entity"))


def next_chunk_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.next_edges(current_chunks(spark, sf, "paper_id", "chunk_index"))


def cites_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _cites(spark, sf)


def citation_stub(spark: SparkSession, sf: str) -> DataFrame:
    return graph.stubs(_cites(spark, sf), current_papers(spark, sf, "title"))


def citation_expand(spark: SparkSession, sf: str) -> DataFrame:
    return graph.citation_expand(_seed_chunks(spark, sf), current_chunks(spark, sf, "paper_id"), _cites(spark, sf), current_papers(spark, sf, "title"))


def paper_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    authors = table(spark, sf, "authors").select("paper_id", "author_order", "name").distinct()
    return graph.subgraph(_case_papers(spark, sf), current_papers(spark, sf, "title"), authors, current_chunks(spark, sf, "paper_id", "chunk_index"), _cites(spark, sf))


def paper_nested(spark: SparkSession, sf: str) -> DataFrame:
    """The same with children as lists, of the asked papers."""
    authors = table(spark, sf, "authors").select("paper_id", "author_order", "name").distinct()
    n = graph.nested_subgraph(graph.subgraph(_asked_papers(spark, sf), current_papers(spark, sf, "title"), authors, current_chunks(spark, sf, "paper_id", "chunk_index"), _cites(spark, sf)))
    return n.select("paper_id", "title", F.array_join("authors", ";").alias("authors"), F.array_join("chunks", ";").alias("chunks"), F.array_join("citations", ";").alias("citations"))


def next_edges_within(spark: SparkSession, sf: str) -> DataFrame:
    """Sequence edges among the first chunks of each paper."""
    c = current_chunks(spark, sf, "paper_id", "chunk_index")
    return graph.within(graph.next_edges(c), graph.first_chunks(c, 3))


def chunk_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Links between chunks per kind, from the whole graph in compact form."""
    g = graph.chunk_graph(current_chunks(spark, sf, "paper_id", "chunk_index"), _cites(spark, sf), _mentions(spark, sf))
    return g.groupBy("type").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_links"))


def paper_exists(spark: SparkSession, sf: str) -> DataFrame:
    return graph.known(_case_papers(spark, sf), current_papers(spark, sf, "title"), "paper_id")


def khop_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return graph.khop(_asked_papers(spark, sf).withColumnRenamed("paper_id", "seed"), _cites(spark, sf))


def chunks_per_paper(spark: SparkSession, sf: str) -> DataFrame:
    return graph.first_chunks(current_chunks(spark, sf, "paper_id", "chunk_index"), 3).select("paper_id", "chunk_id", "position")


def cites_chunk_edges(spark: SparkSession, sf: str) -> DataFrame:
    """All of them, in compact form."""
    c = current_chunks(spark, sf, "paper_id")
    return graph.compact_links(graph.paper_pairs(c, _cites(spark, sf)), c)


def shared_entity_edges(spark: SparkSession, sf: str) -> DataFrame:
    """All of them, in compact form."""
    return graph.shared_entity_members(_mentions(spark, sf))


def entity_expand(spark: SparkSession, sf: str) -> DataFrame:
    return graph.entity_expand(_seed_chunks(spark, sf), _mentions(spark, sf))


def cross_paper_links(spark: SparkSession, sf: str) -> DataFrame:
    """The cites links between different papers, in compact form."""
    c = current_chunks(spark, sf, "paper_id")
    return graph.compact_links(graph.paper_pairs(c, _cites(spark, sf)).where(F.col("src") != F.col("dst")), c)


def graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    c = current_chunks(spark, sf, "paper_id", "chunk_index")
    nxt = graph.next_edges(c).select(F.col("left").alias("source"), F.col("right").alias("target"), F.lit("next").alias("type"))
    cite = graph.count_cites_chunk_edges(c, _cites(spark, sf)).select(F.lit("cites").alias("type"), "n")
    return graph.graph_summary(c, graph.merge_links(nxt), cite)


def research_flow(spark: SparkSession, sf: str) -> DataFrame:
    return graph.research_flow(_case_papers(spark, sf), _cites(spark, sf), current_papers(spark, sf, "title"))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("grp"), (F.col("label") % 2 == 0).alias("is_global"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf).where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "embedding", "grp")


def _near_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf).select("grp", F.pmod(F.col("grp") + 1, F.lit(10)).alias("related")).distinct()


def vector_topk_selected(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.vector_scores(_vectors(spark, sf), _points(spark, sf), 8, scope="selected")


def vector_topk_global(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.vector_scores(_vectors(spark, sf), _points(spark, sf), 8, scope="global")


def vector_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.vector_scores(_vectors(spark, sf), _points(spark, sf), 8, threshold=0.2)


def knn_links(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.knn_links(_vectors(spark, sf), _points(spark, sf), threshold=0.2)


def knn_links_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.knn_links(_vectors(spark, sf), _points(spark, sf), threshold=0.2, fetch_first=True)


def knn_links_all(spark: SparkSession, sf: str) -> DataFrame:
    """Links of every point."""
    p = _points(spark, sf)
    return similarity.knn_links(p.withColumnRenamed("id", "query_id"), p, threshold=0.2)


def vector_in_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Search among the points of some groups."""
    p = _points(spark, sf)
    return similarity.vector_scores(_vectors(spark, sf), p, 8, papers=p.select("grp").where(F.col("grp").isin(1, 3, 4)))


def vector_routing(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.vector_routing(_vectors(spark, sf), _points(spark, sf))


def hybrid_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.hybrid(_vectors(spark, sf), _points(spark, sf), _near_groups(spark, sf), threshold=0.95).select("query_id", "id", "score", "source", "rank")


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Fusion of the vector list and the list of the query's own group."""
    q, p = _vectors(spark, sf), _points(spark, sf)
    a, b = similarity.vector_scores(q, p, 10, skip="self"), similarity.vector_scores(q, p, 10, scope="selected", skip="self")
    return similarity.rrf(a.select("query_id", "id", "rank").unionByName(b.select("query_id", "id", "rank")))


def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    """Length and non-zero buckets of the hash embedding of every document."""
    e = TermHashing(256)
    d = table(spark, sf, "documents").select("doc_id", e.udf()("text").alias("v"))
    return d.select("doc_id", F.size(F.filter("v", lambda x: x != 0)).alias("n_buckets"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 4).alias("length"))


QUERIES = {
    f.__name__: f
    for f in (
        next_chunk_edges, cites_edges, citation_stub, citation_expand, paper_subgraph, paper_nested, next_edges_within, chunk_graph, paper_exists, khop_neighbors, chunks_per_paper, cites_chunk_edges, shared_entity_edges, entity_expand, cross_paper_links,
        graph_summary, research_flow, vector_topk_selected, vector_topk_global, vector_threshold, knn_links, knn_links_all, knn_links_prefilter, vector_in_papers, vector_routing, hybrid_retrieval, rrf_fusion, hash_embed,
    )
}

_G = f"""
WITH RECURSIVE {CHUNKS}, {PAPERS}, {CASES},
 asked AS (SELECT case_id query_id, question, paper_id, gold_chunk_ids FROM cur_cases WHERE CAST(regexp_extract(case_id, '([0-9]+)$', 1) AS BIGINT) % 50 = 0),
 cites AS (SELECT DISTINCT source_paper_id src, target_paper_id dst FROM citation_edges WHERE source_paper_id <> target_paper_id),
 both_ways AS (SELECT src paper_id, dst related, 'cites' AS type FROM cites UNION ALL SELECT dst, src, 'cited_by' FROM cites),
 seeds AS (SELECT DISTINCT unnest(gold_chunk_ids) chunk_id FROM asked),
 want AS (SELECT DISTINCT paper_id FROM asked WHERE paper_id IS NOT NULL),
 looked AS (SELECT DISTINCT paper_id FROM cur_cases WHERE paper_id IS NOT NULL),
 next_edges AS (SELECT * FROM (SELECT chunk_id AS "left", lead(chunk_id) OVER (PARTITION BY paper_id ORDER BY chunk_index, chunk_id) AS "right" FROM cur_chunks) WHERE "right" IS NOT NULL),
 firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_index, chunk_id) position FROM cur_chunks) WHERE position <= 3),
 held AS (SELECT paper_id, count(*) n FROM cur_chunks GROUP BY 1),
 pairs AS (SELECT src, dst, a.n * b.n AS n FROM cites JOIN held a ON a.paper_id = src JOIN held b ON b.paper_id = dst),
 mentions AS (SELECT DISTINCT chunk_id, paper_id, unnest(regexp_extract_all(text, '\\b[A-Z][a-z]+[A-Z][a-z]+[0-9]*\\b')) entity FROM cur_chunks)
"""
_V = """
WITH p AS (SELECT vec_id id, CAST(embedding AS DOUBLE[]) e, label grp, label % 2 = 0 is_global FROM embeddings),
 q AS (SELECT id query_id, e qe, grp qgrp FROM p WHERE id % 50 = 0),
 s AS (SELECT query_id, id, qgrp, grp, is_global, round(list_cosine_similarity(qe, e), 6) score FROM q, p)
"""


def _top(where: str, k: int, then: str = "") -> str:
    return _V + f"SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) rank FROM s WHERE {where}) WHERE rank <= {k}{then}"


SQL = {
    "next_chunk_edges": _G + "SELECT * FROM next_edges",
    "cites_edges": _G + "SELECT * FROM cites",
    "citation_stub": _G + "SELECT DISTINCT dst AS paper_id, regexp_replace(dst, '^(arxiv|hf|ref):', '') AS title, 'reference_only' AS processing_status FROM cites WHERE dst NOT IN (SELECT paper_id FROM cur_papers)",
    "citation_expand": _G + "SELECT chunk_id, paper_id, type, related FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY related, type) n FROM (SELECT DISTINCT c.chunk_id, c.paper_id, b.type, b.related FROM seeds JOIN cur_chunks c USING (chunk_id) JOIN both_ways b ON b.paper_id = c.paper_id WHERE b.related IN (SELECT paper_id FROM cur_papers))) WHERE n <= 50",
    "paper_subgraph": _G
    + """SELECT paper_id, 'paper' AS kind, 0 AS position, title AS value FROM cur_papers WHERE paper_id IN (FROM looked)
 UNION ALL SELECT DISTINCT paper_id, 'author', author_order, name FROM authors WHERE paper_id IN (FROM looked)
 UNION ALL SELECT paper_id, 'chunk', chunk_index, chunk_id FROM cur_chunks WHERE paper_id IN (FROM looked)
 UNION ALL SELECT src, 'cites', CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS INTEGER), dst FROM cites WHERE src IN (FROM looked)""",
    "paper_nested": _G
    + """SELECT p.paper_id, title, coalesce(a, '') AS authors, coalesce(c, '') AS chunks, coalesce(r, '') AS citations FROM cur_papers p LEFT JOIN (SELECT paper_id, string_agg(name, ';' ORDER BY author_order, name) a FROM (SELECT DISTINCT paper_id, author_order, name FROM authors) GROUP BY 1) USING (paper_id)
 LEFT JOIN (SELECT paper_id, string_agg(chunk_id, ';' ORDER BY chunk_index, chunk_id) c FROM cur_chunks GROUP BY 1) USING (paper_id) LEFT JOIN (SELECT src paper_id, string_agg(dst, ';' ORDER BY dst) r FROM cites GROUP BY 1) USING (paper_id) WHERE p.paper_id IN (FROM want)""",
    "next_edges_within": _G + 'SELECT * FROM next_edges WHERE "left" IN (SELECT chunk_id FROM firsts) AND "right" IN (SELECT chunk_id FROM firsts)',
    "chunk_graph": _G
    + """, mn AS (SELECT entity, paper_id, chunk_id, count(*) OVER (PARTITION BY entity) n, count(*) OVER (PARTITION BY entity, paper_id) own FROM mentions)
 SELECT 'next' AS type, count(*) AS n_rows, count(*) AS n_links FROM next_edges UNION ALL SELECT 'cites', count(*), sum(n) FROM pairs HAVING count(*) > 0 UNION ALL SELECT 'shared_entity', count(DISTINCT (entity, paper_id)), sum(n - own) FROM mn WHERE n > own HAVING count(*) > 0""",
    "paper_exists": _G + "SELECT DISTINCT paper_id FROM cur_papers WHERE paper_id IN (FROM looked)",
    "khop_neighbors": _G
    + """, h0 AS (SELECT paper_id seed, paper_id, 0 hop FROM want), h1 AS (SELECT seed, related paper_id, 1 hop FROM h0 JOIN both_ways USING (paper_id)), h2 AS (SELECT seed, related paper_id, 2 hop FROM (SELECT DISTINCT seed, paper_id FROM h1) JOIN both_ways USING (paper_id)),
 m AS (SELECT seed, paper_id, CAST(min(hop) AS INTEGER) AS hop FROM (FROM h1 UNION ALL FROM h2) WHERE seed <> paper_id GROUP BY 1, 2)
 SELECT seed, paper_id, hop FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hop, paper_id) n FROM m) WHERE n <= 25""",
    "chunks_per_paper": _G + "SELECT paper_id, chunk_id, CAST(position AS INTEGER) AS position FROM firsts",
    "cites_chunk_edges": _G + "SELECT 'cites' AS kind, src AS paper_id, dst AS value, n FROM pairs UNION ALL SELECT 'chunk', paper_id, chunk_id, 1 FROM cur_chunks WHERE paper_id IN (SELECT src FROM pairs UNION SELECT dst FROM pairs)",
    "shared_entity_edges": _G + "SELECT entity, paper_id, chunk_id, n - own AS n_linked FROM (SELECT *, count(*) OVER (PARTITION BY entity) n, count(*) OVER (PARTITION BY entity, paper_id) own FROM mentions) WHERE n > own",
    "entity_expand": _G + "SELECT s.chunk_id, o.paper_id, count(DISTINCT o.entity) AS n_entities FROM mentions s JOIN mentions o ON s.entity = o.entity AND s.chunk_id <> o.chunk_id AND s.paper_id <> o.paper_id WHERE s.chunk_id IN (FROM seeds) GROUP BY 1, 2",
    "cross_paper_links": _G + "SELECT 'cites' AS kind, src AS paper_id, dst AS value, n FROM pairs WHERE src <> dst UNION ALL SELECT 'chunk', paper_id, chunk_id, 1 FROM cur_chunks WHERE paper_id IN (SELECT src FROM pairs UNION SELECT dst FROM pairs)",
    "graph_summary": _G
    + """, k AS (SELECT (SELECT count(*) FROM next_edges) nx, (SELECT coalesce(sum(n), 0) FROM pairs) ct)
 SELECT 'chunks' AS measure, count(*) AS n FROM cur_chunks UNION ALL SELECT 'papers', count(DISTINCT paper_id) FROM cur_chunks UNION ALL SELECT 'links', nx + ct FROM k
 UNION ALL SELECT 'links:next', nx FROM k UNION ALL SELECT 'links:cites', ct FROM k WHERE ct > 0 UNION ALL SELECT 'links across papers', ct FROM k""",
    "research_flow": _G + "SELECT paper_id, 'current' AS stage, paper_id AS related FROM cur_papers WHERE paper_id IN (FROM looked) UNION SELECT src, 'prior', dst FROM cites WHERE src IN (FROM looked) UNION SELECT dst, 'later', src FROM cites WHERE dst IN (FROM looked)",
    "vector_topk_selected": _top("grp = qgrp", 8),
    "vector_topk_global": _top("is_global", 8),
    "vector_threshold": _top("score >= 0.2", 8),
    "knn_links": _V + "SELECT query_id AS source, id AS target, CAST(round(CAST(score AS DECIMAL(18, 6)), 4) AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) r FROM s WHERE grp <> qgrp AND score >= 0.2) WHERE r <= 3",
    "vector_in_papers": _top("grp IN (1, 3, 4)", 8),
    "knn_links_all": _V.replace(" WHERE id % 50 = 0", "") + "SELECT query_id AS source, id AS target, CAST(round(CAST(score AS DECIMAL(18, 6)), 4) AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) r FROM s WHERE grp <> qgrp AND score >= 0.2) WHERE r <= 3",
    "knn_links_prefilter": _V + "SELECT source, target, score FROM (SELECT query_id AS source, id AS target, CAST(round(CAST(score AS DECIMAL(18, 6)), 4) AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY r) k FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) r FROM s) WHERE r <= 4 AND grp <> qgrp AND score >= 0.2) WHERE k <= 3",
    "vector_routing": _V + "SELECT query_id, coalesce(round(max(CASE WHEN grp = qgrp THEN score END) / max(score), 6), 0.0) AS ratio, CASE WHEN coalesce(round(max(CASE WHEN grp = qgrp THEN score END) / max(score), 6), 0.0) >= 0.45 THEN 'selected' ELSE 'global' END AS scope FROM s WHERE id <> query_id GROUP BY query_id",
    "hybrid_retrieval": _V
    + """, rt AS (SELECT query_id, coalesce(round(max(CASE WHEN grp = qgrp THEN score END) / max(score), 6), 0.0) >= 0.95 sel FROM s WHERE id <> query_id GROUP BY query_id),
 t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) r FROM s JOIN rt USING (query_id) WHERE id <> query_id AND (NOT sel OR grp = qgrp)),
 hits AS (SELECT * FROM t WHERE r <= 10),
 sd AS (SELECT query_id, qgrp grp FROM q JOIN rt USING (query_id) WHERE NOT sel UNION SELECT query_id, grp FROM hits WHERE NOT sel AND r <= 3),
 near AS (SELECT DISTINCT grp, (grp + 1) % 10 related FROM p),
 rel AS (SELECT query_id, related grp FROM sd JOIN near USING (grp) EXCEPT SELECT query_id, grp FROM sd),
 rel5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grp) n FROM rel) WHERE n <= 5),
 f AS (SELECT * FROM (SELECT id, grp, row_number() OVER (PARTITION BY grp ORDER BY id) n FROM p) WHERE n <= 3),
 u AS (SELECT query_id, id, score, 'vector' source, 0 o FROM hits UNION ALL SELECT s.query_id, s.id, s.score, 'graph', 1 FROM rel5 JOIN f ON f.grp = rel5.grp JOIN s ON s.query_id = rel5.query_id AND s.id = f.id WHERE s.id <> s.query_id),
 one AS (SELECT query_id, id, min(o) o, any_value(score) score FROM u GROUP BY 1, 2)
 SELECT query_id, id, CAST(round(CAST(score AS DECIMAL(18, 6)), 4) AS DOUBLE) AS score, CASE WHEN o = 0 THEN 'vector' ELSE 'graph' END AS source, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o, id) rank FROM one) WHERE rank <= 10""",
    "rrf_fusion": _V
    + """, a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) r FROM s WHERE id <> query_id), b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) r FROM s WHERE id <> query_id AND grp = qgrp),
 f AS (SELECT query_id, id, round(sum(1.0 / (60 + r)), 6) score FROM (FROM a WHERE r <= 10 UNION ALL FROM b WHERE r <= 10) GROUP BY 1, 2)
 SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) rank FROM f) WHERE rank <= 10""",
}
