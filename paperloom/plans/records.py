"""Queries of scans, payloads and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import records, report
from paperloom.plans.evaluation import _R, responses
from paperloom.plans.network import _G, _asked_papers, _cites, _seed_chunks
from paperloom.plans.search import CASES, CHUNKS, PAPERS, cases, current_among, current_chunks, current_papers
from paperloom.session import cut, spread
from paperloom.sources import benchmarks
from paperloom.sources.tables import table


def chunk_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of 100 chunks."""
    return records.scan(current_chunks(spark, sf, "paper_id"), skip=100, limit=100).select("chunk_id", "paper_id")


def chunk_multi_get(spark: SparkSession, sf: str) -> DataFrame:
    return records.multi_get(current_chunks(spark, sf, "paper_id", "char_count"), _seed_chunks(spark, sf)).select("chunk_id", "paper_id", "char_count")


def raw_query(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "papers").createOrReplaceTempView("raw_papers")
    return records.ask(spark, "SELECT processing_status, count(DISTINCT paper_id) AS n_papers FROM raw_papers WHERE is_deleted = :gone GROUP BY processing_status", gone=False)


def widened_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the asked papers and of the papers one citation away, per paper."""
    c = records.load_chunks(current_chunks(spark, sf, "paper_id", F.length(F.trim("text")).alias("filled")), _cites(spark, sf), _asked_papers(spark, sf), 1)
    return c.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def graph_payload(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "papers").groupBy("paper_id").agg(F.max_by(F.struct("title", "source_version", "content_hash", "is_deleted"), F.struct("ingested_at", "is_deleted")).alias("r")).select("paper_id", "r.*").where(~F.col("is_deleted"))
    return records.graph_payload(p, current_chunks(spark, sf, "paper_id"))


def vector_payload(spark: SparkSession, sf: str) -> DataFrame:
    """The columns stored beside the vectors that identify and describe a chunk; reference chunks are counted out."""
    c = current_chunks(spark, sf, "paper_id", "chunk_index", "is_references", "section", F.length("text").alias("char_count"))
    return records.vector_payload(c, current_papers(spark, sf, "title", "published_at"))


def index_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome of a load per stage: the graph takes papers that keep its contract, vectors those whose points exist."""
    g = graph_payload(spark, sf)
    attempted = g.select("paper_id", F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("stage"))
    o = report.load_outcomes(attempted, g.where("ok"), table(spark, sf, "vector_points"))
    return o.groupBy(F.coalesce("stage", F.lit("written")).alias("stage")).agg(F.count(F.lit(1)).alias("n_papers"))


def restore_contexts(spark: SparkSession, sf: str) -> DataFrame:
    r = records.restore_contexts(responses(spark, sf), current_chunks(spark, sf, "text"))
    return r.select("case_id", F.size("contexts").alias("n_contexts"), F.sha2(F.array_join("contexts", "\n"), 256).alias("digest"))


def triple_recovery(spark: SparkSession, sf: str) -> DataFrame:
    t = cases(spark, sf).select(F.explode("gold_triples").alias("t")).select("t.*").where(F.col("chunk_id").isNotNull()).distinct()
    return records.recover_triples(responses(spark, sf), t, top=10)


def source_summary(spark: SparkSession, sf: str) -> DataFrame:
    return records.source_summary(current_chunks(spark, sf, "paper_id", "section", F.length("text").alias("char_count")))


def export_report(spark: SparkSession, sf: str) -> DataFrame:
    return records.export_report(cases(spark, sf), current_chunks(spark, sf, "paper_id"))


def packaged_cases(spark: SparkSession, sf: str) -> DataFrame:
    return records.package(cases(spark, sf), "packaged").select("case_id", F.array_join("tags", ",").alias("tags"))


def _contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The cases as rows of a generated test set: question, answer and the texts of the gold chunks."""
    c = cases(spark, sf).where(F.length("question") > 0)
    gold = c.select("case_id", F.explode("gold_chunk_ids").alias("chunk_id")).distinct()
    gold = gold.join(current_among(spark, sf, gold, "text"), "chunk_id")
    texts = gold.groupBy("case_id").agg(F.array_sort(F.collect_set("text")).alias("reference_contexts"))  # of one case
    return c.join(texts, "case_id", "left").groupBy(F.col("question").alias("user_input")).agg(F.min("gold_answer").alias("reference"), F.array_distinct(F.flatten(F.collect_list("reference_contexts"))).alias("reference_contexts"))


def _listed(made: DataFrame) -> DataFrame:
    return made.select("case_id", "question", F.array_join("gold_chunk_ids", ",").alias("gold_chunk_ids"), F.array_join("gold_paper_ids", ",").alias("gold_paper_ids"), "expected_scope")


def imported_conversion(spark: SparkSession, sf: str) -> DataFrame:
    """Cases from a generated test set."""
    version = F.xxhash64("paper_id", "chunk_index", "text").alias("version")
    every = spread(table(spark, sf, "chunks").select("chunk_id", version, "paper_id", "chunk_index", "text"))
    made = cut(benchmarks.imported_cases(_contexts(spark, sf), every, cut(current_chunks(spark, sf, version, "paper_id"))))
    return _listed(made).join(made.select("case_id", F.array_join("tags", ",").alias("tags")), "case_id")


def _abstracts(spark: SparkSession, sf: str) -> DataFrame:
    """Current papers with an abstract of some length, and its first half as evidence."""
    p = current_papers(spark, sf, "title", "abstract", "source_url").withColumn("abstract", F.trim("abstract"))
    return p.where((F.length("abstract") >= 80) & ~F.contains("abstract", F.lit("\n\n"))).withColumn("half", F.expr("left(abstract, length(abstract) div 2)"))


def qasper_conversion(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks and cases of papers with questions: each abstract as a paper that is asked for its title."""
    p = _abstracts(spark, sf).where(F.length("title") > 0)
    answer = F.struct(F.struct(F.lit(False).alias("unanswerable"), F.array("half").alias("evidence"), F.col("title").alias("free_form_answer"), F.array().cast("array<string>").alias("extractive_spans")).alias("x"))
    qas = F.struct(F.array("title").alias("question"), F.array("paper_id").alias("question_id"), F.array(F.struct(F.array(answer["x"]).alias("answer"))).alias("answers"))
    rows = p.select(F.col("paper_id").alias("id"), "title", "abstract", F.lit(None).cast("struct<section_name: array<string>, paragraphs: array<array<string>>>").alias("full_text"), qas.alias("qas"))
    return _listed(benchmarks.qasper(rows)[1])


def graph_conversion(spark: SparkSession, sf: str) -> DataFrame:
    """Cases without a corpus: answers only."""
    q = cases(spark, sf).where(F.length("gold_answer") > 0).groupBy("question").agg(F.min("gold_answer").alias("answer"), F.min("case_id").alias("id"))
    rows = q.select("id", "question", "answer", F.lit("").alias("question_type"), F.array().cast("array<string>").alias("evidence"))
    return benchmarks.graph_bench(None, rows)[1].select("case_id", "question", "gold_answer", F.size("gold_chunk_ids").alias("n_gold"), "expected_scope")


QUERIES = {f.__name__: f for f in (chunk_scan, chunk_multi_get, raw_query, widened_chunks, graph_payload, vector_payload, index_outcomes, restore_contexts, triple_recovery, source_summary, export_report, packaged_cases, imported_conversion, qasper_conversion, graph_conversion)}

_KEY = "lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
_T = f"WITH {CHUNKS}, {PAPERS}, {CASES}"
_GP = f"""{_T}, gp AS (SELECT paper_id, CASE WHEN coalesce(trim(title), '') = '' THEN 'title' WHEN coalesce(trim(source_version), '') = '' THEN 'source_version' WHEN coalesce(trim(content_hash), '') = '' THEN 'content_hash' WHEN paper_id NOT IN (SELECT paper_id FROM cur_chunks) THEN 'chunks' END AS error FROM cur_papers)"""
SQL = {
    "chunk_scan": _T + " SELECT chunk_id, paper_id FROM cur_chunks ORDER BY chunk_id LIMIT 100 OFFSET 100",
    "chunk_multi_get": _G + " SELECT chunk_id, paper_id, char_count FROM cur_chunks WHERE chunk_id IN (FROM seeds)",
    "raw_query": "SELECT processing_status, count(DISTINCT paper_id) AS n_papers FROM papers WHERE NOT is_deleted GROUP BY 1",
    "widened_chunks": _G + " SELECT paper_id, count(*) AS n_chunks FROM cur_chunks WHERE length(trim(text)) > 0 AND paper_id IN (SELECT paper_id FROM want UNION SELECT related FROM both_ways WHERE paper_id IN (FROM want)) GROUP BY 1",
    "graph_payload": _GP + " SELECT paper_id, error IS NULL AS ok, error FROM gp",
    "vector_payload": _T + " SELECT chunk_id, c.paper_id, chunk_index, nullif(section, '') AS section, CAST(length(text) AS INTEGER) AS char_count, title, strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS published_at FROM cur_chunks c LEFT JOIN cur_papers p ON c.paper_id = p.paper_id WHERE NOT coalesce(is_references, false)",
    "index_outcomes": _GP + " SELECT CASE WHEN error IS NOT NULL THEN 'graph' WHEN paper_id NOT IN (SELECT paper_id FROM vector_points) THEN 'vector' ELSE 'written' END AS stage, count(*) AS n_papers FROM gp GROUP BY 1",
    "restore_contexts": _R + " SELECT case_id, CAST(len(E) AS INTEGER) AS n_contexts, sha256(array_to_string(E, chr(10))) AS digest FROM r WHERE len(E) > 0",
    "triple_recovery": _R + ", st AS (SELECT DISTINCT t.chunk_id, t.subject, t.predicate, t.object, t.confidence FROM (SELECT unnest(gold_triples) t FROM cur_cases) WHERE t.chunk_id IS NOT NULL) SELECT rk.case_id, rk.chunk_id, subject, predicate, object, coalesce(confidence, 0.7) AS confidence FROM rk JOIN st USING (chunk_id) WHERE rank <= 10",
    "source_summary": _T + " SELECT count(*) AS n_chunks, count(DISTINCT paper_id) AS n_papers, count(DISTINCT section) AS n_sections, round(coalesce(avg(length(text)), 0), 6) AS mean_chars FROM cur_chunks",
    "export_report": _T
    + """, go AS (SELECT DISTINCT case_id, chunk_id FROM (SELECT case_id, unnest(gold_chunk_ids) chunk_id FROM cur_cases) WHERE chunk_id IN (SELECT chunk_id FROM cur_chunks)), kept AS (SELECT * FROM cur_cases WHERE case_id IN (SELECT case_id FROM go))
 SELECT 'total' AS measure, count(*) AS n FROM cur_cases UNION ALL SELECT 'exported', count(*) FROM kept UNION ALL SELECT 'dropped_no_gold', (SELECT count(*) FROM cur_cases) - (SELECT count(*) FROM kept) UNION ALL SELECT 'contexts_matched', count(*) FROM go
 UNION ALL SELECT 'tag:' || tag, count(*) FROM (SELECT DISTINCT case_id, unnest(tags) tag FROM kept) GROUP BY tag""",
    "imported_conversion": _T
    + f""", k AS (SELECT chunk_id, paper_id, chunk_index, {_KEY.replace("{c}", "text")} t FROM cur_chunks),
 u AS (SELECT DISTINCT question, {_KEY.replace("{c}", "c.text")} t FROM (SELECT question, unnest(gold_chunk_ids) chunk_id FROM cur_cases WHERE length(question) > 0) JOIN cur_chunks c USING (chunk_id)),
 b AS (SELECT question, t, first(chunk_id ORDER BY paper_id, chunk_index, chunk_id) chunk_id, first(paper_id ORDER BY paper_id, chunk_index, chunk_id) paper_id FROM u JOIN k USING (t) WHERE t <> '' AND NOT starts_with(t, 'float selected') GROUP BY 1, 2),
 g AS (SELECT question, string_agg(DISTINCT chunk_id, ',' ORDER BY chunk_id) gold_chunk_ids, string_agg(DISTINCT paper_id, ',' ORDER BY paper_id) gold_paper_ids, count(DISTINCT chunk_id) n, count(DISTINCT paper_id) m FROM b GROUP BY 1)
 SELECT 'imp-' || substr(sha1(question), 1, 12) AS case_id, question, gold_chunk_ids, gold_paper_ids, CASE WHEN m > 1 THEN 'global' ELSE 'selected' END AS expected_scope, CASE WHEN n > 1 THEN 'multi-hop' ELSE 'single-hop' END || ',' || CASE WHEN m > 1 THEN 'global' ELSE 'local' END AS tags FROM g""",
    "qasper_conversion": _T
    + """, a AS (SELECT paper_id, title, trim(abstract, ' ') t FROM cur_papers), p AS (SELECT 'arxiv:' || regexp_replace(paper_id, '^arxiv:', '') paper_id, title, t FROM a WHERE length(t) >= 80 AND NOT contains(t, chr(10) || chr(10)) AND length(title) > 0)
 SELECT 'qasper-' || substr(sha1(paper_id || '|' || title), 1, 12) AS case_id, title AS question, paper_id || ':chunk:0:' || substr(sha256(t), 1, 8) AS gold_chunk_ids, paper_id AS gold_paper_ids, 'selected' AS expected_scope FROM p""",
    "graph_conversion": _T + "SELECT 'graph-' || substr(sha1(question), 1, 12) AS case_id, question, min(gold_answer) AS gold_answer, CAST(0 AS INTEGER) AS n_gold, 'unknown' AS expected_scope FROM cur_cases WHERE length(gold_answer) > 0 AND length(question) > 0 GROUP BY question",
    "packaged_cases": _T + " SELECT case_id, array_to_string(list_distinct_ordered, ',') AS tags FROM (SELECT case_id, list_concat(list_filter(coalesce(tags, []), lambda x, i: list_position(tags, x) = i), ['packaged']) list_distinct_ordered FROM cur_cases)",
}
