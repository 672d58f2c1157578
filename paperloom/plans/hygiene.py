"""Queries of the general table problems: hot keys and orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.ids import chunk_owner, chunk_tail, loose_paper_id
from paperloom.operators.eager import heavy_keys, join_states, key_states, roll_up
from paperloom.operators.orphans import orphan_references, orphan_report, target_states
from paperloom.session import cut
from paperloom.sources.tables import table


def _per_paper(spark: SparkSession, sf: str, how: str) -> DataFrame:
    chunks = key_states(table(spark, sf, "chunks"), {"paper_id": "paper_id"}, {"chars": "char_count"}, maxs={"index": "chunk_index"})
    edges = key_states(table(spark, sf, "citation_edges"), {"paper_id": "target_paper_id"}, mins={"at": "ingested_at"})
    return join_states(chunks, edges, ["paper_id"], how)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that hold at least 5 % of `chunks` or of `citation_edges`."""
    found = heavy_keys(_per_paper(spark, sf, "full"), ["paper_id"], {"chunks": "n_left", "citation_edges": "n_right"}, percent=5)
    return found.select(F.col("side").alias("table_name"), F.col("paper_id").alias("key_value"))


def p1_chunk_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregates of chunks joined with the citations of their paper, for every paper that has both."""
    s = _per_paper(spark, sf, "inner")
    return s.select(
        "paper_id",
        F.col("n_left").alias("n_chunks"),
        F.col("n_right").alias("n_citations"),
        F.col("n_join").alias("n_pairs"),
        F.col("left_sum_chars").cast("bigint").alias("pair_chars"),
        F.col("left_max_index").alias("last_chunk_index"),
        F.date_format("right_min_at", "yyyy-MM-dd").alias("first_cited_on"),
    )


def p1_citations_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """The same join rolled up to the month in which a paper was first loaded."""
    papers = table(spark, sf, "papers").groupBy("paper_id").agg(F.date_format(F.min("ingested_at"), "yyyy-MM").alias("load_month"))
    s = _per_paper(spark, sf, "inner").join(papers, "paper_id", "left")
    r = roll_up(s, ["load_month"], drop=["paper_id"])
    return r.select("load_month", F.col("n_left").cast("bigint").alias("n_chunks"), F.col("n_right").cast("bigint").alias("n_citations"), F.col("n_join").cast("bigint").alias("n_pairs"), F.col("left_sum_chars").cast("bigint").alias("pair_chars"))


def _paper_keys(rows: DataFrame, column: str) -> DataFrame:
    """Split a paper reference into the two parts of its key: scheme and local id."""
    loose = loose_paper_id(F.col(column))
    return rows.withColumns({"k_scheme": F.substring_index(loose, ":", 1), "k_local": F.nullif(F.regexp_extract(loose, r"(?s)^[a-z]+:(.*)$", 1), F.lit(""))})


def _chunk_keys(rows: DataFrame, column: str) -> DataFrame:
    """Split a chunk reference into the two parts of its key: paper, and index with digest."""
    return rows.withColumns({"k_paper": chunk_owner(F.col(column)), "k_tail": chunk_tail(F.col(column))})


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    papers, edges, cases, chunks = (table(spark, sf, t) for t in ("papers", "citation_edges", "eval_cases", "chunks"))
    gone = F.col("is_deleted")
    paper_states = target_states(_paper_keys(papers.select("paper_id", "ingested_at", "is_deleted"), "paper_id"), ["k_scheme", "k_local"], F.col("ingested_at"), gone)
    chunk_states = target_states(_chunk_keys(chunks.select("chunk_id", "ingested_at", "is_deleted"), "chunk_id"), ["k_paper", "k_tail"], F.col("ingested_at"), gone)

    # Each record is folded to one row (earliest time, union of its entries) before its entries are exploded.
    entries = lambda c: F.array_distinct(F.flatten(F.collect_set(F.array_compact(F.col(c)))))
    by_paper = papers.groupBy(F.col("paper_id").alias("record_id")).agg(F.min("ingested_at").alias("at"), entries("reference_ids").alias("ids"))
    by_case = cases.groupBy(F.col("case_id").alias("record_id")).agg(F.min("created_at").alias("at"), entries("gold_chunk_ids").alias("ids"))
    by_edge = edges.groupBy(F.col("source_paper_id").alias("record_id"), F.col("target_paper_id").alias("missing_id")).agg(F.min("ingested_at").alias("at"))
    to_papers = by_paper.select(F.lit("papers").alias("table_name"), "record_id", F.explode("ids").alias("missing_id"), "at").unionByName(by_edge.select(F.lit("citation_edges").alias("table_name"), "record_id", "missing_id", "at"))
    to_chunks = by_case.select(F.lit("eval_cases").alias("table_name"), "record_id", F.explode("ids").alias("missing_id"), "at")
    # Few bytes but much work a row: as many tasks as the session has for a shuffle, which the adaptive planner would merge by
    # size. The keys are taken once and used for counting, for hot and for other keys.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda refs: refs.repartition(tasks, "record_id", "missing_id")
    found = [
        orphan_references(cut(_paper_keys(spread(to_papers), "missing_id")), paper_states, ["k_scheme", "k_local"], "at", match="full"),
        orphan_references(cut(_chunk_keys(spread(to_chunks), "missing_id")), chunk_states, ["k_paper", "k_tail"], "at", match="full"),
    ]
    out = [f.select("table_name", "record_id", "missing_id", "reason", F.date_format("at", "yyyy-MM").alias("load_month")) for f in found]
    return out[0].unionByName(out[1])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """References of papers, edges and cases whose target is missing, deleted or late."""
    return _orphans(spark, sf)


def p6_orphans_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """The same references counted per table, month and reason."""
    return orphan_report(_orphans(spark, sf), ["table_name", "load_month", "reason"])


QUERIES = {f.__name__: f for f in (p1_found, p1_chunk_citations, p1_citations_by_month, p6_found, p6_orphans_by_month)}

_LOOSE = "(CASE WHEN regexp_matches({t}, '^[A-Za-z]+:') THEN lower(regexp_extract({t}, '^([A-Za-z]+):', 1)) || ':' || regexp_replace({t}, '^[A-Za-z]+:\\s*', '') ELSE 'arxiv:' || {t} END)"
_TRIM = r"regexp_replace({c}, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')"


def _paper_sql(c: str) -> str:
    return "regexp_replace(" + _LOOSE.replace("{t}", _TRIM.replace("{c}", c)) + r", '([0-9])[vV][0-9]+$', '\1')"


def _chunk_sql(c: str) -> str:
    return _LOOSE.replace("{t}", _TRIM.replace("{c}", c))


_P6 = f"""
WITH pt AS (SELECT {_paper_sql('paper_id')} k, min(ingested_at) first_at, max(row(ingested_at, coalesce(is_deleted, false)))[2] gone FROM papers GROUP BY 1),
 ct AS (SELECT {_chunk_sql('chunk_id')} k, min(ingested_at) first_at, max(row(ingested_at, coalesce(is_deleted, false)))[2] gone FROM chunks GROUP BY 1),
 pa AS (SELECT paper_id, min(ingested_at) OVER (PARTITION BY paper_id) AS seen, reference_ids FROM papers),
 ca AS (SELECT case_id, min(created_at) OVER (PARTITION BY case_id) AS seen, gold_chunk_ids FROM eval_cases),
 refs AS (
  SELECT 'papers' table_name, paper_id record_id, x missing_id, seen, {_paper_sql('x')} k FROM (SELECT DISTINCT paper_id, seen, unnest(reference_ids) x FROM pa) WHERE x IS NOT NULL AND length({_TRIM.replace('{c}', 'x')}) > 0
  UNION ALL SELECT 'citation_edges', source_paper_id, target_paper_id, min(ingested_at), {_paper_sql('target_paper_id')} FROM citation_edges WHERE target_paper_id IS NOT NULL GROUP BY source_paper_id, target_paper_id),
 crefs AS (SELECT 'eval_cases' table_name, case_id record_id, x missing_id, seen, {_chunk_sql('x')} k FROM (SELECT DISTINCT case_id, seen, unnest(gold_chunk_ids) x FROM ca) WHERE x IS NOT NULL AND length({_TRIM.replace('{c}', 'x')}) > 0),
 verdict AS (
  SELECT r.*, CASE WHEN t.k IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN first_at > seen THEN 'late' END reason FROM refs r LEFT JOIN pt t ON r.k = t.k
  UNION ALL SELECT r.*, CASE WHEN t.k IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN first_at > seen THEN 'late' END FROM crefs r LEFT JOIN ct t ON r.k = t.k),
 found AS (SELECT table_name, record_id, missing_id, reason, strftime(seen, '%Y-%m') load_month FROM verdict WHERE reason IS NOT NULL)
"""

SQL = {
    "p1_found": """
SELECT 'chunks' AS table_name, paper_id AS key_value FROM chunks WHERE paper_id IS NOT NULL GROUP BY paper_id HAVING count(*) * 20 >= (SELECT count(*) FROM chunks)
UNION ALL
SELECT 'citation_edges', target_paper_id FROM citation_edges WHERE target_paper_id IS NOT NULL GROUP BY target_paper_id HAVING count(*) * 20 >= (SELECT count(*) FROM citation_edges)""",
    "p1_chunk_citations": f"""
SELECT c.paper_id, count(DISTINCT c.rn) AS n_chunks, count(DISTINCT e.rn) AS n_citations, count(*) AS n_pairs, CAST(coalesce(sum(c.char_count), 0) AS BIGINT) AS pair_chars,
 max(c.chunk_index) AS last_chunk_index, strftime(min(e.ingested_at), '%Y-%m-%d') AS first_cited_on
FROM (SELECT *, row_number() OVER () rn FROM chunks) c JOIN (SELECT *, row_number() OVER () rn FROM citation_edges) e ON c.paper_id = e.target_paper_id GROUP BY c.paper_id""",
    "p1_citations_by_month": f"""
WITH m AS (SELECT paper_id, strftime(min(ingested_at), '%Y-%m') load_month FROM papers GROUP BY 1),
 j AS (SELECT c.paper_id, c.char_count, c.rn crn, e.rn ern FROM (SELECT *, row_number() OVER () rn FROM chunks) c JOIN (SELECT *, row_number() OVER () rn FROM citation_edges) e ON c.paper_id = e.target_paper_id)
SELECT load_month, count(DISTINCT crn) AS n_chunks, count(DISTINCT ern) AS n_citations, count(*) AS n_pairs, CAST(coalesce(sum(char_count), 0) AS BIGINT) AS pair_chars FROM j LEFT JOIN m USING (paper_id) GROUP BY load_month""",
    "p6_found": _P6 + "SELECT * FROM found",
    "p6_orphans_by_month": _P6 + "SELECT table_name, load_month, reason, count(*) AS n_references, count(DISTINCT record_id) AS n_records, count(DISTINCT missing_id) AS n_missing_ids FROM found GROUP BY table_name, load_month, reason",
}
