"""Chunking, storage, quality and streaming queries."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import chunking, graph, indexing, quality, store
from paperloom.plans.search import CASES, CHUNKS, PAPERS, cases, current_chunks, current_papers, latest
from paperloom.session import shared_dir
from paperloom.sources.tables import table
from paperloom.streaming import incremental


def section_split(spark: SparkSession, sf: str) -> DataFrame:
    """Reference sections and body sections of every Markdown text."""
    c = chunking.chunk_papers(table(spark, sf, "paper_markdown").select("paper_id", "text").distinct())
    return c.groupBy("paper_id", "section_index", "section", "is_references").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("char_count").alias("n_chars"))


def recursive_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_papers(table(spark, sf, "paper_markdown").select("paper_id", "text").distinct())


def chunk_fixed_split(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.split_texts(table(spark, sf, "documents"))


def pending_load(spark: SparkSession, sf: str) -> indexing.Load:
    """The load of the papers that wait for it, with the texts fetched so far."""
    p = latest(table(spark, sf, "papers"), "paper_id", "title", "authors", "published_at", "source_version", "content_hash", "processing_status")
    bodies = table(spark, sf, "paper_markdown").select("paper_id", "text", F.lit(None).cast("string").alias("error"))
    return indexing.plan_load(p.where("processing_status = 'pending'").drop("processing_status"), bodies, base=True)


def indexing_job(spark: SparkSession, sf: str) -> DataFrame:
    """How each waiting paper fares: fetch, chunks, graph, vectors."""
    return pending_load(spark, sf).outcomes.select("paper_id", "ok", F.coalesce("stage", F.lit("written")).alias("stage"))


def indexing_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Papers, chunks and points of the load."""
    return pending_load(spark, sf).summary()


def seed_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Rows a benchmark's corpus gives per table: the current chunks as one."""
    c = current_chunks(spark, sf, "paper_id", "chunk_index", "text", "section").withColumn("title", F.lit(None).cast("string"))
    made = indexing.seed(c, table(spark, sf, "citation_edges"))
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("table_name"), "n") for k, df in made.items()]
    return functools.reduce(DataFrame.unionByName, counts)


def unseed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What leaves with the papers that are pending, taken as a seed."""
    return indexing.unseed(current_papers(spark, sf, "processing_status"), current_chunks(spark, sf, "paper_id"), "pending")[2]


def _months(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Papers loaded before 2023 as the table, all later rows as updates."""
    p = table(spark, sf, "papers").select("paper_id", "title", "processing_status", "is_deleted", "ingested_at")
    rn = p.withColumns({"created_at": F.col("ingested_at"), "is_global": F.col("processing_status") == "completed"})
    cut = F.lit("2023-01-01").cast("timestamp")
    return rn.where(F.col("ingested_at") < cut), rn.where(F.col("ingested_at") >= cut)


def upsert_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    """Old papers upserted with the later ones, twice."""
    old, new = _months(spark, sf)
    base = store.merge_upsert(old.limit(0), old.groupBy("paper_id").agg(F.max_by(F.struct("title", "processing_status", "is_deleted", "ingested_at", "created_at", "is_global"), F.struct("ingested_at", "title", "is_deleted")).alias("r")).select("paper_id", "r.*"), ["paper_id"])
    last = new.groupBy("paper_id").agg(F.max_by(F.struct("title", "processing_status", "is_deleted", "ingested_at", "created_at", "is_global"), F.struct("ingested_at", "title", "is_deleted")).alias("r")).select("paper_id", "r.*")
    once = store.merge_upsert(base, last, ["paper_id"], keep=["created_at"], sticky=["is_global"])
    twice = store.merge_upsert(once, last, ["paper_id"], keep=["created_at"], sticky=["is_global"])
    return twice.select("paper_id", "title", "is_global", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"))


def stale_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks left when papers are loaded anew without their deleted chunks."""
    every = table(spark, sf, "chunks").select("paper_id", "chunk_id").distinct()
    return store.delete_stale(every, current_chunks(spark, sf, "paper_id"), "paper_id", "chunk_id")


def sticky_global(spark: SparkSession, sf: str) -> DataFrame:
    """Points loaded again without the flag keep it where their paper had it."""
    v = table(spark, sf, "vector_points").select("paper_id", "chunk_id", "in_global_corpus").distinct()
    again = v.withColumn("in_global_corpus", F.lit(False)).distinct()
    return store.sticky_global(v, again)


def feed_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "papers").select("paper_id", F.to_date("ingested_at").alias("day"), F.col("title").alias("position"))
    return store.feed_dedupe(p).select("paper_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("position").alias("title"))


def month_window(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "papers").select(F.date_format("ingested_at", "yyyy-MM").alias("month")).distinct()
    first, last = store.month_window(F.col("month"), F.lit("2024-06-15").cast("date"))
    return m.select("month", F.date_format(first, "yyyy-MM-dd").alias("first_day"), F.date_format(last, "yyyy-MM-dd").alias("last_day"))


def dq_chunk_index_unique(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_keys(current_chunks(spark, sf, "paper_id", "chunk_index"), ["paper_id", "chunk_index"])


def dq_chunk_one_paper(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_keys(table(spark, sf, "chunks").select("chunk_id", "paper_id").distinct(), ["chunk_id"])


def dq_next_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive chunks whose indexes do not differ by one."""
    c = current_chunks(spark, sf, "paper_id", "chunk_index")
    e = graph.next_edges(c)
    c = c.select("chunk_id", "chunk_index")
    j = e.join(c.select(F.col("chunk_id").alias("left"), F.col("chunk_index").alias("i")), "left").join(c.select(F.col("chunk_id").alias("right"), F.col("chunk_index").alias("j")), "right")
    return j.where(F.col("j") - F.col("i") != 1).select("left", "right", (F.col("j") - F.col("i")).alias("gap"))


def dq_points_have_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return quality.dangling(table(spark, sf, "vector_points"), "chunk_id", current_chunks(spark, sf, "paper_id"), "chunk_id")


def dq_global_points(spark: SparkSession, sf: str) -> DataFrame:
    """Papers of which some points are global and some are not."""
    v = table(spark, sf, "vector_points").groupBy("paper_id").agg(F.count_if("in_global_corpus").alias("n_global"), F.count_if(~F.col("in_global_corpus")).alias("n_other"))
    return v.where((F.col("n_global") > 0) & (F.col("n_other") > 0))


def dq_completed_have_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return quality.childless(current_papers(spark, sf, "processing_status").where("processing_status = 'completed'"), "paper_id", current_chunks(spark, sf, "paper_id"), "paper_id")


def dq_predicates(spark: SparkSession, sf: str) -> DataFrame:
    t = cases(spark, sf).select(F.explode("gold_triples").alias("t")).select("t.predicate")
    return quality.outside(t, "predicate", ["USES_METHOD", "EVALUATED_ON"])


def dq_source_versions(spark: SparkSession, sf: str) -> DataFrame:
    return quality.outside(table(spark, sf, "vector_points"), "source_version", ["hf-markdown", "pdf-pymupdf4llm"])


def dq_embedding_signature(spark: SparkSession, sf: str) -> DataFrame:
    want = {"embedding_provider": "hash", "embedding_model": "hash-embed-64", "embedding_dimension": 64, "embedding_version": "v2"}
    return quality.mixed_signatures(table(spark, sf, "vector_points"), want)


def dup_case_ids(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_keys(table(spark, sf, "eval_cases"), ["case_id"])


def gold_ids_exist(spark: SparkSession, sf: str) -> DataFrame:
    return quality.dangling(cases(spark, sf).select(F.explode("gold_chunk_ids").alias("chunk_id")), "chunk_id", current_chunks(spark, sf, "paper_id"), "chunk_id")


def stream_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """`papers` loaded by a file stream into a versioned table, twice; the second run finds nothing new."""
    at = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    p = spark.read.parquet(f"{sf}/papers.parquet")
    source = f"{sf}/papers.parq*"
    for _ in range(2):
        incremental.load_incrementally(spark, source, p.schema, f"{at}/table", f"{at}/seen", ["paper_id"], prepare=_stored, keep=["created_at"], sticky=["is_global"])
    return store.VersionedTable(spark, f"{at}/table", ["paper_id"]).read().select("paper_id", "title", "processing_status", "is_deleted", F.date_format("ingested_at", "yyyy-MM-dd").alias("loaded_on"))


def _stored(papers: DataFrame) -> DataFrame:
    """Rows of the table of papers, the columns that tell the latest first."""
    rest = [c for c in papers.columns if c not in ("ingested_at", "is_deleted", "title")]
    return papers.select("ingested_at", "is_deleted", "title", *rest).withColumns({"created_at": F.col("ingested_at"), "is_global": F.col("processing_status") == "completed"})


def stream_latency_window(spark: SparkSession, sf: str) -> DataFrame:
    """Daily latency of the event table, by the function that also serves streams."""
    return incremental.windowed_latency(spark.read.parquet(f"{sf}/events.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        section_split, recursive_chunk, chunk_fixed_split, upsert_idempotent, stale_delete, sticky_global, feed_dedupe, month_window, dq_chunk_index_unique, dq_chunk_one_paper, dq_next_edges, dq_points_have_chunks,
        dq_global_points, dq_completed_have_chunks, dq_predicates, dq_source_versions, dq_embedding_signature, dup_case_ids, gold_ids_exist, stream_incremental, stream_latency_window, indexing_job, indexing_summary, seed_graph, unseed_counts,
    )
}

_T = f"WITH {CHUNKS}, {PAPERS}, {CASES} "
SQL = {
    "indexing_job": _T + """SELECT paper_id, stage = 'written' AS ok, stage FROM (SELECT paper_id, CASE WHEN m.paper_id IS NULL THEN 'fetch' WHEN trim(coalesce(body, '')) = '' THEN 'preprocess' WHEN trim(coalesce(title, '')) = '' OR trim(coalesce(source_version, '')) = '' OR trim(coalesce(content_hash, '')) = '' THEN 'graph' ELSE 'written' END AS stage
 FROM cur_papers p LEFT JOIN (SELECT paper_id, max(text) AS body FROM paper_markdown GROUP BY 1) m USING (paper_id) WHERE processing_status = 'pending')""",
    "seed_graph": _T + """SELECT 'papers' AS table_name, count(DISTINCT paper_id) AS n FROM cur_chunks UNION ALL SELECT 'chunks', count(*) FROM cur_chunks UNION ALL SELECT 'points', count(*) FROM cur_chunks
 UNION ALL SELECT 'next_chunk', count(*) - count(DISTINCT paper_id) FROM cur_chunks UNION ALL SELECT 'cites', count(*) FROM (SELECT DISTINCT source_paper_id, target_paper_id FROM citation_edges WHERE source_paper_id <> target_paper_id)""",
    "unseed_counts": _T + "SELECT papers, chunks, papers + chunks AS removed FROM (SELECT count(*) papers FROM cur_papers WHERE processing_status = 'pending'), (SELECT count(*) chunks FROM cur_chunks WHERE paper_id IN (SELECT paper_id FROM cur_papers WHERE processing_status = 'pending'))",
    "upsert_idempotent": """WITH p AS (SELECT paper_id, title, processing_status = 'completed' g, ingested_at, ingested_at < TIMESTAMPTZ '2023-01-01 00:00:00+00' old, row_number() OVER (PARTITION BY paper_id, ingested_at < TIMESTAMPTZ '2023-01-01 00:00:00+00' ORDER BY ingested_at DESC, title DESC, is_deleted DESC) rn FROM papers),
 o AS (SELECT * FROM p WHERE old AND rn = 1), n AS (SELECT * FROM p WHERE NOT old AND rn = 1)
 SELECT coalesce(n.paper_id, o.paper_id) AS paper_id, CASE WHEN n.paper_id IS NULL THEN o.title ELSE n.title END AS title, CASE WHEN n.paper_id IS NULL THEN o.g ELSE coalesce(o.g, false) OR coalesce(n.g, false) END AS is_global, strftime(coalesce(o.ingested_at, n.ingested_at), '%Y-%m-%d') AS created_on FROM o FULL JOIN n ON o.paper_id = n.paper_id""",
    "stale_delete": _T + "SELECT DISTINCT paper_id, chunk_id FROM chunks WHERE paper_id NOT IN (SELECT paper_id FROM cur_chunks) OR chunk_id IN (SELECT chunk_id FROM cur_chunks)",
    "sticky_global": "SELECT DISTINCT v.paper_id, v.chunk_id, h.g AS in_global_corpus FROM vector_points v JOIN (SELECT paper_id, bool_or(coalesce(in_global_corpus, false)) g FROM vector_points GROUP BY 1) h USING (paper_id)",
    "feed_dedupe": "SELECT paper_id, strftime(day, '%Y-%m-%d') AS day, title FROM (SELECT paper_id, CAST(ingested_at AS DATE) AS day, title, row_number() OVER (PARTITION BY paper_id ORDER BY CAST(ingested_at AS DATE), title NULLS FIRST) rn FROM papers) WHERE rn = 1",
    "month_window": "SELECT DISTINCT strftime(ingested_at, '%Y-%m') AS month, strftime(date_trunc('month', ingested_at), '%Y-%m-%d') AS first_day, CASE WHEN date_trunc('month', ingested_at) <= DATE '2024-06-15' THEN strftime(least(last_day(CAST(ingested_at AS DATE)), DATE '2024-06-15'), '%Y-%m-%d') END AS last_day FROM papers",
    "dq_chunk_index_unique": _T + "SELECT paper_id, chunk_index, count(*) AS n FROM cur_chunks GROUP BY ALL HAVING count(*) > 1",
    "dq_chunk_one_paper": "SELECT chunk_id, count(DISTINCT paper_id) AS n FROM chunks GROUP BY 1 HAVING count(DISTINCT paper_id) > 1",
    "dq_next_edges": _T + 'SELECT "left", "right", gap FROM (SELECT chunk_id AS "left", lead(chunk_id) OVER w AS "right", lead(chunk_index) OVER w - chunk_index AS gap FROM cur_chunks WINDOW w AS (PARTITION BY paper_id ORDER BY chunk_index, chunk_id)) WHERE gap <> 1',
    "dq_points_have_chunks": _T + "SELECT DISTINCT chunk_id FROM vector_points WHERE chunk_id NOT IN (SELECT chunk_id FROM cur_chunks)",
    "dq_global_points": "SELECT paper_id, count(*) FILTER (in_global_corpus) AS n_global, count(*) FILTER (NOT in_global_corpus) AS n_other FROM vector_points GROUP BY 1 HAVING count(*) FILTER (in_global_corpus) > 0 AND count(*) FILTER (NOT in_global_corpus) > 0",
    "dq_completed_have_chunks": _T + "SELECT paper_id FROM cur_papers WHERE processing_status = 'completed' AND paper_id NOT IN (SELECT paper_id FROM cur_chunks)",
    "dq_predicates": _T + "SELECT predicate, count(*) AS n FROM (SELECT unnest(gold_triples).predicate predicate FROM cur_cases) WHERE predicate IS NULL OR predicate NOT IN ('USES_METHOD', 'EVALUATED_ON') GROUP BY 1",
    "dq_source_versions": "SELECT source_version, count(*) AS n FROM vector_points WHERE source_version IS NULL OR source_version NOT IN ('hf-markdown', 'pdf-pymupdf4llm') GROUP BY 1",
    "dq_embedding_signature": "SELECT embedding_provider, embedding_model, embedding_dimension, embedding_version, count(*) AS n FROM vector_points WHERE NOT (embedding_provider = 'hash' AND embedding_model = 'hash-embed-64' AND embedding_dimension = 64 AND embedding_version = 'v2') GROUP BY ALL",
    "dup_case_ids": "SELECT case_id, count(*) AS n FROM eval_cases GROUP BY 1 HAVING count(*) > 1",
    "gold_ids_exist": _T + "SELECT DISTINCT chunk_id FROM (SELECT unnest(gold_chunk_ids) chunk_id FROM cur_cases) WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM cur_chunks)",
    "stream_incremental": "SELECT paper_id, title, processing_status, is_deleted, strftime(ingested_at, '%Y-%m-%d') AS loaded_on FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at DESC NULLS LAST, is_deleted DESC NULLS LAST, title DESC NULLS LAST) rn FROM papers) WHERE rn = 1",
    "stream_latency_window": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n_events, count(*) FILTER (event_type = 'error') AS n_errors, round(avg(value) FILTER (event_type <> 'error'), 6) AS latency_mean FROM events GROUP BY 1",
}
