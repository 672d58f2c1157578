"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import leak, mix, names, neardup, ocr, split, subjects
from paperloom.operators.lexical import if_small
from paperloom.session import shared_dir
from paperloom.sources.tables import table


def _records(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), "text")
    papers = table(spark, sf, "papers").select(F.lit("abstract").alias("kind"), F.col("paper_id").alias("id"), F.col("abstract").alias("text"))
    return chunks.unionByName(papers)


def _spellings(rows: DataFrame, name: str = "name") -> DataFrame:
    return rows.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of spellings in `authors.name` that denote one person or institution."""
    return names.name_pairs(names.NameLinks(_spellings(table(spark, sf, "authors"))).entities)


def p2_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The entity of every spelling in `authors.name`, `authors.normalized_name` and `papers.authors`."""
    authors, papers = table(spark, sf, "authors"), table(spark, sf, "papers")
    every = _spellings(authors).unionByName(_spellings(authors, "normalized_name")).unionByName(_spellings(papers.select(F.explode("authors").alias("name"))))
    return names.clusters(names.NameLinks(every).entities)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of chunks, and of abstracts, whose sets of 3-word runs are at least 0.6 alike."""
    found = neardup.NearDuplicates(_records(spark, sf), k=3, threshold=0.6)
    return neardup.id_pairs(found).withColumnRenamed("kind", "record_kind")


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Class, group and number of links of every record, at five words and a similarity of 0.8."""
    return neardup.groups(neardup.NearDuplicates(_records(spark, sf), k=5, threshold=0.8))


def _noise(spark: SparkSession, sf: str) -> ocr.ScanNoise:
    return ocr.ScanNoise(table(spark, sf, "chunks"), table(spark, sf, "papers"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of scanner noise in each chunk."""
    return _noise(spark, sf).damage


def p4_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """The damaged chunks as repaired, continuous paragraphs."""
    return _noise(spark, sf).repaired


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sections longer than 1,200 characters."""
    return split.oversized(split.split_sections(table(spark, sf, "paper_markdown")))


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of at most 1,200 characters of every section, with up to 150 characters of overlap."""
    papers = table(spark, sf, "paper_markdown").groupBy("paper_id", F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"))
    return split.split_sections(papers)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold at least a third of the 4-word runs of a held-out item."""
    return leak.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_passages")).select("doc_id", "item_id").distinct()


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """The items that leaked."""
    items = table(spark, sf, "eval_passages")
    return leak.leak_report(leak.leaks(table(spark, sf, "documents"), items), items)


def p7_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that leak, with their overlap with questions and with answers."""
    items = table(spark, sf, "eval_passages")
    return leak.leak_documents(leak.leaks(table(spark, sf, "documents"), items), items)


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts, written once: the plan of the mix reads them several times."""
    at = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    mix.count_tokens(table(spark, sf, "documents")).write.parquet(at)
    return spark.read.parquet(at)


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mix, how often each is used, and the share its source reached."""
    tokens, targets = _tokens(spark, sf), table(spark, sf, "mix_targets")
    mixed = mix.mix_sources(tokens, targets)
    shares = mix.mix_shares(mixed, tokens, targets).select("source", "target_share", "actual_share")
    return mixed.join(if_small(shares), "source")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source."""
    tokens, targets = _tokens(spark, sf), table(spark, sf, "mix_targets")
    return mix.mix_shares(mix.mix_sources(tokens, targets), tokens, targets)


def _areas(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    areas = [r["subject_code"] for r in table(spark, sf, "subjects").select("subject_code").distinct().collect()]
    features = subjects.featurize(documents)
    return subjects.classify(features, subjects.fit(features, table(spark, sf, "subject_labels"), areas))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Areas that at least a quarter of a document's sentences are about."""
    return _areas(spark, sf).select("doc_id", "subject_code")


def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and characters of each area in the whole corpus."""
    return subjects.composition(_areas(spark, sf), table(spark, sf, "documents"), table(spark, sf, "subjects"))


QUERIES = {f.__name__: f for f in (p2_found, p2_clusters, p3_found, p3_groups, p4_found, p4_repaired, p5_found, p5_pieces, p7_found, p7_report, p7_documents, p8_mix, p8_shares, p9_found, p9_composition)}

_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def _runs(k: int) -> str:
    return "list_distinct(list_transform(range(1, len(w) - " + str(k - 2) + "), lambda i: array_to_string(list_slice(w, i, i + " + str(k - 1) + "), ' ')))"


_P7 = f"""
WITH i AS (SELECT item_id, unnest({_runs(4)}) r FROM (SELECT DISTINCT item_id, {_WORDS} w FROM eval_passages WHERE text IS NOT NULL) WHERE len(w) >= 4),
 n AS (SELECT item_id, count(*) n FROM i GROUP BY 1),
 d AS (SELECT doc_id, unnest({_runs(4)}) r FROM (SELECT doc_id, {_WORDS} w FROM documents WHERE text IS NOT NULL) WHERE len(w) >= 4),
 h AS (SELECT doc_id, item_id, count(*) held FROM d JOIN i USING (r) GROUP BY ALL),
 found AS (SELECT doc_id, item_id, held, n FROM h JOIN n USING (item_id) WHERE held * 3 >= n)
"""

SQL = {
    "p3_found": f"""
WITH t AS (SELECT 'chunk' kind, chunk_id id, text FROM chunks UNION SELECT 'abstract', paper_id, abstract FROM papers),
 s AS (SELECT DISTINCT kind, id, {_runs(3)} runs FROM (SELECT kind, id, {_WORDS} w FROM t WHERE text IS NOT NULL AND id IS NOT NULL) WHERE len(w) >= 3),
 u AS (SELECT *, row_number() OVER () u, len(runs) n FROM s), e AS (SELECT kind, u, n, id, unnest(runs) r FROM u),
 f AS (SELECT kind, r FROM e GROUP BY 1, 2 HAVING count(*) > 1), g AS (SELECT e.* FROM e JOIN f USING (kind, r)),
 p AS (SELECT a.kind, a.id id_a, b.id id_b, a.u, b.u v, any_value(a.n) n, any_value(b.n) m, count(*) c FROM g a JOIN g b ON a.kind = b.kind AND a.r = b.r AND a.id < b.id GROUP BY a.kind, a.id, b.id, a.u, b.u)
SELECT DISTINCT kind AS record_kind, id_a, id_b FROM p WHERE c >= 0.6 * (n + m - c) - 1e-9""",
    "p7_found": _P7 + "SELECT DISTINCT doc_id, item_id FROM found",
    "p7_documents": _P7
    + """, k AS (SELECT doc_id, split_name, item_id, item_kind, held / n share FROM found JOIN (SELECT DISTINCT item_id, item_kind, split_name FROM eval_passages) USING (item_id))
 SELECT doc_id, split_name, count(DISTINCT item_id) AS n_items, count(DISTINCT item_id) FILTER (item_kind = 'question') AS n_questions, count(DISTINCT item_id) FILTER (item_kind = 'answer') AS n_answers, round(max(share) FILTER (item_kind = 'question'), 6) AS question_overlap,
  round(max(share) FILTER (item_kind = 'answer'), 6) AS answer_overlap, bool_or(item_kind = 'question') AND bool_or(item_kind = 'answer') AS complete FROM k GROUP BY doc_id, split_name""",
    "p7_report": _P7
    + """SELECT f.item_id, any_value(e.item_kind) AS item_kind, any_value(e.split_name) AS split_name, count(DISTINCT doc_id) AS n_documents, round(max(held / n), 6) AS most_held
 FROM found f LEFT JOIN (SELECT DISTINCT item_id, item_kind, split_name FROM eval_passages) e USING (item_id) GROUP BY f.item_id""",
}
