"""Lexical search and text queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions import ids, text
from paperloom.operators import lexical
from paperloom.session import cut, spread
from paperloom.sources.tables import table


#: Columns of the tables that queries work with.
CHUNK = ("paper_id", "chunk_index", "text", "section", "section_index", "is_references", "char_count")
PAPER = ("arxiv_id", "title", "abstract", "authors", "published_at", "processing_status")


def latest(rows: DataFrame, key: str, *columns: str | Column) -> DataFrame:
    """``columns`` of the latest row of every key that is not deleted; rows equal in time are taken in a fixed order.

    Only these columns are shuffled. Expressions are computed in the scan, so what a query needs of a text (its tokens,
    its length) moves in place of the text.
    """
    r = rows.groupBy(key).agg(F.max_by(F.struct(*columns, "is_deleted"), F.struct("ingested_at", "is_deleted")).alias("r"))
    return r.select(key, "r.*").where(~F.col("is_deleted")).drop("is_deleted")


def current_chunks(spark: SparkSession, sf: str, *columns: str | Column) -> DataFrame:
    return latest(table(spark, sf, "chunks"), "chunk_id", *(columns or CHUNK))


def current_among(spark: SparkSession, sf: str, ids: DataFrame, *columns: str | Column) -> DataFrame:
    """:func:`current_chunks` of the ids in ``ids(chunk_id)`` alone, whose texts may then move."""
    wanted = lexical.if_small(ids.select("chunk_id").distinct())
    return latest(table(spark, sf, "chunks").join(wanted, "chunk_id", "left_semi"), "chunk_id", *columns)


def current_papers(spark: SparkSession, sf: str, *columns: str | Column) -> DataFrame:
    return latest(table(spark, sf, "papers"), "paper_id", *(columns or PAPER))


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """One row per case id: the earliest, then the smallest question."""
    t = table(spark, sf, "eval_cases")
    return t.withColumn("_rn", F.row_number().over(W.partitionBy("case_id").orderBy("created_at", "question"))).where("_rn = 1").drop("_rn")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set of searches: cases whose number is divisible by 50."""
    return cases(spark, sf).where(F.regexp_extract("case_id", r"(\d+)$", 1).cast("bigint") % 50 == 0).select(F.col("case_id").alias("query_id"), F.col("question").alias("text"), "paper_id", "gold_chunk_ids", "expected_scope")


def corpus(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All versions ``doc_id, version, paper_id, text`` of the chunks, and which are searched: ``doc_id, version, paper_id,
    len`` with the number of tokens. The latter is written once, since several steps of a search read it."""
    version = F.xxhash64("paper_id", "is_references", "text").alias("version")
    every = spread(table(spark, sf, "chunks").select(F.col("chunk_id").alias("doc_id"), version, "paper_id", "text"))
    size = F.size(text.tokenize(F.coalesce("text", F.lit("")))).alias("len")
    live = current_chunks(spark, sf, version, "paper_id", "is_references", size).where(~F.col("is_references"))
    return every, cut(live.select(F.col("chunk_id").alias("doc_id"), "version", "paper_id", "len"))


def doc_tokens_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", text.tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))
    return lexical.corpus_stats(d).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


def doc_frequency(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", text.tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))
    n = lexical.corpus_stats(d)
    return lexical.document_frequency(d).crossJoin(F.broadcast(n)).select("term", "df", F.round(lexical.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 top 10 chunks for every asked question."""
    q, (d, live) = asked(spark, sf), corpus(spark, sf)
    return lexical.top_k(lexical.bm25_scores(q, d, live)).select("query_id", "rank", "doc_id", "score")


def bm25_routing(spark: SparkSession, sf: str) -> DataFrame:
    q, (d, live) = asked(spark, sf), corpus(spark, sf)
    return lexical.route(lexical.bm25_best(q, d, live, 1), live, q)


def bm25_extractive_answer(spark: SparkSession, sf: str) -> DataFrame:
    q, (d, live) = asked(spark, sf), corpus(spark, sf)
    s = cut(lexical.bm25_best(q, d, live))
    return lexical.extractive_answers(lexical.routed_hits(s, live, q, lexical.route(s, live, q)), d, live)


def paper_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Every reference as written and its canonical ids of both kinds."""
    r = table(spark, sf, "papers").select(F.explode("reference_ids").alias("raw")).where(F.col("raw").isNotNull()).distinct()
    return r.select("raw", ids.paper_id(F.lit(None).cast("string"), F.col("raw")).alias("canonical_id"), ids.paper_id_with_default(F.col("raw")).alias("default_id"))


def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk ids and point ids derived from paper, index and text."""
    t = table(spark, sf, "chunks").select("paper_id", "chunk_index", "text").distinct()
    c = ids.chunk_id(F.col("paper_id"), F.col("chunk_index"), F.col("text"))
    return t.select(c.alias("chunk_id"), ids.uuid5(F.concat(F.lit("paperloom:chunk:"), c)).alias("point_id"), F.length("text").alias("char_count"))


def author_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Authors of each current paper by position, with provisional ids."""
    p = current_papers(spark, sf, "authors").select("paper_id", F.posexplode("authors").alias("author_order", "name")).where(F.trim("name") != "")
    key = text.name_key(F.trim("name"))
    r = p.select("paper_id", "author_order", F.trim("name").alias("name"), key.alias("name_key"))
    return r.select("paper_id", "author_order", "name", "name_key", ids.author_id(F.col("paper_id"), F.col("author_order"), F.col("name_key")).alias("author_id"))


def markdown_clean(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "paper_markdown").select("paper_id", "text").distinct()
    c = text.clean_markdown(F.col("text"))
    return m.select("paper_id", F.length(c).alias("n_chars"), F.sha2(c, 256).alias("digest"))


def page_body_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Usability of fetched bodies: the Markdown table taken as responses of status 200."""
    m = table(spark, sf, "paper_markdown").select("paper_id", "text", "source").distinct()
    return m.select("paper_id", F.coalesce(text.body_problem(F.col("text"), F.lit(200), F.col("source")), F.lit("ok")).alias("verdict"), F.length(text.strip_feed_header(F.col("text"))).alias("n_chars"))


def arxiv_extract(spark: SparkSession, sf: str) -> DataFrame:
    """arXiv ids cited in the reference chunks of each paper."""
    c = table(spark, sf, "chunks").where("is_references").select("paper_id", F.explode(text.arxiv_ids(F.col("text"), F.col("paper_id"))).alias("cited"))
    return c.groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_set("cited")), ",").alias("cited"), F.countDistinct("cited").alias("n_cited"))


def paper_search(spark: SparkSession, sf: str) -> DataFrame:
    """Papers whose title or authors contain a word, ignoring case, or whose id contains it."""
    q = "graph"
    p = current_papers(spark, sf, "title", "authors")
    hit = F.contains(F.lower("title"), F.lit(q)) | F.contains(F.lower(F.array_join("authors", "\n")), F.lit(q)) | F.contains(F.lower("paper_id"), F.lit(q))
    return p.where(hit).select("paper_id", "title")


QUERIES = {f.__name__: f for f in (doc_tokens_stats, doc_frequency, bm25_topk, bm25_routing, bm25_extractive_answer, paper_ids, chunk_ids, author_rows, markdown_clean, page_body_validity, arxiv_extract, paper_search)}

_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"


def tok(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+|[가-힣]+'), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))"


CHUNKS = "cur_chunks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC, is_deleted DESC) rn FROM chunks) WHERE rn = 1 AND NOT is_deleted)"
PAPERS = "cur_papers AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at DESC, is_deleted DESC) rn FROM papers) WHERE rn = 1 AND NOT is_deleted)"
CASES = "cur_cases AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY created_at, question) rn FROM eval_cases) WHERE rn = 1)"
_BM25 = f"""
WITH {CHUNKS}, {CASES},
 asked AS (SELECT case_id query_id, question, paper_id FROM cur_cases WHERE CAST(regexp_extract(case_id, '([0-9]+)$', 1) AS BIGINT) % 50 = 0),
 d AS (SELECT chunk_id doc_id, paper_id, text, {tok("coalesce(text, '')")} tokens FROM cur_chunks WHERE NOT is_references),
 st AS (SELECT count(*) n, coalesce(nullif(avg(len(tokens)), 0), 1.0) al FROM d),
 q AS (SELECT query_id, term, count(*) qtf FROM (SELECT query_id, unnest({tok('question')}) term FROM asked) GROUP BY ALL),
 tf AS (SELECT doc_id, l, term, count(*) tf FROM (SELECT doc_id, len(tokens) l, unnest(tokens) term FROM d) GROUP BY ALL),
 dfs AS (SELECT term, count(*) df FROM tf GROUP BY term),
 scores AS (SELECT * FROM (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(l, 1) / al))), 6) score
   FROM q JOIN dfs USING (term) JOIN tf USING (term), st GROUP BY query_id, doc_id) WHERE score > 0),
 ratios AS (SELECT query_id, coalesce(round(max(CASE WHEN d.paper_id = asked.paper_id THEN score END) / max(score), 6), 0.0) ratio FROM asked LEFT JOIN scores USING (query_id) LEFT JOIN d USING (doc_id) GROUP BY query_id),
 routes AS (SELECT query_id, ratio, CASE WHEN ratio >= 0.45 THEN 'selected' ELSE 'global' END AS scope FROM ratios)
"""

SQL = {
    "doc_tokens_stats": f"SELECT count(*) AS n_docs, round(coalesce(nullif(avg(len(t)), 0), 1.0), 6) AS avg_len FROM (SELECT {tok('coalesce(text, $$$$)')} t FROM documents)",
    "doc_frequency": f"WITH d AS (SELECT list_distinct({tok('coalesce(text, $$$$)')}) t FROM documents), n AS (SELECT count(*) n FROM d), f AS (SELECT term, count(*) df FROM (SELECT unnest(t) term FROM d) GROUP BY term) SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM f, n",
    "bm25_topk": _BM25 + "SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM scores) WHERE rank <= 10",
    "bm25_routing": _BM25 + "SELECT * FROM routes",
    "bm25_extractive_answer": _BM25
    + """, h AS (SELECT s.*, d.text, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, s.doc_id) rank FROM scores s JOIN d USING (doc_id) JOIN routes r ON r.query_id = s.query_id JOIN asked a ON a.query_id = s.query_id
  WHERE r.scope = 'global' OR a.paper_id IS NULL OR d.paper_id = a.paper_id)
 SELECT query_id, array_to_string(list(regexp_replace(trim(split_part(text, '. ', 1)), '\\.+$', '') || '.' ORDER BY rank) FILTER (rank <= 2), ' ') AS answer, array_to_string(list(doc_id ORDER BY rank) FILTER (rank <= 3), ',') AS citations FROM h WHERE rank <= 3 GROUP BY query_id""",
    "paper_ids": r"""SELECT DISTINCT raw, CASE WHEN regexp_matches(raw, '^(arxiv|hf|ref):') THEN raw WHEN regexp_matches(raw, '^([0-9]{4}\.[0-9]{4,5}|[A-Za-z-]+(\.[A-Za-z-]+)?/[0-9]{7})$') THEN 'arxiv:' || raw ELSE 'hf:' || raw END AS canonical_id,
 CASE WHEN raw = '' OR regexp_matches(raw, '(?i)^(arxiv|hf|ref):') THEN raw ELSE 'arxiv:' || raw END AS default_id FROM (SELECT unnest(reference_ids) raw FROM papers) WHERE raw IS NOT NULL""",
    "chunk_ids": r"""WITH c AS (SELECT DISTINCT paper_id || ':chunk:' || chunk_index || ':' || substr(sha256(text), 1, 8) AS chunk_id, text, paper_id, chunk_index FROM chunks),
 h AS (SELECT chunk_id, length(text) char_count, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('paperloom:chunk:' || chunk_id)) h FROM c)
 SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE WHEN substr(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substr(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id, CAST(char_count AS INTEGER) AS char_count FROM h""",
    "author_rows": f"""WITH {PAPERS}, a AS (SELECT paper_id, trim(name, ' ') n, CAST(i AS INTEGER) i FROM (SELECT paper_id, unnest(authors) name, generate_subscripts(authors, 1) - 1 i FROM cur_papers) WHERE trim(name, ' ') <> ''),
 k AS (SELECT paper_id, i, n, trim(regexp_replace(lower(nfc_normalize(n)), '\\s+', ' ', 'g')) key FROM a)
 SELECT paper_id, i AS author_order, n AS name, key AS name_key, 'author:provisional:' || substr(sha256(paper_id || '|' || i || '|' || key), 1, 20) AS author_id FROM k""",
    "markdown_clean": r"""WITH m AS (SELECT DISTINCT paper_id, text FROM paper_markdown), c AS (SELECT paper_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g') t FROM m)
 SELECT paper_id, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS digest FROM c""",
    "page_body_validity": r"""WITH m AS (SELECT DISTINCT paper_id, text, source FROM paper_markdown), b AS (SELECT paper_id, source, trim(CASE WHEN instr(text, 'Markdown Content:') > 0 THEN substr(text, instr(text, 'Markdown Content:') + 17) ELSE text END, ' ') t FROM m)
 SELECT paper_id, CASE WHEN contains(lower(source), 'html') THEN 'content-type' WHEN length(t) < 500 THEN 'short' WHEN regexp_matches(lower(substr(ltrim(t), 1, 200)), '^(<!doctype|<html|<\?xml)') THEN 'markup' ELSE 'ok' END AS verdict, CAST(length(t) AS INTEGER) AS n_chars FROM b""",
    "arxiv_extract": r"""WITH c AS (SELECT paper_id, lower(x) x FROM (SELECT paper_id, unnest(list_concat(regexp_extract_all(text, '(?i)arxiv\s*:\s*([0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[A-Za-z]{2})?/[0-9]{7})(?:v[0-9]+)?', 1), regexp_extract_all(text, '(?i)arxiv\.org/(?:abs|pdf|html)/([0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[A-Za-z]{2})?/[0-9]{7})(?:v[0-9]+)?', 1))) x FROM chunks WHERE is_references))
 SELECT paper_id, string_agg(DISTINCT x, ',' ORDER BY x) AS cited, count(DISTINCT x) AS n_cited FROM c WHERE x <> regexp_replace(lower(paper_id), '^arxiv:|v[0-9]+$', '', 'g') GROUP BY paper_id""",
    "paper_search": f"WITH {PAPERS} SELECT paper_id, title FROM cur_papers WHERE contains(lower(title), 'graph') OR contains(lower(array_to_string(authors, chr(10))), 'graph') OR contains(lower(paper_id), 'graph')",
}
