"""Public question-answering sets as chunk corpora and evaluation cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.ids import chunk_id
from paperloom.functions.text import collapse
from paperloom.operators.chunking import split_text
from paperloom.operators.evidence import match_evidence

QASPER = (
    "id string, title string, abstract string, full_text struct<section_name: array<string>, paragraphs: array<array<string>>>, qas struct<question: array<string>, question_id: array<string>, "
    "answers: array<struct<answer: array<struct<unanswerable: boolean, evidence: array<string>, free_form_answer: string, extractive_spans: array<string>>>>>>"
)
HOP_CORPUS, HOP_QUERIES = "title string, url string, category string, body string", "query string, question_type string, answer string, evidence_list array<struct<fact: string, url: string, title: string>>"
SHORTEST = 40


def qasper(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (a paragraph each, abstract first, 40 characters at least) and cases of papers with questions.

    Evidence becomes gold chunk ids by the tiered matcher inside the paper; the answer is the free form, else the spans
    joined by "; ". Questions without evidence found and without answer are left out.
    """
    paper = F.concat(F.lit("arxiv:"), F.regexp_replace("id", "^arxiv:", ""))
    base = rows.where(F.length("id") > 0).withColumn("paper_id", paper)
    body = F.flatten(F.transform(F.arrays_zip(F.col("full_text.section_name").alias("s"), F.col("full_text.paragraphs").alias("p")), lambda z: F.transform(z["p"], lambda t: F.struct(z["s"].alias("section"), F.trim(t).alias("text")))))
    first = F.array(F.struct(F.lit("Abstract").alias("section"), F.trim("abstract").alias("text")))
    parts = F.filter(F.concat(first, F.coalesce(body, F.array().cast("array<struct<section string, text string>>"))), lambda x: F.length(x["text"]) >= SHORTEST)
    c = base.select("paper_id", "title", F.posexplode(parts).alias("chunk_index", "x")).select("paper_id", "title", "chunk_index", "x.section", "x.text")
    chunks = c.withColumn("chunk_id", chunk_id(F.col("paper_id"), F.col("chunk_index"), F.col("text")))
    q = base.select("paper_id", F.inline(F.arrays_zip(F.col("qas.question").alias("question"), F.col("qas.answers").alias("answers"))))
    a = q.select("paper_id", "question", F.col("answers.answer").alias("list"))
    a = a.withColumn("case_id", F.concat(F.lit("qasper-"), F.substring(F.sha1(F.concat_ws("|", "paper_id", "question")), 1, 12)))
    said = F.filter("list", lambda x: ~F.coalesce(x["unanswerable"], F.lit(False)))
    text = F.get(F.filter(F.transform(said, lambda x: F.coalesce(F.nullif(F.trim(x["free_form_answer"]), F.lit("")), F.nullif(F.array_join(x["extractive_spans"], "; "), F.lit("")))), lambda t: t.isNotNull()), F.lit(0))
    evidence = a.select("case_id", "paper_id", F.explode(F.array_distinct(F.flatten(F.transform("list", lambda x: F.coalesce(x["evidence"], F.array().cast("array<string>")))))).alias("text"))
    return chunks, _cases(a.select("case_id", "question", "paper_id", text.alias("gold_answer")), evidence, chunks)


def _cases(base: DataFrame, evidence: DataFrame, chunks: DataFrame, live: DataFrame | None = None) -> DataFrame:
    e = evidence.withColumn("evidence_id", F.concat_ws("|", "case_id", F.sha1("text")))
    gold = e.select("evidence_id", "case_id").distinct().join(match_evidence(e, chunks, live=live), "evidence_id").join((chunks if live is None else live).select("chunk_id", F.col("paper_id").alias("p")), "chunk_id")
    per = gold.groupBy("case_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("gold_chunk_ids"), F.array_sort(F.collect_set("p")).alias("gold_paper_ids"))
    out = base.join(per, "case_id", "left").where(F.col("gold_chunk_ids").isNotNull() | (F.length("gold_answer") > 0))
    empty = F.array().cast("array<string>")
    n = F.size(F.coalesce("gold_paper_ids", empty))
    return out.select("case_id", "question", "paper_id", F.coalesce("gold_chunk_ids", empty).alias("gold_chunk_ids"), F.coalesce("gold_paper_ids", empty).alias("gold_paper_ids"), "gold_answer", F.when(n > 1, "global").when(n == 1, "selected").otherwise("unknown").alias("expected_scope"))


def multihop(corpus: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of articles and cases whose evidence names its article by address or, failing that, by title."""
    slug = lambda c: F.substring(F.sha1(F.lower(F.regexp_replace(F.trim(c), "/+$", ""))), 1, 12)
    docs = corpus.where(F.length("body") > 0).groupBy(F.concat(F.lit("hf:"), slug(F.coalesce(F.nullif("url", F.lit("")), F.col("title")))).alias("paper_id")).agg(F.max_by(F.struct("title", "url", "body"), F.struct("title", "body")).alias("d")).select("paper_id", "d.*")
    pieces = F.udf(lambda t: split_text(t), "array<string>", useArrow=True)
    c = docs.select("paper_id", "title", F.posexplode(pieces("body")).alias("chunk_index", "text"))
    chunks = c.withColumn("chunk_id", chunk_id(F.col("paper_id"), F.col("chunk_index"), F.col("text")))
    q = queries.where(F.length("query") > 0).withColumn("case_id", F.concat(F.lit("multihop-"), F.substring(F.sha1("query"), 1, 12)))
    e = q.select("case_id", F.inline("evidence_list"))
    by_url, by_title = docs.select(slug(F.col("url")).alias("u"), F.col("paper_id").alias("pu")).dropDuplicates(["u"]), docs.select(collapse(F.lower("title")).alias("t"), F.col("paper_id").alias("pt")).dropDuplicates(["t"])
    e = e.withColumns({"u": slug(F.col("url")), "t": collapse(F.lower("title"))}).join(by_url, "u", "left").join(by_title, "t", "left")
    evidence = e.select("case_id", F.coalesce("pu", "pt").alias("paper_id"), F.col("fact").alias("text")).where(F.col("paper_id").isNotNull())
    cases = _cases(q.select("case_id", F.col("query").alias("question"), F.lit(None).cast("string").alias("paper_id"), F.col("answer").alias("gold_answer")), evidence, chunks)
    return chunks, cases


GRAPH_CORPUS, GRAPH_QUESTIONS = "title string, source string, context string, text string, content string, corpus string", "id string, question string, answer string, question_type string, evidence array<string>"


def graph_bench(corpus: DataFrame | None, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of plain articles and cases of questions with evidence sentences.

    The body is the first filled of context, text, content and corpus. Without a corpus there are no chunks and the
    cases have answers only. Questions without an answer and without evidence found are left out.
    """
    spark = questions.sparkSession
    if corpus is None:
        corpus = spark.createDataFrame([], GRAPH_CORPUS)
    body = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("context", "text", "content", "corpus")])
    docs = corpus.select(F.coalesce(F.nullif("title", F.lit("")), F.col("source")).alias("title"), body.alias("body")).where(F.col("body").isNotNull())
    docs = docs.groupBy(F.concat(F.lit("hf:"), F.substring(F.sha1(F.coalesce("title", F.col("body"))), 1, 12)).alias("paper_id")).agg(F.min_by(F.struct("title", "body"), F.struct("title", "body")).alias("d")).select("paper_id", "d.*")
    pieces = F.udf(lambda t: split_text(t), "array<string>", useArrow=True)
    c = docs.select("paper_id", "title", F.posexplode(pieces("body")).alias("chunk_index", "text"))
    chunks = c.withColumn("chunk_id", chunk_id(F.col("paper_id"), F.col("chunk_index"), F.col("text")))
    q = questions.where(F.length("question") > 0).withColumn("case_id", F.concat(F.lit("graph-"), F.substring(F.sha1("question"), 1, 12)))
    evidence = q.select("case_id", F.lit(None).cast("string").alias("paper_id"), F.explode("evidence").alias("text")).where(F.length("text") > 0)
    return chunks, _cases(q.select("case_id", "question", F.lit(None).cast("string").alias("paper_id"), F.col("answer").alias("gold_answer")), evidence, chunks)


def imported_cases(rows: DataFrame, chunks: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Cases of generated test sets ``user_input, reference, reference_contexts``: contexts become gold ids by the tiered
    matcher, cases without any are dropped; the tags tell hops and scope. ``live(chunk_id, version, paper_id)`` as there."""
    q = rows.where(F.length("user_input") > 0).withColumn("case_id", F.concat(F.lit("imp-"), F.substring(F.sha1("user_input"), 1, 12)))
    evidence = q.select("case_id", F.lit(None).cast("string").alias("paper_id"), F.explode("reference_contexts").alias("text")).where(F.length("text") > 0)
    cases = _cases(q.select("case_id", F.col("user_input").alias("question"), F.lit(None).cast("string").alias("paper_id"), F.col("reference").alias("gold_answer")), evidence, chunks, live).where(F.size("gold_chunk_ids") > 0)
    hops = F.when(F.size("gold_chunk_ids") > 1, "multi-hop").otherwise("single-hop")
    return cases.withColumn("tags", F.array(hops, F.when(F.size("gold_paper_ids") > 1, "global").otherwise("local")))


#: Converters by the name of the format they read.
CONVERTERS = {"qasper": qasper, "multihop": multihop, "graph": graph_bench}
