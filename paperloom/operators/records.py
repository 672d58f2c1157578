"""Scans, payloads and look-ups of chunk records."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.operators.lexical import if_small


def scan(chunks: DataFrame, papers: Sequence[str] | None = None, skip: int = 0, limit: int | None = None, after: str | None = None) -> DataFrame:
    """Chunks in order of id, from ``skip`` on, optionally of some papers; pages of one table do not overlap.

    ``after`` is the last id of the page before: a page by key is a top-k of ``limit`` rows however far on it lies, while
    ``skip`` makes each task keep ``skip + limit`` rows.
    """
    df = chunks if papers is None else chunks.where(F.col("paper_id").isin(list(papers)))
    df = df if after is None else df.where(F.col("chunk_id") > after)
    df = df.orderBy("chunk_id").offset(skip)
    return df if limit is None else df.limit(limit)


def multi_get(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks with the asked ids; unknown ids give nothing."""
    return chunks.join(if_small(ids.select("chunk_id").distinct()), "chunk_id", "left_semi")


def ask(spark: SparkSession, text: str, **args: object) -> DataFrame:
    """A parameterised SQL text over registered views."""
    return spark.sql(text, args=args)


def row_count(spark: SparkSession, name: str) -> int:
    """Rows of a table or view; 0 if there is none of the name."""
    return spark.table(name).count() if spark.catalog.tableExists(name) else 0


def load_chunks(chunks: DataFrame, cite: DataFrame | None = None, papers: Iterable[str] | DataFrame | None = None, hops: int = 0) -> DataFrame:
    """Chunks with text, of all or of some papers and those up to ``hops`` citations away; seeds come with their neighbours.

    ``papers`` is a list or a table of ids. Where ``chunks`` has no ``text`` but ``filled``, that is its trimmed length.
    """
    spark = chunks.sparkSession
    df = chunks.where((F.col("filled") if "filled" in chunks.columns else F.length(F.trim("text"))) > 0)
    if papers is None:
        return df
    wanted = papers.select("paper_id") if isinstance(papers, DataFrame) else spark.createDataFrame([(p,) for p in papers], "paper_id string")
    if hops and cite is not None:
        from paperloom.operators.graph import khop

        near = khop(wanted.select(F.col("paper_id").alias("seed")), cite, hops, limit=2**31 - 1)
        wanted = wanted.unionByName(near.select("paper_id")).distinct()
    return df.join(if_small(wanted), "paper_id", "left_semi")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def graph_payload(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """``paper_id, ok, error`` of the contract of a graph load: title, source version, hash and at least one chunk."""
    n = chunks.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    j = papers.join(n, "paper_id", "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    error = F.when(blank("title"), "title").when(blank("source_version"), "source_version").when(blank("content_hash"), "content_hash").when(F.coalesce("n", F.lit(0)) == 0, "chunks")
    return j.select("paper_id", error.isNull().alias("ok"), error.alias("error"))


def vector_payload(chunks: DataFrame, papers: DataFrame, with_references: bool = False) -> DataFrame:
    """What is stored beside a vector; reference chunks are left out unless asked for, an empty section is null."""
    c = chunks if with_references else chunks.where(~F.coalesce("is_references", F.lit(False)))
    p = papers.select("paper_id", "title", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"))
    return c.join(p, "paper_id", "left").select("chunk_id", "paper_id", "chunk_index", F.nullif("section", F.lit("")).alias("section"), "char_count", "title", "published_at")


def scope_filter(scope: str, paper_id: str | None = None) -> Column:
    """What a scoped vector request may see: `selected` its paper and nothing else, `global` the global corpus.

    A request that is neither, `selected` without a paper and `global` with one are errors.
    """
    if scope == "selected":
        if not paper_id:
            raise ValueError("a selected search needs a paper")
        return F.col("paper_id") == paper_id
    if scope == "global":
        if paper_id:
            raise ValueError("a global search has no paper")
        return F.coalesce("in_global_corpus", F.lit(False))
    raise ValueError(f"unknown scope: {scope}")


#: Names under which a field of a chunk may come.
ALIASES = {
    "chunk_id": ("chunk_id", "chunkId", "id"), "paper_id": ("paper_id", "paperId"), "text": ("text", "content", "body"), "section": ("section", "section_name", "sectionName"),
    "chunk_index": ("chunk_index", "chunkIndex", "index"), "title": ("title", "paper_title", "paperTitle"),
}


def chunk_records(payloads: DataFrame) -> DataFrame:
    """Chunk rows of payloads whose fields go by any of their names; blanks are null, rows without an id are dropped."""
    def pick(field: str) -> Column:
        found = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in ALIASES[field] if n in payloads.columns]
        c = F.coalesce(*found) if found else F.lit(None).cast("string")
        return (c.try_cast("int") if field == "chunk_index" else c).alias(field)

    return payloads.select(*[pick(f) for f in ALIASES]).where(F.col("chunk_id").isNotNull())


def corpus_rows(chunks: DataFrame) -> DataFrame:
    """Chunks as JSON lines of a corpus file; null and blank fields are left out."""
    keep = [F.nullif(F.col(c), F.lit("")).alias(c) if t in ("string",) else F.col(c) for c, t in chunks.dtypes]
    return chunks.select(F.to_json(F.struct(*keep), {"ignoreNullFields": "true"}).alias("value"))


def gold_answers(cases: DataFrame) -> DataFrame:
    """``case_id, gold_answer`` of the cases that have one."""
    return cases.where(F.length(F.trim("gold_answer")) > 0).select("case_id", "gold_answer").dropDuplicates(["case_id"])


def checked_points(points: DataFrame, dimensions: int, signature: dict[str, object]) -> DataFrame:
    """``points`` whose every row is checked on reading: another length or signature fails the query."""
    ok = F.size("embedding") == dimensions
    for c, v in signature.items():
        ok = ok & F.col(c).eqNullSafe(F.lit(v))
    return points.withColumn("embedding", F.when(ok, F.col("embedding")).otherwise(F.raise_error(F.lit("a point breaks the contract of its collection"))))


def restore_contexts(responses: DataFrame, corpus: DataFrame) -> DataFrame:
    """``case_id, contexts``: texts of the retrieved ids in order; ids without a text are dropped.

    ``responses(case_id, ranked)`` holds a short list per case.
    """
    r = responses.select("case_id", F.posexplode("ranked").alias("i", "chunk_id"))
    j = r.join(corpus.select("chunk_id", "text"), "chunk_id")
    return j.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda s: s["text"]).alias("contexts"))


def recover_triples(responses: DataFrame, triples: DataFrame, top: int = 3, confidence: float = 0.7) -> DataFrame:
    """Stored triples of the ``top`` retrieved chunks of each case, with a default confidence."""
    r = responses.select("case_id", F.explode(F.slice("ranked", 1, top)).alias("chunk_id"))
    return r.join(triples, "chunk_id").select("case_id", "chunk_id", "subject", "predicate", "object", F.coalesce("confidence", F.lit(confidence)).alias("confidence"))


def source_summary(chunks: DataFrame) -> DataFrame:
    """One row: chunks, papers, sections and mean length, 0 where there is nothing."""
    mean = F.round(F.coalesce(F.avg("char_count"), F.lit(0.0)), 6)
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("paper_id").alias("n_papers"), F.countDistinct("section").alias("n_sections"), mean.alias("mean_chars"))


def export_report(cases: DataFrame, known: DataFrame) -> DataFrame:
    """Long table ``measure, n`` of an export: cases, exported, dropped for want of gold, gold ids found, cases per tag.

    A case is exported if at least one of its gold ids exists.
    """
    gold = cases.select("case_id", F.explode("gold_chunk_ids").alias("chunk_id")).where(F.col("chunk_id").isNotNull()).distinct()
    found = gold.join(known.select("chunk_id").distinct(), "chunk_id", "left_semi")
    good = found.select("case_id").distinct()
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n")
    kept = cases.join(good, "case_id", "left_semi")
    tags = kept.select("case_id", F.explode("tags").alias("tag")).distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("tag:"), "tag").alias("measure"), "n")
    return one(cases, "total").unionByName(one(kept, "exported")).unionByName(one(cases.join(good, "case_id", "left_anti"), "dropped_no_gold")).unionByName(one(found, "contexts_matched")).unionByName(tags)


def package(cases: DataFrame, tag: str) -> DataFrame:
    """Cases with one more tag."""
    return cases.withColumn("tags", F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit(tag))))
