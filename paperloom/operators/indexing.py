"""The indexing job: texts become chunks, graph rows and vector points, in one plan for all papers of a batch."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import ids, text
from paperloom.functions.vectors import TermHashing
from paperloom.operators import chunking, graph, records, report, store
from paperloom.session import cut

#: Columns of a point besides its vector.
PAYLOAD = (
    "chunk_id", "paper_id", "chunk_index", "text", "section", "char_count", "content_hash", "title", "published_at", "source_version", "in_global_corpus",
    "embedding_provider", "embedding_model", "embedding_dimension", "embedding_version",
)
#: Tables a load writes and their keys.
KEYS = {"papers": ("paper_id",), "chunks": ("chunk_id",), "authors": ("author_id",), "next_chunk": ("left",), "cites": ("src", "dst"), "points": ("chunk_id",)}


@dataclass
class Load:
    """What a batch writes, and how each of its papers fared: ``paper_id, ok, stage, error, n_chunks, n_points, n_skipped``."""

    papers: DataFrame
    chunks: DataFrame
    authors: DataFrame
    next_chunk: DataFrame
    cites: DataFrame
    points: DataFrame
    outcomes: DataFrame

    def summary(self) -> DataFrame:
        """One row: papers, successes, failures, whether all failed, chunks, points and reference chunks left out."""
        n = self.outcomes.agg(*[F.coalesce(F.sum(F.when(F.col("ok"), F.col(c))), F.lit(0)).alias(c) for c in ("n_chunks", "n_points", "n_skipped")])
        return report.run_summary(self.outcomes).crossJoin(F.broadcast(n))


def plan_load(papers: DataFrame, bodies: DataFrame, old_points: DataFrame | None = None, embedder: TermHashing | None = None, in_global: bool = False, base: bool = False, with_references: bool = False) -> Load:
    """The rows of a load of ``papers`` whose texts are ``bodies(paper_id, text, error)``.

    ``papers``: ``paper_id, title, authors, published_at, source_version, content_hash``, one row per paper. A paper fails
    at ``fetch`` if its body has an error or is missing, at ``preprocess`` if the text gives no chunk, at ``graph`` if it
    breaks the contract of a graph row, and at ``vector`` if it has nothing to embed. Failed papers write nothing to the
    graph, and vectors are written of papers the graph takes only, so no point lacks its chunk. ``base`` puts all papers
    into the global corpus; a paper once in it stays (``old_points``). Reference chunks get no point unless asked for.
    """
    e = embedder or TermHashing()
    body = bodies.groupBy("paper_id").agg(F.max_by(F.struct("text", "error"), F.struct(F.col("error").isNull(), F.length("text"), "text")).alias("b")).select("paper_id", "b.*")
    j = cut(papers.join(body.withColumn("_body", F.lit(True)), "paper_id", "left"))
    good = j.where(F.col("_body") & F.col("error").isNull())
    chunks = cut(chunking.chunk_papers(good.select("paper_id", "text")))
    n = chunks.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if("is_references").alias("n_refs"))
    held = j.join(n, "paper_id", "left").withColumns({"n_chunks": F.coalesce("n_chunks", F.lit(0)), "n_refs": F.coalesce("n_refs", F.lit(0))})
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    contract = F.when(blank("title"), "title").when(blank("source_version"), "source_version").when(blank("content_hash"), "content_hash")
    stage = F.when(F.coalesce("_body", F.lit(False)) & F.col("error").isNull(), F.when(F.col("n_chunks") == 0, "preprocess").when(contract.isNotNull(), "graph")).otherwise("fetch")
    why = F.when(stage == "fetch", F.coalesce("error", F.lit("no body"))).when(stage == "preprocess", "no chunks").when(stage == "graph", F.concat(F.lit("missing: "), contract))
    skipped = F.lit(0).cast("bigint") if with_references else F.col("n_refs")
    told = held.withColumns({"stage": stage, "why": why, "n_points": F.col("n_chunks") - skipped, "n_skipped": skipped})
    no_vector = F.col("stage").isNull() & (F.col("n_points") == 0)
    told = cut(told.withColumns({"in_graph": F.col("stage").isNull(), "stage": F.when(no_vector, "vector").otherwise(F.col("stage")), "why": F.when(no_vector, "nothing to embed").otherwise(F.col("why"))}))
    outcomes = told.select("paper_id", F.col("stage").isNull().alias("ok"), "stage", F.col("why").alias("error"), "n_chunks", "n_points", "n_skipped")

    kept = told.where("in_graph")
    paper_rows = kept.select("paper_id", "title", "authors", "published_at", "source_version", "content_hash", F.lit("completed").alias("processing_status"), F.lit(in_global or base).alias("is_global"))
    of = chunks.join(kept.select("paper_id"), "paper_id", "left_semi")
    signed = kept.select("paper_id", F.posexplode("authors").alias("author_order", "name")).where(F.trim("name") != "").select("paper_id", "author_order", F.trim("name").alias("name"))
    signed = signed.withColumn("normalized_name", text.name_key(F.col("name")))
    authors = signed.withColumn("author_id", ids.author_id(F.col("paper_id"), F.col("author_order"), F.col("normalized_name")))
    referred = of.where("is_references").select("paper_id", F.explode(text.arxiv_ids(F.col("text"), F.col("paper_id"))).alias("raw")).distinct()
    cites = referred.select(F.col("paper_id").alias("src"), F.concat(F.lit("arxiv:"), "raw").alias("dst"))
    points = of if with_references else of.where(~F.col("is_references"))
    about = kept.select("paper_id", "title", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"), "source_version")
    points = points.join(about, "paper_id").withColumns({"section": F.nullif("section", F.lit("")), "in_global_corpus": F.lit(in_global or base), "embedding": e.udf()("text")} | {k: F.lit(v) for k, v in e.signature().items()})
    points = points.select(*PAYLOAD, "embedding")
    if old_points is not None:
        points = store.sticky_global(old_points, points)
    return Load(paper_rows, of, authors, graph.next_edges(of), cites, records.checked_points(points, e.dimensions, e.signature()), outcomes)


def write_load(load: Load, tables: Mapping[str, store.VersionedTable], created: str | None = None) -> None:
    """Write a load: papers (with stubs of the cited ones), then their chunks and edges, and the points last.

    Rows of a loaded paper that it no longer has are removed first, so a repeated load changes nothing. ``created`` is a
    column of ``papers`` that keeps its first value. A stub never replaces a paper, a paper replaces its stub.
    """
    keep = (created,) if created else ()
    stubs = graph.stubs(load.cites, load.papers).withColumn("is_global", F.lit(False))
    old = tables["papers"].read()
    if old is not None:
        stubs = stubs.join(old.select("paper_id"), "paper_id", "left_anti")
    tables["papers"].upsert(load.papers.unionByName(stubs, allowMissingColumns=True), keep=keep, sticky=("is_global",))
    loaded = load.papers.select("paper_id").distinct()
    for name, rows, owner in (("chunks", load.chunks, "paper_id"), ("authors", load.authors, "paper_id"), ("next_chunk", load.next_chunk.join(load.chunks.select(F.col("chunk_id").alias("left"), "paper_id"), "left"), "paper_id"), ("cites", load.cites, "src"), ("points", load.points, "paper_id")):
        if name in tables:
            tables[name].replace(rows, loaded.withColumnRenamed("paper_id", owner), owner)


def seed(chunks: DataFrame, cite: DataFrame | None = None, embedder: TermHashing | None = None) -> dict[str, DataFrame]:
    """Papers, chunks, edges and points of a benchmark's corpus ``chunks(chunk_id, paper_id, chunk_index, text, section, title)``.

    Papers are marked `benchmark`, so :func:`unseed` removes them again and nothing else.
    """
    e = embedder or TermHashing()
    c = chunks.withColumns({"chunk_index": F.coalesce("chunk_index", F.lit(0)), "char_count": F.length("text")})
    papers = c.groupBy("paper_id").agg(F.max("title").alias("title")).withColumns({"processing_status": F.lit("benchmark"), "is_global": F.lit(True)})
    points = c.select("chunk_id", "paper_id", "chunk_index", "text", "section", "char_count", "title", F.lit(True).alias("in_global_corpus"), e.udf()("text").alias("embedding"), *[F.lit(v).alias(k) for k, v in e.signature().items()])
    out = {"papers": papers, "chunks": c, "next_chunk": graph.next_edges(c), "points": points}
    if cite is not None:
        out["cites"] = graph.cites(cite)
    return out


def seeded_papers(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` papers with those of a seed: a new title replaces an old one only where there is one, a paper that is there
    keeps its status."""
    had = old.select("paper_id", F.col("title").alias("_title"), F.col("processing_status").alias("_status"))
    merged = new.join(had, "paper_id", "left").withColumns({"title": F.coalesce("title", "_title"), "processing_status": F.coalesce("_status", "processing_status")}).drop("_title", "_status")
    return store.merge_upsert(old, merged, ["paper_id"], sticky=[c for c in ("is_global",) if c in old.columns])


def unseed(papers: DataFrame, chunks: DataFrame, status: str = "benchmark") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Papers and chunks without those of a seed, and one row ``papers, chunks, removed``."""
    gone = papers.where(F.col("processing_status") == status).select("paper_id").distinct()
    lost = chunks.join(gone, "paper_id", "left_semi")
    n = gone.agg(F.count(F.lit(1)).alias("papers")).crossJoin(F.broadcast(lost.agg(F.count(F.lit(1)).alias("chunks"))))
    return papers.join(gone, "paper_id", "left_anti"), chunks.join(gone, "paper_id", "left_anti"), n.withColumn("removed", F.col("papers") + F.col("chunks"))


def single_paper(papers: DataFrame, bodies: DataFrame, paper_id: str, **how: object) -> Load:
    """The load of one paper, through the same plan; other than in a batch, its failure is an error."""
    one = plan_load(papers.where(F.col("paper_id") == paper_id), bodies.where(F.col("paper_id") == paper_id), **how)
    r = one.outcomes.first()
    if r is None:
        raise ValueError(f"unknown paper: {paper_id}")
    if not r["ok"]:
        raise ValueError(f"{paper_id} failed at {r['stage']}: {r['error']}")
    return one


def inject_links(nodes: DataFrame, links: DataFrame, score: float = 0.9) -> DataFrame:
    """Relations between ``nodes(chunk_id, node_id)`` for ``links(source, target, type, score)`` whose ends are both there.

    ``source, target`` are node ids; the property of a vector link is its similarity, links without a score get ``score``.
    """
    n = nodes.where(F.col("chunk_id").isNotNull()).dropDuplicates(["chunk_id"])
    a = n.select(F.col("chunk_id").alias("source"), F.col("node_id").alias("from"))
    b = n.select(F.col("chunk_id").alias("target"), F.col("node_id").alias("to"))
    return links.join(a, "source").join(b, "target").select(F.col("from").alias("source"), F.col("to").alias("target"), "type", F.coalesce("score", F.lit(score)).alias("score"))


def outcome_counts(outcomes: DataFrame, by: Sequence[str] = ("stage",)) -> DataFrame:
    """Papers by outcome; written ones are stage `written`."""
    return outcomes.withColumn("stage", F.coalesce("stage", F.lit("written"))).groupBy(*by).agg(F.count(F.lit(1)).alias("n_papers"))
