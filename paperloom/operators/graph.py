"""The property graph as tables: sequence and citation edges, expansions, neighbourhoods, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.operators.lexical import if_small
from paperloom.session import cut

BLOCK = 10_000


def next_edges(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """``left, right``: consecutive chunks of each paper by index (null counts as 0), then id.

    A paper is cut into blocks of ``block`` indexes, so none is ordered in one task; a block's last chunk is joined to the
    first of the paper's next block. Rows with a null paper or id have no edges, repeated ids one edge per row.
    """
    rows = chunks.where(F.col("paper_id").isNotNull() & F.col("chunk_id").isNotNull()).select("paper_id", "chunk_id", F.coalesce("chunk_index", F.lit(0)).alias("i"))
    rows = rows.withColumn("b", F.floor(F.col("i") / block))
    w = W.partitionBy("paper_id", "b").orderBy("i", "chunk_id")
    inside = rows.withColumn("right", F.lead("chunk_id").over(w))
    firsts = rows.groupBy("paper_id", "b").agg(F.min(F.struct("i", "chunk_id")).alias("f"))
    after = firsts.select("paper_id", "b", F.lead("f.chunk_id").over(W.partitionBy("paper_id").orderBy("b")).alias("after")).where(F.col("after").isNotNull())
    edge = inside.where(F.col("right").isNotNull()).select(F.col("chunk_id").alias("left"), "right")
    over = inside.where(F.col("right").isNull()).join(after, ["paper_id", "b"]).select(F.col("chunk_id").alias("left"), F.col("after").alias("right"))
    return edge.unionByName(over)


def cites(edges: DataFrame) -> DataFrame:
    """Distinct citations without self-citations: ``src, dst``."""
    return edges.select(F.col("source_paper_id").alias("src"), F.col("target_paper_id").alias("dst")).where(F.col("src") != F.col("dst")).distinct()


def stubs(cite: DataFrame, papers: DataFrame) -> DataFrame:
    """Cited papers that are not there, as rows to insert: ``paper_id, title, processing_status``."""
    missing = cite.select(F.col("dst").alias("paper_id")).distinct().join(papers.select("paper_id"), "paper_id", "left_anti")
    return missing.select("paper_id", F.regexp_replace("paper_id", "^(arxiv|hf|ref):", "").alias("title"), F.lit("reference_only").alias("processing_status"))


def both_ways(cite: DataFrame) -> DataFrame:
    """Each citation from either end: ``paper_id, related, type``."""
    out = cite.select(F.col("src").alias("paper_id"), F.col("dst").alias("related"), F.lit("cites").alias("type"))
    return out.unionByName(cite.select(F.col("dst").alias("paper_id"), F.col("src").alias("related"), F.lit("cited_by").alias("type")))


def citation_expand(seeds: DataFrame, chunks: DataFrame, cite: DataFrame, papers: DataFrame, limit: int = 50, only_global: bool = False) -> DataFrame:
    """Papers related by citation, in either direction, to the papers of seed chunks: the first ``limit`` per seed chunk.

    The seeds are the small side: only their papers' citations are touched. A paper's list is cut to ``limit`` before it
    meets the chunks, and each task keeps no more than that of a paper, so a hub costs no more than any other paper.
    ``limit`` is between 1 and 500; ``only_global`` keeps related papers flagged ``is_global``.
    """
    if not 1 <= limit <= 500:
        raise ValueError(f"limit must be between 1 and 500: {limit}")
    if only_global:
        papers = papers.where("is_global")
    s = if_small(seeds.select("chunk_id").distinct())
    own = cut(chunks.select("chunk_id", "paper_id").join(s, "chunk_id").distinct())
    wanted = if_small(own.select("paper_id").distinct())
    near = both_ways(cite).join(wanted, "paper_id", "left_semi").join(papers.select(F.col("paper_id").alias("related")), "related", "left_semi").distinct()
    first = near.withColumn("_n", F.row_number().over(W.partitionBy("paper_id").orderBy("related", "type"))).where(F.col("_n") <= limit)
    return first.join(if_small(own), "paper_id").select("chunk_id", "paper_id", "type", "related")


def subgraph(wanted: DataFrame, papers: DataFrame, authors: DataFrame, chunks: DataFrame, cite: DataFrame) -> DataFrame:
    """What belongs to each wanted paper, one row per child: ``paper_id, kind, position, value``.

    Children are kept as rows in order instead of arrays, so a paper with millions of chunks needs no single huge row. A
    paper without children has its `paper` row alone.
    """
    w = if_small(wanted.select("paper_id").distinct())
    at = lambda by: (F.row_number().over(W.partitionBy("paper_id").orderBy(*by)) - 1).alias("position")
    p = papers.join(w, "paper_id", "left_semi").select("paper_id", F.lit("paper").alias("kind"), F.lit(0).alias("position"), F.col("title").alias("value"))
    a = authors.join(w, "paper_id", "left_semi").select("paper_id", F.lit("author").alias("kind"), F.col("author_order").alias("position"), F.col("name").alias("value"))
    c = chunks.join(w, "paper_id", "left_semi").select("paper_id", F.lit("chunk").alias("kind"), F.col("chunk_index").alias("position"), F.col("chunk_id").alias("value"))
    r = cite.withColumnRenamed("src", "paper_id").join(w, "paper_id", "left_semi").select("paper_id", F.lit("cites").alias("kind"), at(["dst"]), F.col("dst").alias("value"))
    return p.unionByName(a).unionByName(c).unionByName(r)


def nested_subgraph(rows: DataFrame) -> DataFrame:
    """The rows of :func:`subgraph` as one row per paper: ``paper_id, title, authors, chunks, citations``, lists in order.

    For papers of ordinary size; one with very many chunks is better read as rows. Papers without children have empty
    lists; children of papers without a `paper` row are left out.
    """
    of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("position", "value")))), lambda s: s["value"])
    per = rows.groupBy("paper_id").agg(F.max(F.when(F.col("kind") == "paper", F.struct("value"))).alias("p"), of("author").alias("authors"), of("chunk").alias("chunks"), of("cites").alias("citations"))
    return per.where(F.col("p").isNotNull()).select("paper_id", F.col("p.value").alias("title"), "authors", "chunks", "citations")


def within(edges: DataFrame, ids: DataFrame, ends: Sequence[str] = ("left", "right")) -> DataFrame:
    """The edges both of whose ends are among ``ids(chunk_id)``."""
    known = if_small(ids.select("chunk_id").where(F.col("chunk_id").isNotNull()).distinct())
    for end in ends:
        edges = edges.join(known.withColumnRenamed("chunk_id", end), end, "left_semi")
    return edges


def chunk_graph(chunks: DataFrame, cite: DataFrame, mentions: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """All link kinds between chunks in compact form: ``type, source, target, score, n``.

    Sequence links and vector links (``near(source, target, score)``) are rows of chunks, one per link, without loops and
    once per kind. Citation links are rows of papers and links by a shared entity rows of an entity and a paper, with the
    number ``n`` of links they stand for; the chunks of a paper say which.
    """
    one = F.lit(1).cast("bigint").alias("n")
    nothing = F.lit(None).cast("double").alias("score")
    out = next_edges(chunks).select(F.lit("next").alias("type"), F.col("left").alias("source"), F.col("right").alias("target"), nothing, one)
    out = out.unionByName(paper_pairs(chunks, cite).select(F.lit("cites").alias("type"), F.col("src").alias("source"), F.col("dst").alias("target"), nothing, "n"))
    if mentions is not None:
        m = shared_entity_members(mentions).groupBy("entity", "paper_id").agg(F.sum("n_linked").alias("n"))
        out = out.unionByName(m.select(F.lit("shared_entity").alias("type"), F.col("entity").alias("source"), F.col("paper_id").alias("target"), nothing, "n"))
    if near is not None:
        known = chunks.select("chunk_id")
        links = merge_links(near.withColumn("type", F.lit("vector"))).join(known.withColumnRenamed("chunk_id", "source"), "source", "left_semi").join(known.withColumnRenamed("chunk_id", "target"), "target", "left_semi")
        out = out.unionByName(links.select("type", "source", "target", "score", one))
    return out


def khop(seeds: DataFrame, cite: DataFrame, hops: int = 2, limit: int = 25) -> DataFrame:
    """Papers within ``hops`` (1 to 3) citations of each seed in either direction, nearest first, then by id.

    ``seeds(seed)``; result ``seed, paper_id, hop`` with the least number of hops, the seed itself left out, at most
    ``limit`` per seed. Each hop joins the frontier of distinct papers and drops what was seen before.
    """
    hops = min(max(hops, 1), 3)
    step = both_ways(cite).select("paper_id", "related").distinct()
    seen = seeds.select("seed", F.col("seed").alias("paper_id"), F.lit(0).alias("hop")).distinct()
    front = seen
    for h in range(1, hops + 1):
        # A frontier that is small is sent to the edges, so a hub's edges stay spread over their tasks.
        found = step.join(if_small(front.select("seed", "paper_id")), "paper_id").select("seed", F.col("related").alias("paper_id")).distinct()
        front = cut(found.join(seen, ["seed", "paper_id"], "left_anti").withColumn("hop", F.lit(h)))
        seen = seen.unionByName(front)
    w = W.partitionBy("seed").orderBy("hop", "paper_id")
    return seen.where(F.col("hop") > 0).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def first_chunks(chunks: DataFrame, n: int = 3, by: Sequence[str] = ("paper_id",)) -> DataFrame:
    """The first ``n`` chunks of each paper by index and id; tasks keep no more than ``n`` per paper before the shuffle."""
    w = W.partitionBy(*by).orderBy("chunk_index", "chunk_id")
    return chunks.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def cites_chunk_edges(chunks: DataFrame, cite: DataFrame) -> DataFrame:
    """Every chunk of a citing with every chunk of a cited paper, one by one; :func:`compact_links` has them all in short.

    For the first few by ids see :func:`first_cites_chunk_edges`.
    """
    a = chunks.select(F.col("paper_id").alias("src"), F.col("chunk_id").alias("source"))
    b = chunks.select(F.col("paper_id").alias("dst"), F.col("chunk_id").alias("target"))
    return cite.join(a, "src").join(b, "dst").select("source", "target").distinct()


def paper_pairs(chunks: DataFrame, cite: DataFrame) -> DataFrame:
    """Citations with chunks (one row per id) at both ends: ``src, dst, n`` with the number of chunk pairs between them."""
    per = chunks.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    a, b = per.select(F.col("paper_id").alias("src"), F.col("n").alias("a")), per.select(F.col("paper_id").alias("dst"), F.col("n").alias("b"))
    return cite.join(a, "src").join(b, "dst").select("src", "dst", (F.col("a") * F.col("b")).alias("n"))


def compact_links(pairs: DataFrame, chunks: DataFrame, kind: str = "cites") -> DataFrame:
    """All chunk links of :func:`paper_pairs` without making them: ``kind, paper_id, value, n``.

    A row of ``kind`` has two papers and how many links there are between their chunks; a row `chunk` has a paper of such
    a pair and one of its chunks. The links are the chunks of the one joined with those of the other, see
    :func:`listed_links`. The rows grow with the citations and the chunks, the links with the product of both ends.
    """
    ends = pairs.select(F.col("src").alias("paper_id")).unionByName(pairs.select(F.col("dst").alias("paper_id"))).distinct()
    links = pairs.select(F.lit(kind).alias("kind"), F.col("src").alias("paper_id"), F.col("dst").alias("value"), "n")
    members = chunks.join(ends, "paper_id", "left_semi").select(F.lit("chunk").alias("kind"), "paper_id", F.col("chunk_id").alias("value"), F.lit(1).cast("bigint").alias("n"))
    return links.unionByName(members)


def listed_links(compact: DataFrame) -> DataFrame:
    """The links of :func:`compact_links`, one by one: ``source, target, type``."""
    c = compact.where(F.col("kind") == "chunk")
    a, b = c.select("paper_id", F.col("value").alias("source")), c.select(F.col("paper_id").alias("dst"), F.col("value").alias("target"))
    pairs = compact.where(F.col("kind") != "chunk").select("paper_id", F.col("value").alias("dst"), F.col("kind").alias("type"))
    return pairs.join(a, "paper_id").join(b, "dst").select("source", "target", "type")


def first_cites_chunk_edges(chunks: DataFrame, cite: DataFrame, limit: int) -> DataFrame:
    """The rows of :func:`cites_chunk_edges` for a small ``limit``, without making all pairs (``chunks`` has one row per id).

    Each chunk of a citing paper has an edge, so the first edges start in the first ``limit`` of these chunks, and of
    each of their papers' targets only the first ``limit`` matter.
    """
    c, pairs = chunks.select("paper_id", "chunk_id"), paper_pairs(chunks, cite).select("src", "dst")
    heads = c.join(pairs.select(F.col("src").alias("paper_id")).distinct(), "paper_id", "left_semi").orderBy("chunk_id").limit(limit).select(F.col("paper_id").alias("src"), F.col("chunk_id").alias("source"))
    heads = cut(heads)  # at most `limit` rows
    near = pairs.join(F.broadcast(heads.select("src").distinct()), "src")
    tails = near.join(c.select(F.col("paper_id").alias("dst"), F.col("chunk_id").alias("target")), "dst").withColumn("_n", F.row_number().over(W.partitionBy("src").orderBy("target"))).where(F.col("_n") <= limit)
    return tails.join(F.broadcast(heads), "src").select("source", "target").orderBy("source", "target").limit(limit)


def shared_entity_edges(mentions: DataFrame) -> DataFrame:
    """Chunks of different papers that mention one entity, pair by pair: ``source < target, entity``.

    All pairs of an entity are made; :func:`shared_entity_members` has them all in short.
    """
    m = mentions.select("entity", "chunk_id", "paper_id").distinct()
    a = m.select("entity", F.col("chunk_id").alias("source"), F.col("paper_id").alias("pa"))
    b = m.select("entity", F.col("chunk_id").alias("target"), F.col("paper_id").alias("pb"))
    return a.join(b, "entity").where((F.col("source") < F.col("target")) & (F.col("pa") != F.col("pb"))).select("source", "target", "entity")


def shared_entity_members(mentions: DataFrame) -> DataFrame:
    """All of :func:`shared_entity_edges` without making them: ``entity, paper_id, chunk_id, n_linked``.

    One row per mention that has an edge, with the number of chunks of other papers that mention the entity; the edges are
    the pairs of an entity's chunks from different papers. Mentions are counted per entity and paper, and these counts
    summed per entity, so the rows grow with the mentions and a hot entity sends one row per paper.
    """
    m = mentions.where(F.col("paper_id").isNotNull() & F.col("chunk_id").isNotNull()).select("entity", "paper_id", "chunk_id").distinct()
    per = m.groupBy("entity", "paper_id").agg(F.count(F.lit(1)).alias("own"))
    others = per.join(per.groupBy("entity").agg(F.sum("own").alias("n")), "entity").select("entity", "paper_id", (F.col("n") - F.col("own")).alias("n_linked"))
    return m.join(others.where(F.col("n_linked") > 0), ["entity", "paper_id"]).select("entity", "paper_id", "chunk_id", "n_linked")


def entity_expand(seeds: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per seed chunk the papers of other chunks that mention one of its entities: ``chunk_id, paper_id, n_entities``."""
    s = cut(mentions.join(if_small(seeds.select("chunk_id").distinct()), "chunk_id").select("chunk_id", F.col("paper_id").alias("own"), "entity").distinct())
    # Papers are folded per entity first, so an entity of a hot paper's chunks is one row.
    per = mentions.select("entity", "paper_id").distinct()
    return per.join(if_small(s), "entity").where(F.col("paper_id") != F.col("own")).groupBy("chunk_id", "paper_id").agg(F.countDistinct("entity").alias("n_entities"))


def cross_paper_links(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Links whose ends are known and lie in different papers: ``source, target, type``."""
    a = chunks.select(F.col("chunk_id").alias("source"), F.col("paper_id").alias("pa"))
    b = chunks.select(F.col("chunk_id").alias("target"), F.col("paper_id").alias("pb"))
    return links.join(a, "source").join(b, "target").where(F.col("pa") != F.col("pb")).select("source", "target", "type")


def merge_links(*links: DataFrame) -> DataFrame:
    """Union of links without loops, one per (source, target, type); the first table's score is kept."""
    union = None
    for k, part in enumerate(links):
        part = part.select("source", "target", "type", F.col("score") if "score" in part.columns else F.lit(None).cast("double").alias("score"), F.lit(k).alias("_k"))
        union = part if union is None else union.unionByName(part)
    return union.where(F.col("source") != F.col("target")).groupBy("source", "target", "type").agg(F.min_by("score", F.struct("_k", "score")).alias("score"))


def count_cites_chunk_edges(chunks: DataFrame, cite: DataFrame) -> DataFrame:
    """``n``: how many edges :func:`cites_chunk_edges` has over all ``chunks`` (one row per id), without making them.

    Chunks fold to a count per paper, citing counts are summed per cited paper, so a hot target sends one row per task.
    """
    per = chunks.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    into = cite.join(per.withColumnRenamed("paper_id", "src"), "src").groupBy(F.col("dst").alias("paper_id")).agg(F.sum("n").alias("n_citing"))
    return into.join(per, "paper_id").agg(F.coalesce(F.sum(F.col("n") * F.col("n_citing")), F.lit(0)).alias("n"))


def graph_summary(chunks: DataFrame, links: DataFrame, across: DataFrame | None = None) -> DataFrame:
    """Long table ``measure, n``: chunks, papers, links, links by type, links across papers.

    ``across(type, n)`` has numbers of further links, all across papers, that are counted but not listed.
    """
    more = links.sparkSession.createDataFrame([], "type string, n bigint") if across is None else across.where(F.col("n") > 0)
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("paper_id").alias("papers"))
    types = links.groupBy("type").agg(F.count(F.lit(1)).alias("n")).unionByName(more).groupBy("type").agg(F.sum("n").alias("n"))
    per = types.select(F.concat(F.lit("links:"), "type").alias("measure"), "n")
    all_ = types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("links").alias("measure"), "n")
    known = cross_paper_links(links, chunks).agg(F.count(F.lit(1)).alias("n"))
    cross = known.unionByName(more.select("n")).agg(F.sum("n").alias("n")).select(F.lit("links across papers").alias("measure"), "n")
    base = c.select(F.explode(F.create_map(F.lit("chunks"), "chunks", F.lit("papers"), "papers")).alias("measure", "n"))
    return base.unionByName(all_).unionByName(per).unionByName(cross)


def research_flow(wanted: DataFrame, cite: DataFrame, papers: DataFrame) -> DataFrame:
    """Earlier and later works around each paper: ``paper_id, stage, related`` with stages prior, current, later."""
    w = if_small(wanted.select("paper_id").distinct())
    prior = cite.withColumnRenamed("src", "paper_id").join(w, "paper_id", "left_semi").select("paper_id", F.lit("prior").alias("stage"), F.col("dst").alias("related"))
    later = cite.withColumnRenamed("dst", "paper_id").join(w, "paper_id", "left_semi").select("paper_id", F.lit("later").alias("stage"), F.col("src").alias("related"))
    now = papers.join(w, "paper_id", "left_semi").select("paper_id", F.lit("current").alias("stage"), F.col("paper_id").alias("related"))
    return now.unionByName(prior).unionByName(later).distinct()


def known(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The ids that exist."""
    return table.select(key).join(if_small(ids.select(key).distinct()), key, "left_semi").distinct()


ENTITY = r"\b[A-Z][a-z]+[A-Z][a-z]+[0-9]*\b"


def entities_in(text: Column, pattern: str = ENTITY) -> Column:
    """Distinct names with an inner capital, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def mentions_of(chunks: DataFrame, pattern: str = ENTITY) -> DataFrame:
    """Names with an inner capital as entities: ``chunk_id, paper_id, entity``."""
    return chunks.select("chunk_id", "paper_id", F.explode(entities_in(F.col("text"), pattern)).alias("entity"))
