"""Generation of test cases from the chunk graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions.text import first_sentences, join_terms, tokenize
from paperloom.operators.lexical import if_small
from paperloom.session import cut

#: Words that are no topic of a question.
FUNCTION_WORDS = (
    "about", "above", "after", "again", "against", "all", "also", "although", "among", "another", "any", "because", "been", "before", "being", "below", "between", "both", "cannot", "could",
    "does", "doing", "done", "during", "each", "either", "else", "even", "every", "from", "further", "had", "has", "have", "having", "here", "how", "however", "into", "itself", "just", "less",
    "like", "made", "make", "many", "more", "most", "much", "must", "neither", "never", "not", "only", "other", "others", "our", "over", "rather", "same", "should", "since", "some", "such",
    "than", "their", "them", "then", "there", "these", "they", "thing", "things", "those", "though", "through", "thus", "under", "until", "upon", "used", "using", "very", "well", "were", "what",
    "when", "where", "which", "while", "whose", "will", "with", "within", "without", "would", "your",
)
#: Question wordings; {a} and {b} stand for the key terms of the first and second chunk, {s} for the section.
SINGLE = ("Which finding of the paper concerns {a}?", "What is reported on {a} under {s}?", "How are {a} treated in the paper?")
MULTI = {
    "cites": ("In which way do {a} of the one paper build on {b} of the work it cites?", "Which part of the cited work on {b} matters for {a}?"),
    "shared_entity": ("In what do the papers agree on {a} and {b}?", "How do {a} and {b} differ from one paper to the other?"),
}
DEFAULT_MULTI = ("Where do the two papers treat {a} and {b} alike?", "What do {a} and {b} have in common?")


def key_terms(chunks: DataFrame, skip: int = 1, take: int = 2, least: int = 5, only: DataFrame | None = None) -> DataFrame:
    """``chunk_id, terms``: after the top ``skip`` by tf * idf the next ``take``, of the first pool that can fill them.

    Pools in order: topic words (``least`` letters or more, no function word) in at least two chunks, all topic words,
    all tokens. A pool can fill them if as many terms are left after the skipped ones as it has terms to give, at most
    ``take``; so one that would have to give up its skipped term is passed over. idf is ln(1 + N / (df + 0.5)) over
    ``chunks``; equal weights are in order of the term. Chunks no pool of which can fill them have no row. With
    ``only(chunk_id)``, a few ids, just these get terms; the statistics are still those of all ``chunks``.
    """
    ranked = chunks if only is None else chunks.join(F.broadcast(only.select("chunk_id").distinct()), "chunk_id", "left_semi")
    t = ranked.select("chunk_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = chunks.select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = chunks.agg(F.count(F.lit(1)).alias("n"))
    known = t.join(if_small(cut(df)) if only is None else df, "term").crossJoin(F.broadcast(n))
    w = known.withColumn("w", F.round(F.col("tf") * F.ln(1 + F.col("n") / (F.col("df") + 0.5)), 6))
    topic = (F.length("term") >= least) & ~F.col("term").isin(*FUNCTION_WORDS)
    pool = F.when(topic & (F.col("df") >= 2), 1).when(topic, 2).otherwise(3)  # the first that has the term; the later ones have it too
    x = w.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("w"), "term", pool.alias("pool")))).alias("x"), F.count_if(pool == 1).alias("n1"), F.count_if(pool <= 2).alias("n2"))  # terms of one text
    fills = lambda size: (size > 0) & (size - skip >= F.least(size, F.lit(take)))
    best = F.when(fills(F.col("n1")), 1).when(fills(F.col("n2")), 2).when(fills(F.size("x")), 3)
    p = x.withColumn("best", best).where(F.col("best").isNotNull()).select("chunk_id", F.filter("x", lambda s: s["pool"] <= F.col("best")).alias("p"))
    return p.select("chunk_id", F.transform(F.slice("p", skip + 1, take), lambda s: s["term"]).alias("terms"))


def round_robin(chunks: DataFrame, n: int) -> DataFrame:
    """``n`` chunks taken one per paper in turn: the k-th of every paper before the k+1-th of any.

    The corpus is in order of chunk id; a paper's place is that of its first chunk. Tasks keep at most ``n`` per paper.
    """
    w = W.partitionBy("paper_id").orderBy("chunk_id")
    few = chunks.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
    return few.withColumn("first", F.min("chunk_id").over(W.partitionBy("paper_id"))).orderBy("turn", "first").limit(n)


def _worded(templates: Sequence[str], seed: int, key: Column, a: Column, b: Column | None = None, section: Column | None = None) -> Column:
    """One of the wordings, by a hash of the seed and the key, with its blanks filled."""
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("bigint")
    q = F.element_at(F.array(*[F.lit(t) for t in templates]), (F.pmod(number, F.lit(len(templates))) + 1).cast("int"))
    for blank, value in (("{a}", join_terms(a)), ("{b}", None if b is None else join_terms(b)), ("{s}", section)):
        q = q if value is None else F.replace(q, F.lit(blank), value)
    return q


CASE = ("case_id", "question", "paper_id", "gold_chunk_ids", "gold_paper_ids", "grades", "expected_scope", "gold_answer", "tags")


def single_hop(chunks: DataFrame, n: int, seed: int = 7, begin: int = 0) -> DataFrame:
    """``n`` cases of one chunk each, by round robin over papers, numbered from ``begin``; columns as in ``CASE``.

    The reference answer is the chunk's first two sentences. ``chunks(chunk_id, paper_id, text)`` and, if
    known, ``section``.
    """
    chosen = cut(round_robin(chunks.select("chunk_id", "paper_id"), n).select("chunk_id", "turn", "first"))
    terms = key_terms(chunks, only=chosen)
    j = chunks.join(F.broadcast(chosen), "chunk_id").join(terms, "chunk_id", "left")
    number = F.row_number().over(W.orderBy("turn", "first")) - 1 + begin  # n rows
    section = F.coalesce(F.nullif("section", F.lit("")), F.lit("main")) if "section" in chunks.columns else F.lit("main")
    return j.select(
        F.format_string("gen-sh-%04d", number).alias("case_id"), _worded(SINGLE, seed, F.col("chunk_id"), F.col("terms"), section=section).alias("question"), "paper_id",
        F.array("chunk_id").alias("gold_chunk_ids"), F.array("paper_id").alias("gold_paper_ids"), F.create_map("chunk_id", F.lit(3)).alias("grades"), F.lit("selected").alias("expected_scope"),
        first_sentences(F.col("text"), 2).alias("gold_answer"), F.array(*map(F.lit, ("generated", "offline-template", "single-hop", "local", "extractive-reference"))).alias("tags"),
    )


def multi_hop(links: DataFrame, chunks: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """``n`` cases of two chunks from links across papers, by score, source and target, one per unordered pair.

    ``links(source, target, type, score)`` are links whose ends exist. The reference answer is the first sentence of both.
    """
    pair = links.withColumns({"x": F.least("source", "target"), "y": F.greatest("source", "target")})
    one = pair.groupBy("x", "y").agg(F.min(F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), "source", "target", "type")).alias("l")).select("l.*")
    top = cut(one.orderBy("s", "source", "target").limit(n))
    ends = top.select(F.col("source").alias("chunk_id")).unionByName(top.select(F.col("target").alias("chunk_id"))).distinct()
    body = chunks.join(F.broadcast(ends), "chunk_id").select("chunk_id", "paper_id", first_sentences(F.col("text"), 1).alias("said"))  # at most 2 n rows
    t = cut(body.join(key_terms(chunks, only=ends), "chunk_id", "left"))
    side = lambda end, x: t.select(F.col("chunk_id").alias(end), F.col("paper_id").alias(f"p{x}"), F.col("said").alias(f"s{x}"), F.col("terms").alias(x))
    j = top.join(side("source", "a"), "source").join(side("target", "b"), "target")
    key = F.concat("source", F.lit("|"), "target")
    q = _worded(DEFAULT_MULTI, seed, key, F.col("a"), F.col("b"))
    for kind, templates in MULTI.items():
        q = F.when(F.col("type") == kind, _worded(templates, seed, key, F.col("a"), F.col("b"))).otherwise(q)
    number = F.row_number().over(W.orderBy("s", "source", "target")) - 1  # n rows
    tags = F.array(*map(F.lit, ("generated", "offline-template", "multi-hop", "global")), F.concat(F.lit("link:"), "type"), F.lit("extractive-reference"))
    return j.select(
        F.format_string("gen-mh-%04d", number).alias("case_id"), q.alias("question"), F.col("pa").alias("paper_id"), F.array("source", "target").alias("gold_chunk_ids"), F.array_sort(F.array_distinct(F.array("pa", "pb"))).alias("gold_paper_ids"),
        F.create_map("source", F.lit(3), "target", F.lit(3)).alias("grades"), F.lit("global").alias("expected_scope"), F.trim(F.concat_ws(" ", "sa", "sb")).alias("gold_answer"), tags.alias("tags"),
    )


def generate(links: DataFrame, chunks: DataFrame, size: int = 20, single_ratio: float = 0.5, seed: int = 7) -> DataFrame:
    """A test set of ``size`` cases: the asked share of two chunks, as far as there are links, the rest of one chunk."""
    multi = cut(multi_hop(links, chunks, split_sizes(size, single_ratio)[0], seed))
    made = multi.count()
    return multi.unionByName(single_hop(chunks, size - made, seed, made))


def split_sizes(size: int, single_ratio: float) -> tuple[int, int]:
    """Multi-hop and single-hop cases of a set; halves round to even."""
    multi = round(size * (1 - single_ratio))
    return multi, size - multi
