"""Matching evidence texts to chunks in tiers."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.columns import once
from paperloom.functions.text import TOKEN, evidence_key, tokenize
from paperloom.operators.lexical import if_small
from paperloom.session import cut

#: Characters of the keys by which texts without a whole token are met.
GRAM = 3
#: Evidence texts that go to every task at once, and keys that are looked for within the tokens of a chunk.
MOST_TEXTS, MOST_NAMED = 50_000, 50_000


def _inner(c: Column) -> Column:
    """The tokens that any text around it keeps whole: all but those at its ends."""
    t = F.regexp_replace(c, rf"^[^a-z0-9가-힣]*({TOKEN})", "")
    return F.array_distinct(tokenize(F.regexp_replace(t, rf"({TOKEN})[^a-z0-9가-힣]*$", "")))


def match_evidence(evidence: DataFrame, chunks: DataFrame, least: float = 0.75, live: DataFrame | None = None) -> DataFrame:
    """The chunk of each evidence text: ``evidence_id, chunk_id, tier, score``; texts without a match are left out.

    ``evidence(evidence_id, paper_id, text)`` is the query set, ``chunks(chunk_id, paper_id, chunk_index, text)`` is
    everything. Tiers: 1 the same text in any paper, 2 the evidence inside a chunk, 3 a chunk inside the evidence, 4 the
    share of the evidence's distinct tokens in the chunk, at least ``least``; 2 to 4 only in the evidence's paper where
    it has one. The best tier wins, in it the highest share, then the first chunk by paper, index and id. Texts compare
    without case and extra white space; blank texts and those of figures and tables match nothing.

    The tiers are looked for one after another, each only for what has no match yet. Equal texts are met by their hash, so
    no text moves. For the others, pairs are found by keys that every match must share and are checked where they meet,
    with blocks of the evidence going to the chunks: a chunk that holds the evidence has its rarest inner token; one with
    enough of its tokens has one of the rarest that cannot all be missing; one inside it has its own longest inner token
    there. Texts without an inner token are met by their first characters, evidence of a word or two as a list that goes
    with every chunk. Where ``chunks`` has several versions of a chunk, told apart by a column ``version``,
    ``live(chunk_id, version)`` says which count; then no text is shuffled.
    """
    key = ["chunk_id"] if live is None else ["chunk_id", "version"]
    live = None if live is None else cut(live.select(*key))
    e = evidence.select("evidence_id", F.col("paper_id").alias("want"), evidence_key(F.col("text")).alias("e"))
    e = cut(e.where((F.col("e") != "") & ~F.col("e").startswith("float selected")).withColumn("h", F.sha2("e", 256)))
    c = once(chunks.select(*key, "paper_id", "chunk_index", "text"), {"c": evidence_key(F.col("text"))}).drop("text").where(F.col("c") != "")
    same = c.select("paper_id", "chunk_index", *key, F.sha2("c", 256).alias("h")).join(if_small(e.select("h").distinct()), "h", "left_semi")
    same = _alive(same, live, key).groupBy("h").agg(F.min(F.struct("paper_id", "chunk_index", "chunk_id")).alias("b"))
    found = [cut(e.join(same, "h").groupBy("evidence_id").agg(F.min("b").alias("b")).select("evidence_id", F.col("b.chunk_id").alias("chunk_id"), F.lit(1).alias("tier"), F.lit(1.0).alias("score")))]
    e = e.drop("h").join(found[0], "evidence_id", "left_anti")
    e = cut(once(e, {"et": F.array_distinct(tokenize(F.col("e"))), "inner": _inner(F.col("e"))}))
    if e.isEmpty():
        return found[0]
    c = once(c, {"ct": F.array_distinct(tokenize(F.col("c")))})
    # How rare a token is only steers which keys are chosen, so all versions may count.
    asked = if_small(e.select(F.explode("et").alias("t")).distinct())
    df = c.select(F.explode("ct").alias("t")).join(asked, "t", "left_semi").groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    known = e.select("evidence_id", F.explode("et").alias("t"), F.size("et").alias("n"), "inner").join(df, "t", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ranked = cut(known.groupBy("evidence_id").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("r"), F.max("n").alias("n"), F.min(F.when(F.array_contains("inner", F.col("t")), F.struct("df", "t"))).alias("rare")))  # tokens of one text
    for stage in (_inside, _rest):
        for block in _blocks(e, MOST_TEXTS if stage is _inside else MOST_TEXTS // 5):
            found.append(cut(_first(_alive(stage(block, ranked, c, key, least), live, key))))
            e = e.join(found[-1], "evidence_id", "left_anti")
        e = cut(e)
        if e.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, found)


def _alive(found: DataFrame, live: DataFrame | None, key: list[str]) -> DataFrame:
    """The rows of ``found`` whose chunk is in force."""
    return found if live is None else live.join(if_small(cut(found.distinct())), key).select(*found.columns)


def _first(found: DataFrame) -> DataFrame:
    """The best chunk of each evidence text."""
    best = found.groupBy("evidence_id").agg(F.min(F.struct("tier", (-F.col("score")).alias("s"), "paper_id", "chunk_index", "chunk_id")).alias("b"))
    return best.select("evidence_id", F.col("b.chunk_id").alias("chunk_id"), F.col("b.tier").alias("tier"), (-F.col("b.s")).alias("score"))


def _blocks(e: DataFrame, most: int) -> list[DataFrame]:
    """``e`` in parts of about ``most`` rows, small enough to go to every task."""
    n = -(-e.count() // most)
    return [e] if n <= 1 else [e.where(F.pmod(F.xxhash64("evidence_id"), F.lit(n)) == i) for i in range(n)]


def _named(kind: str, x: Column) -> Column:
    return F.concat(F.lit(kind + ":"), x)


def _here() -> Column:
    return F.col("want").isNull() | (F.col("want") == F.col("paper_id"))


def _inside(e: DataFrame, ranked: DataFrame, c: DataFrame, key: list[str], least: float) -> DataFrame:
    """Tier 2: chunks of the right paper that hold the evidence."""
    keys = cut(ranked.select("evidence_id", F.col("rare.t").alias("k")).where("k IS NOT NULL").join(e.select("evidence_id", "want", "e"), "evidence_id"))
    met = c.select("paper_id", "chunk_index", *key, "c", F.explode(_known(F.col("ct"), keys)).alias("k")).join(F.broadcast(keys), "k").where(_here() & F.contains("c", "e"))
    out = ["evidence_id", "paper_id", "chunk_index", *key]
    met = met.select(*out)
    few = e.where(F.size("inner") == 0)
    if not few.isEmpty():
        short = few.agg(F.collect_list(F.struct("evidence_id", "e", "want")).alias("short"))  # a word or two each
        held = c.crossJoin(F.broadcast(short)).select("paper_id", "chunk_index", *key, F.explode(F.filter("short", lambda s: F.contains(F.col("c"), s["e"]))).alias("s")).select("paper_id", "chunk_index", *key, "s.evidence_id", "s.want").where(_here())
        met = met.unionByName(held.select(*out))
    return met.withColumns({"tier": F.lit(2), "score": F.lit(1.0)})


def _known(tokens: Column, keys: DataFrame) -> Column:
    """Those of the tokens that are keys, so that a chunk is not repeated for the others; all of them where the keys are many."""
    named = [r["k"] for r in keys.select("k").distinct().limit(MOST_NAMED + 1).collect()]
    return tokens if len(named) > MOST_NAMED else F.filter(tokens, lambda t: t.isin(*named)) if named else F.slice(tokens, 1, 0)


def _rest(e: DataFrame, ranked: DataFrame, c: DataFrame, key: list[str], least: float) -> DataFrame:
    """Tiers 3 and 4: chunks inside the evidence, and those with enough of its tokens."""
    longest = e.agg(F.coalesce(F.max(F.length("e")), F.lit(0)).alias("n")).collect()[0]["n"]
    spare = F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-4).cast("int") + 1
    starts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("e")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substr("e", i, n))))
    inner = F.transform(_inner(F.col("c")), lambda x: F.struct(F.length(x).alias("n"), x.alias("t")))
    small = once(c.where(F.length("c") <= longest), {"l": F.coalesce(_named("l", F.array_max(inner)["t"]), _named("g", F.substring("c", 1, GRAM)))})
    grams = small.select(F.col("l").alias("k")).where(F.col("k").startswith("g:")).distinct()
    begun = e.select("evidence_id", F.explode(F.array_distinct(starts)).alias("g")).select("evidence_id", _named("g", F.col("g")).alias("k")).join(if_small(cut(grams)), "k", "left_semi")
    t = ranked.join(e.select("evidence_id"), "evidence_id", "left_semi").select("evidence_id", F.explode(F.transform(F.slice("r", F.lit(1), spare), lambda s: s["t"])).alias("k"))
    texts = F.broadcast(e.select("evidence_id", "want", "e", "et"))
    own = if_small(cut(e.select("evidence_id", F.explode(F.transform("inner", lambda x: _named("l", x))).alias("k")).unionByName(begun.select("evidence_id", "k"))))
    out = ["evidence_id", "paper_id", "chunk_index", *key]
    part = small.withColumnRenamed("l", "k").join(own, "k").join(texts, "evidence_id").where(_here() & F.contains("e", "c")).select(*out, F.lit(3).alias("tier"), F.lit(1.0).alias("score"))
    share = F.when(F.size("et") > 0, F.round(F.size(F.array_intersect("et", "ct")) / F.size("et"), 6)).otherwise(0.0)
    keys = cut(t.join(e.select("evidence_id", "want"), "evidence_id"))
    near = c.select("paper_id", "chunk_index", *key, "ct", F.explode(_known(F.col("ct"), keys)).alias("k")).join(if_small(keys), "k").where(_here()).drop("want", "k")
    near = near.join(texts, "evidence_id").withColumn("score", share).where(F.col("score") >= least)
    return part.unionByName(near.select(*out, F.lit(4).alias("tier"), "score"))


def conversion_counts(chunks: DataFrame, cases: DataFrame, asked: DataFrame, evidence: DataFrame, matches: DataFrame) -> DataFrame:
    """:func:`conversion_report` with how many chunks, papers and cases a conversion gave, and questions it left out."""
    c = chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("paper_id").alias("n_papers"))
    made = cases.agg(F.count(F.lit(1)).alias("n_cases"))
    left = asked.select("case_id").distinct().join(cases.select("case_id"), "case_id", "left_anti").agg(F.count(F.lit(1)).alias("n_skipped"))
    return c.crossJoin(F.broadcast(made)).crossJoin(F.broadcast(left)).crossJoin(F.broadcast(conversion_report(evidence, matches)))  # one row each


def conversion_report(evidence: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: evidence texts, matched ones, their share (1.0 if there are none) and whether it is under 0.8."""
    n = evidence.agg(F.count(F.lit(1)).alias("n_evidence"))
    m = matches.agg(F.count(F.lit(1)).alias("n_matched"))
    rate = F.round(F.coalesce(F.try_divide("n_matched", "n_evidence"), F.lit(1.0)), 6)
    return n.crossJoin(F.broadcast(m)).select("n_evidence", "n_matched", rate.alias("match_rate"), (rate < 0.8).alias("warning"))
