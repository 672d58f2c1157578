"""Retrieval, generation and extraction metrics as long rows ``case_id, metric, value``; not applicable is null."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions.columns import once
from paperloom.functions.text import tokenize, triple_key
from paperloom.session import cut

KS = (1, 3, 5, 10)


def resolve_ranks(items: Column) -> Column:
    """Retrieved items in order: by rank if every item has one, else as they stand; the first of each chunk id stays.

    ``items`` is an array of structs with ``rank`` and ``chunk_id``; null stays null.
    """
    arr = items
    ordered = F.when(F.forall(arr, lambda x: x["rank"].isNotNull()), F.array_sort(arr, lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0))).otherwise(arr)
    return F.array_distinct(F.transform(ordered, lambda x: x["chunk_id"]))


def _long(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Applicable values as rows, in one pass over the cases; they keep full precision, for means are taken of them."""
    entries = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()])
    return df.select("case_id", F.inline(entries)).where(F.col("value").isNotNull())


def grade_of(grades: Column, gold: Column, chunk: Column) -> Column:
    return F.coalesce(F.element_at(grades, chunk), F.array_contains(gold, chunk).cast("int"), F.lit(0))


def retrieval_metrics(cases: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """recall, precision, hit and nDCG at each k, MRR, AP, paper hit at 5 and routing accuracy.

    ``cases``: ``case_id, ranked`` (distinct ids in order), ``papers`` (paper of each retrieved item in array order),
    ``gold_chunk_ids, gold_paper_ids, grades, expected_scope, scope``. Gold is the gold ids with the ids graded over 0.
    Arrays may be null and count as empty; all work is on the row, nothing is shuffled.
    """
    empty = F.array().cast("array<string>")
    graded = F.map_keys(F.map_filter(F.coalesce("grades", F.from_json(F.lit("{}"), "map<string,int>")), lambda k, v: v > 0))
    df = once(cases, {"R": F.coalesce("ranked", empty), "G": F.array_union(F.coalesce("gold_chunk_ids", empty), graded), "P": F.coalesce("gold_paper_ids", empty), "Q": F.coalesce("papers", empty)})
    gains = F.array_union(F.col("G"), F.col("G"))
    df = once(df, {"n_gold": F.size("G"), "gain": F.transform("R", lambda x: grade_of(F.col("grades"), F.col("G"), x)), "ideal": F.reverse(F.array_sort(F.filter(F.transform(gains, lambda x: grade_of(F.col("grades"), F.col("G"), x)), lambda g: g > 0)))})
    has = F.col("n_gold") > 0
    value: dict[str, Column] = {}
    for k in ks:
        hits = F.size(F.array_intersect(F.slice("R", 1, k), "G"))
        value[f"recall@{k}"] = F.when(has, hits / F.col("n_gold"))
        value[f"precision@{k}"] = hits / F.lit(k)
        value[f"hit@{k}"] = F.when(has, (hits > 0).cast("int"))
        value[f"ndcg@{k}"] = F.when(F.size("ideal") > 0, _dcg(F.col("gain"), k) / _dcg(F.col("ideal"), k))
    first = F.filter(F.transform("R", lambda x, i: F.when(F.array_contains("G", x), i + 1)), lambda p: p.isNotNull())
    value["mrr"] = F.when(has, F.coalesce(1 / F.get(first, F.lit(0)), F.lit(0.0)))
    value["ap"] = F.when(has, F.aggregate(F.transform(first, lambda p, i: (i + 1) / p), F.lit(0.0), lambda s, x: s + x) / F.col("n_gold"))
    value["paper_hit@5"] = F.when(F.size("P") > 0, F.arrays_overlap(F.slice("Q", 1, 5), "P").cast("int"))
    value["routing.accuracy"] = F.when(F.col("expected_scope") != "unknown", (F.col("expected_scope") == F.col("scope")).cast("int"))
    return _long(df, value)


def _dcg(gains: Column, k: int) -> Column:
    return F.aggregate(F.transform(F.slice(gains, 1, k), lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def _bag_overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two bags."""
    return F.aggregate(F.transform(F.array_distinct(a), lambda t: F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t)))), F.lit(0), lambda s, x: s + x)


def generation_metrics(cases: DataFrame) -> DataFrame:
    """Groundedness, token F1, citations, required phrases and the heuristic judge.

    ``cases``: ``case_id, question, answer, evidence`` (texts in array order), ``gold_answer, citations, ranked,
    gold_chunk_ids, must_include``. Empty denominators are not applicable.
    """
    empty = F.array().cast("array<string>")
    text = F.array_join(F.filter(F.coalesce("evidence", empty), lambda x: F.length(x) > 0), "\n")
    df = once(
        cases,
        {
            "A": tokenize(F.coalesce("answer", F.lit(""))), "E": tokenize(text), "T": tokenize(F.coalesce("gold_answer", F.lit(""))), "U": F.array_distinct(tokenize(F.coalesce("question", F.lit("")))),
            "C": F.coalesce("citations", empty), "R": F.coalesce("ranked", empty), "G": F.coalesce("gold_chunk_ids", empty), "M": F.coalesce("must_include", empty),
        },
    )
    df = once(df, {"same": _bag_overlap(F.col("A"), F.col("T")), "grounded": F.when(F.size("A") > 0, F.size(F.filter("A", lambda t: F.array_contains("E", t))) / F.size("A"))})
    n = lambda c: F.size(c)
    grounded, same = F.col("grounded"), F.col("same")
    p, r = same / n("A"), same / n("T")
    share = lambda part, whole: F.when(n(whole) > 0, n(part) / n(whole))
    asked = n("U")
    relevance = F.when(asked > 0, F.least(1.5 * n(F.array_intersect("U", "A")) / asked, F.lit(1.0)))
    blank = F.coalesce(F.trim("answer"), F.lit("")) == ""
    return _long(
        df,
        {
            "groundedness_lexical": grounded,
            "answer_token_f1": F.when((F.length("gold_answer") > 0) & (n("A") > 0) & (n("T") > 0), F.when(same == 0, 0.0).otherwise(2 * p * r / (p + r))),
            "citation_validity": share(F.filter("C", lambda c: F.array_contains("R", c)), "C"),
            "citation_precision": share(F.filter("C", lambda c: F.array_contains("G", c)), "C"),
            "citation_recall": share(F.array_intersect("G", "C"), F.array_distinct("G")),
            "has_citation": (n("C") > 0).cast("int"),
            "must_include": share(F.filter("M", lambda m: F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lower(m))), "M"),
            "judge.faithfulness": F.when(blank, 0.0).otherwise(grounded),
            "judge.relevance": F.when(blank, 0.0).otherwise(relevance),
        },
    )


def triple_metrics(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision, recall and F1 of triples, strict and relaxed (without predicate), entity coverage, evidence attachment.

    Both are ``case_id, subject, predicate, object`` and ``predicted`` also ``chunk_id``, one row per triple. Matching is on
    multisets: each gold triple is used once, so the matches of a key are the smaller of its two counts.
    """
    out = None
    s, p, o = (triple_key(F.col(c)) for c in ("subject", "predicate", "object"))
    sides = {"p": predicted.select("case_id", s.alias("s"), p.alias("p"), o.alias("o")), "g": gold.select("case_id", s.alias("s"), p.alias("p"), o.alias("o"))}
    for name, key in (("triple", ["s", "p", "o"]), ("relaxed", ["s", "o"])):
        both = sides["p"].select("case_id", *key, F.lit(1).alias("np"), F.lit(0).alias("ng")).unionByName(sides["g"].select("case_id", *key, F.lit(0).alias("np"), F.lit(1).alias("ng")))
        c = both.groupBy("case_id", *key).agg(F.sum("np").alias("np"), F.sum("ng").alias("ng")).groupBy("case_id").agg(F.sum(F.least("np", "ng")).alias("hit"), F.sum("np").alias("np"), F.sum("ng").alias("ng"))
        pr, rc = F.when(F.col("np") > 0, F.col("hit") / F.col("np")), F.when(F.col("ng") > 0, F.col("hit") / F.col("ng"))
        f1 = F.when((F.col("np") > 0) & (F.col("ng") > 0), F.when(F.col("hit") == 0, 0.0).otherwise(2 * pr * rc / (pr + rc)))
        part = _long(c, {f"{name}_precision": pr, f"{name}_recall": rc, f"{name}_f1": f1})
        out = part if out is None else out.unionByName(part)
    ends = lambda side, f: sides[side].select("case_id", F.explode(F.array("s", "o")).alias("e")).distinct().withColumn(f, F.lit(1))
    cover = ends("g", "g").join(ends("p", "p"), ["case_id", "e"], "left").groupBy("case_id").agg(F.sum(F.coalesce("p", F.lit(0))).alias("hit"), F.count(F.lit(1)).alias("n"))
    attached = predicted.groupBy("case_id").agg(F.avg((F.length("chunk_id") > 0).cast("int")).alias("v"), F.avg(F.coalesce((F.length("chunk_id") > 0).cast("int"), F.lit(0))).alias("w"))
    return out.unionByName(_long(cover, {"entity_coverage": F.col("hit") / F.col("n")})).unionByName(_long(attached, {"evidence_attachment": F.col("w")}))


def macro_mean(metrics: DataFrame) -> DataFrame:
    """Mean over the cases a metric applies to; metrics without any are left out."""
    v = F.nanvl("value", F.lit(None).cast("double"))
    return metrics.groupBy("metric").agg(F.round(F.avg(v), 6).alias("mean"), F.count(v).alias("n_cases")).where(F.col("mean").isNotNull())


def by_tag(metrics: DataFrame, tags: DataFrame) -> DataFrame:
    """The same per tag; a case counts once for each distinct tag of ``tags(case_id, tag)``."""
    v = F.nanvl("value", F.lit(None).cast("double"))
    return metrics.join(tags.distinct(), "case_id").groupBy("tag", "metric").agg(F.round(F.avg(v), 6).alias("mean"), F.count(v).alias("n_cases")).where(F.col("mean").isNotNull())


def operational(runs: DataFrame) -> DataFrame:
    """Long summary of ``runs(latency_ms, error)``: cases, error rate, and latency of the runs without error."""
    ok = F.when(F.col("error").isNull(), F.col("latency_ms"))
    a = runs.agg(
        F.count(F.lit(1)).cast("double").alias("case_count"), F.avg(F.col("error").isNotNull().cast("int")).alias("error_rate"), F.avg(ok).alias("latency_mean"), F.max(ok).alias("latency_max"),
    )
    quantile = percentiles(runs.where(F.col("error").isNull()), "latency_ms", (0.5, 0.95))
    a = a.withColumns({f"latency_p{q * 100:g}": F.lit(v).cast("double") for q, v in quantile.items()})
    return a.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.round(c, 6).alias("value")) for c in a.columns]))).where(F.col("value").isNotNull())


def percentiles(df: DataFrame, column: str, shares: Sequence[float]) -> dict[float, float | None]:
    """Exact percentiles at position (n - 1) * share, interpolated; None without values. Nulls and NaN are left out.

    The values are sorted in ranges, one a task; the sizes of the ranges tell in which of them a wanted position lies, and
    only there are rows numbered. The driver gets the sizes and two values a share.
    """
    v = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ranges = cut(v.repartitionByRange("v").select("v", F.spark_partition_id().alias("part")))
    sizes = {r["part"]: r["n"] for r in ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one a range
    n = sum(sizes.values())
    if not n:
        return dict.fromkeys(shares)
    at = {i for q in shares for i in (math.floor((n - 1) * q), math.ceil((n - 1) * q))}
    wanted, begin = [], 0
    for part in sorted(sizes):
        wanted += [(part, i - begin + 1, i) for i in at if begin <= i < begin + sizes[part]]
        begin += sizes[part]
    numbered = ranges.where(F.col("part").isin([p for p, _, _ in wanted])).withColumn("r", F.row_number().over(W.partitionBy("part").orderBy("v")))
    hit = F.broadcast(df.sparkSession.createDataFrame(wanted, "part int, r int, i bigint"))  # two rows a share
    value = {r["i"]: r["v"] for r in numbered.join(hit, ["part", "r"]).select("i", "v").collect()}
    out = {}
    for q in shares:
        p = (n - 1) * q
        low, high = value[math.floor(p)], value[math.ceil(p)]
        out[q] = low + (high - low) * (p - math.floor(p))
    return out


#: Parts of a metric's name by which less is better.
LESS_IS_BETTER = ("error_rate", "latency", "cost")


def gates(rules: DataFrame, aggregate: DataFrame, baseline: DataFrame) -> DataFrame:
    """``metric, value, base, passed, reason`` for ``rules(metric, least, most, max_regression)``.

    A rule fails when the metric is missing, below ``least``, above ``most`` or has got worse than its baseline by more
    than ``max_regression``; equality passes, and without a baseline regression is not checked.
    """
    j = rules.join(aggregate.select("metric", F.col("mean").alias("value")), "metric", "left").join(baseline.select("metric", F.col("mean").alias("base")), "metric", "left")
    down = F.lit(False)
    for part in LESS_IS_BETTER:
        down = down | F.contains("metric", F.lit(part))
    worse = F.round(F.when(down, F.col("value") - F.col("base")).otherwise(F.col("base") - F.col("value")), 6)
    reason = (
        F.when(F.col("value").isNull(), "missing").when(F.col("value") < F.col("least"), "below minimum").when(F.col("value") > F.col("most"), "above maximum").when(worse > F.col("max_regression"), "regression").otherwise("ok")
    )
    return j.select("metric", "value", "base", (reason == "ok").alias("passed"), reason.alias("reason"))


def verdict(outcomes: DataFrame) -> DataFrame:
    """One row for all gates: ``n_gates, n_failed, passed``; without gates they pass."""
    return outcomes.agg(F.count(F.lit(1)).alias("n_gates"), F.count_if(~F.col("passed")).alias("n_failed"), F.coalesce(F.every("passed"), F.lit(True)).alias("passed"))


def deltas(aggregate: DataFrame, baseline: DataFrame) -> DataFrame:
    j = aggregate.select("metric", F.col("mean").alias("value")).join(baseline.select("metric", F.col("mean").alias("base")), "metric", "left")
    return j.select("metric", "value", "base", F.round(F.col("value") - F.col("base"), 6).alias("delta"))


def worst_cases(metrics: DataFrame, metric: str, n: int = 5) -> DataFrame:
    """The ``n`` cases with the least value, by value and id; a top-k, so only n rows per task move."""
    return metrics.where(F.col("metric") == metric).orderBy("value", "case_id").limit(n)


def rounded(metrics: DataFrame, column: str = "value", digits: int = 6) -> DataFrame:
    """Metric rows for display."""
    return metrics.withColumn(column, F.round(column, digits))


def with_ranks(df: DataFrame, by: str, order: Sequence[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)))
