"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Where the vocabularies of public tokenizers lie; a parameter of every function below.
TOKENIZERS = os.environ.get("PAPERLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Buckets of one source over which its fractional repetition is cut; only the bucket at the cut is sorted.
BUCKETS = 4096


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens`` of every document; null and empty texts have 0 tokens."""
    path = f"{tokenizers}/{vocabulary}"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": [len(encode(t)) if t else 0 for t in batch["text"]]})

    return documents.select("doc_id", "source", "text").mapInPandas(count, "doc_id bigint, source string, n_tokens bigint")


def water_fill(sizes: Mapping[str, int], targets: Mapping[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens each source contributes to a mix of ``total``.

    ``targets`` gives share and most repetitions. Sources over ``size * repetitions`` are clamped there, and what they
    leave is spread over the others in proportion to their shares until none is over or all are clamped. Sources
    without rows, share or repetitions get 0. The default total is one pass over all sources with a target.
    """
    caps = {s: sizes.get(s, 0) * max(int(r or 0), 0) for s, (_, r) in targets.items()}
    if total is None:
        total = float(sum(sizes.get(s, 0) for s in targets))
    fixed = {s: 0.0 for s, (share, _) in targets.items() if not share or share <= 0 or caps[s] == 0}
    while True:
        free = [s for s in targets if s not in fixed]
        rest, weight = total - sum(fixed.values()), sum(targets[s][0] for s in free)
        over = [s for s in free if rest * targets[s][0] / weight >= caps[s]] if free else []
        if not over:
            return fixed | {s: rest * targets[s][0] / weight for s in free}
        fixed |= {s: float(caps[s]) for s in over}


def mix_sources(tokens: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17, buckets: int = BUCKETS) -> DataFrame:
    """The mix: ``doc_id, source, n_tokens, copies`` of every document used.

    ``tokens`` is from :func:`count_tokens`, ``targets(source, target_share, max_repeats)`` has one row per source (the
    first by share where a source is repeated). A source that has to contribute e times its size gives each document
    floor(e) times and, in seeded order, once more to as many as fit into the rest. The order is by a hash of seed and
    ``doc_id``; the cut is found from bucket sums of the hash, and only the bucket at the cut is ordered by document, so
    no source is gathered in one task. Sources without a target, null sources and documents without tokens are not used.
    """
    spark = tokens.sparkSession
    sums = {r["source"]: int(r["size"]) for r in tokens.groupBy("source").agg(F.sum("n_tokens").alias("size")).join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").collect()}
    wanted: dict[str, tuple[float, int]] = {}
    for r in targets.where(F.col("source").isNotNull()).orderBy("source", F.desc("target_share"), F.desc("max_repeats")).collect():
        wanted.setdefault(r["source"], (r["target_share"] or 0.0, r["max_repeats"] or 0))
    filled = water_fill(sums, wanted, total)
    plan = [(s, int(filled[s] // sums[s]), filled[s] - int(filled[s] // sums[s]) * sums[s]) for s in wanted if sums.get(s)]
    plan_df = spark.createDataFrame(plan, "source string, whole int, rest double")
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = tokens.where(F.col("n_tokens") > 0).withColumns({"h": h, "bucket": F.pmod(h, F.lit(buckets)).cast("int")}).join(F.broadcast(plan_df), "source")
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    # At most one bucket per source is cut; the buckets before it are used whole.
    cuts = starts.join(F.broadcast(plan_df), "source").where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("held") > F.col("rest"))).select("source", F.col("bucket").alias("cut"), "before")
    placed = rows.join(F.broadcast(cuts), "source", "left")
    inner = W.partitionBy("source").orderBy("h", "doc_id")
    at_cut = placed.where(F.col("bucket") == F.col("cut")).withColumn("through", F.col("before") + F.sum("n_tokens").over(inner.rowsBetween(W.unboundedPreceding, 0)))
    others = placed.where(F.col("cut").isNull() | (F.col("bucket") != F.col("cut"))).withColumn("through", F.lit(None).cast("long"))
    once: Column = F.when(F.col("rest") <= 0, F.lit(0)).when(F.col("cut").isNull() | (F.col("bucket") < F.col("cut")), F.lit(1)).when(F.col("bucket") > F.col("cut"), F.lit(0)).otherwise((F.col("through") <= F.col("rest")).cast("int"))
    every = others.unionByName(at_cut).withColumn("copies", F.col("whole") + once)
    return every.where(F.col("copies") > 0).select("doc_id", "source", "n_tokens", "copies")


def mix_shares(mixed: DataFrame, tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: its size, what the mix took of it, the share reached beside the target, and repetitions.

    All sources of ``tokens`` are listed, also those without target (their target is null and they contribute nothing)
    and the null source, and all of ``targets``, also those without rows.
    """
    size = tokens.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("size_tokens"))
    used = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_used"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.max("copies").alias("most_copies"))
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    j = size.alias("s").join(t.alias("t"), F.expr("s.source <=> t.source"), "full").select(F.coalesce("s.source", "t.source").alias("source"), "n_documents", "size_tokens", "target_share", "max_repeats")
    j = j.alias("j").join(used.alias("u"), F.expr("j.source <=> u.source"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    total = F.sum(zero("u.mix_tokens")).over(W.partitionBy(F.lit(1)))  # one row per source
    return j.select(F.col("j.source").alias("source"), "target_share", "max_repeats", zero("n_documents").alias("n_documents"), zero("size_tokens").alias("size_tokens"), zero("u.n_used").alias("n_used"), zero("u.most_copies").alias("most_copies"), zero("u.mix_tokens").alias("mix_tokens"), F.coalesce(F.round(F.try_divide(zero("u.mix_tokens"), total), 6), F.lit(0.0)).alias("actual_share"))
