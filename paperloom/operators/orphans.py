"""Orphan references: foreign keys whose target is missing, deleted or late."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.eager import hot_split_join

MATCH = ("simple", "full", "partial")


def target_states(targets: DataFrame, keys: Sequence[str], at: Column, deleted: Column) -> DataFrame:
    """One state per target key: ``first_at`` and whether its latest row is a deletion.

    Rows with a null in the key are no targets. Among rows of the same latest time a deletion wins. Rows without a time
    count as oldest; a key with none but such rows has a null ``first_at``.
    """
    state = F.max(F.struct(at.alias("at"), F.coalesce(deleted, F.lit(False)).alias("gone")))
    rows = targets.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    return rows.groupBy(*keys).agg(F.min(at).alias("first_at"), state.alias("_s")).select(*keys, "first_at", F.col("_s.gone").alias("gone"))


def orphan_references(references: DataFrame, states: DataFrame, keys: Sequence[str], at: str, match: str = "full", hot_rows: int = 50_000) -> DataFrame:
    """The rows of ``references`` whose target fails, with ``reason``: ``missing``, ``deleted`` or ``late``.

    ``references`` has the key columns and its own time ``at``; ``states`` is from :func:`target_states`. References
    are grouped by the null mask of their key and each mask is checked on its non-null columns:

    * complete keys are anti-joined on all columns; a target that exists is ``deleted`` if its latest row is, else
      ``late`` if it first came after the reference;
    * a key with some nulls follows ``match``: ``simple`` never checks it, ``full`` makes it ``missing`` outright,
      ``partial`` makes it ``missing`` unless some target agrees on the non-null columns (deletion and lateness need
      one target and are not judged);
    * a key of nulls alone is no reference under any semantics.

    Rows without a time are never late. Rows of ``references`` are kept as they are, repeated ones included.
    """
    if match not in MATCH:
        raise ValueError(f"match must be one of {MATCH}: {match}")
    keys = list(keys)
    mask = lambda bits: reduce(lambda a, b: a & b, [F.col(k).isNotNull() if b else F.col(k).isNull() for k, b in zip(keys, bits, strict=True)])
    whole = hot_split_join(references.where(mask([True] * len(keys))), states.withColumn("_known", F.lit(True)), keys, "left", hot_rows)
    reason = F.when(F.col("_known").isNull(), "missing").when(F.col("gone"), "deleted").when(F.col("first_at") > F.col(at), "late")
    parts = [whole.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*references.columns, "reason")]
    for code in range(1, 2 ** len(keys) - 1) if match != "simple" else ():
        bits = [bool(code >> i & 1) for i in range(len(keys))]
        rows, on = references.where(mask(bits)), [k for k, b in zip(keys, bits, strict=True) if b]
        if match == "partial":
            rows = rows.join(states.select(*on).distinct(), on, "left_anti")
        parts.append(rows.select(*references.columns, F.lit("missing").alias("reason")))
    return reduce(DataFrame.unionByName, parts)


def orphan_report(orphans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Orphans per table and period: rows, distinct records and distinct missing ids of every ``by`` group."""
    counts = orphans.groupBy(*by).agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("record_id").alias("n_records"), F.countDistinct("missing_id").alias("n_missing_ids"))
    return counts
