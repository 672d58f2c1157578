"""Eager aggregation through joins, and joins that survive hot keys.

A join whose result is only aggregated per key never needs its own rows: both inputs are folded to one compact state
per key first (with map-side combine, so a key that holds a third of a table sends one row per task into the shuffle),
the states are joined one to one, and the aggregates of the join follow algebraically: a count is the product of the
counts, a sum is the sum of one side times the count of the other, minima and maxima carry over.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEFT, RIGHT = "l", "r"


def key_states(df: DataFrame, keys: Mapping[str, Column | str], sums: Mapping[str, Column | str] | None = None, mins: Mapping[str, Column | str] | None = None, maxs: Mapping[str, Column | str] | None = None) -> DataFrame:
    """One compact state per key: ``n`` rows and the asked sums, minima and maxima.

    Columns are named ``n``, ``sum_<x>``, ``cnt_<x>`` (rows where x is not null), ``min_<x>``, ``max_<x>``. Nulls are
    skipped by every aggregate; a null key is a key of its own here. An empty table has no states.
    """
    picked = df.select(
        *[_col(c).alias(k) for k, c in keys.items()],
        *[_col(c).alias(f"_s_{k}") for k, c in (sums or {}).items()],
        *[_col(c).alias(f"_a_{k}") for k, c in (mins or {}).items()],
        *[_col(c).alias(f"_z_{k}") for k, c in (maxs or {}).items()],
    )
    return picked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.sum(f"_s_{k}"), F.lit(0)).alias(f"sum_{k}") for k in sums or {}],
        *[F.count(f"_s_{k}").alias(f"cnt_{k}") for k in sums or {}],
        *[F.min(f"_a_{k}").alias(f"min_{k}") for k in mins or {}],
        *[F.max(f"_z_{k}").alias(f"max_{k}") for k in maxs or {}],
    )


def join_states(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two state tables of :func:`key_states` and derive the aggregates of the row-level join.

    Result: the keys, ``n_left``, ``n_right``, ``n_join`` (rows the row-level join would have), ``left_sum_<x>`` and
    ``right_sum_<x>`` (sums over the joined rows), minima and maxima with their side's prefix. With
    ``how="full"`` keys of one side only have 0 for the other. Null keys match nothing, as in any equi-join; with
    ``"full"`` both null groups stay as separate rows.
    """
    a = left.select(*keys, *[F.col(c).alias(f"left_{c}") for c in left.columns if c not in keys])
    b = right.select(*keys, *[F.col(c).alias(f"right_{c}") for c in right.columns if c not in keys])
    joined = a.join(b, list(keys), how)
    n_left, n_right = F.coalesce("left_n", F.lit(0)), F.coalesce("right_n", F.lit(0))
    out = [*keys, n_left.alias("n_left"), n_right.alias("n_right"), (n_left * n_right).alias("n_join")]
    for side, other in (("left", n_right), ("right", n_left)):
        for c in (left if side == "left" else right).columns:
            if c.startswith(("sum_", "cnt_")):
                out.append((F.coalesce(f"{side}_{c}", F.lit(0)) * other).alias(f"{side}_{c}"))
            elif c.startswith(("min_", "max_")):
                out.append(F.when(other > 0, F.col(f"{side}_{c}")).alias(f"{side}_{c}"))
    return joined.select(*out)


def roll_up(states: DataFrame, by: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Roll joined states up to coarser keys: counts and sums add, minima and maxima combine."""
    aggs = []
    for c in states.columns:
        if c in by or c in drop:
            continue
        if c.startswith(("n_", "left_sum_", "right_sum_", "left_cnt_", "right_cnt_")):
            aggs.append(F.sum(c).alias(c))
        elif "_min_" in c:
            aggs.append(F.min(c).alias(c))
        elif "_max_" in c:
            aggs.append(F.max(c).alias(c))
    return states.groupBy(*by).agg(*aggs)


def heavy_keys(states: DataFrame, keys: Sequence[str], sides: Mapping[str, str], percent: int = 5) -> DataFrame:
    """Keys that hold at least ``percent`` % of a side's rows: ``side``, the keys, ``n_rows``.

    ``sides`` maps a label to the count column of a full outer join of states. Totals are rolled up from the states,
    not from the tables; a side has at most ``100 / percent`` such keys. Keys with a null part count in the total but
    are no keys themselves.
    """
    totals = states.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{i}") for i, c in enumerate(sides.values())])
    entries = F.array(*[F.struct(F.lit(label).alias("side"), F.col(c).alias("n_rows"), F.col(f"total_{i}").alias("total")) for i, (label, c) in enumerate(sides.items())])
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return (
        states.where(known)
        .crossJoin(F.broadcast(totals))  # one row
        .select(*keys, F.explode(entries).alias("e"))
        .where((F.col("e.n_rows") > 0) & (F.col("e.n_rows") * 100 >= F.col("e.total") * percent))
        .select("e.side", *keys, "e.n_rows")
    )


def hot_split_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", hot_rows: int = 50_000, most_hot: int = 10_000) -> DataFrame:
    """``left`` join ``right`` where ``right`` has one row per key and ``left`` may have hot keys.

    Keys with at least ``hot_rows`` rows in ``left`` are hot. A table of n rows has at most n / ``hot_rows`` of them, and
    that number is checked: up to ``most_hot`` hot keys' rows of ``right`` are broadcast to where the hot rows already
    lie, so those are not shuffled; beyond it (tables of hundreds of millions of rows) the threshold is raised until it
    holds. All other rows take a plain shuffle join, whose largest key is then below the threshold. ``how`` is
    ``inner`` or ``left``; rows with a null key match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left: {how}")
    counts = left.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot_rows)
    found = counts.orderBy(F.desc("_n"), *keys).limit(most_hot + 1).collect()
    if len(found) > most_hot:  # the last one's count bounds all the others
        found = [r for r in found if r["_n"] > found[-1]["_n"]]
    if not found:
        return left.join(right, list(keys), how)
    spark = left.sparkSession
    hot = spark.createDataFrame([tuple(r[k] for k in keys) for r in found], left.select(*keys).schema)
    flagged = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), list(keys), "left")
    warm = flagged.where(F.col("_hot")).drop("_hot").join(F.broadcast(right.join(F.broadcast(hot), list(keys), "left_semi")), list(keys), how)
    cold = flagged.where(F.col("_hot").isNull()).drop("_hot").join(right, list(keys), how)
    return warm.unionByName(cold)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
