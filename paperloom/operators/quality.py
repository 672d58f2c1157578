"""Invariants of the tables, each as the rows that break it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with ``n``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def dangling(df: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Distinct non-null keys without a target."""
    known = target.select(F.col(target_key).alias(key)).distinct()
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(known, key, "left_anti")


def outside(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values outside a closed list, with ``n``; null is outside."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*allowed)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def childless(df: DataFrame, key: str, children: DataFrame, child_key: str) -> DataFrame:
    """Keys that should have children and have none."""
    return df.select(key).distinct().join(children.select(F.col(child_key).alias(key)).distinct(), key, "left_anti")


def mixed_signatures(points: DataFrame, expected: dict[str, object]) -> DataFrame:
    """Signatures of points that differ from the expected one, with ``n``."""
    same = F.lit(True)
    for c, v in expected.items():
        same = same & F.col(c).eqNullSafe(F.lit(v))
    return points.where(~same).groupBy(*expected).agg(F.count(F.lit(1)).alias("n"))
