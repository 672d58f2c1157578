"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges(a, b)``; the root is the least node of the component.

    Each round links a node's larger neighbours to its least one (large star), then all its smaller ones and itself
    (small star); the number of rounds grows with the logarithm of the component size. Minima are combined before the
    shuffle, edges stay distributed, and each round is cut with a checkpoint. Loops and edges with a null are dropped.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where((F.col("a") != F.col("b")) & F.col("a").isNotNull() & F.col("b").isNotNull()).distinct()
    e = cut(e)
    state = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        now = _state(e)
        if now == state:
            break
        state = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _state(e: DataFrame) -> tuple:
    """Count and an order-free digest of the edges, one row."""
    h = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))
    return tuple(e.agg(F.count(F.lit(1)), F.sum(h), F.sum(F.pmod(h * 31 + 7, F.lit(1_000_003)))).collect()[0])
