"""Exact vector search, nearest-neighbour links, hybrid retrieval and rank fusion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions.vectors import cosine
from paperloom.operators.lexical import if_small
from paperloom.session import cut

#: Query vectors held by a task at once; larger query sets are searched in pairs of blocks of queries and of points.
QUERY_BLOCK, POINT_BLOCK = 4096, 16_384
SCOPES = ("all", "selected", "global")


def vector_lists(queries: DataFrame, points: DataFrame, k: int, scopes: Sequence[str] = ("all",), skip: str | None = None, threshold: float | None = None, papers: DataFrame | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The best ``k`` points of each query by cosine in each scope: ``scope, query_id, id, grp, score, rank``; equal scores by id.

    ``queries(query_id, embedding, grp)``, ``points(id, embedding, grp, is_global)``. The scope `selected` searches the
    query's own group, `global` the points flagged so, `all` everything; one pass over the points serves all scopes.
    ``skip``: `self` leaves out the point with the query's id, `group` all of its group. ``papers(grp)`` keeps points of
    these groups. Scores are rounded to 6; ``threshold`` keeps those at least as high. A task sends on at most ``k`` rows
    per query, scope and batch.

    Up to ``query_block`` queries are multiplied with each batch of points in one matrix product where the points lie. More
    are cut into blocks by hash, as are the points, and each pair of blocks is a task's work; no vector reaches the
    driver then. Null vectors are skipped, vectors of another length than the queries' are an error, queries with a null
    group have an empty `selected` list.
    """
    if bad := set(scopes) - set(SCOPES):
        raise ValueError(f"unknown scopes: {sorted(bad)}")
    if k < 1:
        raise ValueError("at least one hit must be asked for")
    q = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding", F.col("grp").alias("qgrp"))
    p = points.where(F.col("embedding").isNotNull()).select("id", "embedding", "grp", "is_global")
    if papers is not None:
        p = p.join(if_small(papers.select("grp").distinct()), "grp", "left_semi")
    kind = {c: points.schema[c].dataType.simpleString() for c in ("id", "grp")}
    schema = f"scope string, query_id {queries.schema['query_id'].dataType.simpleString()}, id {kind['id']}, grp {kind['grp']}, score double"
    n = q.count()
    if n <= query_block:
        held = q.toPandas()
        shared = points.sparkSession.sparkContext.broadcast((held["query_id"].to_numpy(), held["qgrp"].to_numpy(), _unit(held["embedding"])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch) and len(shared.value[0]):
                    yield _best(*shared.value, batch, k, scopes, skip, threshold)

        hits = p.mapInPandas(run, schema)
    else:
        nq, np_ = -(-n // query_block), max(1, -(-p.count() // POINT_BLOCK))
        block = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
        left = q.withColumns({"qb": block("query_id", nq), "pb": F.explode(F.sequence(F.lit(0), F.lit(np_ - 1)))})
        right = p.withColumns({"pb": block("id", np_), "qb": F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))})

        def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
            return _best(a["query_id"].to_numpy(), a["qgrp"].to_numpy(), _unit(a["embedding"]), b, k, scopes, skip, threshold)

        hits = left.groupBy("qb", "pb").cogroup(right.groupBy("qb", "pb")).applyInPandas(both, schema)
    w = W.partitionBy("scope", "query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(vectors: pd.Series) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 0))
    m = np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _best(ids: np.ndarray, groups: np.ndarray, m: np.ndarray, batch: pd.DataFrame, k: int, scopes: Sequence[str], skip: str | None, threshold: float | None) -> pd.DataFrame:
    """The best ``k`` of a batch of points for each query vector and scope."""
    lengths = batch["embedding"].map(len)
    if (lengths != m.shape[1]).any():
        raise ValueError(f"vectors of {m.shape[1]} dimensions expected")
    batch = batch.sort_values("id", kind="stable")
    pid, grp = batch["id"].to_numpy(), batch["grp"].to_numpy()
    s = np.round(m @ _unit(batch["embedding"]).T, 6) + 0.0
    ok = np.ones(s.shape, bool) if threshold is None else s >= threshold
    if skip in ("self", "group"):
        ok &= ids[:, None] != pid[None]
    same = groups[:, None] == grp[None] if skip == "group" or "selected" in scopes else None
    if skip == "group":
        ok &= ~same
    parts = []
    for scope in scopes:
        allowed = ok & same if scope == "selected" else ok & batch["is_global"].fillna(False).to_numpy(bool)[None] if scope == "global" else ok
        t = np.where(allowed, s, -np.inf)
        best = np.argsort(-t, axis=1, kind="stable")[:, :k]
        i, j = np.repeat(np.arange(len(ids)), best.shape[1]), best.ravel()
        keep = t[i, j] > -np.inf
        parts.append(pd.DataFrame({"scope": scope, "query_id": ids[i[keep]], "id": pid[j[keep]], "grp": grp[j[keep]], "score": s[i[keep], j[keep]]}))
    return pd.concat(parts, ignore_index=True)


def vector_scores(queries: DataFrame, points: DataFrame, k: int, scope: str | None = None, skip: str | None = None, threshold: float | None = None, papers: DataFrame | None = None) -> DataFrame:
    """:func:`vector_lists` in one scope (None is all): ``query_id, id, score, rank``."""
    return vector_lists(queries, points, k, (scope or "all",), skip, threshold, papers).select("query_id", "id", "score", "rank")


def knn_links(queries: DataFrame, points: DataFrame, k: int = 3, threshold: float = 0.3, fetch_first: bool = False) -> DataFrame:
    """Links from each query point to similar points of other groups: ``source, target, score``.

    By default the filter comes before the top ``k``; with ``fetch_first`` the top ``k`` + 1 are taken first and filtered
    then, as a store would, which can leave fewer. Scores are rounded to 4.
    """
    if fetch_first:
        hits = vector_lists(queries, points, k + 1).join(if_small(queries.select("query_id", F.col("grp").alias("g"))), "query_id")
        hits = hits.where((F.col("id") != F.col("query_id")) & (F.col("g") != F.col("grp")) & (F.col("score") >= threshold))
        w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
        hits = hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    else:
        hits = vector_scores(queries, points, k, skip="group", threshold=threshold)
    return hits.select(F.col("query_id").alias("source"), F.col("id").alias("target"), F.round("score", 4).alias("score"))


def vector_routing(queries: DataFrame, points: DataFrame, threshold: float = 0.45) -> DataFrame:
    """``query_id, ratio, scope`` from the best hit in the query's group over the best of all, itself left out."""
    return _routes(queries, vector_lists(queries, points, 1, ("all", "selected"), skip="self"), threshold)


def _routes(queries: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    top = lists.where(F.col("rank") == 1).groupBy("query_id").agg(*[F.max(F.when(F.col("scope") == s, F.col("score"))).alias(n) for s, n in (("all", "best"), ("selected", "inside"))])
    ratio = F.coalesce(F.round(F.try_divide("inside", "best"), 6), F.lit(0.0))
    return queries.select("query_id").join(top, "query_id", "left").select("query_id", ratio.alias("ratio"), F.when(ratio >= threshold, "selected").otherwise("global").alias("scope"))


def hybrid(queries: DataFrame, points: DataFrame, near: DataFrame, k: int = 10, threshold: float = 0.45, top_papers: int = 3, most_near: int = 5, per_group: int = 3) -> DataFrame:
    """Vector hits joined with hits by graph expansion: ``query_id, id, grp, score, source, rank, scope``.

    A query routed to its own group gets that group's hits. The others get global hits and, from the groups next
    (``near(grp, related)``) to their own and to those of their three best hits, at most five groups by name, the first
    points of each group scored against the query. A point found both ways counts once, as a vector hit. Scores are
    rounded to 4 after sorting. The points are read once for all lists and once for the expansion.
    """
    lists = cut(vector_lists(queries, points, k, ("all", "selected"), skip="self"))
    routes = _routes(queries, lists, threshold).select("query_id", F.col("scope").alias("route"))
    picked = cut(queries.join(routes, "query_id"))
    vector = lists.join(if_small(picked.select("query_id", "route")), "query_id").where(F.col("scope") == F.when(F.col("route") == "selected", "selected").otherwise("all"))
    far = picked.where("route = 'global'")
    seeds = far.select("query_id", "grp").where(F.col("grp").isNotNull()).unionByName(vector.where((F.col("route") == "global") & (F.col("rank") <= top_papers)).select("query_id", "grp")).distinct()
    related = near.select("grp", "related").distinct().join(if_small(cut(seeds)), "grp").select("query_id", F.col("related").alias("grp")).distinct().join(seeds, ["query_id", "grp"], "left_anti")
    w = W.partitionBy("query_id").orderBy("grp")
    related = cut(related.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most_near).drop("_n"))
    firsts = points.join(if_small(related.select("grp").distinct()), "grp", "left_semi").withColumn("_n", F.row_number().over(W.partitionBy("grp").orderBy("id"))).where(F.col("_n") <= per_group)
    pairs = firsts.select("id", "grp", F.col("embedding").alias("e")).join(if_small(related), "grp").join(if_small(far.select("query_id", "embedding")), "query_id").where(~F.col("id").eqNullSafe(F.col("query_id")))
    graph = pairs.select("query_id", "id", "grp", F.round(cosine(F.col("embedding"), F.col("e")), 6).alias("score"), F.lit("graph").alias("source"), F.lit(1).alias("o"))
    hits = vector.select("query_id", "id", "grp", "score", F.lit("vector").alias("source"), F.lit(0).alias("o")).unionByName(graph)
    once = hits.groupBy("query_id", "id").agg(F.min(F.struct("o", "score", "source", "grp")).alias("h")).select("query_id", "id", "h.*")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "o", "id")
    top = once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).join(if_small(routes.withColumnRenamed("route", "scope")), "query_id")
    return top.select("query_id", "id", "grp", F.round("score", 4).alias("score"), "source", "rank", "scope")


def rrf(ranked: DataFrame, constant: int = 60, k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of ``ranked(query_id, id, rank)`` from several lists: ``query_id, id, score, rank``."""
    s = ranked.groupBy("query_id", "id").agg(F.round(F.sum(1 / (F.lit(constant) + F.col("rank"))), 6).alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
