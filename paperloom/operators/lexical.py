"""BM25 over an inverted index in the form of joins, with scope routing and extractive answers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions.columns import once
from paperloom.functions.text import first_sentence, tokenize
from paperloom.session import cut

#: BM25 constants, number of hits, and the share from which a query stays in its own paper.
K1, B, TOP_K, ROUTE = 1.5, 0.75, 10, 0.45
#: Distinct (query, term) rows that are broadcast; more are joined by shuffle.
MOST_BROADCAST = 500_000
#: Scores that a task holds at once: so many documents are scored together that they stay under it.
MOST_CELLS = 2_000_000


def if_small(df: DataFrame, rows: int = MOST_BROADCAST) -> DataFrame:
    """``df`` with a broadcast hint if it is checked to have at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: ``n_docs`` and ``avg_len`` (1.0 for an empty corpus) over ``docs(doc_id, tokens)``."""
    mean = F.avg(F.size("tokens"))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.nullif(mean, F.lit(0.0)), F.lit(1.0)).alias("avg_len"))


def document_frequency(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def bm25_scores(queries: DataFrame, docs: DataFrame, live: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, doc_id, score`` of every document that shares a term with the query; score over 0, rounded to 6.

    ``queries(query_id, text)``, ``docs(doc_id, text)`` with unique ids. Repeated query tokens count as often as they
    occur. Documents without tokens count for the corpus size and mean length. Only tokens that some query asks for
    leave the scan of the corpus; null texts have no tokens.

    Where ``docs`` has several versions of a document, told apart by a column ``version``, ``live(doc_id, version)`` says
    which of them count; equal rows count once. Texts are then never shuffled to find the version in force. With the
    number of tokens as ``len`` in ``live`` the corpus is read once.
    """
    q = queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    key = ["doc_id"] if live is None else ["doc_id", "version"]
    d = once(docs.select(*key, "text"), {"tokens": tokenize(F.coalesce("text", F.lit("")))}).drop("text")
    terms = if_small(q.select("term").distinct())
    # Terms are counted row by row in the scan, so only matched ones leave it; this is read for df and for the scores.
    rows = d.withColumn("_row", F.monotonically_increasing_id())
    held = rows.select(*key, "_row", F.size("tokens").alias("len"), F.explode("tokens").alias("term")).join(terms, "term", "left_semi")
    tf = held.groupBy(*key, "_row", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    size = d.select(*key, F.size("tokens").alias("len"))
    if live is not None and "len" in live.columns:
        tf = tf.join(live.select(*key), key, "left_semi").groupBy("doc_id", "len", "term").agg(F.max("tf").alias("tf"))
        size = live.select("doc_id", "len")
    elif live is not None:
        wanted = live.select(*key)
        tf = tf.join(wanted, key, "left_semi").groupBy("doc_id", "len", "term").agg(F.max("tf").alias("tf"))
        size = size.join(wanted, key, "left_semi").groupBy("doc_id").agg(F.max("len").alias("len"))
    tf = cut(tf.select("doc_id", "len", "term", "tf"))
    stats = size.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.nullif(F.avg("len"), F.lit(0.0)), F.lit(1.0)).alias("avg_len")).collect()[0]
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = if_small(q.join(df, "term").select("query_id", "term", "qtf", idf(F.lit(stats["n_docs"]), F.col("df")).alias("idf")))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.greatest("len", F.lit(1)) / F.lit(stats["avg_len"])))
    score = F.round(F.sum(part), 6)
    return tf.join(asked, "term").groupBy("query_id", "doc_id").agg(score.alias("score")).where(F.col("score") > 0)


def bm25_best(queries: DataFrame, docs: DataFrame, live: DataFrame | None = None, k: int = TOP_K, tie: str = "doc_id") -> DataFrame:
    """The rows of :func:`bm25_scores` that :func:`top_k`, :func:`route` and :func:`routed_hits` can need: at least the best
    ``k`` of each query in the whole corpus, and the best ``k`` in the query's own paper.

    ``queries(query_id, text, paper_id)``; ``docs``, or ``live`` where it is given, has ``paper_id`` and the column ``tie``
    by which equal scores are ordered. Every document becomes one short row with the numbers of the asked terms in it;
    these are scored where they lie, and a task passes on its best documents only. So the disk grows with the corpus, not
    with the pairs of queries and documents.
    """
    q = queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = q.limit(MOST_BROADCAST + 1).toPandas()
    if len(asked) > MOST_BROADCAST:
        return bm25_scores(queries, docs, live)
    terms, term = np.unique(asked["term"].to_numpy(object), return_inverse=True)
    key = ["doc_id"] if live is None else ["doc_id", "version"]
    about = list(dict.fromkeys(["paper_id", tie]))
    own = [c for c in about if c not in key] if live is None else []
    d = docs.select(*key, *own, tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))
    kept = d.drop("tokens").schema
    held = d.mapInArrow(_numbered(list(terms)), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "len int, held binary"]))
    if live is not None:
        held = held.join(live.select(*dict.fromkeys([*key, *about])), key).dropDuplicates(key)
    held = cut(held.select(*dict.fromkeys(["doc_id", *about, "len", "held"])))
    stats = held.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.nullif(F.avg("len"), F.lit(0.0)), F.lit(1.0)).alias("avg_len")).collect()[0]
    df = np.zeros(len(terms))
    for r in held.select("held").mapInArrow(_counted(len(terms)), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    idf_of = np.log(1 + (stats["n_docs"] - df + 0.5) / (df + 0.5))
    ids, query = np.unique(asked["query_id"].to_numpy(object), return_inverse=True)
    paper = {r["query_id"]: r["paper_id"] for r in queries.select("query_id", "paper_id").collect()}
    order = np.argsort(term, kind="stable")
    index = _Asked(list(ids), [paper.get(i) for i in ids], np.searchsorted(term[order], np.arange(len(terms) + 1)), query[order], asked["qtf"].to_numpy(float)[order] * idf_of[term[order]], stats["avg_len"])
    kinds = dict(held.dtypes) | dict(queries.dtypes)
    return held.select(*dict.fromkeys(["doc_id", *about, "len", "held"])).mapInArrow(_searched(index, k, tie), f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")


@dataclass
class _Asked:
    """Queries by term: those of term t are ``query[offsets[t]:offsets[t + 1]]``, with their weights."""

    ids: list
    papers: list
    offsets: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    avg_len: float


def _kind(n: int) -> type:
    """The numbers of the terms as they are stored."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def _numbered(terms: list[str]):
    """Rows with ``len``, the number of tokens, and ``held``, the numbers of those that are asked for, in place of ``tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kind = pa.array(terms, pa.string()), _kind(len(terms))
        for b in batches:
            tokens = b.column("tokens")
            number = pc.fill_null(pc.index_in(tokens.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            length = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
            there = number >= 0
            ends = np.append(0, np.cumsum(there))[np.cumsum(length)]
            data = number[there].astype(kind)
            at = np.append(0, ends).astype(np.int64) * data.itemsize
            held = pa.Array.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "tokens"), pa.array(length, pa.int32()), held], names=[*(c for c in b.schema.names if c != "tokens"), "len", "held"])

    return run


def _postings(held: pa.Array, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, row and how often the term is in the row, by term and row."""
    kind, texts = _kind(n_terms), held.to_pylist()
    number = np.frombuffer(b"".join(texts), kind).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) // np.dtype(kind).itemsize for t in texts])
    both, tf = np.unique(number * max(1, len(texts)) + row, return_counts=True)
    return both // max(1, len(texts)), both % max(1, len(texts)), tf


def _counted(n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            df += np.bincount(_postings(b.column("held"), n_terms)[0], minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], names=["term", "df"])

    return run


class _Best:
    """The best ``k`` documents of each query so far; equal scores by ``tie``, null first."""

    def __init__(self, k: int, n: int):
        self.k, self.rows, self.least = k, [[] for _ in range(n)], np.zeros(n)

    def add(self, query: int, scores: np.ndarray, ties: list, docs: list) -> None:
        rows = self.rows[query]
        rows += [(-s, t is not None, t, d) for s, t, d in zip(scores.tolist(), ties, docs, strict=True)]
        rows.sort()
        del rows[self.k :]
        if len(rows) == self.k:
            self.least[query] = -rows[-1][0]


def _searched(index: _Asked, k: int, tie: str, k1: float = K1, b: float = B):
    """Of the documents of a task, the best ``k`` of each query, and the best ``k`` in its own paper."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_terms, n = len(index.offsets) - 1, len(index.ids)
        every, inside = _Best(k, n), _Best(k, n)
        wanted: dict = {}
        for i, p in enumerate(index.papers):
            if p is not None:
                wanted.setdefault(p, []).append(i)
        step = max(1, MOST_CELLS // max(1, n))
        for batch in batches:
            for part in (batch.slice(i, step) for i in range(0, len(batch) if n else 0, step)):
                term, row, tf = _postings(part.column("held"), n_terms)
                length = np.maximum(part.column("len").to_numpy(zero_copy_only=False), 1)
                impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / index.avg_len))
                score = np.zeros((n, len(part)))
                starts = np.flatnonzero(np.diff(term, prepend=-1))
                for t, i, j in zip(term[starts].tolist(), starts.tolist(), np.append(starts, len(term))[1:].tolist(), strict=True):
                    at = slice(index.offsets[t], index.offsets[t + 1])
                    score[index.query[at, None], row[i:j]] += index.weight[at, None] * impact[i:j]
                score = np.floor(score * 1e6 + 0.5) / 1e6
                docs, ties = part.column("doc_id"), part.column(tie)
                papers = part.column("paper_id").to_pylist()
                rows_of: dict = {}
                for i, p in enumerate(papers):
                    if p in wanted:
                        rows_of.setdefault(p, []).append(i)
                for i in np.flatnonzero(score.max(axis=1, initial=0) >= np.maximum(every.least, 1e-6)).tolist():
                    _offer(every, i, score[i], np.arange(len(part)), ties, docs)
                for p, rows in rows_of.items():
                    rows = np.array(rows)
                    for i in wanted[p]:
                        _offer(inside, i, score[i, rows], rows, ties, docs)
        found = [(i, -r[0], r[3]) for i in range(n) for r in dict.fromkeys([*every.rows[i], *inside.rows[i]])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([index.ids[i] for i, _, _ in found]), pa.array([d for _, _, d in found]), pa.array([s for _, s, _ in found], pa.float64())], names=["query_id", "doc_id", "score"])

    return run


def _offer(best: _Best, query: int, score: np.ndarray, rows: np.ndarray, ties: pa.Array, docs: pa.Array) -> None:
    """Those of the rows that may be among the best; more than ``k`` only where scores are equal."""
    least = max(best.least[query], 1e-6)
    at = np.flatnonzero(score >= least)
    if len(at) > best.k:
        at = at[score[at] >= np.partition(score[at], -best.k)[-best.k]]
    if len(at):
        take = pa.array(rows[at])
        best.add(query, score[at], ties.take(take).to_pylist(), docs.take(take).to_pylist())


def top_k(scores: DataFrame, k: int = TOP_K, tie: str = "doc_id") -> DataFrame:
    """The best ``k`` per query with ``rank`` from 1; equal scores by id."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), tie)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def route(scores: DataFrame, docs: DataFrame, queries: DataFrame, threshold: float = ROUTE) -> DataFrame:
    """``query_id, ratio, scope``: best score inside the query's own paper over the best overall, and where to search.

    ``docs(doc_id, paper_id)``, ``queries(query_id, paper_id)``. A query without hits or paper has ratio 0 and scope
    `global`.
    """
    own = scores.join(docs.select("doc_id", "paper_id"), "doc_id").join(if_small(queries.select("query_id", F.col("paper_id").alias("wanted"))), "query_id")
    best = own.groupBy("query_id").agg(F.max("score").alias("best"), F.max(F.when(F.col("paper_id") == F.col("wanted"), F.col("score"))).alias("inside"))
    ratio = F.coalesce(F.round(F.try_divide(F.col("inside"), F.col("best")), 6), F.lit(0.0))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", ratio.alias("ratio"), F.when(ratio >= threshold, "selected").otherwise("global").alias("scope"))


def routed_hits(scores: DataFrame, docs: DataFrame, queries: DataFrame, routes: DataFrame, k: int = TOP_K, order: str | None = None) -> DataFrame:
    """Top hits after routing: a `selected` query keeps only documents of its paper.

    Equal scores are in order of the column ``order`` of ``docs``, by default of the id.
    """
    tie = order or "doc_id"
    j = scores.join(docs.select(*dict.fromkeys(["doc_id", "paper_id", tie])), "doc_id").join(if_small(queries.select("query_id", F.col("paper_id").alias("wanted")).join(routes, "query_id")), "query_id")
    return top_k(j.where((F.col("scope") == "global") | F.col("wanted").isNull() | (F.col("paper_id") == F.col("wanted"))).select(*dict.fromkeys(["query_id", "doc_id", "score", tie])), k, tie).select("query_id", "doc_id", "score", "rank")


def extractive_answers(hits: DataFrame, docs: DataFrame, live: DataFrame | None = None, n_sentences: int = 2, n_citations: int = 3) -> DataFrame:
    """``query_id, answer, citations``: first sentences of the best two documents, ids of the best three.

    ``live`` as in :func:`bm25_scores`. The few hits go to the texts, not the texts to the hits.
    """
    top = hits.where(F.col("rank") <= max(n_sentences, n_citations)).select("query_id", "doc_id", "rank")
    if live is None:
        j = docs.select("doc_id", "text").join(if_small(cut(top)), "doc_id")
    else:
        wanted = cut(live.select("doc_id", "version").join(if_small(cut(top)), "doc_id"))
        j = docs.select("doc_id", "version", "text").join(if_small(wanted), ["doc_id", "version"]).dropDuplicates(["query_id", "doc_id"])
    rows = j.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", first_sentence(F.col("text")).alias("s")))).alias("r"))  # at most three rows
    said = F.array_compact(F.transform(F.filter("r", lambda x: x["rank"] <= n_sentences), lambda x: x["s"]))
    return rows.select("query_id", F.array_join(said, " ").alias("answer"), F.array_join(F.transform(F.filter("r", lambda x: x["rank"] <= n_citations), lambda x: x["doc_id"]), ",").alias("citations"))
