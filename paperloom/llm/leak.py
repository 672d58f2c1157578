"""Held-out items inside a corpus: an inverted index of the items, searched by every text with block-max WAND."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shingles import distinct_runs, word_runs
from paperloom.operators.lexical import if_small
from paperloom.session import spread

K1, B = 1.5, 0.75
RUN, SHARE_OF = 4, 3
BLOCK = 16
#: Postings of one index; more items are searched index by index, so what a task holds stays bounded.
MOST_POSTINGS = 2_000_000


@dataclass
class Index:
    """BM25 impacts of the items' word runs, each divided by the item's own threshold.

    An item is found when at least 1 / ``share_of`` of its distinct runs occur. Its threshold is the sum of its least
    impacts over that many runs, so a scaled score under 1 proves that too few occur: the search loses nothing.
    """

    ids: np.ndarray
    needed: np.ndarray
    terms: np.ndarray  # sorted run hashes
    offsets: np.ndarray  # postings of term i: offsets[i]:offsets[i + 1]
    items: np.ndarray
    impacts: np.ndarray
    tops: np.ndarray  # largest impact of each term
    block_tops: np.ndarray  # largest impact of each block of BLOCK postings, term after term
    block_at: np.ndarray  # first block of each term


def build_index(ids: Sequence[int], texts: Sequence[str | None], run: int = RUN, share_of: int = SHARE_OF) -> Index:
    """Index of the items; items under ``run`` words have no runs and are never found."""
    every, owner = word_runs(texts, run)
    length = np.bincount(owner, minlength=len(ids)).astype(float) if len(owner) else np.zeros(len(ids))
    key = np.stack([every, owner.astype(np.uint64)], 1) if len(every) else np.empty((0, 2), np.uint64)
    pairs, tf = np.unique(key, axis=0, return_counts=True)
    terms, start, df = np.unique(pairs[:, 0], return_index=True, return_counts=True)
    items = pairs[:, 1].astype(np.int64)
    mean = length[length > 0].mean() if (length > 0).any() else 1.0
    idf = np.repeat(np.log1p((len(ids) - df + 0.5) / (df + 0.5)), df)
    impacts = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[items] / mean))
    distinct = np.bincount(items, minlength=len(ids)) if len(items) else np.zeros(len(ids), int)
    needed = -(-distinct // share_of)
    order = np.lexsort((impacts, items))  # each item's impacts from the least
    place = np.arange(len(items)) - np.repeat(np.cumsum(distinct) - distinct, distinct)
    least = order[place < needed[items[order]]] if len(items) else order
    threshold = np.bincount(items[least], impacts[least], len(ids)) if len(items) else np.zeros(len(ids))
    impacts = impacts / np.where(threshold > 0, threshold, 1.0)[items]
    offsets = np.append(start, len(items))
    tops = np.maximum.reduceat(impacts, start) if len(start) else np.empty(0)
    first = np.flatnonzero((np.arange(len(items)) - np.repeat(start, df)) % BLOCK == 0) if len(items) else np.empty(0, np.int64)
    blocks = np.maximum.reduceat(impacts, first) if len(first) else np.empty(0)
    at = np.cumsum(-(-df // BLOCK)) - -(-df // BLOCK)
    return Index(np.asarray(ids), needed, terms, offsets, items, impacts, tops, blocks, at)


def wand(index: Index, terms: Sequence[int], threshold: float = 1.0 - 1e-9) -> list[tuple[int, float]]:
    """Items whose summed impacts over ``terms`` (positions in the index, distinct) reach ``threshold``.

    Cursors are kept in item order; the pivot is the first item that the term tops could carry over the threshold, the
    tops of the cursors' present blocks may then rule it out and move all of them past the nearest block end.
    """
    end = len(index.ids)
    cursors = [[int(index.items[index.offsets[t]]), t, int(index.offsets[t])] for t in terms]  # item, term, posting
    found = []
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, None
        for k, (item, t, _) in enumerate(cursors):
            bound += index.tops[t]
            if bound >= threshold:
                pivot = k
                break
        if pivot is None:
            return found
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        bound, edge = 0.0, end
        for c in cursors[: pivot + 1]:
            a, b = index.offsets[c[1]], index.offsets[c[1] + 1]
            p = int(np.searchsorted(index.items[a:b], item)) if c[0] < item else c[2] - a
            if p >= b - a:
                continue
            block = int(p) // BLOCK
            bound += index.block_tops[index.block_at[c[1]] + block]
            last = min((block + 1) * BLOCK, b - a) - 1
            edge = min(edge, int(index.items[a + last]) + 1)
        if bound < threshold:  # no item before the nearest block end, nor before the next list begins, can reach it
            goal = max(item + 1, min(edge, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end))
            _advance(index, cursors, pivot, goal)
        elif cursors[0][0] == item:
            score = sum(float(index.impacts[c[2]]) for c in cursors[: pivot + 1])
            if score >= threshold:
                found.append((item, score))
            _advance(index, cursors, pivot, item + 1)
        else:
            _advance(index, cursors, pivot, item)
    return found


def _advance(index: Index, cursors: list[list[int]], pivot: int, goal: int) -> None:
    for c in cursors[: pivot + 1]:
        if c[0] < goal:
            end = index.offsets[c[1] + 1]
            c[2] += int(np.searchsorted(index.items[c[2] : end], goal))
            c[0] = int(index.items[c[2]]) if c[2] < end else -1
    cursors[:] = [c for c in cursors if c[0] >= 0]


FOUND = "doc_id bigint, item_id bigint, n_runs int, n_item_runs int, score double"


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, share_of: int = SHARE_OF, most_postings: int = MOST_POSTINGS) -> DataFrame:
    """Every document that holds at least 1 / ``share_of`` of an item's distinct runs of ``run`` words.

    ``documents(doc_id, text)`` are the queries, ``items(item_id, text)`` is what is indexed. One row per document and
    item with the runs shared, the item's runs and the BM25 score in units of the item's threshold. Whole texts are
    searched. Null texts and short items give nothing; repeated items (equal id) are searched by their union of rows
    and may repeat a result. The items are read to the driver index by index of at most ``most_postings`` postings.
    """
    rows = [(r["item_id"], r["text"]) for r in items.select("item_id", "text").where(F.col("text").isNotNull()).dropDuplicates().orderBy("item_id", "text").toLocalIterator()]
    blocks: list[list[tuple[int, str]]] = [[]]
    held = 0
    for r in rows:
        n = r[1].count(" ") + r[1].count("\n") + 1
        if held + n > most_postings and blocks[-1]:
            blocks.append([])
            held = 0
        blocks[-1].append(r)
        held += n
    out = None
    for block in blocks:
        part = _search(documents, build_index([i for i, _ in block], [t for _, t in block], run, share_of), run)
        out = part if out is None else out.unionByName(part)
    return out


def _search(documents: DataFrame, index: Index, run: int) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix: Index = shared.value
        sizes = np.bincount(ix.items, minlength=len(ix.ids)) if len(ix.items) else np.zeros(len(ix.ids), int)
        for batch in batches:
            runs, owner = word_runs(batch["text"], run)
            at = np.searchsorted(ix.terms, runs)
            hit = np.zeros(len(runs), bool)
            inside = at < len(ix.terms)
            hit[inside] = ix.terms[at[inside]] == runs[inside]
            at, owner = at[hit], owner[hit]
            ids, out = batch["doc_id"].to_numpy(), []
            edges = np.flatnonzero(np.diff(owner, prepend=-1, append=-1)) if len(owner) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                terms = np.unique(at[a:b])
                candidates = wand(ix, terms.tolist())
                if not candidates:
                    continue
                held = np.bincount(np.concatenate([ix.items[ix.offsets[t] : ix.offsets[t + 1]] for t in terms]), minlength=len(ix.ids))
                out += [(ids[owner[a]], ix.ids[i], held[i], sizes[i], s) for i, s in candidates if held[i] >= ix.needed[i]]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_runs", "n_item_runs", "score"])

    return spread(documents.select("doc_id", "text").where(F.col("text").isNotNull())).mapInPandas(search, FOUND)


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per item that leaks: its kind and split, the documents that hold it and the largest share held."""
    return (
        found.groupBy("item_id")
        .agg(F.countDistinct("doc_id").alias("n_documents"), F.round(F.max(F.col("n_runs") / F.col("n_item_runs")), 6).alias("most_held"))
        .join(if_small(items.select("item_id", "item_kind", "split_name").dropDuplicates(["item_id"])), "item_id", "left")
        .select("item_id", "item_kind", "split_name", "n_documents", "most_held")
    )


def leak_documents(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per document that leaks: items of each kind it holds, and the largest share held of a question and of an answer.

    ``complete`` tells a document that holds both, which gives away more than either. The items are not paired, so any
    question counts with any answer of the same split. Items without kind count for neither.
    """
    kinds = items.select("item_id", "item_kind", "split_name").dropDuplicates(["item_id"])
    j = found.join(if_small(kinds), "item_id")
    share = F.col("n_runs") / F.col("n_item_runs")
    of = lambda k: F.when(F.col("item_kind") == k, share)
    per = j.groupBy("doc_id", "split_name").agg(
        F.countDistinct("item_id").alias("n_items"), F.countDistinct(F.when(F.col("item_kind") == "question", F.col("item_id"))).alias("n_questions"), F.countDistinct(F.when(F.col("item_kind") == "answer", F.col("item_id"))).alias("n_answers"),
        F.round(F.max(of("question")), 6).alias("question_overlap"), F.round(F.max(of("answer")), 6).alias("answer_overlap"),
    )
    return per.withColumn("complete", (F.col("n_questions") > 0) & (F.col("n_answers") > 0))


def documents_scored(index: Index, text: str, run: int = RUN) -> dict[int, float]:
    """Scaled scores of all items for one text without pruning; the reference for tests."""
    runs, _ = distinct_runs([text], run)
    scores: dict[int, float] = {}
    for t in np.flatnonzero(np.isin(index.terms, runs)):
        for p in range(index.offsets[t], index.offsets[t + 1]):
            scores[int(index.items[p])] = scores.get(int(index.items[p]), 0.0) + float(index.impacts[p])
    return {i: s for i, s in scores.items() if not math.isclose(s, 0.0)}
