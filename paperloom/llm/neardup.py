"""Near-duplicate records by binary tries of bit sketches, self-joined under a Hamming budget.

Every distinct text gets a parity sketch: bit b tells whether an odd number of its word runs hash to b. Two sketches
differ in at most as many bits as the run sets have elements not in common, so for a Jaccard similarity t between sets
of m and n runs the Hamming distance of any true pair is at most (1 - t) / (1 + t) * (m + n): a budget that no true
pair breaks.

A forest of tries is built over the sketches. The top levels of each trie are a block of min-hash bits on which both
texts of a pair must agree; they are the shuffle key, so one cell of the shuffle is one subtree. Inside a cell the trie
of the parity bits is joined with itself: node pairs are walked together, differing bits accumulate along the way, and a
pair of nodes is dropped once they exceed the budget of the largest texts below them. Every cell is walked from its root;
edges are compressed, so two single leaves are followed to the end in one step. Surviving leaf pairs are verified on
their sets of runs. The number of tries sets the chance that a pair has errors in every block: with 28 tries of 3 minima
a pair of similarity 0.6 is missed with probability 0.0011, one of 0.7 with 0.00001.

Parity bits alone cannot lead the tries: the budget is a quarter of the elements of a pair, so a block without errors
tells little. To keep chance pairs as rare as 28 blocks of min-hash bits do, about 160 blocks of them would be needed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.llm.components import components
from paperloom.llm.shingles import constants, distinct_runs, mix
from paperloom.operators.lexical import if_small
from paperloom.session import cut, shared_dir, spread

TRIES, MINIMA, BITS = 28, 3, 512
#: Members of a cell above which it is cut into blocks whose pairs are spread over tasks.
BLOCK = 512
#: Keys that are broadcast to filter a scan; more are joined by shuffle.
MOST_SENT = 200_000

SKETCH = "kind string, id string, c1 bigint, c2 bigint, n int, labels array<bigint>, bits binary"


def sketches(records: DataFrame, k: int, tries: int = TRIES, minima: int = MINIMA, bits: int = BITS, seed: int = 11) -> DataFrame:
    """Class key (128 bits of kind and run set), number of runs, trie labels and parity sketch of ``records(kind, id, text)``.

    Records of one kind with equal run sets get equal rows apart from their id; a task gives labels and sketch only with the
    first of them, so a text copied over and over costs one row of labels per task. Texts without runs are dropped.
    """
    mults, adds = constants(tries * minima, seed), constants(tries * minima, seed + 1)
    joint = constants(minima, seed + 2)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, int, int]] = set()
        for big in batches:
            for at in range(0, len(big), 1000):
                batch = big.iloc[at : at + 1000]
                runs, owner = distinct_runs(batch["text"], k)
                if not len(runs):
                    continue
                start = np.flatnonzero(np.diff(owner, prepend=-1))
                n = np.diff(start, append=len(owner))
                who = owner[start]
                kinds = _kind_hash(batch["kind"].to_numpy()[who])
                c1, c2 = _class_key(runs, start, kinds)
                labels = np.zeros((tries, len(start)), np.uint64)
                for i in range(tries * minima):
                    low = np.minimum.reduceat(mix_fast(runs, mults[i], adds[i]), start)
                    labels[i // minima] += low * joint[i % minima]
                labels = mix((labels + kinds) ^ np.arange(1, tries + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)).view(np.int64).T
                row = np.repeat(np.arange(len(start)), n)
                odd = np.bincount(row * bits + (runs % np.uint64(bits)).astype(np.int64), minlength=len(start) * bits) & 1
                packed = np.packbits(odd.astype(np.uint8).reshape(len(start), bits), axis=1)
                if len(seen) > 500_000:
                    seen.clear()
                first = []
                for key in zip(batch["kind"].to_numpy()[who].tolist(), c1.tolist(), c2.tolist(), strict=True):
                    first.append(key not in seen)
                    seen.add(key)
                yield pd.DataFrame(
                    {
                        "kind": batch["kind"].to_numpy()[who],
                        "id": batch["id"].to_numpy()[who],
                        "c1": c1,
                        "c2": c2,
                        "n": n.astype(np.int32),
                        "labels": [x if f else None for f, x in zip(first, labels, strict=True)],
                        "bits": [x.tobytes() if f else None for f, x in zip(first, packed, strict=True)],
                    }
                )

    return spread(records.select("kind", "id", "text").where(F.col("text").isNotNull() & F.col("id").isNotNull())).mapInPandas(sketch, SKETCH)


def _kind_hash(kinds: np.ndarray) -> np.ndarray:
    """A number per kind, so that keys of different kinds never agree."""
    known = {k: np.uint64(xxhash.xxh3_64_intdigest(k or "")) for k in set(kinds.tolist())}
    return np.array([known[k] for k in kinds.tolist()], np.uint64)


def _class_key(runs: np.ndarray, start: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class key of each run set (128 bits) of a kind."""
    c1 = mix(np.add.reduceat(mix(runs ^ np.uint64(0xA5A5A5A5)), start) + kinds)
    c2 = mix(np.add.reduceat(mix(runs ^ np.uint64(0x5A5A5A5A)), start))
    return c1.view(np.int64), c2.view(np.int64)


def mix_fast(x: np.ndarray, mult: np.uint64, add: np.uint64) -> np.ndarray:
    """One min-hash function over mixed hashes."""
    y = (x ^ add) * mult
    return y ^ (y >> np.uint64(32))


@dataclass
class Walked:
    """Counts of a walk: node pairs met, dropped over their budget, and leaf pairs kept."""

    nodes: int = 0
    pruned: int = 0
    leaves: int = 0


def trie_join(bits: np.ndarray, sizes: np.ndarray, threshold: float, other: tuple[np.ndarray, np.ndarray] | None = None, walked: Walked | None = None) -> np.ndarray:
    """Pairs of rows whose sketches differ by at most the budget of their sizes, by joining binary tries.

    ``bits`` are packed sketches, one row each; without ``other`` the trie is joined with itself (each pair once), else
    with the trie of ``other``'s rows. Returns positions, one pair a row.
    """
    left = _Trie(bits, sizes)
    right = left if other is None else _Trie(*other)
    if len(left.order) == 0 or len(right.order) == 0:
        return np.empty((0, 2), np.int64)
    return _walk(left, right, np.array([[0, len(left.order), 0, len(right.order), 0]], np.int64), threshold, walked)


def forest_join(bits: np.ndarray, sizes: np.ndarray, edges: np.ndarray, threshold: float, walked: Walked | None = None) -> np.ndarray:
    """As :func:`trie_join` of each run of rows between two ``edges`` with itself, all of them walked together.

    The runs are the subtrees of one trie below its label: their roots are the first node pairs.
    """
    trie = _Trie(bits, sizes, edges)
    a, b = edges[:-1], edges[1:]
    return _walk(trie, trie, np.stack([a, b, a, b, np.zeros_like(a)], 1).astype(np.int64), threshold, walked)


def _walk(left: _Trie, right: _Trie, pairs: np.ndarray, threshold: float, walked: Walked | None = None) -> np.ndarray:
    """Leaf pairs within budget below the given node pairs (two ranges and the bits that differ so far).

    A node is a range of sorted sketches that agree on the bits so far. All node pairs of a level are advanced at once:
    each splits at its next bit into up to four, the crossing ones gain one differing bit, and pairs over their budget
    are pruned. The compressed edges of two single leaves are followed to the end at once.
    """
    rate, same = (1 - threshold) / (1 + threshold), left is right
    found = []
    w = walked or Walked()
    for level in range(left.bits + 1):
        if same:  # a leaf has no pair with itself
            pairs = pairs[(pairs[:, 0] != pairs[:, 2]) | (pairs[:, 1] - pairs[:, 0] > 1)]
        budget = rate * (left.most(pairs[:, 0], pairs[:, 1]) + right.most(pairs[:, 2], pairs[:, 3])) + 1e-9
        within = pairs[:, 4] <= budget
        w.nodes += len(pairs)
        w.pruned += len(pairs) - int(within.sum())
        pairs = pairs[within]
        # At the last level the leaves of a node are equal.
        done = ((pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)) if level < left.bits else np.ones(len(pairs), bool)
        if done.any():
            found.append(_leaves(left, right, pairs[done], rate, same))
        pairs = pairs[~done]
        if not len(pairs):
            break
        la = left.split(level, pairs[:, 0], pairs[:, 1])
        rb = right.split(level, pairs[:, 2], pairs[:, 3])
        a0, a1, b0, b1, d = pairs.T
        zz = np.stack([a0, la, b0, rb, d], 1)
        oo = np.stack([la, a1, rb, b1, d], 1)
        zo = np.stack([a0, la, rb, b1, d + 1], 1)
        oz = np.stack([la, a1, b0, rb, d + 1], 1)
        if same:  # a node with itself has one crossing pair, not two
            oz = oz[a0 != b0]
        pairs = np.concatenate([zz, oo, zo, oz])
        pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])]
    out = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    w.leaves += len(out)
    return out


class _Trie:
    """Binary tries kept as the sorted order of their leaves: a node is a range, its children are cut by a prefix sum.

    With ``edges`` each run of rows between two of them is a trie of its own, all in one order.
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, edges: np.ndarray | None = None):
        self.bits = bits.shape[1] * 8
        wide = np.pad(np.ascontiguousarray(bits), ((0, 0), (0, -bits.shape[1] % 8))).view(">u8")
        cell = np.zeros(len(bits), np.int64) if edges is None else np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        self.order = np.lexsort((*wide.T[::-1], cell))
        self.rows = bits[self.order]
        self.sizes = sizes[self.order].astype(np.int64)
        table = [self.sizes]
        while (1 << len(table)) <= len(self.sizes):
            half = 1 << (len(table) - 1)
            table.append(np.maximum(table[-1][:-half], table[-1][half:]))
        self.table = table

    def most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Largest size in each range, by a sparse table."""
        level = np.frexp((b - a).astype(float))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            m = level == k
            t = self.table[k]
            out[m] = np.maximum(t[a[m]], t[b[m] - (1 << k)])
        return out

    def split(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the ones begin in each range, given that it agrees on all bits above ``level``."""
        ones = np.concatenate([[0], np.cumsum((self.rows[:, level >> 3] >> (7 - (level & 7))) & 1, dtype=np.int64)])
        return b - (ones[b] - ones[a])


def _leaves(left: _Trie, right: _Trie, ranges: np.ndarray, rate: float, same: bool) -> np.ndarray:
    wide, high = ranges[:, 1] - ranges[:, 0], ranges[:, 3] - ranges[:, 2]
    out = []
    for lo in range(0, len(ranges), 20_000):
        r, w, h = ranges[lo : lo + 20_000], wide[lo : lo + 20_000], high[lo : lo + 20_000]
        count = w * h
        base = np.repeat(np.arange(len(r)), count)
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        i, j = r[base, 0] + k // h[base], r[base, 2] + k % h[base]
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        differ = np.bitwise_count(left.rows[i] ^ right.rows[j]).sum(1, dtype=np.int64)
        ok = differ <= rate * (left.sizes[i] + right.sizes[j]) + 1e-9
        out.append(np.stack([left.order[i[ok]], right.order[j[ok]]], 1))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


PAIR = "a1 bigint, a2 bigint, b1 bigint, b2 bigint"


def candidates(sketch: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Pairs of classes that some trie of the forest keeps: ``kind, a1, a2, b1, b2``, each once, a before b.

    ``sketch`` is from :func:`sketches`; a class may have labels in several rows. Cells of one class vanish before any
    sketch is moved. A cell of more than ``block`` classes is cut into blocks, and the pairs of its blocks are joined in
    separate tasks, so no task holds more than two blocks of one cell; none of its pairs is skipped.
    """
    # Labels and class keys tell the kinds apart, so two numbers a row are all that is shuffled and sorted.
    members = sketch.where(F.col("labels").isNotNull()).select(F.explode("labels").alias("label"), "c1")
    w = W.partitionBy("label")
    several = members.withColumns({"low": F.min("c1").over(w), "high": F.max("c1").over(w)}).where(F.col("low") < F.col("high"))
    shared = cut(several.select("label", "c1").distinct())
    wanted = if_small(shared.select("c1").distinct(), MOST_SENT)
    classes = sketch.where(F.col("bits").isNotNull()).select("kind", "c1", "c2", "n", "bits").join(wanted, "c1", "left_semi").dropDuplicates(["c1", "c2"])
    shared = shared.withColumn("m", F.count(F.lit(1)).over(w))
    n_blocks = F.ceil(F.col("m") / block).cast("int")
    mine = F.pmod(F.xxhash64("c1", F.lit(3)), n_blocks).cast("int")
    # Block b is sent to every pair of blocks {b, x}; in a small cell that is the one pair (0, 0).
    routed = shared.withColumn("nb", n_blocks).withColumn("b", mine).select("label", "c1", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("x"))
    routed = routed.select("label", "c1", "b", F.least("b", "x").alias("lo"), F.greatest("b", "x").alias("hi"))
    loaded = routed.join(classes, "c1")
    unit = F.xxhash64("label", "lo", "hi").alias("unit")
    parts = loaded.select("kind", unit, "label", "lo", "hi", "b", "c1", "c2", "n", "bits").repartition("unit").sortWithinPartitions("unit", "label", "lo", "hi")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            last = batch.iloc[-1]
            tail = (batch["label"] == last["label"]) & (batch["lo"] == last["lo"]) & (batch["hi"] == last["hi"])
            held = batch[tail]
            if not tail.all():
                yield from _join_units(batch[~tail], threshold)
        if held is not None and len(held):
            yield from _join_units(held, threshold)

    found = parts.select("kind", "label", "lo", "hi", "b", "c1", "c2", "n", "bits").mapInPandas(join, "kind string, " + PAIR)
    return found.distinct()


def _join_units(batch: pd.DataFrame, threshold: float) -> Iterator[pd.DataFrame]:
    kind, c1, c2 = batch["kind"].to_numpy(), batch["c1"].to_numpy(), batch["c2"].to_numpy()
    n, b, lo, hi = (batch[x].to_numpy() for x in ("n", "b", "lo", "hi"))
    label = batch["label"].to_numpy()
    bits = np.frombuffer(b"".join(batch["bits"]), np.uint8).reshape(len(batch), -1)
    new = np.ones(len(batch), bool)
    new[1:] = (label[1:] != label[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    edges = np.append(np.flatnonzero(new), len(batch))
    whole = lo[edges[:-1]] == hi[edges[:-1]]
    # Subtrees joined with themselves are walked together; rows between them belong to pairs of blocks.
    keep = np.repeat(whole, np.diff(edges))
    inner = np.append(0, np.cumsum(np.diff(edges)[whole]))
    at = np.flatnonzero(keep)
    out = [at[forest_join(bits[keep], n[keep], inner, threshold)]] if len(at) else []
    for s, e in zip(edges[:-1][~whole], edges[1:][~whole], strict=True):
        left, right = s + np.flatnonzero(b[s:e] == lo[s]), s + np.flatnonzero(b[s:e] == hi[s])
        p = trie_join(bits[left], n[left], threshold, (bits[right], n[right]))
        p = np.stack([left[p[:, 0]], right[p[:, 1]]], 1)
        if len(p):
            out.append(p)
    if out:
        p = np.concatenate(out)
        i, j = p[:, 0], p[:, 1]
        swap = (c1[i] > c1[j]) | ((c1[i] == c1[j]) & (c2[i] > c2[j]))
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        keep = (c1[i] != c1[j]) | (c2[i] != c2[j])
        i, j = i[keep], j[keep]
        yield pd.DataFrame({"kind": kind[i], "a1": c1[i], "a2": c2[i], "b1": c1[j], "b2": c2[j]}).drop_duplicates()


class NearDuplicates:
    """Classes of equal texts and the links between similar ones, over ``records(kind, id, text)``.

    Only records of one kind are compared. ``membership``: ``kind, id, c1, c2``, the class of each record; ids with
    several texts are in several classes. ``links``: ``kind, a1, a2, b1, b2, similarity``, pairs of classes whose sets of
    ``k``-word runs have at least ``threshold`` of their union in common. Records with a null id or text, or under ``k``
    words, are in no class. Intermediate tables are written to the shared folder.
    """

    def __init__(self, records: DataFrame, k: int = 5, threshold: float = 0.8, tries: int = TRIES, minima: int = MINIMA, bits: int = BITS, block: int = BLOCK):
        spark = records.sparkSession
        self.at = f"{shared_dir(spark).rstrip('/')}/neardup-{uuid.uuid4().hex}"
        sketches(records, k, tries, minima, bits).write.parquet(f"{self.at}/sketches")
        sketch = spark.read.parquet(f"{self.at}/sketches")
        self.membership = sketch.select("kind", "id", "c1", "c2").distinct()
        candidates(sketch, threshold, block).write.parquet(f"{self.at}/candidates")
        pairs = spark.read.parquet(f"{self.at}/candidates")
        self.links = verified(pairs, sketch, records, k, threshold)


def verified(pairs: DataFrame, sketch: DataFrame, records: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs whose run sets are similar enough, with the similarity; sets are rebuilt from one record per class."""
    ends = pairs.select("kind", F.col("a1").alias("c1"), F.col("a2").alias("c2")).unionByName(pairs.select("kind", F.col("b1").alias("c1"), F.col("b2").alias("c2"))).distinct()
    chosen = sketch.select("kind", "id", "c1", "c2").join(ends, ["kind", "c1", "c2"]).groupBy("kind", "c1", "c2").agg(F.min("id").alias("id")).select("kind", "id").distinct()
    texts = records.select("kind", "id", "text").join(if_small(cut(chosen), MOST_SENT), ["kind", "id"])

    def runs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs, owner = distinct_runs(batch["text"], k)
            if not len(runs):
                continue
            start = np.flatnonzero(np.diff(owner, prepend=-1))
            kinds = batch["kind"].to_numpy()[owner[start]]
            c1, c2 = _class_key(runs, start, _kind_hash(kinds))
            yield pd.DataFrame({"kind": kinds, "c1": c1, "c2": c2, "runs": np.split(runs.view(np.int64), start[1:])})

    sets = texts.mapInPandas(runs_of, "kind string, c1 bigint, c2 bigint, runs array<bigint>").join(ends, ["kind", "c1", "c2"], "left_semi").dropDuplicates(["kind", "c1", "c2"])
    side = lambda x: sets.select("kind", F.col("c1").alias(f"{x}1"), F.col("c2").alias(f"{x}2"), F.col("runs").alias(f"{x}_runs"))
    both = F.size(F.array_intersect("a_runs", "b_runs"))
    similarity = both / (F.size("a_runs") + F.size("b_runs") - both)
    joined = pairs.join(side("a"), ["kind", "a1", "a2"]).join(side("b"), ["kind", "b1", "b2"])
    return joined.select("kind", "a1", "a2", "b1", "b2", similarity.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def id_pairs(found: NearDuplicates) -> DataFrame:
    """Every pair of different ids with similar or equal texts: ``kind, id_a, id_b``, the smaller id first."""
    m = found.membership
    a = m.select("kind", F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("id").alias("x"))
    b = m.select("kind", F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("id").alias("y"))
    across = found.links.drop("similarity").join(a, ["kind", "a1", "a2"]).join(b, ["kind", "b1", "b2"]).select("kind", "x", "y")
    inside = a.join(b.withColumnsRenamed({"b1": "a1", "b2": "a2"}), ["kind", "a1", "a2"]).where(F.col("x") < F.col("y")).select("kind", "x", "y")
    every = across.where(F.col("x") != F.col("y")).unionByName(inside)
    return every.select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def groups(found: NearDuplicates) -> DataFrame:
    """One row per record: ``kind, id, class_id, group_id, n_links``.

    Records of one class are equal in their runs; a group is a connected component of similar classes, named by its least
    class; ``n_links`` is the number of other classes the record's class is similar to. An id with several texts has a row
    for each of its classes.
    """
    name = lambda x: F.concat(F.hex(f"{x}1"), F.lit("-"), F.hex(f"{x}2"))
    link = cut(found.links.select("kind", F.concat("kind", F.lit("/"), name("a")).alias("a"), F.concat("kind", F.lit("/"), name("b")).alias("b")))
    ends = link.select(F.col("a").alias("node")).unionByName(link.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    root = components(link.select("a", "b"))
    m = found.membership.withColumn("node", F.concat("kind", F.lit("/"), F.hex("c1"), F.lit("-"), F.hex("c2")))
    j = m.join(root, "node", "left").join(ends, "node", "left")
    return j.select("kind", "id", F.col("node").alias("class_id"), F.coalesce("root", "node").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
