"""Exact radius joins of strings under a true edit metric, by rings around pivots and the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut

#: Members of a cell above which it is cut into blocks whose pairs are spread over tasks.
BLOCK = 2000
#: Pairs looked at in one go.
PAIRS = 1_000_000
#: Pivots at most, and the width of the rings around them in radii.
MOST_PIVOTS, RING = 7, 3
#: Bits of the hash by which letters are put into groups.
LETTERS = 12
ODD = (np.arange(1, 33, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
#: Pivots of one group each, by which pairs are filtered: 64 groups hold every letter once.
LETTER_GROUPS = (np.arange(1 << LETTERS)[:, None] % 64 == np.arange(64)).astype(np.uint8)


def codes(strings: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the strings in a matrix padded with 0, and their lengths."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    wide = max(int(size.max(initial=0)), 1)
    flat = np.frombuffer("".join(s.ljust(wide, "\0") for s in strings).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(strings), wide), size


def distances(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Damerau-Levenshtein distance of each ``a[i]`` and ``b[i]``.

    Insertions, deletions, substitutions and swaps of neighbours cost 1, and edits may follow between swapped characters,
    which makes this form, unlike the restricted one, a metric.
    """
    out = np.empty(len(a), np.int64)
    for lo in range(0, len(a), 20_000):
        out[lo : lo + 20_000] = _distances(a[lo : lo + 20_000], b[lo : lo + 20_000])
    return out


def _distances(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    x, nx = codes(a)
    y, ny = codes(b)
    alphabet, dense = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True)
    x, y = dense[: x.size].reshape(x.shape), dense[x.size :].reshape(y.shape)
    m, w, h = len(x), x.shape[1], y.shape[1]
    far = w + h + 2
    rows = np.arange(m)
    d = np.full((w + 2, h + 2, m), far, np.int32)
    d[1:, 1] = np.arange(w + 1)[:, None]
    d[1, 1:] = np.arange(h + 1)[:, None]
    last_row = np.zeros((len(alphabet), m), np.int32)  # last row in which a character was seen in x
    for i in range(1, w + 1):
        last_col = np.zeros(m, np.int64)  # last column of this row with an equal character
        for j in range(1, h + 1):
            k = last_row[y[:, j - 1], rows]
            same = x[:, i - 1] == y[:, j - 1]
            swap = d[k, last_col, rows] + (i - k - 1) + 1 + (j - last_col - 1)
            best = np.minimum(d[i, j] + ~same, np.minimum(d[i + 1, j], d[i, j + 1]) + 1)
            d[i + 1, j + 1] = np.minimum(best, swap)
            last_col[same] = j
        last_row[x[:, i - 1], rows] = i
    return d[nx + 1, ny + 1, rows]


def counts(strings: Sequence[str], groups: np.ndarray, every: bool = False) -> np.ndarray:
    """How many letters of each string are in each group; ``groups`` is a table of letter hash by group, or, with ``every``,
    group k of n holds the letters whose hash is k modulo n.

    The count is the distance of the string to the strings without a letter of the group, so the groups are pivots: by
    the triangle inequality the counts of two strings differ by at most their distance.
    """
    longest = max(map(len, strings), default=0)
    step = max(1, 4_000_000 // max(longest, 1))
    if len(strings) > step:
        return np.concatenate([counts(strings[k : k + step], groups, every) for k in range(0, len(strings), step)])
    x, size = codes(strings)
    mixed = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    letter = (mixed >> np.uint64(64 - LETTERS)).astype(np.int64)
    inside = np.arange(x.shape[1])[None] < size[:, None]
    if every:  # groups that hold each letter once: one place to count up
        out = np.zeros((len(strings), groups.shape[1]), np.int16)
        np.add.at(out, (np.nonzero(inside)[0], letter[inside] % groups.shape[1]), 1)
        return out
    member = groups[letter]
    member[~inside] = 0
    return member.sum(1, dtype=np.int64)


def pivot_groups(n: int, seed: int = 5) -> np.ndarray:
    """Letter hash by group: all letters, then halves drawn at random. Groups steer only how cells are cut; any choice gives
    the same join."""
    g = np.random.default_rng(seed).random((1 << LETTERS, max(n, 1))) < 0.5
    g[:, 0] = True
    return g.astype(np.uint8)


def radius_join(strings: DataFrame, radius: int = 1, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """All pairs ``a < b`` of distinct values of ``strings(key)`` within ``radius`` edits: ``a, b, distance``.

    Pivots are sets of strings, those without letters of a group: the distance to one is a count of letters, exact and
    without dynamic programming. Rings of ``RING * radius`` around each pivot cut the space into cells. A key within the
    radius of the next ring is also put there, so two keys within the radius meet in the cell of the higher of their
    rings around each pivot, and nowhere else is their pair looked at. Inside a cell the distances to many pivots must
    agree up to the radius before the metric is computed. The number of pivots grows with the logarithm of the keys up to
    ``MOST_PIVOTS``, where a key has (1 + 1 / RING) ** MOST_PIVOTS = 7.5 copies in the mean. Cells of more than ``block``
    keys are cut into blocks joined pair by pair. Null keys are dropped; the empty string is a key.
    """
    spark = strings.sparkSession
    keys = cut(strings.select("key").where(F.col("key").isNotNull()).distinct())
    size = keys.count()
    n = pivots or int(min(max(np.ceil(np.log2(max(size, 1) / 100)), 1), MOST_PIVOTS))
    # Few bytes but much work: tasks by number of keys, which the adaptive planner would merge by size.
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // 1000)))
    groups, wide = pivot_groups(n), RING * radius

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 5000):
                ks = batch["key"].iloc[lo : lo + 5000].tolist()
                f = counts(ks, groups) + np.arange(n) % wide
                ring, near = f // wide, f % wide >= wide - radius
                at, moved = np.arange(len(ks)), np.zeros(len(ks), np.int32)
                for j in range(n):
                    up = near[at, j]
                    at, moved = np.concatenate([at, at[up]]), np.concatenate([moved, moved[up] | (1 << j)])
                cell = ring[at] + ((moved[:, None] >> np.arange(n)) & 1)
                unit = (cell.astype(np.uint64) * ODD[:n]).sum(1, dtype=np.uint64).view(np.int64)
                yield pd.DataFrame({"cell": unit, "moved": moved, "key": [ks[k] for k in at]})

    placed = keys.repartition(tasks, F.xxhash64("key")).mapInPandas(place, "cell bigint, moved int, key string")
    several = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("cell", F.ceil(F.col("n") / block).cast("int").alias("nb"))
    mine = F.pmod(F.xxhash64("key"), F.col("nb")).cast("int")
    routed = placed.join(several, "cell").withColumn("b", mine).select("cell", "moved", "key", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("x"))
    unit = ["cell", "lo", "hi"]
    parts = routed.select("cell", F.least("b", "x").alias("lo"), F.greatest("b", "x").alias("hi"), "b", "moved", "key").repartition(tasks, *unit).sortWithinPartitions(*unit, "b")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            last = batch.iloc[-1]
            tail = (batch["cell"] == last["cell"]) & (batch["lo"] == last["lo"]) & (batch["hi"] == last["hi"])
            held = batch[tail]
            if not tail.all():
                yield from _cells(batch[~tail], radius)
        if held is not None and len(held):
            yield from _cells(held, radius)

    return parts.mapInPandas(join, "a string, b string, distance int").distinct()


def copies(strings: DataFrame, radius: int = 1, pivots: int = 7) -> float:
    """Mean number of cells a key is put into."""
    groups, wide = pivot_groups(pivots), RING * radius
    ks = [r["key"] for r in strings.select("key").where(F.col("key").isNotNull()).distinct().toLocalIterator()]
    near = (counts(ks, groups) + np.arange(pivots) % wide) % wide >= wide - radius
    return float((2.0 ** near.sum(1)).mean()) if ks else 0.0


def _cells(batch: pd.DataFrame, radius: int) -> Iterator[pd.DataFrame]:
    """Pairs within the radius in each of the whole cells (or pairs of blocks) of a sorted batch, all cells at once."""
    keys, b, moved = batch["key"].to_numpy(), batch["b"].to_numpy(), batch["moved"].to_numpy()
    lo, hi, cell = batch["lo"].to_numpy(), batch["hi"].to_numpy(), batch["cell"].to_numpy()
    new = np.ones(len(batch), bool)
    new[1:] = (cell[1:] != cell[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    start = np.flatnonzero(new)
    size = np.diff(start, append=len(batch))
    one = lo[start] == hi[start]
    # Rows of the lower block come first; a block with itself has all of its rows on both sides.
    low = np.where(one, size, np.add.reduceat((b == lo).astype(np.int64), start) if len(start) else size)
    right, high = np.where(one, start, start + low), np.where(one, size, size - low)
    v = counts(keys.tolist(), LETTER_GROUPS, every=True)
    mask = ((v > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)
    # Left rows one by one, each with all right rows of its cell.
    l = np.concatenate([np.arange(s, s + n) for s, n in zip(start, low, strict=True)]) if len(start) else start
    first, n = np.repeat(right, low), np.repeat(high, low)
    first = np.where(np.repeat(one, low), np.maximum(first, l + 1), first)
    n = np.where(np.repeat(one, low), np.repeat(start + size, low) - first, n)
    done = np.append(0, np.cumsum(n))
    at = 0
    while at < len(l):
        to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, "right")) - 1)
        k = n[at:to]
        i = np.repeat(l[at:to], k)
        j = np.arange(done[to] - done[at]) - np.repeat(done[at:to] - done[at], k) + np.repeat(first[at:to], k)
        at = to
        # A pair belongs to this cell if no pivot moved both of its keys; an edit touches at most two letters.
        ok = ((moved[i] & moved[j]) == 0) & (np.bitwise_count(mask[i] ^ mask[j]) <= 2 * radius)
        i, j = i[ok], j[ok]
        ok = (np.abs(v[i] - v[j]) <= radius).all(1)
        i, j = i[ok], j[ok]
        if len(i):
            x, y = keys[i].tolist(), keys[j].tolist()
            d = distances(x, y)
            pairs = [(min(p, q), max(p, q), int(e)) for p, q, e in zip(x, y, d, strict=True) if 0 < e <= radius]
            if pairs:
                yield pd.DataFrame(pairs, columns=["a", "b", "distance"]).drop_duplicates()
