"""Word runs of many texts at once, as 64-bit hashes in NumPy."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import xxhash

WORD = re.compile(r"[a-z0-9]+")
_MOST_WORDS = 1_000_000


class _Words(dict):
    """word -> 64-bit hash; emptied when it has grown too large, which changes no result."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _MOST_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the one of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def word_runs(texts: Iterable[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and the number of the text each belongs to, in order.

    Words are the runs of ``[a-z0-9]`` in the lower-cased text. Null texts and texts under ``k`` words have no runs.
    """
    hashes: list[int] = []
    lengths = []
    for t in texts:
        words = WORD.findall(t.lower()) if t else ()
        lengths.append(len(words))
        hashes.extend(map(_WORDS.__getitem__, words))
    w = np.fromiter(hashes, np.uint64, len(hashes))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    runs = np.zeros(n, np.uint64)
    for i, a in enumerate(constants(k, 7)):
        runs += w[i : n + i] * a
    whole = owner[:n] == owner[k - 1 :]
    return mix(runs[whole]), owner[:n][whole]


def distinct_runs(texts: Iterable[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`word_runs`, each run once per text, ordered by text and hash."""
    runs, owner = word_runs(texts, k)
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    return runs[first], owner[first]
