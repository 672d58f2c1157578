"""Dense vectors as arrays, and the deterministic hash embedding."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[\w-]+")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


class TermHashing:
    """Unit vectors of texts by signed feature hashing: no model, no state, the same everywhere.

    A word adds the square root of how often it occurs to the coordinate its hash names, with the sign of another bit.
    Words are runs of letters, digits, underscores and hyphens, case folded. Texts without words are the zero vector. Links
    between such vectors count from ``link_threshold`` on.
    """

    provider, model, version, link_threshold = "hashing", "xxh3-sqrt", "1", 0.12

    def __init__(self, dimensions: int = 256):
        if dimensions < 1:
            raise ValueError("a vector has at least one dimension")
        self.dimensions = dimensions

    def signature(self) -> dict[str, object]:
        """What stored vectors are labelled with, as in the payload of a point."""
        return {"embedding_provider": self.provider, "embedding_model": self.model, "embedding_dimension": self.dimensions, "embedding_version": self.version}

    def matrix(self, texts: Sequence[str | None]) -> np.ndarray:
        """All texts of a batch at once, one row each."""
        out = np.zeros((len(texts), self.dimensions))
        words = [_WORD.findall(t.casefold()) if t else [] for t in texts]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64)
        row = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
        if len(hashes):
            order = np.lexsort((hashes, row))
            hashes, row = hashes[order], row[order]
            first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])))
            weight = np.sqrt(np.diff(first, append=len(hashes)))
            h = hashes[first]
            sign = np.where(h >> np.uint64(63), -1.0, 1.0)
            np.add.at(out, (row[first], (h % np.uint64(self.dimensions)).astype(np.int64)), sign * weight)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)

    def embed(self, text: str | None) -> list[float]:
        return self.matrix([text])[0].tolist()

    def udf(self):
        matrix = self.matrix

        @F.pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series(list(matrix(texts.tolist()).astype(np.float32)), index=texts.index)

        return run


#: Embedders by provider; anything with ``dimensions``, ``signature`` and ``udf`` can be added.
EMBEDDERS = {TermHashing.provider: TermHashing}
