"""Splitting oversized sections at natural boundaries, by balanced targets."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.chunking import sections

LIMIT, OVERLAP = 1200, 150

#: Boundaries from strong to weak; a cut falls after the match.
_BOUNDARIES = (
    (6, re.compile(r"\n[ \t]*\n\s*")),
    (5, re.compile(r"\n")),
    (4, re.compile(r"[.!?。][\"')\]]*\s+")),
    (3, re.compile(r"[;:]\s+")),
    (2, re.compile(r",\s+")),
    (1, re.compile(r"\s+")),
)

PIECES = "paper_id string, section string, section_index int, section_chars int, n_pieces int, piece_index int, chunk_index int, start int, n_chars int, overlap int, text string"


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Positions after which the text may be cut, ascending, and the strength of each."""
    best: dict[int, int] = {}
    for strength, pattern in _BOUNDARIES:
        for m in pattern.finditer(text):
            best.setdefault(m.end(), strength)
    at = sorted(best)
    return at, [best[p] for p in at]


def split_balanced(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces ``(start, end)`` of at most ``limit`` characters that cover ``text``, each starting in the one before.

    The fewest pieces that could do get targets of equal length; each target is moved to the strongest boundary near it
    (nearest among equals), and the next piece starts at a boundary at most ``overlap`` characters before that cut. If a
    piece then breaks the limit, one piece is added and all targets are placed anew. A run without any boundary is cut
    at its target. A text within the limit is one piece, an empty one has none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    at, strength = boundaries(text)
    n = -(-(len(text) - overlap) // (limit - overlap))
    while True:
        pieces = _place(text, at, strength, n, limit, overlap)
        if pieces:
            return pieces
        n += 1


def _place(text: str, at: list[int], strength: list[int], n: int, limit: int, overlap: int) -> list[tuple[int, int]] | None:
    size = len(text)
    pieces, start, cut = [], 0, 0
    for i in range(1, n):
        left = n - i + 1  # pieces still to place, this one included
        length = (size - start + (left - 1) * overlap) / left
        target = start + int(length)
        reach = max(int(length) // 4, 1)
        low = max(cut + 1, start + overlap + 1, target - reach)
        high = min(target + reach, start + limit, size - 1)
        if low > high:
            return None
        a, b = bisect_left(at, low), bisect_right(at, high)
        near = max(range(a, b), key=lambda k: (strength[k], -abs(at[k] - target)), default=None)
        cut = min(max(target, low), high) if near is None else at[near]
        pieces.append((start, cut))
        a, b = bisect_left(at, max(cut - overlap, start + 1)), bisect_left(at, cut)
        back = max(range(a, b), key=lambda k: (min(strength[k], 4), -at[k]), default=None)
        start = at[back] if back is not None else max(cut - overlap, start + 1) if near is None else cut
    pieces.append((start, size))
    return pieces if all(e - s <= limit for s, e in pieces) else None


def split_sections(papers: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every section of ``papers(paper_id, text)``, with a running ``chunk_index`` per text.

    ``section_index`` counts the sections with a body from 0, ``section_chars`` is the length of the trimmed body,
    ``start`` and ``overlap`` tell where a piece lies in it and how much it repeats of the one before. Repeated rows
    give repeated pieces; several texts of one paper are split one by one. Null and blank texts give none.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for paper_id, text in zip(batch["paper_id"], batch["text"], strict=True):
                index = 0
                for k, (title, _, body) in enumerate(sections(text)):
                    spans, before = split_balanced(body, limit, overlap), 0
                    for i, (s, e) in enumerate(spans):
                        out.append((paper_id, title, k, len(body), len(spans), i, index, s, e - s, max(before - s, 0), body[s:e]))
                        index, before = index + 1, e
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

    return papers.select("paper_id", "text").where(F.col("text").isNotNull()).mapInPandas(pieces, PIECES)


def oversized(pieces: DataFrame) -> DataFrame:
    """Sections that needed a cut, from the pieces."""
    return pieces.where(F.col("n_pieces") > 1).select("paper_id", "section_index").distinct()
