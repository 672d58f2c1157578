"""Identifier rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of canonical paper ids.
PREFIXES = "arxiv|hf|ref"
BLANKS = r"^[\s ]+|[\s ]+$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, BLANKS, "")


def loose_paper_id(c: Column, strip_version: bool = True) -> Column:
    """The id up to blanks around it, case of the prefix, a left-out ``arxiv:`` and, if asked, a trailing version.

    Null and blank ids give null.
    """
    t = trimmed(c)
    prefix = F.regexp_extract(t, r"^([A-Za-z]+):", 1)
    bare = F.when(prefix == "", t).otherwise(F.regexp_replace(t, r"^[A-Za-z]+:\s*", ""))
    if strip_version:
        bare = F.regexp_replace(bare, r"(?<=[0-9])[vV][0-9]+$", "")
    return F.when(F.length(t) > 0, F.concat(F.when(prefix == "", F.lit("arxiv")).otherwise(F.lower(prefix)), F.lit(":"), bare))


def chunk_owner(c: Column) -> Column:
    """The paper part of a loosely written chunk id; null for null and blank ids."""
    return loose_paper_id(F.regexp_extract(c, r"(?s)^(.*?)(?::chunk:.*)?$", 1), strip_version=False)


def chunk_tail(c: Column) -> Column:
    """What follows the paper in a chunk id, ``<index>:<digest>``; null if the id names only a paper."""
    tail = F.regexp_extract(trimmed(c), r"(?s):chunk:(.*)$", 1)
    return F.when(F.length(tail) > 0, tail)


def paper_id(arxiv_id: Column, raw: Column) -> Column:
    """Canonical id of the indexer: prefixed ids stay, arXiv-shaped ids get `arxiv:`, all others `hf:`."""
    candidate = F.coalesce(F.nullif(arxiv_id, F.lit("")), raw)
    shaped = candidate.rlike(r"^(\d{4}\.\d{4,5}|[A-Za-z-]+(\.[A-Za-z-]+)?/\d{7})$")
    return F.when(raw.rlike(f"^({PREFIXES}):"), raw).when(shaped, F.concat(F.lit("arxiv:"), candidate)).otherwise(F.concat(F.lit("hf:"), raw))


def paper_id_with_default(raw: Column, prefix: str = "arxiv") -> Column:
    """Canonical id of the evaluation side: an unprefixed id gets the default prefix, an empty one stays empty."""
    return F.when((raw == "") | raw.rlike(f"(?i)^({PREFIXES}):"), raw).otherwise(F.concat(F.lit(prefix + ":"), raw))


def chunk_id(paper: Column, index: Column, text: Column) -> Column:
    return F.concat_ws(":", paper, F.lit("chunk"), index.cast("string"), F.substring(F.sha2(text, 256), 1, 8))


def author_id(paper: Column, order: Column, key: Column) -> Column:
    """Provisional id of one authorship; namesakes are never merged."""
    return F.concat(F.lit("author:provisional:"), F.substring(F.sha2(F.concat_ws("|", paper, order.cast("string"), key), 256), 1, 20))


def uuid5(name: Column, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """Name-based UUID (version 5) in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8))), -1, 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
