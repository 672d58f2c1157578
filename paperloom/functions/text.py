"""Text rules as column expressions; Arrow functions only where Catalyst has no equivalent."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content in either language.
STOPWORDS = (
    "the", "a", "an", "of", "and", "or", "to", "in", "on", "for", "is", "are", "was", "were", "be", "by", "with", "that", "this", "it", "as", "at", "from",
    "이", "그", "저", "것", "수", "등", "및", "를", "을", "은", "는", "에", "의",
)
TOKEN = "[a-z0-9]+|[가-힣]+"


def tokenize(c: Column) -> Column:
    """Content tokens, in order and with repeats: Latin and Hangul runs of two characters or more without stopwords."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def collapse(c: Column) -> Column:
    """Runs of white space to single blanks, trimmed; Unicode white space counts."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def evidence_key(c: Column) -> Column:
    """How evidence and chunk texts are compared."""
    return F.lower(collapse(c))


def triple_key(c: Column) -> Column:
    """How a part of a triple is compared: lower case, underscores as blanks."""
    return F.lower(collapse(F.translate(c, "_", " ")))


def clean_markdown(c: Column) -> Column:
    """Drop images, keep the text of links, at most one blank line, trimmed."""
    t = F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", "")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def clean_heading(c: Column) -> Column:
    return F.coalesce(F.nullif(collapse(F.regexp_replace(c, "[*`]", "")), F.lit("")), F.lit("Front Matter"))


#: Fixed value: what a heading of a reference list contains as whole words.
REFERENCE_HEADING = r"(?i)\b(references?|bibliography|works\s+cited|literature\s+cited)\b|참고문헌"


def is_references_heading(c: Column) -> Column:
    t = collapse(c)
    return (t != "") & (F.size(F.split(t, " ")) <= 4) & t.rlike(REFERENCE_HEADING)


#: Forms in which texts cite arXiv papers.
ARXIV_ID = r"(\d{4}\.\d{4,5}|[a-z-]+(?:\.[A-Za-z]{2})?/\d{7})(?:v\d+)?"
ARXIV_FORMS = (r"(?i)arxiv\s*:\s*" + ARXIV_ID, r"(?i)arxiv\.org/(?:abs|pdf|html)/" + ARXIV_ID)


def arxiv_ids(text: Column, own: Column) -> Column:
    """Distinct cited arXiv ids, sorted, without version and without the paper's own id (which may have a prefix)."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in ARXIV_FORMS])
    low = F.transform(found, lambda x: F.lower(x))
    me = F.coalesce(F.regexp_replace(F.lower(own), r"^arxiv:|v\d+$", ""), F.lit(""))
    return F.array_sort(F.array_distinct(F.filter(low, lambda x: x != me)))


def first_sentence(c: Column) -> Column:
    """Up to the first full stop and blank, trimmed, with one full stop; null for nothing."""
    t = F.trim(F.substring_index(c, ". ", 1))
    return F.when(t != "", F.concat(F.regexp_replace(t, r"\.+$", ""), F.lit(".")))


def first_sentences(c: Column, n: int) -> Column:
    """The first ``n`` sentences, each trimmed, with a blank between."""
    parts = F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return F.array_join(F.slice(parts, 1, n), " ")


def join_terms(terms: Column) -> Column:
    """"a, b and c"; "this topic" for none."""
    n = F.size(terms)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit("this topic")).when(n == 1, F.element_at(terms, 1)).otherwise(F.concat(F.array_join(F.slice(terms, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(terms, -1)))


def strip_feed_header(c: Column, marker: str = "Markdown Content:") -> Column:
    """What follows the marker line of a fetched body, or the body itself."""
    at = F.instr(c, marker)
    return F.trim(F.when(at > 0, F.substr(c, at + F.lit(len(marker)))).otherwise(c))


def body_problem(c: Column, status: Column, content_type: Column) -> Column:
    """Why a fetched body is unusable, or null."""
    body = strip_feed_header(c)
    head = F.lower(F.substring(F.ltrim(body), 1, 200))
    return (
        F.when(status >= 400, "status")
        .when(F.contains(F.lower(content_type), F.lit("html")), "content-type")
        .when(F.coalesce(F.length(body), F.lit(0)) < 500, "short")
        .when(head.startswith("<!doctype") | head.startswith("<html") | head.startswith("<?xml"), "markup")
    )


def _name_keys(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else " ".join(unicodedata.normalize("NFKC", n).casefold().split()))


def name_key(c: Column) -> Column:
    """Compatibility form, case folded, white space collapsed; Catalyst has neither normalisation, so Arrow batches it is."""
    return F.pandas_udf(_name_keys, "string")(c)
