"""Readers of feeds, files and configuration at the edge of the tables."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
import warnings
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of papers, cases and chunks as the outside names them.
_PAPER = "id string, title string, summary string, authors array<struct<name string>>, ai_keywords array<string>, publishedAt string"
FEED = f"paper struct<{_PAPER}>, {_PAPER}"
CASE = (
    "case_id string, question string, paper_id string, gold_chunk_ids array<string>, gold_paper_ids array<string>, grades map<string,int>, expected_scope string, gold_answer string, must_include array<string>, "
    "gold_triples array<struct<subject string, predicate string, object string, chunk_id string, confidence double>>, tags array<string>, notes string"
)
CHUNK = "chunk_id string, paper_id string, text string, section string, chunk_index int, title string, is_references boolean, metadata map<string,string>"

#: Statuses that may pass.
RETRIED = frozenset({429, 500, 502, 503, 504})
#: Fixed value: how a response names its next page.
_NEXT_PAGE = re.compile(r"rel=\"?next\"?")


class FeedError(Exception):
    """A response that cannot be what was asked for."""


def get_json(url: str, open_url: Callable = urllib.request.urlopen, attempts: int = 3, wait: float = 1.0, sleep: Callable = time.sleep) -> Any:
    """A JSON body; transport errors and the statuses that may pass are tried again with doubled waits, others fail at once."""
    return get_page(url, open_url, attempts, wait, sleep)[0]


def get_page(url: str, open_url: Callable = urllib.request.urlopen, attempts: int = 3, wait: float = 1.0, sleep: Callable = time.sleep) -> tuple[Any, bool]:
    """As :func:`get_json`, with whether the response links to a next page. A body that is no JSON is a :class:`FeedError`."""
    for n in range(1, attempts + 1):
        try:
            with open_url(url) as r:
                body, link = r.read(), getattr(r, "headers", None) or {}
            try:
                return json.loads(body), _NEXT_PAGE.search(link.get("link") or link.get("Link") or "") is not None
            except ValueError as e:
                raise FeedError(f"no JSON from {url}: {e}") from e
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or n == attempts:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if n == attempts:
                raise
        sleep(wait * 2 ** (n - 1))
    raise AssertionError


def list_day(day: str, get: Callable[[str], tuple[Any, bool]], base: str, limit: int = 50, pages: int = 100) -> list[dict]:
    """All entries of one day's feed, page by page until one is empty or links to no next one; a short page is no end.

    ``get`` is :func:`get_page` or alike. A page that is no list is a :class:`FeedError`; at ``pages`` pages the rest is
    left with a warning.
    """
    out: list[dict] = []
    for p in range(pages):
        page, more = get(f"{base}?date={day}&p={p}&limit={limit}")
        if not isinstance(page, list):
            raise FeedError(f"the feed of {day} is no list but {type(page).__name__}")
        out += page
        if not page or not more:
            return out
    warnings.warn(f"the feed of {day} has more than {pages} pages", stacklevel=2)
    return out


def get_papers(wanted: DataFrame, get: Callable[[str], Any], base: str) -> DataFrame:
    """``day, position, body, error`` of single papers by ``wanted(paper_id)``, as :func:`feed_days` has them; ``day`` is null.

    ``get`` returns a JSON body. What is no object, and what cannot be had, is a row with its error.
    """

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for i, paper in enumerate(batch["paper_id"]):
                try:
                    body = get(f"{base}/{paper}")
                    if not isinstance(body, dict):
                        raise FeedError(f"the paper {paper} is no object")
                    rows.append((None, i, json.dumps(body), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, i, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["day", "position", "body", "error"]).astype({"position": "Int32"})

    return wanted.select("paper_id").distinct().mapInPandas(fetch, "day string, position int, body string, error string")


def feed_days(spark: SparkSession, first: str, last: str, get_day: Callable[[str], list[dict]]) -> DataFrame:
    """``day, position, body, error``: raw entries of each day from ``first`` to ``last``, one task per few days.

    A day that fails is a row with its error instead of a failed job. A first day after the last is an error.
    """
    if first > last:
        raise ValueError(f"first day {first} is after {last}")
    days = spark.sql("SELECT date_format(d, 'yyyy-MM-dd') AS day FROM (SELECT explode(sequence(to_date(:a), to_date(:b))) AS d)", args={"a": first, "b": last})

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for day in batch["day"]:
                try:
                    rows += [(day, i, json.dumps(x), None) for i, x in enumerate(get_day(day))]
                except Exception as e:  # noqa: BLE001
                    rows.append((day, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["day", "position", "body", "error"]).astype({"position": "Int32"})

    return days.mapInPandas(fetch, "day string, position int, body string, error string")


def flatten_feed(raw: DataFrame) -> DataFrame:
    """Feed entries, nested under `paper` or flat, as paper rows; entries without an id are dropped."""
    x = raw.select("day", "position", F.from_json("body", FEED).alias("f")).where(F.col("f").isNotNull())
    pick = lambda c: F.coalesce(F.nullif(F.col(f"f.paper.{c}"), F.lit("")), F.nullif(F.col(f"f.{c}"), F.lit("")))
    people = F.coalesce("f.paper.authors", "f.authors", F.array().cast("array<struct<name string>>"))
    pid = pick("id")
    shaped = pid.rlike(r"^\d{4}\.\d{4,5}$")
    return x.where(pid.isNotNull()).select(
        "day", "position", pid.alias("raw_id"), F.when(shaped, pid).alias("arxiv_id"), F.coalesce(pick("title"), F.lit("")).alias("title"), F.coalesce(pick("summary"), F.lit("")).alias("abstract"),
        F.transform(F.filter(people, lambda a: F.length(a["name"]) > 0), lambda a: a["name"]).alias("authors"), F.coalesce("f.paper.ai_keywords", "f.ai_keywords", F.array().cast("array<string>")).alias("keywords"),
        F.try_to_timestamp(pick("publishedAt")).alias("published_at"), F.when(shaped, F.concat(F.lit("https://arxiv.org/pdf/"), pid)).alias("pdf_url"),
    )


def read_envelope(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON file that is a list, JSON lines, an object with a list under data, rows, questions or examples, or
    one object. What is not an object is dropped; unknown keys are ignored."""
    text = spark.read.text(path, wholetext=True)
    kinds = ("data", "rows", "questions", "examples")
    held = F.from_json("value", ", ".join(f"{k} array<struct<{_ddl(schema)}>>" for k in kinds))
    listed = F.from_json("value", f"array<struct<{_ddl(schema)}>>")
    one = F.from_json("value", f"struct<{_ddl(schema)}>")
    t = F.regexp_replace("value", r"^\s+", "")
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda s: F.when(s.rlike(r"^\s*\{.*\}\s*$"), F.from_json(s, f"struct<{_ddl(schema)}>"))), lambda r: r.isNotNull())
    n_lines = F.size(F.filter(F.split("value", r"\r?\n"), lambda s: s.rlike(r"\S")))
    inner = F.coalesce(*[held[k] for k in kinds])
    rows = F.when(t.startswith("["), listed).when((n_lines > 1) & (F.size(lines) == n_lines), lines).otherwise(F.coalesce(inner, F.array(one)))
    return text.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")


def _ddl(schema: str) -> str:
    """A column list as the inside of a struct type."""
    return re.sub(r"(?<=[,<])\s*(\w+) (?=\w)", r"\1: ", re.sub(r"^(\w+) ", r"\1: ", schema)) if ":" not in schema else schema


def load_cases(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Evaluation cases from JSON lines; blank lines and lines that begin with // are skipped.

    A line that is no case, an empty file and a repeated case id are errors that name the line or id.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").where(~F.ltrim("value").startswith("//"))
    rows = lines.select("value", F.from_json("value", CASE + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = rows.where(F.col("r._bad").isNotNull() | F.col("r.case_id").isNull()).select("value").limit(1).collect()
    if bad:
        raise ValueError(f"no evaluation case: {bad[0]['value'][:200]}")
    cases = rows.select("r.*").drop("_bad")
    twice = cases.groupBy("case_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated case id: {twice[0]['case_id']}")
    if not cases.limit(1).count():
        raise ValueError(f"no cases in {path}")
    return cases.orderBy("case_id").limit(limit) if limit is not None else cases


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """``metric, mean`` of a baseline file, flat or under `aggregate`; a missing file is empty."""
    if not Path(path).exists():
        return spark.createDataFrame([], "metric string, mean double")
    body = json.loads(Path(path).read_text())
    rows = [(k, float(v)) for k, v in body.get("aggregate", body).items() if isinstance(v, int | float)]
    return spark.createDataFrame(rows, "metric string, mean double")


_VARIABLE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


def expand(value: Any, env: dict[str, str] | None = None) -> Any:
    """``${NAME}`` and ``${NAME:-default}`` in all strings of nested dicts and lists; an unset name without default is empty."""
    env = dict(os.environ) if env is None else env
    if isinstance(value, str):
        return _VARIABLE.sub(lambda m: env.get(m[1]) or (m[2] if m[2] is not None else ""), value)
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, env) for v in value]
    return value


def alias(*names: str) -> Column:
    """The first of several columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def read_pdfs(spark: SparkSession, path: str, convert: Callable[[bytes], str]) -> DataFrame:
    """``path, text, error`` of PDF files by a converter hook; what is no PDF or converts to nothing is an error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, body in zip(batch["path"], batch["content"], strict=True):
                try:
                    if not bytes(body).startswith(b"%PDF-"):
                        raise ValueError("not a PDF")
                    text = convert(bytes(body))
                    if not text.strip():
                        raise ValueError("no text")
                    rows.append((p, text, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string, error string")


def sse_events(lines: DataFrame) -> DataFrame:
    """The JSON payloads of `data:` lines of an event stream; the end mark and other lines are skipped."""
    body = F.trim(F.regexp_extract("value", r"^data:\s?(.*)$", 1))
    return lines.select(body.alias("data")).where((F.col("data") != "") & (F.col("data") != "[DONE]"))
