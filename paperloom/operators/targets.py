"""Systems under test, and the runner that scores their answers.

A target turns a table of cases into a table of responses; every metric is then computed in one plan over all cases.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import first_sentence
from paperloom.operators import lexical, metrics, records, similarity
from paperloom.operators.lexical import if_small
from paperloom.session import cut

TRIPLE = "struct<subject string, predicate string, object string, chunk_id string, confidence double>"
RESPONSE = f"case_id string, ranked array<string>, papers array<string>, evidence array<string>, answer string, citations array<string>, scope string, triples array<{TRIPLE}>, latency_ms double, error string"
SUITES = ("retrieval", "generation", "extraction", "full")
#: Citations of a response, and hits whose first sentences make its answer.
CITATIONS, SENTENCES = 3, 2


class Target(Protocol):
    """Anything with a name that answers ``cases(case_id, question, paper_id)`` with rows of ``RESPONSE``."""

    name: str

    def respond(self, cases: DataFrame) -> DataFrame: ...


def assembled(cases: DataFrame, hits: DataFrame, scopes: DataFrame, triples: DataFrame | None = None) -> DataFrame:
    """Responses from ``hits(case_id, rank, chunk_id, paper_id, text)``, a short list per case, and ``scopes(case_id, scope)``.

    The answer is made of the first sentences of the best hits, the citations are the first ids, the triples those stored
    with the cited chunks. Cases without hits have an empty answer and no ranks.
    """
    per = hits.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "paper_id", "text"))).alias("h"))  # a short list
    ids = F.transform("h", lambda x: x["chunk_id"])
    said = F.array_compact(F.transform(F.slice("h", 1, SENTENCES), lambda x: first_sentence(x["text"])))
    j = cases.select("case_id").join(per, "case_id", "left").join(scopes.select("case_id", "scope"), "case_id", "left")
    out = j.select(
        "case_id", ids.alias("ranked"), F.transform("h", lambda x: x["paper_id"]).alias("papers"), F.transform("h", lambda x: x["text"]).alias("evidence"),
        F.coalesce(F.array_join(said, " "), F.lit("")).alias("answer"), F.slice(ids, 1, CITATIONS).alias("citations"), F.coalesce("scope", F.lit("unknown")).alias("scope"),
    )
    if triples is None:
        held = out.withColumn("triples", F.lit(None).cast(f"array<{TRIPLE}>"))
    else:
        found = records.recover_triples(out, triples, CITATIONS)
        listed = found.groupBy("case_id").agg(F.collect_list(F.struct("subject", "predicate", "object", "chunk_id", "confidence")).alias("triples"))  # of three chunks
        held = out.join(listed, "case_id", "left")
    return held.withColumns({"latency_ms": F.lit(None).cast("double"), "error": F.lit(None).cast("string")})


class LexicalTarget:
    """BM25 with routing to the case's own paper over ``docs(doc_id, paper_id, text)``; see :mod:`lexical` for ``live``.

    ``order`` is a column of ``docs`` that tells a document's place in the corpus, by which equal scores are ordered;
    without it that is the id.
    """

    name = "lexical"

    def __init__(self, docs: DataFrame, live: DataFrame | None = None, triples: DataFrame | None = None, top_k: int = lexical.TOP_K, threshold: float = lexical.ROUTE, order: str | None = None):
        self.docs, self.live, self.triples, self.top_k, self.threshold, self.order = docs, live, triples, top_k, threshold, order

    def respond(self, cases: DataFrame) -> DataFrame:
        q = cases.select(F.col("case_id").alias("query_id"), F.col("question").alias("text"), "paper_id")
        held = self.docs if self.live is None else self.live
        scores = cut(lexical.bm25_best(q, self.docs, self.live, max(1, self.top_k), self.order or "doc_id"))
        routes = lexical.route(scores, held, q, self.threshold)
        hits = cut(lexical.routed_hits(scores, held, q, routes, self.top_k, self.order))
        key = ["doc_id"] if self.live is None else ["doc_id", "version"]
        wanted = hits if self.live is None else cut(held.select(*key).join(if_small(hits), "doc_id"))
        text = self.docs.select(*key, "paper_id", "text").join(if_small(wanted), key).dropDuplicates(["query_id", "doc_id"])
        named = text.select(F.col("query_id").alias("case_id"), "rank", F.col("doc_id").alias("chunk_id"), "paper_id", "text")
        return assembled(cases, named, routes.select(F.col("query_id").alias("case_id"), "scope"), self.triples)


class HybridTarget:
    """Vector search joined with citation expansion, over ``points(id, embedding, grp, is_global)`` whose groups are papers.

    ``near(grp, related)`` are the papers next to each other, ``texts(id, text)`` the chunks, ``embed`` gives the vector of
    a question.
    """

    name = "hybrid"

    def __init__(self, points: DataFrame, near: DataFrame, texts: DataFrame, embed: Callable[[Column], Column], triples: DataFrame | None = None, top_k: int = 10, threshold: float = lexical.ROUTE):
        self.points, self.near, self.texts, self.embed, self.triples, self.top_k, self.threshold = points, near, texts, embed, triples, top_k, threshold

    def respond(self, cases: DataFrame) -> DataFrame:
        q = cut(cases.select(F.col("case_id").alias("query_id"), self.embed(F.coalesce("question", F.lit(""))).alias("embedding"), F.col("paper_id").alias("grp")))
        hits = cut(similarity.hybrid(q, self.points, self.near, self.top_k, self.threshold))
        named = self.texts.select("id", "text").join(if_small(hits.select("query_id", "id", "rank", "grp")), "id").select(F.col("query_id").alias("case_id"), "rank", F.col("id").alias("chunk_id"), F.col("grp").alias("paper_id"), "text")
        return assembled(cases, named, hits.select(F.col("query_id").alias("case_id"), "scope").distinct(), self.triples)


class RemoteTarget:
    """A service that is asked case by case; a failure is a response with an error.

    ``ask(question, paper_id)`` returns status and body of the answer; what it raises, statuses from 400 and bodies that
    are no JSON object become errors, with the time they took. Tasks ask for the cases of their own partition.
    """

    name = "remote"

    def __init__(self, ask: Callable[[str, str | None], tuple[int, str]], parallel: int = 4):
        self.ask, self.parallel = ask, parallel

    def respond(self, cases: DataFrame) -> DataFrame:
        ask = self.ask

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for case, question, paper in zip(batch["case_id"], batch["question"], batch["paper_id"], strict=True):
                    began, body, error = time.perf_counter(), None, None
                    try:
                        status, body = ask(question, paper)
                        if status >= 400:
                            body, error = None, f"http_{status}: {str(body)[:200]}"
                        elif not isinstance(json.loads(body), dict):
                            body, error = None, "invalid_json: not an object"
                    except ValueError as e:
                        body, error = None, f"invalid_json: {e}"
                    except Exception as e:  # noqa: BLE001
                        body, error = None, f"transport_error: {e}"
                    rows.append((case, body, round((time.perf_counter() - began) * 1000, 3), error))
                yield pd.DataFrame(rows, columns=["case_id", "body", "latency_ms", "error"])

        raw = cases.select("case_id", "question", "paper_id").repartition(self.parallel).mapInPandas(run, "case_id string, body string, latency_ms double, error string")
        return project_responses(cut(raw))


def project_responses(raw: DataFrame) -> DataFrame:
    """Rows of ``RESPONSE`` from ``raw(case_id, body, latency_ms, error)`` with JSON bodies.

    Names may be in camel or in snake case, citations texts or objects; empty citations are dropped. Retrieved items are
    in the order of their ranks if all have one; the evidence stays in the order of the body.
    """
    item = "struct<chunkId string, chunk_id string, paperId string, paper_id string, text string, rank int>"
    triple = "struct<subject string, predicate string, object string, chunkId string, chunk_id string, confidence double>"
    b = F.from_json("body", f"answer string, scope string, citations array<string>, retrieved array<{item}>, triples array<{triple}>")
    two = lambda x, a, c: F.coalesce(F.nullif(x[a], F.lit("")), x[c])
    empty = F.array().cast(f"array<{item}>")
    items = F.transform(F.coalesce("b.retrieved", empty), lambda x: F.struct(two(x, "chunkId", "chunk_id").alias("chunk_id"), two(x, "paperId", "paper_id").alias("paper_id"), x["text"].alias("text"), x["rank"].alias("rank")))
    cited = F.transform(F.coalesce("b.citations", F.array().cast("array<string>")), lambda c: F.when(F.startswith(F.ltrim(c), F.lit("{")), F.coalesce(F.nullif(F.get_json_object(c, "$.chunkId"), F.lit("")), F.get_json_object(c, "$.chunk_id"))).otherwise(c))
    named = F.transform("b.triples", lambda t: F.struct(t["subject"].alias("subject"), t["predicate"].alias("predicate"), t["object"].alias("object"), two(t, "chunkId", "chunk_id").alias("chunk_id"), t["confidence"].alias("confidence")))
    x = raw.withColumn("b", b).withColumn("items", items)
    return x.select(
        "case_id", F.when(F.col("error").isNull(), metrics.resolve_ranks(F.col("items"))).alias("ranked"), F.transform("items", lambda i: i["paper_id"]).alias("papers"), F.transform("items", lambda i: i["text"]).alias("evidence"),
        F.coalesce("b.answer", F.lit("")).alias("answer"), F.filter(cited, lambda c: F.length(c) > 0).alias("citations"), F.coalesce("b.scope", F.lit("unknown")).alias("scope"), named.cast(f"array<{TRIPLE}>").alias("triples"), "latency_ms", "error",
    )


#: Kinds of targets by name; each makes one from options. The names configurations use.
TARGETS: dict[str, Callable[..., Target]] = {
    "lexical": LexicalTarget, "lexical_baseline": LexicalTarget, "mock": LexicalTarget, "hybrid": HybridTarget, "graphrag_hybrid": HybridTarget, "remote": RemoteTarget, "http": RemoteTarget, "http_backend": RemoteTarget,
}


def build_target(spec: Mapping[str, Any]) -> Target:
    """The target of ``{"type": ..., "options": {...}}``; without a type the lexical one."""
    kind = spec.get("type", "lexical")
    if kind not in TARGETS:
        raise ValueError(f"unknown target: {kind}")
    return TARGETS[kind](**(spec.get("options") or {}))


class HookJudge:
    """A judge of answers outside of Spark, asked case by case.

    ``ask(question, evidence, answer)`` returns numbers by name, which become metrics ``judge.<name>``; other values are
    left out. Blank answers score 0 without being asked about. If asking fails, faithfulness and relevance do not apply and
    ``judge.error`` is 1. The evidence is cut to ``most_evidence`` characters, which is what the judge is given to read.
    """

    def __init__(self, name: str, ask: Callable[[str, str, str], Mapping[str, Any]], most_evidence: int = 6000, parallel: int = 4):
        self.name, self.ask, self.most_evidence, self.parallel = name, ask, most_evidence, parallel

    def score(self, told: DataFrame) -> DataFrame:
        ask = self.ask

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows: list[tuple] = []
                for case, question, evidence, answer in zip(batch["case_id"], batch["question"], batch["evidence"], batch["answer"], strict=True):
                    if not (answer or "").strip():
                        rows += [(case, "judge.faithfulness", 0.0), (case, "judge.relevance", 0.0)]
                        continue
                    try:
                        said = {k: float(v) for k, v in ask(question, evidence, answer).items() if isinstance(v, int | float) and not isinstance(v, bool)}
                        rows += [(case, f"judge.{k}", v) for k, v in said.items() if v == v]
                    except Exception:  # noqa: BLE001
                        rows.append((case, "judge.error", 1.0))
                yield pd.DataFrame(rows, columns=["case_id", "metric", "value"])

        text = F.array_join(F.filter(F.coalesce("evidence", F.array().cast("array<string>")), lambda x: F.length(x) > 0), "\n")
        asked = told.select("case_id", "question", F.substring(text, 1, self.most_evidence).alias("evidence"), "answer")
        return cut(asked.repartition(self.parallel).mapInPandas(run, "case_id string, metric string, value double"))


@dataclass
class Run:
    """What a suite came to: long metric rows of the cases without error, and the responses."""

    suite: str
    target: str
    values: DataFrame
    responses: DataFrame
    manifest: dict[str, object] = field(default_factory=dict)

    def aggregate(self) -> DataFrame:
        """Means of the metrics and the operational figures as ``metric, mean``."""
        ops = metrics.operational(self.responses.select("latency_ms", "error")).select(F.concat(F.lit("operational."), "measure").alias("metric"), F.col("value").alias("mean"))
        return metrics.macro_mean(self.values).select("metric", "mean").unionByName(ops)


def run_suite(target: Target, cases: DataFrame, suite: str = "full", ks: tuple[int, ...] = metrics.KS, limit: int | None = None, manifest: Mapping[str, object] | None = None, judge: HookJudge | None = None) -> Run:
    """Answer all ``cases`` (or the first ``limit`` by id) and score the answers.

    ``retrieval`` scores ranks and routing, ``generation`` answers and citations, ``extraction`` triples, ``full`` all.
    Cases with an error have no values and count for the error rate alone. A ``judge`` takes the place of the heuristic one
    where answers are scored.
    """
    if suite not in SUITES:
        raise ValueError(f"suite must be one of {SUITES}: {suite}")
    asked = cases if limit is None else cases.orderBy("case_id").limit(limit)
    responses = cut(target.respond(asked))
    told = asked.join(responses.where(F.col("error").isNull()), "case_id")
    values = score(told, suite, ks)
    judged = suite in ("generation", "full")
    if judge is not None and judged:
        values = values.where(~F.col("metric").startswith("judge.")).unionByName(judge.score(told))
    named = (judge.name if judge else "heuristic") if judged else None
    return Run(suite, target.name, values, responses, dict(manifest or {}) | {"suite": suite, "target": target.name, "judge": named})


def score(told: DataFrame, suite: str = "full", ks: tuple[int, ...] = metrics.KS) -> DataFrame:
    """Metric rows of cases joined with their responses."""
    parts = []
    if suite in ("retrieval", "full"):
        parts.append(metrics.retrieval_metrics(told, ks))
    if suite in ("generation", "full"):
        parts.append(metrics.generation_metrics(told))
    if suite in ("extraction", "full"):
        rows = lambda c: told.select("case_id", F.inline(F.transform(F.coalesce(c, F.array().cast(f"array<{TRIPLE}>")), lambda t: F.struct(t["subject"].alias("subject"), t["predicate"].alias("predicate"), t["object"].alias("object"), t["chunk_id"].alias("chunk_id")))))
        parts.append(metrics.triple_metrics(rows("triples"), rows("gold_triples")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
