"""Reports of runs and the bookkeeping of loads."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import metrics as M


#: Metrics shown first, where a run has them.
HEADLINE = ("recall@5", "mrr", "ndcg@10", "routing.accuracy", "groundedness_lexical", "answer_token_f1", "citation_validity", "triple_f1")


def digest(value: object) -> str:
    """Short digest of a configuration or of a file's bytes."""
    body = value if isinstance(value, bytes) else json.dumps(value, sort_keys=True, ensure_ascii=False).encode()
    return hashlib.sha256(body).hexdigest()[:16]


def load_outcomes(attempted: DataFrame, graph_ok: DataFrame, vector_ok: DataFrame) -> DataFrame:
    """``paper_id, ok, stage, error`` of a load: both stores must have the paper, and vectors are written after the graph.

    ``attempted(paper_id, error, stage)`` has an error where a paper failed before any store; the others are outcomes of
    the writes. A paper the graph does not have counts as failed there, whatever the vectors.
    """
    j = attempted.join(graph_ok.select("paper_id").distinct().withColumn("g", F.lit(True)), "paper_id", "left").join(vector_ok.select("paper_id").distinct().withColumn("v", F.lit(True)), "paper_id", "left")
    stage = F.when(F.col("error").isNotNull(), F.col("stage")).when(F.col("g").isNull(), "graph").when(F.col("v").isNull(), "vector")
    return j.select("paper_id", stage.isNull().alias("ok"), stage.alias("stage"), F.when(stage.isNotNull(), F.coalesce("error", F.concat(F.lit("not written: "), stage))).alias("error"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """One row: papers, successes, failures, and whether all failed."""
    a = outcomes.agg(F.count(F.lit(1)).alias("n_papers"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))
    return a.withColumn("all_failed", (F.col("n_papers") > 0) & (F.col("n_ok") == 0))


def render(run: Mapping[str, object], values: DataFrame, tags: DataFrame, rules: DataFrame, baseline: DataFrame, primary: str = "recall@5", n_worst: int = 5, failures: DataFrame | None = None, headline: Sequence[str] = HEADLINE) -> str:
    """The Markdown report of a run: gates first, the headline, all metrics with their change, tags, failures, worst cases.

    ``values`` are long metric rows, ``tags(case_id, tag)``, ``rules`` and ``baseline`` as for the gates,
    ``failures(case_id, error)`` the responses. Only aggregates, the first failures and the worst cases reach the driver.
    """
    agg = M.macro_mean(values)
    gates = M.gates(rules, agg, baseline).orderBy("metric").collect()
    lines = [f"# Run {run.get('run_id', '')}", "", *[f"- {k}: {v}" for k, v in run.items() if k != "run_id"], ""]
    if gates:
        verdict = "passed" if all(g["passed"] for g in gates) else "FAILED"
        lines += [f"## Gates: {verdict}", "", "| metric | value | baseline | result |", "|---|---|---|---|", *[f"| {g['metric']} | {_n(g['value'])} | {_n(g['base'])} | {g['reason']} |" for g in gates], ""]
    means = {r["metric"]: r["mean"] for r in agg.collect()}
    if shown := [m for m in headline if m in means]:
        lines += ["## Headline", "", *[f"- {m}: {_n(means[m])}" for m in shown], ""]
    lines += ["## Metrics", "", "| metric | mean | baseline | change |", "|---|---|---|---|"]
    lines += [f"| {r['metric']} | {_n(r['value'])} | {_n(r['base'])} | {_n(r['delta'])} |" for r in M.deltas(agg, baseline).orderBy("metric").collect()]
    per = M.by_tag(values.where(F.col("metric") == primary), tags).orderBy("tag").collect()
    if per:
        lines += ["", f"## {primary} by tag", "", "| tag | mean | cases |", "|---|---|---|", *[f"| {r['tag']} | {_n(r['mean'])} | {r['n_cases']} |" for r in per]]
    failed = [] if failures is None else failures.where(F.col("error").isNotNull()).orderBy("case_id").limit(n_worst).collect()
    if failed:
        lines += ["", "## Failures", "", *[f"- {r['case_id']}: {r['error']}" for r in failed]]
    worst = M.worst_cases(values, primary, n_worst).collect()
    if worst:
        lines += ["", "## Worst cases", "", *[f"- {r['case_id']}: {_n(r['value'])}" for r in worst]]
    return "\n".join(lines) + "\n"


def _n(x: float | None) -> str:
    return "-" if x is None else f"{x:.4f}"


def write_run(path: str, run: Mapping[str, object], values: DataFrame, tags: DataFrame) -> None:
    """The artefacts of a run: manifest and aggregates as small JSON files, case rows as JSON lines by tasks."""
    at = Path(path)
    at.mkdir(parents=True, exist_ok=True)
    agg = {r["metric"]: r["mean"] for r in M.macro_mean(values).collect()}
    by_tag: dict[str, dict[str, float]] = {}
    for r in M.by_tag(values, tags).collect():
        by_tag.setdefault(r["tag"], {})[r["metric"]] = r["mean"]
    (at / "manifest.json").write_text(json.dumps(dict(run), sort_keys=True, ensure_ascii=False, indent=1))
    (at / "metrics.json").write_text(json.dumps({"aggregate": agg, "by_tag": by_tag}, sort_keys=True, indent=1))
    values.write.mode("overwrite").json(str(at / "cases"))


def read_run(spark: SparkSession, path: str) -> tuple[dict[str, object], DataFrame, DataFrame, DataFrame]:
    """What :func:`write_run` wrote: manifest, ``metric, mean``, ``tag, metric, mean`` and the metric rows of the cases."""
    at = Path(path)
    held = json.loads((at / "metrics.json").read_text())
    tags = [(t, m, float(v)) for t, per in held["by_tag"].items() for m, v in per.items()]
    agg = spark.createDataFrame([(m, float(v)) for m, v in held["aggregate"].items()], "metric string, mean double")
    return json.loads((at / "manifest.json").read_text()), agg, spark.createDataFrame(tags, "tag string, metric string, mean double"), spark.read.schema("case_id string, metric string, value double").json(str(at / "cases"))


def save_baseline(path: str, run: Mapping[str, object], aggregate: DataFrame) -> None:
    body = dict(run) | {"aggregate": {r["metric"]: r["mean"] for r in aggregate.collect()}}
    Path(path).write_text(json.dumps(body, sort_keys=True, indent=1))
