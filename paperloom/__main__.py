"""``python -m paperloom``: list and run queries, evaluate with gates, load incrementally."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from paperloom.operators import indexing, metrics, report
from paperloom.operators.store import VersionedTable
from paperloom.plans import catalog, evaluation, pipeline
from paperloom.plans.search import cases
from paperloom.session import local_session
from paperloom.sources.feeds import read_baseline
from paperloom.streaming.incremental import load_incrementally


def main(args: list[str] | None = None) -> int:
    """Exit 0 if all is well, 1 if a gate fails or all papers failed, 2 on wrong input."""
    p = argparse.ArgumentParser(prog="paperloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    q = sub.add_parser("query", help="run one query")
    q.add_argument("name")
    q.add_argument("data")
    q.add_argument("--out", help="folder for Parquet; else the first rows are shown")
    e = sub.add_parser("evaluate", help="score the baseline run, report, check gates")
    e.add_argument("data")
    e.add_argument("--out", required=True)
    e.add_argument("--baseline", default="")
    e.add_argument("--save-baseline", default="")
    e.add_argument("--target", choices=("lexical", "first"), default="lexical", help="BM25 over all chunks, or the first chunks of the case's paper")
    x = sub.add_parser("index", help="index the waiting papers; prints the outcome as JSON")
    x.add_argument("data")
    x.add_argument("tables")
    x.add_argument("--buckets", type=int, default=16)
    w = sub.add_parser("load", help="upsert new Parquet files into a table")
    for name in ("source", "table", "checkpoint", "keys"):
        w.add_argument(name)
    a = p.parse_args(args)
    if a.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    spark = local_session()
    if a.command == "query":
        every = catalog.queries()
        if a.name not in every:
            print(f"unknown query: {a.name}", file=sys.stderr)
            return 2
        df = every[a.name](spark, a.data)
        df.write.mode("overwrite").parquet(a.out) if a.out else df.show(20, False)
        return 0
    if a.command == "load":
        load_incrementally(spark, a.source, spark.read.parquet(a.source).schema, a.table, a.checkpoint, a.keys.split(","))
        return 0
    if a.command == "index":
        load = pipeline.pending_load(spark, a.data)
        indexing.write_load(load, {n: VersionedTable(spark, f"{a.tables}/{n}", k, a.buckets) for n, k in indexing.KEYS.items()})
        s = load.summary().first().asDict()
        failed = {r["stage"]: r["n_papers"] for r in indexing.outcome_counts(load.outcomes.where(~F.col("ok"))).collect()}
        print(json.dumps(s | {"failed_by_stage": failed}, sort_keys=True))
        return 1 if s["all_failed"] else 0
    failures = None
    if a.target == "lexical":
        done = evaluation.run_lexical(spark, a.data, all_cases=True)
        values, failures = done.values, done.responses.select("case_id", "error")
    else:
        values = evaluation.ir_metrics(spark, a.data).unionByName(evaluation.gen_metrics(spark, a.data))
    tags = cases(spark, a.data).select("case_id", F.explode("tags").alias("tag"))
    rules = spark.createDataFrame(evaluation.RULES[:2], "metric string, least double, most double, max_regression double")
    base = read_baseline(spark, a.baseline) if a.baseline else spark.createDataFrame([], "metric string, mean double")
    run = {"run_id": report.digest([a.data, a.baseline]), "data": a.data, "target": a.target}
    report.write_run(a.out, run, values, tags)
    with open(f"{a.out}/report.md", "w") as f:
        f.write(report.render(run, values, tags, rules, base, failures=failures))
    if a.save_baseline:
        report.save_baseline(a.save_baseline, run, metrics.macro_mean(values))
    return 0 if metrics.gates(rules, metrics.macro_mean(values), base).where(~F.col("passed")).count() == 0 else 1


if __name__ == "__main__":
    sys.exit(main())
