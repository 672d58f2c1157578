import json

from pyspark.sql import functions as F

from paperloom.operators import report


def test_report_and_artefacts(spark, rows, tmp_path):
    v = spark.createDataFrame([("a", "recall@5", 1.0), ("b", "recall@5", 0.0), ("a", "mrr", 0.5)], "case_id string, metric string, value double")
    tags = spark.createDataFrame([("a", "t"), ("b", "u")], "case_id string, tag string")
    rules = spark.createDataFrame([("recall@5", 0.6, None, None)], "metric string, least double, most double, max_regression double")
    base = spark.createDataFrame([("mrr", 0.4)], "metric string, mean double")
    text = report.render({"run_id": "r1", "suite": "s"}, v, tags, rules, base)
    assert "Gates: FAILED" in text and text.index("Gates") < text.index("## Metrics") and "| mrr | 0.5000 | 0.4000 | 0.1000 |" in text and "- b: 0.0000" in text
    report.write_run(str(tmp_path / "run"), {"run_id": "r1"}, v, tags)
    assert json.loads((tmp_path / "run/metrics.json").read_text())["by_tag"]["t"] == {"recall@5": 1.0, "mrr": 0.5}
    report.save_baseline(str(tmp_path / "b.json"), {}, v.groupBy("metric").agg(F.avg("value").alias("mean")))
    assert json.loads((tmp_path / "b.json").read_text())["aggregate"]["recall@5"] == 0.5


def test_load_outcomes(spark, rows):
    a = spark.createDataFrame([("p", None, None), ("q", "boom", "fetch"), ("r", None, None), ("s", None, None)], "paper_id string, error string, stage string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "paper_id string")
    o = report.load_outcomes(a, ids("p", "r"), ids("p", "s"))
    assert rows(o.select("paper_id", "ok", "stage")) == [("p", True, None), ("q", False, "fetch"), ("r", False, "vector"), ("s", False, "graph")]
    assert rows(report.run_summary(o)) == [(4, 1, 3, False)]


def test_digest_does_not_depend_on_order():
    assert report.digest({"a": 1, "b": 2}) == report.digest({"b": 2, "a": 1}) and len(report.digest(b"x")) == 16
