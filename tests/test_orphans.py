from datetime import datetime

import pytest
from pyspark.sql import functions as F

from paperloom.functions.ids import chunk_owner, chunk_tail, loose_paper_id
from paperloom.operators.orphans import orphan_references, orphan_report, target_states

D = datetime


def _states(spark):
    t = spark.createDataFrame(
        [("a", "1", D(2024, 1, 1), False), ("a", "2", D(2024, 1, 1), False), ("a", "2", D(2024, 2, 1), True), ("b", "1", D(2024, 6, 1), False), ("b", "2", D(2024, 1, 1), True), ("b", "2", D(2024, 2, 1), None), (None, "9", D(2024, 1, 1), False)],
        "x string, y string, at timestamp, gone boolean",
    )
    return target_states(t, ["x", "y"], F.col("at"), F.col("gone"))


def test_missing_deleted_late(spark, rows):
    r = spark.createDataFrame([("r1", "a", "1"), ("r2", "a", "2"), ("r3", "b", "1"), ("r4", "b", "2"), ("r5", "c", "1"), ("r5", "c", "1")], "id string, x string, y string").withColumn("at", F.lit("2024-03-01").cast("timestamp"))
    assert rows(orphan_references(r, _states(spark), ["x", "y"], "at").select("id", "reason")) == [("r2", "deleted"), ("r3", "late"), ("r5", "missing"), ("r5", "missing")]


@pytest.mark.parametrize(("match", "expected"), [("simple", []), ("full", ["n1", "n2", "n3"]), ("partial", ["n2"])])
def test_partial_nulls_follow_the_declared_match(spark, match, expected):
    r = spark.createDataFrame([("n1", "a", None), ("n2", "z", None), ("n3", None, "1"), ("n4", None, None)], "id string, x string, y string").withColumn("at", F.lit(None).cast("timestamp"))
    found = orphan_references(r, _states(spark), ["x", "y"], "at", match)
    assert sorted(x["id"] for x in found.collect()) == expected


def test_rows_without_time_are_never_late_and_empty_tables_pass(spark):
    r = spark.createDataFrame([("r", "b", "1", None)], "id string, x string, y string, at timestamp")
    assert orphan_references(r, _states(spark), ["x", "y"], "at").count() == 0
    assert orphan_references(r.limit(0), _states(spark).limit(0), ["x", "y"], "at").count() == 0


def test_unknown_match_is_refused(spark):
    with pytest.raises(ValueError):
        orphan_references(spark.range(1), spark.range(1), ["id"], "id", "some")


def test_loose_ids(spark):
    ids = [" arxiv:1.2 ", "arXiv:1.2v3", "1.2", "hf:a-v2", "", None, " ", "hf:x-12v2"]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "c string").select(loose_paper_id(F.col("c"))).collect()]
    assert got == ["arxiv:1.2", "arxiv:1.2", "arxiv:1.2", "hf:a-v2", None, None, None, "hf:x-12"]
    c = spark.createDataFrame([(" 1.2:chunk:3:ab",), ("arXiv:1.2:chunk:3:ab",), ("arxiv:1.2",)], "c string").select(chunk_owner(F.col("c")), chunk_tail(F.col("c"))).collect()
    assert [tuple(r) for r in c] == [("arxiv:1.2", "3:ab"), ("arxiv:1.2", "3:ab"), ("arxiv:1.2", None)]


def test_report(spark, rows):
    o = spark.createDataFrame([("t", "m", "r1", "x"), ("t", "m", "r1", "y"), ("t", "n", "r2", "x")], "table_name string, load_month string, record_id string, missing_id string")
    assert rows(orphan_report(o, ["table_name", "load_month"])) == [("t", "m", 2, 1, 2), ("t", "n", 1, 1, 1)]
