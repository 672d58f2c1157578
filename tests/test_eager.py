import pytest
from pyspark.sql import functions as F

from paperloom.operators.eager import heavy_keys, hot_split_join, join_states, key_states, roll_up


def test_aggregates_of_the_join_equal_the_join_of_rows(spark, rows):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("x", None), ("y", 5), (None, 7), ("z", 1)], "k string, v int")
    b = spark.createDataFrame([("x", 10), ("x", 20), ("y", 1), ("y", 1), (None, 3), ("w", 4)], "k string, w int")
    s = join_states(key_states(a, {"k": "k"}, {"v": "v"}, mins={"v": "v"}), key_states(b, {"k": "k"}, {"w": "w"}, maxs={"w": "w"}), ["k"])
    plain = a.join(b, "k").groupBy("k").agg(F.count(F.lit(1)), F.sum("v"), F.sum("w"), F.min("v"), F.max("w"))
    assert rows(s.select("k", "n_join", "left_sum_v", "right_sum_w", "left_min_v", "right_max_w")) == rows(plain)
    total = roll_up(s.withColumn("g", F.lit(1)), ["g"], drop=["k"])
    assert rows(total.select("n_join", "left_sum_v", "right_sum_w")) == rows(a.join(b, "k").agg(F.count(F.lit(1)), F.sum("v"), F.sum("w")))


def test_full_join_keeps_keys_of_one_side(spark, rows):
    a = key_states(spark.createDataFrame([("x",), ("y",), (None,)], "k string"), {"k": "k"})
    b = key_states(spark.createDataFrame([("x",), ("z",), (None,)], "k string"), {"k": "k"})
    assert rows(join_states(a, b, ["k"], "full").select("k", "n_left", "n_right", "n_join")) == [(None, 0, 1, 0), (None, 1, 0, 0), ("x", 1, 1, 1), ("y", 1, 0, 0), ("z", 0, 1, 0)]


def test_heavy_keys_count_null_rows_in_the_total(spark, rows):
    left = spark.createDataFrame([("x",)] * 5 + [("y",)] * 4 + [(None,)] * 91, "k string")
    s = join_states(key_states(left, {"k": "k"}), key_states(left.limit(0), {"k": "k"}), ["k"], "full")
    assert rows(heavy_keys(s, ["k"], {"l": "n_left", "r": "n_right"}, 5)) == [("l", "x", 5)]


def test_empty_tables_have_no_states(spark):
    e = spark.createDataFrame([], "k string, v int")
    assert join_states(key_states(e, {"k": "k"}), key_states(e, {"k": "k"}), ["k"], "full").count() == 0


def test_columns_with_clashing_names_do_not_matter(spark, rows):
    a = spark.createDataFrame([("x", 1, 2, 3)], "k string, n int, sum_v int, left_n int")
    assert rows(key_states(a, {"k": "k"}, {"v": "n"}).select("k", "n", "sum_v")) == [("x", 1, 1)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_split_join_equals_join(spark, rows, how):
    a = spark.createDataFrame([("h", i) for i in range(30)] + [("c", 1), ("d", 2), (None, 3)], "k string, v int")
    b = spark.createDataFrame([("h", "H"), ("c", "C"), ("e", "E")], "k string, w string")
    assert rows(hot_split_join(a, b, ["k"], how, hot_rows=5)) == rows(a.join(b, "k", how))
    assert rows(hot_split_join(a, b, ["k"], how, hot_rows=5, most_hot=0)) == rows(a.join(b, "k", how))
