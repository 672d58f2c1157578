"""Training-data queries on the planted tables: against SQL, and the radius join's copies at two sizes."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paperloom.llm import metric, names, queries
from paperloom.sources.tables import table

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def normal(names_, rows):
    order = sorted(range(len(names_)), key=lambda i: names_[i])
    return sorted(tuple("NULL" if r[i] is None else f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in DATA.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
    df = queries.QUERIES[name](spark, str(DATA))
    res = con.execute(queries.SQL[name])
    cols = [d[0] for d in res.description]
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(cols, res.fetchall())


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_radius_join_of_the_surnames(spark, scale):
    data = DATA.parent / scale
    if not data.exists():
        pytest.skip("no test tables")
    read = names.read_names(table(spark, str(data), "authors").select("name").distinct())
    keys = read.where("kind = 'person'").select(F.col("last").alias("key")).distinct()
    every = sorted(r["key"] for r in keys.collect())
    got = {(r["a"], r["b"]) for r in metric.radius_join(keys, 1).collect()}
    left, right = zip(*[(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if abs(len(a) - len(b)) <= 1], strict=True)
    assert got == {(a, b) for a, b, d in zip(left, right, metric.distances(left, right), strict=True) if d <= 1}
    assert metric.copies(keys) < 9


def test_every_query_runs(spark):
    for name in sorted(set(queries.QUERIES) - set(queries.SQL)):
        assert queries.QUERIES[name](spark, str(DATA)).count() >= 0
