"""Readers of the Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` under ``sf_dir``; ``TIMESTAMP_NTZ`` columns are read as UTC timestamps."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    ntz = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(ntz) if ntz else df
