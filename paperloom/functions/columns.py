"""Helpers for column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``df`` with columns that are computed once per row.

    The optimizer merges projections and so repeats an expression wherever its result is used; a generator between them
    keeps costly ones (tokenising, higher-order functions) from running again for each use.
    """
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
