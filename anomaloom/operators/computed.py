"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns, one after the other, that later steps read as plain columns.

    The optimizer copies the expression of a projected column into filters and conditions that use
    it; a column that steps read many times would be computed as often and the generated code
    outgrow the JIT. A column that comes out of a one-element ``explode`` stays as it is.
    """
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df
