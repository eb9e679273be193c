"""Whole rows in one struct column, so that working columns clash with no column of theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def boxed(df: DataFrame, **columns: Column) -> DataFrame:
    """`row` with all columns of `df`, and the named columns beside it."""
    return df.select(
        F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *[c.alias(name) for name, c in columns.items()])


def unboxed(df: DataFrame) -> DataFrame:
    return df.select("row.*")
