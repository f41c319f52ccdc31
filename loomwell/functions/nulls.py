"""Null rules of data frames whose groupings drop null keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are all there; groupings and counts of the reference drop the others."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def not_or_true(c: Column) -> Column:
    """`not c`, where a null c counts as true and so gives false."""
    return ~F.coalesce(c, F.lit(True))
