"""Limits and counts of the query surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, key: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows in order of key, so that a page is the same each time."""
    if limit is None and not offset:
        return df
    out = df.orderBy(key)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def balanced(df: DataFrame, n: int, column: str, key: str) -> DataFrame:
    """At most n // groups rows of each value of column, first by key; the remainder is lost.

    Null counts among the groups but has no rows, and what is left is filtered before the shuffle by a window group limit.
    """
    groups = df.select(column).distinct().count()
    each = n // groups if groups else 0
    order = Window.partitionBy(column).orderBy(key)
    return df.where(F.col(column).isNotNull()).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= each).drop("__r")


def counted(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each group, null being one, sorted by the keys."""
    return df.groupBy(*by).agg(F.count("*").alias("count")).orderBy(*by)
