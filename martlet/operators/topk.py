"""Value counts and the best rows per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str, n: int | None = None, name: str = "count") -> DataFrame:
    """Counts of the values that are set, most frequent first, ties by value."""
    counts = (df.where(F.col(column).isNotNull()).groupBy(column)
              .agg(F.count(F.lit(1)).alias(name))
              .orderBy(F.desc(name), F.asc(column)))
    return counts if n is None else counts.limit(n)


def best_per_group(df: DataFrame, keys: list[str], order, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of every group.  Spark keeps ``n`` per task before the
    shuffle (window group limit), so a hot group costs ``n`` rows per task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def rows_of_top(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows whose value is among the ``n`` most frequent ones."""
    top = value_counts(df, column, n).select(column)
    return df.join(F.broadcast(top), column, "left_semi")  # n rows


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def first_rows(df: DataFrame, order, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows drawn by a hash of their key: the same rows on any partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
