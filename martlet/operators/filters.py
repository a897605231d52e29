"""Row filters.  Predicates stay on bare columns so that the scan gets them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.operators.ranks import fixed_row


def date_range(df: DataFrame, first: str, last: str, column: str = "scraped_at") -> DataFrame:
    """Rows of the days ``first`` to ``last``, both included."""
    kind = df.schema[column].dataType.simpleString()
    low = F.lit(first).cast(kind)
    high = (F.to_date(F.lit(last)) + F.expr("INTERVAL 1 DAY")).cast(kind)
    return df.where((F.col(column) >= low) & (F.col(column) < high))


def equals(df: DataFrame, **wanted: str) -> DataFrame:
    """Equality on columns; the value 'All' switches a filter off."""
    for column, value in wanted.items():
        if value != "All":
            df = df.where(F.col(column) == value)
    return df


def price_between(df: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Inclusive price band.  Without bounds the band is the whole range, which
    drops rows without a price."""
    df = df.where(F.col("price").isNotNull())
    if low is not None:
        df = df.where(F.col("price") >= low)
    if high is not None:
        df = df.where(F.col("price") <= high)
    return df


def category_like(df: DataFrame, pattern: str) -> DataFrame:
    return df.where(F.col("category").rlike("(?i)" + pattern))


def price_near(df: DataFrame, target: float, tolerance: float = 0.2) -> DataFrame:
    return df.where(F.col("price").between(target * (1 - tolerance), target * (1 + tolerance)))


def complete_rows(df: DataFrame, columns) -> DataFrame:
    return df.na.drop(subset=list(columns))


def recent_or_all(df: DataFrame, as_of, days: int, column: str = "scraped_at") -> DataFrame:
    """Rows of the last ``days`` days, or every row when there are none."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    newest = fixed_row(df.agg(F.max(F.col(column).cast("timestamp_ntz")).alias("t")))
    ts = F.col(column).cast("timestamp_ntz")
    return df.where((ts >= cutoff) | (newest["t"] < cutoff) | newest["t"].isNull())


def enough_rows(df: DataFrame, least: int) -> bool:
    """Are there ``least`` rows?  Reads no more than needed to tell."""
    return df.limit(least).count() >= least
