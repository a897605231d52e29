"""Right-closed bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut(c: Column, edges, labels, include_lowest: bool = False) -> Column:
    """Label of the bin ``(a, b]`` holding the value, NULL outside all bins."""
    label = None
    for i, (low, high, name) in enumerate(zip(edges[:-1], edges[1:], labels)):
        above = (c >= low) if include_lowest and i == 0 else (c > low)
        hit = above & (c <= high)
        label = F.when(hit, F.lit(name)) if label is None else label.when(hit, F.lit(name))
    return label


def rating_category(c: Column) -> Column:
    return cut(c, (0, 2, 3, 4, 5), ("Poor", "Fair", "Good", "Excellent"))


def rating_band(c: Column) -> Column:
    """The finer bands used as a model feature; missing ratings get their own."""
    bands = cut(c, (0, 3, 4, 4.5, 5), ("Poor", "Good", "Very Good", "Excellent"), True)
    return F.coalesce(bands, F.lit("Unknown"))


def price_range(c: Column) -> Column:
    return (
        F.when(c < 50, F.lit("under_50")).when(c < 100, F.lit("50_to_100"))
        .when(c < 500, F.lit("100_to_500")).when(c >= 500, F.lit("over_500"))
    )


def freshness(age_seconds: Column) -> Column:
    return (F.when(age_seconds < 300, F.lit("fresh"))
            .when(age_seconds < 1800, F.lit("moderate")).otherwise(F.lit("stale")))
