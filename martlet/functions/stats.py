"""Aggregates with pandas semantics that stay inside one partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows where both are set; NULL if either is constant."""
    both_a = F.when(b.isNotNull(), a)
    both_b = F.when(a.isNotNull(), b)
    spread = F.stddev_pop(both_a) * F.stddev_pop(both_b)
    return F.try_divide(F.covar_pop(a, b), spread)


def skewness(c: Column) -> Column:
    """Bias-corrected skewness; 0 for a constant column, NULL below 3 values."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    fixed = F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2)
    return F.when(n >= 3, F.when(F.stddev_pop(c) == 0, F.lit(0.0)).otherwise(fixed))


def kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 for a constant column, NULL below 4 values."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    fixed = F.try_divide((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3))
    return F.when(n >= 4, F.when(F.stddev_pop(c) == 0, F.lit(0.0)).otherwise(fixed))


def share(condition: Column, scale: float = 100.0) -> Column:
    """Share of rows meeting a condition; a NULL condition counts as not met."""
    return F.avg(F.coalesce(condition.cast("double"), F.lit(0.0))) * scale
