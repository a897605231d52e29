"""The numbers behind histograms, box plots, density curves and Q-Q plots."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.operators.ranks import bind_row, quantiles, quantiles_long
from martlet.operators.topk import rows_of_top


def histogram(df: DataFrame, value: str, nbins: int) -> DataFrame:
    """(bin, low, high, count, density): equal widths, the last bin closed.

    A constant column is one bin of zero width.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    facts = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n"))
    rows, span = bind_row(rows, facts)
    step = (span["high"] - span["low"]) / nbins
    spot = F.floor(F.try_divide(F.col("v") - span["low"], step)).cast("int")
    index = F.least(F.coalesce(spot, F.lit(0)), F.lit(nbins - 1))
    counts = rows.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    counts, span = bind_row(counts, facts)
    low = span["low"] + F.col("bin") * step
    return counts.select("bin", low.alias("low"), (low + step).alias("high"), "count",
                         F.try_divide(F.col("count"), span["n"] * step).alias("density"))


def five_numbers(df: DataFrame, value: str = "price", keys: list[str] = ()) -> DataFrame:
    """Quartiles, whiskers within 1.5 IQR and the number of points beyond them."""
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    spots = quantiles(rows, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    v = F.col(value)
    if keys:
        joined = rows.select(*keys, value).join(spots, keys)
        q1, q3, mid = F.col("q1"), F.col("q3"), F.first("median")
        outer = [F.first("q1").alias("q1"), mid.alias("median"), F.first("q3").alias("q3")]
        grouped = joined.groupBy(*keys)
    else:
        bound, s = bind_row(rows.select(value), spots)
        joined = bound.select(value, *[s[n].alias(n) for n in ("q1", "median", "q3")])
        q1, q3 = F.col("q1"), F.col("q3")
        outer = [F.first(n).alias(n) for n in ("q1", "median", "q3")]
        grouped = joined.groupBy()
    inside = v.between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return grouped.agg(
        F.min(F.when(inside, v)).alias("lower_whisker"), *outer,
        F.max(F.when(inside, v)).alias("upper_whisker"),
        F.count_if(~inside).alias("n_outliers"), F.count(F.lit(1)).alias("count"))


def five_numbers_top(df: DataFrame, key: str = "category", n: int = 10) -> DataFrame:
    return five_numbers(rows_of_top(df, key, n), "price", [key])


def density_curve(df: DataFrame, value: str = "price", points: int = 200) -> DataFrame:
    """Gaussian kernel density on an even grid, bandwidth by Scott's rule.

    Equal values are counted first; each distinct value then adds to every grid
    point inside the map-side aggregation, so only ``points`` sums are shuffled.
    """
    counts = (df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v"))
              .agg(F.count(F.lit(1)).alias("times")))
    facts = df.agg(F.min(value).alias("low"), F.max(value).alias("high"),
                   F.count(value).alias("n"), F.stddev(value).alias("std"))
    counts, s = bind_row(counts, facts)
    step = (s["high"] - s["low"]) / (points - 1)
    width = s["std"] * F.pow(s["n"], F.lit(-0.2))
    grid = counts.select("v", "times", "_fixed", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    at = s["low"] + F.col("point") * step
    z = F.try_divide(at - F.col("v"), width)
    sums = grid.groupBy("point").agg(F.sum(F.col("times") * F.exp(-0.5 * z * z)).alias("mass"))
    sums, s = bind_row(sums, facts)
    return sums.select("point", at.alias("x"), F.try_divide(
        F.col("mass"), s["n"] * width * F.sqrt(2 * F.pi())).alias("density"))


def normal_quantiles(df: DataFrame, value: str = "price", points: int = 99) -> DataFrame:
    """Sample quantiles against those of the standard normal distribution."""
    probs = [i / (points + 1) for i in range(1, points + 1)]
    normal = NormalDist()
    theory = F.create_map(*[F.lit(x) for p in probs for x in (p, normal.inv_cdf(p))])
    found = quantiles_long(df, [], value, probs)
    return found.select("prob", F.element_at(theory, F.col("prob")).alias("theoretical"),
                        F.col("quantile").alias("sample"))


def value_mean(df: DataFrame, *columns: str) -> DataFrame:
    """The means drawn as markers in the histograms."""
    return df.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
