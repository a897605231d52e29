"""Daily demand: linear trend plus weekday effects, seven days ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.operators.topk import rows_of_top

#: Half-width of an 80% band in deviations of the residuals.
BAND = 1.2815515655446004
METHOD = "trend + weekday means"


def daily_counts(df: DataFrame, keys: list[str], column: str = "scraped_at") -> DataFrame:
    return (df.select(*keys, F.to_date(column).alias("day")).where("day IS NOT NULL")
            .groupBy(*keys, "day").agg(F.count(F.lit(1)).cast("double").alias("y")))


def _fitted(days: DataFrame, keys: list[str], least: int):
    """(daily rows with trend and weekly part, weekday effects, line per group)."""
    first = days.groupBy(*keys).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"),
                                    F.count(F.lit(1)).alias("n_days")).where(F.col("n_days") >= least)
    timed = days.join(first, keys).withColumn("t", F.datediff("day", "first_day").cast("double"))
    line = timed.groupBy(*keys).agg(
        F.coalesce(F.regr_slope("y", "t"), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept("y", "t"), F.avg("y")).alias("base"),
        F.first("first_day").alias("first_day"), F.first("last_day").alias("last_day"))
    timed = timed.drop("first_day", "last_day").join(line, keys).withColumn(
        "trend", F.col("base") + F.col("slope") * F.col("t")).withColumn("weekday", F.weekday("day"))
    effects = timed.groupBy(*keys, "weekday").agg(F.avg(F.col("y") - F.col("trend")).alias("weekly"))
    return timed.join(effects, [*keys, "weekday"]), effects, line


def _anchored(df: DataFrame, keys: list[str]):
    return (df.withColumn("_all", F.lit(0)), ["_all"]) if not keys else (df, keys)


def forecast(df: DataFrame, keys: list[str] = (), horizon: int = 7, least: int = 10,
             column: str = "scraped_at") -> DataFrame:
    """Expected rows per day with an 80% band for the days after the last one.

    Groups with fewer than ``least`` days have no forecast.  All groups are fitted
    at once from daily counts.
    """
    keys = list(keys)
    rows, group = _anchored(df, keys)
    fitted, effects, line = _fitted(daily_counts(rows, group, column), group, least)
    spread = fitted.groupBy(*group).agg(
        F.coalesce(F.stddev(F.col("y") - F.col("trend") - F.col("weekly")), F.lit(0.0)).alias("sd"))
    future = line.join(spread, group).select(
        *group, "slope", "base", "first_day", "sd",
        F.explode(F.sequence(F.date_add("last_day", 1), F.date_add("last_day", horizon))).alias("date"))
    future = future.withColumn("weekday", F.weekday("date"))
    joined = future.join(effects, [*group, "weekday"], "left")
    trend = F.col("base") + F.col("slope") * F.datediff("date", "first_day")
    weekly = F.coalesce("weekly", F.lit(0.0))
    return joined.select(
        *keys, F.date_format("date", "yyyy-MM-dd").alias("day"), (trend + weekly).alias("yhat"),
        (trend + weekly - BAND * F.col("sd")).alias("yhat_lower"),
        (trend + weekly + BAND * F.col("sd")).alias("yhat_upper"),
        trend.alias("trend"), weekly.alias("weekly"), F.lit(METHOD).alias("method"))


def fit_quality(df: DataFrame, keys: list[str] = (), least: int = 10, column: str = "scraped_at") -> DataFrame:
    """MAE and MAPE of the fitted days."""
    keys = list(keys)
    rows, group = _anchored(df, keys)
    fitted, _, _ = _fitted(daily_counts(rows, group, column), group, least)
    off = F.abs(F.col("y") - F.col("trend") - F.col("weekly"))
    out = fitted.groupBy(*group).agg(F.avg(off).alias("mae"), F.avg(off / F.col("y")).alias("mape"),
                                     F.count(F.lit(1)).alias("n_days"))
    return out if keys else out.drop("_all")


def forecast_top(df: DataFrame, key: str = "category", n: int = 3, horizon: int = 7,
                 least: int = 5, column: str = "scraped_at") -> DataFrame:
    """Forecasts of the ``n`` largest groups."""
    return forecast(rows_of_top(df, key, n), [key], horizon, least, column)
