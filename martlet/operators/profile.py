"""Descriptive statistics of product tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlet.functions import bins, stats
from martlet.operators.ranks import bind_row, columns_long, fixed_row, quantiles
from martlet.operators.topk import best_per_group, value_counts
from martlet.schema import numeric_columns, present, string_columns

QUARTILES = {"percentile_25": 0.25, "median": 0.5, "percentile_75": 0.75}


def numeric_profile(df: DataFrame, columns=None) -> DataFrame:
    """One row per numeric column that has values: moments, quartiles, extremes."""
    columns = list(columns or numeric_columns(df))
    long = columns_long(df, columns)
    v = F.col("value")
    moments = long.groupBy("column").agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"),
        F.try_divide(F.stddev(v), F.lit(1.0)).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        stats.skewness(v).alias("skewness"), stats.kurtosis(v).alias("kurtosis"))
    spots = quantiles(long, ["column"], "value", QUARTILES)
    return moments.join(spots, "column").select(
        "column", "count", "mean", "median", "std", "min", "max", "skewness", "kurtosis",
        "percentile_25", "percentile_75",
        (F.col("percentile_75") - F.col("percentile_25")).alias("iqr"))


def describe(df: DataFrame, columns=None) -> DataFrame:
    """The eight summary numbers of each numeric column."""
    return numeric_profile(df, columns).select(
        "column", "count", "mean", "std", "min", "percentile_25", "median", "percentile_75", "max")


def text_profile(df: DataFrame, columns=None) -> DataFrame:
    """One row per text column: distinct values, missing count and share."""
    columns = list(columns or string_columns(df))
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        aggs += [F.count_distinct(c).alias(f"u_{c}"), F.count(c).alias(f"c_{c}")]
    row = df.agg(*aggs)
    parts = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"u_{c}").alias("unique_values"),
                 (F.col("n") - F.col(f"c_{c}")).alias("null_count"),
                 (F.try_divide(F.col("n") - F.col(f"c_{c}"), F.col("n")) * 100).alias("null_percentage"))
        for c in columns])).alias("p")
    return row.select(parts).select("p.*").where("unique_values > 0")


def common_values(df: DataFrame, columns=None, n: int = 5) -> DataFrame:
    """(column, value, count, rank): the ``n`` commonest values of each text column."""
    columns = list(columns or string_columns(df))
    long = (df.select(*columns).unpivot([], columns, "column", "value")
            .where("value IS NOT NULL").groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("count")))
    return best_per_group(long, ["column"], [F.desc("count"), F.asc("value")], n)


def price_stats(df: DataFrame) -> DataFrame:
    """Mean, median, deviation and range of the price in one row."""
    p = F.col("price")
    basic = df.agg(F.avg(p).alias("mean"), F.stddev(p).alias("std"),
                   F.min(p).alias("min"), F.max(p).alias("max"))
    middle = fixed_row(quantiles(df, [], "price", {"median": 0.5}))
    return basic.select("mean", middle["median"].alias("median"), "std", "min", "max")


def price_ranges(df: DataFrame) -> DataFrame:
    """Counts of the four fixed price ranges."""
    p = F.col("price")
    return df.agg(
        F.count_if(p < 50).alias("under_50"),
        F.count_if((p >= 50) & (p < 100)).alias("50_to_100"),
        F.count_if((p >= 100) & (p < 500)).alias("100_to_500"),
        F.count_if(p >= 500).alias("over_500"))


def price_by(df: DataFrame, key: str) -> DataFrame:
    """Mean, median and number of prices for each value of ``key``."""
    rows = df.where(F.col(key).isNotNull())
    basic = rows.groupBy(key).agg(F.avg("price").alias("mean"), F.count("price").alias("count"))
    middle = quantiles(rows, [key], "price", {"median": 0.5})
    return basic.join(middle, key, "left").select(
        key, F.round("mean", 2).alias("mean"), F.round("median", 2).alias("median"), "count")


def price_by_top(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """``price_by`` for the ``n`` keys with most prices; only their rows are ranked."""
    rows = df.where(F.col(key).isNotNull())
    top = (rows.groupBy(key).agg(F.count("price").alias("count"))
           .orderBy(F.desc("count"), F.asc(key)).limit(n).select(key))
    return price_by(rows.join(F.broadcast(top), key, "left_semi"), key)  # n rows


# Names of the four price quartile segments.
PRICE_SEGMENTS = ("Budget", "Mid-Range", "Premium", "Luxury")


def price_segments(df: DataFrame) -> DataFrame:
    """Quartile segments of the price: count and mean.

    Equal quartile edges make the segments meaningless; ``edges_distinct`` says so.
    """
    rows, spots = bind_row(df.where(F.col("price").isNotNull()).select("price"), quantiles(df, [], "price", {
        "q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q4": 1.0}))
    q = [spots[f"q{i}"] for i in range(5)]
    p = F.col("price")
    segment = F.when(p <= q[1], F.lit(PRICE_SEGMENTS[0]))
    for i in (1, 2, 3):
        segment = segment.when(p <= q[i + 1], F.lit(PRICE_SEGMENTS[i]))
    distinct = (q[0] < q[1]) & (q[1] < q[2]) & (q[2] < q[3]) & (q[3] < q[4])
    return (rows.groupBy(segment.alias("segment"), distinct.alias("edges_distinct"))
            .agg(F.count(p).alias("count"), F.avg(p).alias("mean_price")))


def rating_segments(df: DataFrame) -> DataFrame:
    """Counts of the rating bins."""
    label = bins.rating_category(F.col("rating"))
    return (df.select(label.alias("segment")).where("segment IS NOT NULL")
            .groupBy("segment").agg(F.count(F.lit(1)).alias("count")))


def daily(df: DataFrame, column: str = "scraped_at") -> DataFrame:
    """Rows and mean price per day."""
    aggs = [F.count(F.lit(1)).alias("count")]
    if "price" in df.columns:
        aggs.append(F.avg("price").alias("avg_price"))
    return (df.select(F.date_format(column, "yyyy-MM-dd").alias("day"), *present(df, ["price"]))
            .where("day IS NOT NULL").groupBy("day").agg(*aggs))


def time_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "scraped" in c.lower() or "date" in c.lower()]


def trends(df: DataFrame, columns=None) -> DataFrame:
    """Per time column: daily volume figures and the volatility of the daily mean price."""
    out = None
    for c in columns or time_columns(df):
        days = daily(df.withColumn(c, F.col(c).try_cast("timestamp_ntz")), c)
        volatility = F.stddev("avg_price") if "price" in df.columns else F.lit(None).cast("double")
        part = days.agg(F.avg("count").alias("daily_average"), F.count(F.lit(1)).alias("total_days"),
                        F.max("count").alias("max_daily"), F.min("count").alias("min_daily"),
                        volatility.alias("price_volatility"))
        part = part.select(F.lit(c).alias("time_column"), "*").where("total_days > 0")
        out = part if out is None else out.union(part)
    return out


def kpis(df: DataFrame) -> DataFrame:
    """Rows, mean price, distinct categories and brands, mean rating."""
    aggs = [F.count(F.lit(1)).alias("total_products")]
    if "price" in df.columns:
        aggs.append(F.avg("price").alias("avg_price"))
    if "category" in df.columns:
        aggs.append(F.count_distinct("category").alias("categories"))
    if "brand" in df.columns:
        aggs.append(F.count_distinct("brand").alias("brands"))
    if "rating" in df.columns:
        aggs.append(F.avg("rating").alias("avg_rating"))
    return df.agg(*aggs)


def export_summary(df: DataFrame) -> DataFrame:
    """(section, name, value) rows of the export summary.

    A price of zero and blank text count as absent here.
    """
    p = F.when(F.col("price") != 0, F.col("price"))

    def set_(c):
        return F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))

    fields = present(df, ("title", "price", "description"))
    fields_set = {c: set_(c) for c in fields}
    if "price" in fields:
        fields_set["price"] = F.count(p)
    for c in present(df, ("images", "specifications")):
        fields_set[c] = F.count_if(F.size(c) > 0)
    one = df.agg(F.count(F.lit(1)).cast("double").alias("total_products"),
                 F.min(p).alias("min_price"), F.max(p).alias("max_price"),
                 F.avg(p).alias("avg_price"),
                 *[v.cast("double").alias(f"products_with_{c}") for c, v in fields_set.items()])
    names = one.columns
    sections = one.unpivot([], names, "name", "value").select(
        F.when(F.col("name") == "total_products", "overview")
        .when(F.col("name").startswith("products_with_"), "data_quality")
        .otherwise("price_statistics").alias("section"), "name", "value")
    categories = value_counts(df.where("category <> ''"), "category").select(
        F.lit("category_distribution").alias("section"), F.col("category").alias("name"),
        F.col("count").cast("double").alias("value"))
    brands = value_counts(df.where("brand <> ''"), "brand", 10).select(
        F.lit("brand_distribution").alias("section"), F.col("brand").alias("name"),
        F.col("count").cast("double").alias("value"))
    return sections.union(categories).union(brands)


def category_stats(df: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest categories with the number and mean size of all of them."""
    counts = (df.where("category IS NOT NULL").groupBy("category")
              .agg(F.count(F.lit(1)).alias("count")))
    whole = fixed_row(counts.agg(F.count(F.lit(1)).alias("k"), F.avg("count").alias("m")))
    return (counts.orderBy(F.desc("count"), F.asc("category")).limit(n)
            .select("category", "count", whole["k"].alias("total_categories"),
                    whole["m"].alias("avg_products_per_category")))


def share_of_total(counts: DataFrame, count: str = "count") -> DataFrame:
    """Percentage of the sum; for short, already aggregated tables."""
    return counts.withColumn(
        "share_pct", F.col(count) / F.sum(count).over(Window.partitionBy(F.lit(1))) * 100)
