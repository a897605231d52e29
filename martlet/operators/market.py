"""Market structure: categories, brands, time, words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.functions.text import letters_only, words
from martlet.operators.profile import share_of_total
from martlet.operators.ranks import quantiles
from martlet.operators.topk import best_per_group, rows_of_top, value_counts

# Words left out of the title word counts (Albanian, then English).
TITLE_STOP_WORDS = (
    "dhe", "per", "me", "nga", "ne", "te", "se", "nje", "i", "e",
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
)


def category_performance(df: DataFrame, n: int = 10) -> DataFrame:
    """Mean price and number of prices of the largest categories."""
    return (df.where("category IS NOT NULL").groupBy("category")
            .agg(F.round(F.avg("price"), 2).alias("avg_price"), F.count("price").alias("product_count"))
            .orderBy(F.desc("product_count"), F.asc("category")).limit(n))


def brand_prices(df: DataFrame, least: int = 5, n: int | None = 15) -> DataFrame:
    """Mean price of brands with enough listings, dearest first."""
    table = (df.where("brand IS NOT NULL").groupBy("brand")
             .agg(F.avg("price").alias("avg_price"), F.count(F.lit(1)).alias("count"))
             .where(F.col("count") >= least).orderBy(F.desc("avg_price"), F.asc("brand")))
    return table if n is None else table.limit(n)


def market_share(df: DataFrame, column: str = "brand", n: int = 10) -> DataFrame:
    """Shares among the ``n`` commonest values, as a pie shows them."""
    return share_of_total(value_counts(df, column, n))


def daily_volume(df: DataFrame, column: str = "scraped_at") -> DataFrame:
    return (df.select(F.date_format(column, "yyyy-MM-dd").alias("day")).where("day IS NOT NULL")
            .groupBy("day").agg(F.count(F.lit(1)).alias("count")).orderBy("day"))


def hourly_volume(df: DataFrame, column: str = "scraped_at") -> DataFrame:
    return (df.select(F.hour(column).alias("hour")).where("hour IS NOT NULL")
            .groupBy("hour").agg(F.count(F.lit(1)).alias("count")).orderBy("hour"))


def daily_price(df: DataFrame, column: str = "scraped_at") -> DataFrame:
    return (df.select(F.date_format(column, "yyyy-MM-dd").alias("day"), "price")
            .where("day IS NOT NULL").groupBy("day").agg(F.avg("price").alias("avg_price")).orderBy("day"))


def category_trends(df: DataFrame, n: int = 5, column: str = "scraped_at") -> DataFrame:
    """Rows per day for each of the ``n`` largest categories."""
    rows = rows_of_top(df, "category", n)
    return (rows.select("category", F.date_format(column, "yyyy-MM-dd").alias("day"))
            .where("day IS NOT NULL").groupBy("category", "day").agg(F.count(F.lit(1)).alias("count")))


def median_price_by_category(df: DataFrame) -> DataFrame:
    rows = df.where("category IS NOT NULL")
    return (quantiles(rows, ["category"], "price", {"median_price": 0.5})
            .orderBy(F.desc("median_price"), F.asc("category")))


def category_brand_tree(df: DataFrame, least: int = 2) -> DataFrame:
    """Leaves (category, brand) with enough rows and the totals of their parents."""
    leaves = (df.where("category IS NOT NULL AND brand IS NOT NULL").groupBy("category", "brand")
              .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
    return leaves.rollup("category", "brand").agg(F.sum("n").alias("count"))


def _title_words(df: DataFrame, *keep: str) -> DataFrame:
    return (df.where("title IS NOT NULL")
            .select(*keep, F.explode(words(letters_only(F.col("title")))).alias("word"))
            .where(~F.col("word").isin(*TITLE_STOP_WORDS)))


def title_words(df: DataFrame, n: int = 100) -> DataFrame:
    """Most frequent words of the titles."""
    return value_counts(_title_words(df), "word", n)


def title_words_by_category(df: DataFrame, categories: int = 4, n: int = 50) -> DataFrame:
    """Most frequent title words within each of the largest categories."""
    counts = (_title_words(rows_of_top(df, "category", categories), "category")
              .groupBy("category", "word").agg(F.count(F.lit(1)).alias("count")))
    return best_per_group(counts, ["category"], [F.desc("count"), F.asc("word")], n)
