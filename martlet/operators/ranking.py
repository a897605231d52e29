"""Ranked product lists: by category, by price band, trending."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.operators.filters import category_like, price_near, recent_or_all
from martlet.operators.ranks import bind_row
from martlet.schema import present

SHOWN = ("product_id", "title", "brand", "category", "price", "rating", "reviews_count", "url")


def best_in_category(df: DataFrame, pattern: str, n: int = 10, sort_by: str = "rating") -> DataFrame:
    """First ``n`` matching products: cheapest first for price, else highest first."""
    if sort_by not in df.columns:
        order = [F.asc("product_id")]
    elif sort_by == "price":
        order = [F.asc_nulls_last("price"), F.asc("product_id")]
    else:
        order = [F.desc_nulls_last(sort_by), F.asc("product_id")]
    return (category_like(df, pattern).orderBy(*order).limit(n)
            .select(*present(df, SHOWN), F.lit(sort_by).alias("sort_criteria"),
                    F.lit("category_based").alias("method")))


def best_near_price(df: DataFrame, target: float, tolerance: float = 0.2, n: int = 10) -> DataFrame:
    """Best rated products in the band around a price."""
    order = F.desc_nulls_last("rating") if "rating" in df.columns else F.asc("price")
    off = F.round(F.abs(F.col("price") - target) / target * 100, 2)
    return (price_near(df, target, tolerance).orderBy(order, F.asc("product_id")).limit(n)
            .select(*present(df, SHOWN), off.alias("price_difference_pct"),
                    F.lit(float(target)).alias("target_price"), F.lit("price_based").alias("method")))


def recency(ts: Column, newest: Column) -> Column:
    """100 for the newest timestamp, fading by a factor e per day."""
    seconds = F.unix_micros(newest.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return F.exp(-(seconds / F.lit(1e6)) / 86400) * 100


def trending(df: DataFrame, as_of, days: int = 7, n: int = 10) -> DataFrame:
    """Products by the mean of popularity, quality, value and recency."""
    rows = recent_or_all(df, as_of, days) if "scraped_at" in df.columns else df
    facts = {}
    if "price" in df.columns:
        facts["top_price"] = F.max("price")
    if "scraped_at" in df.columns:
        facts["newest"] = F.max("scraped_at")
    whole = None
    if facts:
        rows, whole = bind_row(rows, rows.agg(*[c.alias(k) for k, c in facts.items()]))
    scores = []
    if "reviews_count" in df.columns:
        scores.append(F.coalesce(F.col("reviews_count"), F.lit(0)).cast("double"))
    if "rating" in df.columns:
        scores.append(F.coalesce(F.col("rating"), F.lit(0.0)) * 20)
    if "price" in df.columns:
        top = whole["top_price"]
        scores.append(F.try_divide(top - F.coalesce(F.col("price"), top), top) * 100)
    if "scraped_at" in df.columns:
        scores.append(recency(F.col("scraped_at"), whole["newest"]))
    total = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in scores])
    known = reduce(lambda a, b: a + b, [s.isNotNull().cast("int") for s in scores])
    # six digits decide the order, so that it does not hang on the last bit
    scored = rows.withColumn("_score", F.round(F.try_divide(total, known), 6))
    return (scored.orderBy(F.desc("_score"), F.asc("product_id")).limit(n)
            .select(*present(df, SHOWN), F.round("_score", 2).alias("trending_score"),
                    F.lit("trending").alias("method")))
