"""Whole-row validation of scraped products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlet.functions import amounts, text, urls
from martlet.schema import has


def _text_input(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def _column(df: DataFrame, name: str, type_: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(type_)


def _price(df: DataFrame, name: str) -> Column:
    """A positive price; only texts are read by the rules for texts."""
    value = _column(df, name)
    if not has(df, name) or _text_input(df, name):
        return amounts.positive_price(value.cast("string"))
    return F.when(value > 0, value.cast("double"))


def validate_products(df: DataFrame, base_url: str = urls.DEFAULT_BASE,
                      as_of: Column | None = None) -> DataFrame:
    """Raw product rows to validated ones, in one projection.

    Missing input columns are treated as missing values.  ``as_of`` stamps rows
    that carry no ``scraped_at``.
    """
    base = F.coalesce(_column(df, "base_url"), F.lit(base_url))
    images = urls.clean_image_urls(_column(df, "images", "array<string>"), base)
    rating = (amounts.parse_rating(F.col("rating"), _text_input(df, "rating"))
              if has(df, "rating") else F.lit(None).cast("double"))
    reviews = (amounts.parse_review_count(F.col("reviews_count"), _text_input(df, "reviews_count"))
               if has(df, "reviews_count") else F.lit(None).cast("int"))
    stamped = F.coalesce(_column(df, "scraped_at").try_cast("timestamp"),
                         as_of if as_of is not None else F.lit(None).cast("timestamp"))
    carried = [c for c in df.columns if c in ("source_file",)]

    parsed = df.select(
        F.coalesce(_column(df, "product_id").cast("string"),
                   urls.product_id_from_url(_column(df, "url"))).alias("product_id"),
        text.clean_text(_column(df, "title")).alias("title"),
        F.coalesce(_column(df, "url"), F.lit("")).alias("url"),
        stamped.alias("scraped_at"),
        _price(df, "price").alias("price"),
        _price(df, "original_price").alias("original_price"),
        *[text.clean_text(_column(df, n)).alias(n)
          for n in ("description", "brand", "category", "availability")],
        images.alias("images"),
        F.coalesce(_column(df, "specifications", "map<string,string>"),
                   F.create_map().cast("map<string,string>")).alias("specifications"),
        rating.alias("rating"),
        reviews.alias("reviews_count"),
        *carried,
    )
    return parsed.select(
        "product_id", "title", "url", "scraped_at", "price", "original_price",
        amounts.discount_percentage(F.col("price"), F.col("original_price")).alias("discount_percentage"),
        "description", "brand", "category", "availability", "images",
        F.size("images").alias("image_count"),
        F.get("images", F.lit(0)).alias("main_image"),
        "specifications", "rating", "reviews_count", *carried,
    )


# Declared limits of a plausible product.
LIMITS = {"min_price": 0.01, "max_price": 999999.99, "min_title": 3, "max_title": 500}


def within_limits(df: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """Rows whose price and title length lie in the declared limits."""
    return df.where(
        F.col("price").between(limits["min_price"], limits["max_price"])
        & F.length("title").between(limits["min_title"], limits["max_title"]))
