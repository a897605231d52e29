"""Column types of a product row and helpers that look at a frame's schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A product as it arrives: amounts and ratings are still text.
RAW_PRODUCT = T.StructType(
    [T.StructField(name, T.StringType()) for name in (
        "title", "url", "price", "original_price", "description", "brand",
        "category", "availability", "rating", "reviews_count", "product_id",
        "base_url", "scraped_at",
    )]
    + [
        T.StructField("images", T.ArrayType(T.StringType())),
        T.StructField("specifications", T.MapType(T.StringType(), T.StringType())),
    ]
)

#: A validated product.
PRODUCT = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("scraped_at", T.TimestampType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("original_price", T.DoubleType()),
    T.StructField("discount_percentage", T.DoubleType()),
    T.StructField("description", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("availability", T.StringType()),
    T.StructField("images", T.ArrayType(T.StringType())),
    T.StructField("image_count", T.IntegerType()),
    T.StructField("main_image", T.StringType()),
    T.StructField("specifications", T.MapType(T.StringType(), T.StringType())),
    T.StructField("rating", T.DoubleType()),
    T.StructField("reviews_count", T.IntegerType()),
])

NUMERIC_FIELDS = ("price", "rating", "reviews_count", "original_price", "discount_percentage")
TEXT_FIELDS = ("title", "description", "brand", "category")


def has(df: DataFrame, *names: str) -> bool:
    """Are all the named columns present?"""
    return set(names) <= set(df.columns)


def present(df: DataFrame, names) -> list[str]:
    """The named columns that exist, in the order asked for."""
    return [n for n in names if n in df.columns]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def as_double(name: str | Column) -> Column:
    """Number or NULL: NaN is a missing value here, as it is in pandas."""
    c = F.col(name) if isinstance(name, str) else name
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def column_types(df: DataFrame) -> DataFrame:
    """One row per column with its type, in schema order."""
    rows = [(i, n, t) for i, (n, t) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, data_type string")
