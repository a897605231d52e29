"""Derived columns for analysis and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlet.functions import bins, text
from martlet.operators.ranks import bind_row, medians
from martlet.operators.topk import value_counts
from martlet.schema import as_double, has, present, string_columns
from martlet.session import saved

#: Text columns that are never turned into codes.
FREE_TEXT = ("title", "description", "url", "scraped_at", "scraped_at_str")
#: Features of the price models beside the ``*_encoded`` columns.
MODEL_FEATURES = (
    "title_length", "word_count", "rating", "reviews_count", "hour", "day_of_week",
    "month", "is_weekend", "discount_percentage", "has_discount", "has_brand_in_title",
)


def analysis_columns(df: DataFrame) -> DataFrame:
    """Columns the statistics work on: discount, rating category, text lengths."""
    new = {}
    if has(df, "price", "original_price"):
        new["discount_amount"] = F.col("original_price") - F.col("price")
        new["has_discount"] = F.coalesce((new["discount_amount"] > 0).cast("int"), F.lit(0))
    if has(df, "rating"):
        new["rating_category"] = bins.rating_category(F.col("rating"))
    for c in present(df, ("title", "description")):
        new[f"{c}_length"] = F.length(c)
        new[f"{c}_word_count"] = text.word_count(F.col(c))
    return df.withColumns(new) if new else df


def model_columns(df: DataFrame) -> DataFrame:
    """Columns the models work on, before encoding."""
    new = {}
    if has(df, "title"):
        new["title_length"] = F.length("title")
        new["word_count"] = text.word_count(F.col("title"))
    if has(df, "title", "brand"):
        new["has_brand_in_title"] = text.contains_ignore_case(F.col("title"), F.col("brand"))
    if has(df, "price"):
        new["price_log"] = F.log1p(F.coalesce(as_double("price"), F.lit(0.0)))
    if has(df, "price", "original_price"):
        amount = F.col("original_price") - F.col("price")
        new["discount_amount"] = amount
        new["discount_percentage"] = F.coalesce(
            F.try_divide(amount, F.col("original_price")) * 100, F.lit(0.0))
        new["has_discount"] = F.coalesce((amount > 0).cast("int"), F.lit(0))
    if has(df, "rating"):
        new["rating_category"] = bins.rating_band(F.col("rating"))
    if has(df, "scraped_at"):
        ts = F.col("scraped_at")
        new |= {"hour": F.hour(ts), "day_of_week": F.weekday(ts), "month": F.month(ts),
                "is_weekend": (F.weekday(ts) >= 5).cast("int")}
    return df.withColumns(new) if new else df


def _codes(values: DataFrame, pieces: int = 512) -> DataFrame:
    """(column, value, code): codes 0, 1, ... in the order of each column's values.

    The distinct values of a column are cut in about so many ``pieces`` at values drawn by
    hash, numbered piece by piece, and shifted by the sizes of the pieces before.
    """
    values = saved(values.select("column", "value").where("value IS NOT NULL").distinct(), "values")
    shares = values.groupBy("column").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / pieces)).alias("every"))
    # one row for each column, the second time with about so many pieces of its values
    drawn = values.join(F.broadcast(shares), "column").where(F.pmod(F.xxhash64("value"), F.col("every")) == 0)
    cuts = drawn.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("cuts"))
    below = F.size(F.filter("cuts", lambda c: c <= F.col("value")))
    cut = values.join(F.broadcast(cuts), "column", "left").select("column", "value", F.greatest(below, F.lit(0)).alias("piece"))
    before = Window.partitionBy("column").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (cut.groupBy("column", "piece").agg(F.count(F.lit(1)).alias("held"))
               .select("column", "piece", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("below")))
    inside = Window.partitionBy("column", "piece").orderBy("value")
    return (cut.join(offsets, ["column", "piece"])
            .select("column", "value", (F.col("below") + F.row_number().over(inside) - 1).alias("code")))


def value_codes(df: DataFrame, column: str, pieces: int = 512) -> DataFrame:
    """(value, code): codes 0, 1, ... in the order of the values."""
    return _codes(df.select(F.lit("").alias("column"), F.col(column).alias("value")), pieces).drop("column")


def encode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add ``<column>_encoded`` for text columns with more than one value.

    Missing text is the value 'Unknown', as an encoder sees it.  The codes of all columns
    come from one pass over ``df`` and are written, so the plan grows by one join a column.
    Unless named, free text and columns that identify rows (``_id``, ``_key``) get no codes.
    """
    if columns is None:
        columns = [c for c in string_columns(df) if c not in FREE_TEXT and not c.endswith(("_id", "_key"))]
    if not columns:
        return df
    filled = df.withColumns({c: F.coalesce(F.col(c), F.lit("Unknown")) for c in columns})
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("x")
    codes = saved(_codes(filled.select(each).select("x.*")), "codes", "column")
    several = {r["column"] for r in codes.groupBy("column").count().where("count > 1").collect()}
    for c in columns:
        if c in several:
            filled = filled.join(codes.where(F.col("column") == c).select(
                F.col("value").alias(c), F.col("code").alias(f"{c}_encoded")), c)
    return filled


def useful_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at least two different values."""
    spread = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if spread[c]]


def min_max(df: DataFrame, columns=("price", "rating", "reviews_count")) -> DataFrame:
    """``<column>_normalized`` in 0..1 after median fill; a constant column gives 0."""
    columns = present(df, columns)
    middle = medians(df, columns)
    filled = {c: F.coalesce(as_double(c), F.lit(middle.get(c))) for c in columns}
    bound, bounds = bind_row(df, df.agg(*[F.min(as_double(c)).alias(f"low_{c}") for c in columns],
                                        *[F.max(as_double(c)).alias(f"high_{c}") for c in columns]))
    return bound.withColumns({
        f"{c}_normalized": F.coalesce(
            F.try_divide(filled[c] - bounds[f"low_{c}"],
                         bounds[f"high_{c}"] - bounds[f"low_{c}"]), F.lit(0.0))
        for c in columns}).drop("_fixed")


def one_hot_long(df: DataFrame, key: str, columns=("brand", "category"), n: int = 20) -> DataFrame:
    """(key, feature, value 1.0) for rows holding one of the ``n`` commonest values."""
    parts = [df.select(key, F.lit("").alias("feature"), F.lit(1.0).alias("value")).limit(0)]
    for c in present(df, columns):
        top = value_counts(df, c, n).select(c)
        kept = df.select(key, c).join(F.broadcast(top), c)  # n rows
        parts.append(kept.select(key, F.concat(F.lit(f"{c}_"), F.col(c)).alias("feature"),
                                 F.lit(1.0).alias("value")))
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result


def standard_moments(df: DataFrame, columns) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column: one row to the driver."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                 *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}


def standardise(df: DataFrame, columns) -> DataFrame:
    """``z_<column>``: centred, divided by the population deviation."""
    moments = standard_moments(df, columns)
    return df.withColumns({
        f"z_{c}": (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0)
        for c, (m, s) in moments.items()})


