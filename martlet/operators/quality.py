"""Completeness and quality scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlet.functions import stats, text
from martlet.schema import present

# Fields a good listing fills in.
IMPORTANT_FIELDS = ("title", "price", "brand", "category", "description", "rating")


def table_quality(df: DataFrame) -> DataFrame:
    """One row: size, missing cells, completeness and the score derived from it."""
    k = len(df.columns)
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.count(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    filled = reduce(lambda a, b: a + b, [F.col(f"c{i}") for i in range(k)])
    cells = F.col("n") * k
    complete = F.try_divide(filled, cells) * 100
    return row.select(
        F.col("n").alias("total_records"), F.lit(k).cast("long").alias("total_columns"),
        (cells - filled).alias("missing_cells"),
        F.round(complete, 2).alias("completeness_percentage"),
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), complete)).alias("overall_score"),
        F.round(F.try_divide(cells - filled, cells) * 100, 2).alias("missing_percentage"))


#: What the number of distinct text values is capped at.
TEXT_VALUES = 100


def _distinct_values(df: DataFrame, approximate: bool) -> DataFrame:
    """One row: u0, u1, ... the number of different values of each column, exact unless asked otherwise.

    Columns of one type are counted as (column, value) rows, so that no row carries all columns
    once for each.  Text beyond its cap by far is not counted exactly, as only the cap is shown.
    """
    plain = {f"u{i}": F.to_json(f.name) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for i, f in enumerate(df.schema.fields)}
    kinds = {f"u{i}": "string" if isinstance(f.dataType, T.MapType) else f.dataType.simpleString() for i, f in enumerate(df.schema.fields)}
    rows = df.select(*[v.alias(c) for c, v in plain.items()])
    texts = [f"u{i}" for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.StringType)]
    rough = list(plain) if approximate else texts
    sizes = rows.agg(F.lit(0).alias("_"), *[F.approx_count_distinct(c).alias(c) for c in rough])
    if approximate:
        return sizes
    held = sizes.first()
    known = {c: held[c] for c in texts if held[c] > 4 * TEXT_VALUES}
    counted = df.sparkSession.createDataFrame([(c, n) for c, n in known.items()], "column string, values long")
    for kind in dict.fromkeys(kinds.values()):
        names = [c for c in plain if kinds[c] == kind and c not in known]
        if names:
            each = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in names])).alias("x"))
            counted = counted.union(each.select("x.*").where("value IS NOT NULL").distinct().groupBy("column").agg(F.count(F.lit(1))))
    return counted.agg(*[F.coalesce(F.max(F.when(F.col("column") == c, F.col("values"))), F.lit(0)).alias(c) for c in plain])


def column_quality(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: missing share, type, distinct values (text capped at 100)."""
    held = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    row = held.crossJoin(_distinct_values(df, approximate))  # one row each
    cells = []
    for i, f in enumerate(df.schema.fields):
        unique = F.col(f"u{i}")
        if isinstance(f.dataType, T.StringType):
            unique = F.least(unique, F.lit(TEXT_VALUES).cast("long"))
        cells.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("data_type"),
            F.round(F.try_divide(F.col("n") - F.col(f"c{i}"), F.col("n")) * 100, 2)
            .alias("missing_percentage"), unique.alias("unique_values")))
    return row.select(F.explode(F.array(*cells)).alias("q")).select("q.*")


def completeness(df: DataFrame, fields=IMPORTANT_FIELDS) -> DataFrame:
    """(field, completeness_pct) over the fields that exist."""
    fields = present(df, fields)
    row = df.agg(*[stats.share(F.col(c).isNotNull()).alias(c) for c in fields])
    return row.unpivot([], fields, "field", "completeness_pct")


def quality_score(df: DataFrame, fields=IMPORTANT_FIELDS) -> Column:
    """Share of important fields of a row that hold more than blanks, in percent."""
    fields = present(df, fields)
    filled = reduce(lambda a, b: a + b, [(~text.is_blank(F.col(c))).cast("int") for c in fields])
    return filled / F.lit(len(fields)) * 100


def quality_distribution(df: DataFrame, fields=IMPORTANT_FIELDS) -> DataFrame:
    return (df.select(quality_score(df, fields).alias("quality_score"))
            .groupBy("quality_score").agg(F.count(F.lit(1)).alias("count")))


def coverage(df: DataFrame) -> DataFrame:
    """Shares (0..1) of rows with text, a price and a rating."""
    combined = text.combined_text(*[F.col(c) for c in present(
        df, ("title", "description", "brand", "category"))])
    return df.agg(stats.share(F.length(combined) > 0, 1.0).alias("text_coverage"),
                  stats.share(F.col("price").isNotNull(), 1.0).alias("price_coverage"),
                  stats.share(F.col("rating").isNotNull(), 1.0).alias("rating_coverage"))


def system_metrics(df: DataFrame) -> DataFrame:
    """Price completeness and missing share over all cells, in percent."""
    parts = [stats.share(F.col(c).isNull()) for c in df.columns]
    return df.agg(stats.share(F.col("price").isNotNull()).alias("price_completeness_pct"),
                  (reduce(lambda a, b: a + b, parts) / len(parts)).alias("missing_pct"))


def load_statistics(df: DataFrame) -> DataFrame:
    """Rows per source file and how many of all (url, title) pairs are repeats."""
    key = F.struct(F.coalesce("url", F.lit("None")), F.coalesce("title", F.lit("None")))
    files = df.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))
    whole = df.agg(F.count(F.lit(1)).alias("before"), F.count_distinct(key).alias("after"))
    whole = whole.select(F.struct("before", "after").alias("s")).scalar()
    return files.select("source_file", "rows", whole["before"].alias("rows_before"),
                        whole["after"].alias("rows_after"),
                        (whole["before"] - whole["after"]).alias("duplicates_removed"))


def ingest_progress(df: DataFrame, target: int) -> DataFrame:
    """Rows against a target, images and specifications per row."""
    aggs = [F.count(F.lit(1)).alias("scraped"), F.lit(target).cast("long").alias("target"),
            (F.try_divide(F.count(F.lit(1)), F.lit(target)) * 100).alias("success_rate")]
    for c in present(df, ("images", "specifications")):
        aggs.append(F.avg(F.size(c)).alias(f"avg_{c}"))
    return df.agg(*aggs)


