"""Cleaning steps on product tables.  Every step skips columns that are absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlet.functions import text
from martlet.operators.ranks import medians
from martlet.schema import NUMERIC_FIELDS, as_double, numeric_columns, present, string_columns


def coerce_numbers(df: DataFrame, columns=NUMERIC_FIELDS) -> DataFrame:
    """Numbers where they parse, NULL elsewhere; NaN becomes NULL."""
    return df.withColumns({c: as_double(c) for c in present(df, columns)})


def time_parts(df: DataFrame, column: str = "scraped_at") -> DataFrame:
    """String and calendar forms of a timestamp column."""
    if column not in df.columns:
        return df
    ts = F.col(column)
    return df.withColumns({
        "scraped_at_str": F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("")),
        "scraped_date": F.date_format(ts, "yyyy-MM-dd"),
        "scraped_hour": F.coalesce(F.hour(ts), F.lit(0)),
        "scraped_day_of_week": F.coalesce(F.date_format(ts, "EEEE"), F.lit("Unknown")),
    })


def _flat(field: T.StructField, column):
    """A plain string for a list or map, the value itself otherwise."""
    kind = field.dataType
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType):
            return F.array_join(column, ", ")
        return F.to_json(column)
    if isinstance(kind, T.MapType):
        return F.to_json(column)
    return column


def stringify_complex(df: DataFrame) -> DataFrame:
    """Lists and maps as text; spelled-out missing values become ''."""
    changed = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.ArrayType, T.MapType)):
            changed[field.name] = F.coalesce(_flat(field, F.col(field.name)), F.lit(""))
        elif isinstance(field.dataType, T.StructType):
            changed[field.name] = F.coalesce(F.to_json(F.col(field.name)), F.lit(""))
        elif isinstance(field.dataType, T.StringType):
            changed[field.name] = text.blank_missing_words(F.col(field.name))
    return df.withColumns(changed) if changed else df


def fill_zero(df: DataFrame, columns=NUMERIC_FIELDS) -> DataFrame:
    return df.na.fill(0, subset=present(df, columns))


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs become ``parent_child`` columns; lists and maps become text."""
    out = []

    def walk(struct: T.StructType, path: tuple[str, ...]):
        for field in struct.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                walk(field.dataType, here)
            else:
                source = F.col(".".join(f"`{p}`" for p in here))
                out.append(_flat(field, source).alias(sep.join(here)))

    walk(df.schema, ())
    return df.select(*out)


def impute(df: DataFrame) -> DataFrame:
    """Missing numbers get the column median, missing text gets ''."""
    numbers = numeric_columns(df)
    df = df.withColumns({c: as_double(c) for c in numbers
                         if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))})
    middle = {c: m for c, m in medians(df, numbers).items() if m is not None}
    filled = {c: F.coalesce(F.col(c), F.lit(m)) for c, m in middle.items()}
    filled |= {c: F.coalesce(F.col(c), F.lit("")) for c in string_columns(df)}
    return df.withColumns(filled) if filled else df


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Whole-row duplicates; lists and maps are compared as text."""
    return stringify_complex(df).dropDuplicates()


def row_key(df: DataFrame, *columns: str):
    """A stable id for rows that have none: a hash, never a global row number."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def _listing_key(df: DataFrame):
    return [F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(f"_key_{c}")
            for c in ("url", "title")]


def _settled(df: DataFrame, order) -> list:
    """The given order, or by time with a hash of the whole row last, so that reruns agree."""
    return list(order) if order else ["scraped_at", F.xxhash64(F.to_json(F.struct(*df.columns)))]


def keep_first(df: DataFrame, order=None) -> DataFrame:
    """One row per (url, title), the first in the given order (by default: time, ties by the whole row).

    Missing urls or titles are one value.  The rank filter is pushed below the
    shuffle, so a key holding a third of the rows sends one row per task.
    """
    keyed = df.select("*", *_listing_key(df))
    window = Window.partitionBy("_key_url", "_key_title").orderBy(*_settled(df, order))
    return (keyed.withColumn("_nth", F.row_number().over(window)).where("_nth = 1")
            .drop("_nth", "_key_url", "_key_title"))


def keep_new(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming rows whose (url, title) is not known yet (left anti join)."""
    seen = known.select("url", "title").distinct().alias("k")
    new = incoming.alias("n")
    same = F.col("n.url").eqNullSafe(F.col("k.url")) & F.col("n.title").eqNullSafe(F.col("k.title"))
    return new.join(seen, same, "left_anti")


def known_keys(history: DataFrame) -> DataFrame:
    return history.select("url", "title").distinct()


def duplicate_examples(df: DataFrame, order=None, n: int = 3) -> DataFrame:
    """First few rows that ``keep_first`` would remove."""
    order = _settled(df, order)
    keyed = df.select("*", *_listing_key(df))
    window = Window.partitionBy("_key_url", "_key_title").orderBy(*order)
    # the second row of a key is removed in any case: two rows per key suffice
    ranked = keyed.withColumn("_nth", F.row_number().over(window)).where("_nth <= 2")
    return (ranked.where("_nth = 2").drop("_nth", "_key_url", "_key_title")
            .orderBy("url", "title", *order).limit(n))


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Rows of files whose columns differ; absent columns are NULL."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def clean_table(df: DataFrame) -> DataFrame:
    """The load-time clean-up: numbers, text forms, calendar columns."""
    return time_parts(coerce_numbers(stringify_complex(df)))
