"""Exact quantiles and ranks without holding a group in one task.

The built-in ``percentile`` keeps every distinct value of a group in one
aggregation buffer.  Here equal values are first counted, then each group is
cut at split points taken from a sample of the column's distinct values, so no
piece holds more than about 1/parts of them whatever the sizes of the groups.  The
sample is drawn by a hash of the value and has some ``PER_PART`` values a part at
every size of the table; it is a subquery of the plan, so building a plan runs no
job and a recomputed task cuts in the same places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlet.schema import as_double


#: Sampled distinct values for each piece.
PER_PART = 32
_TURNS = 2**30


def _parts(df: DataFrame) -> int:
    return max(256, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def split_points(df: DataFrame, value: str, parts: int | None = None) -> Column:
    """Ascending values cutting the column's distinct values in pieces of like size, as an array."""
    parts = parts or _parts(df)
    values = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    share = values.agg((F.lit(float(PER_PART * parts)) / F.approx_count_distinct("v")).alias("share")).scalar()
    turn = F.pmod(F.xxhash64("v"), F.lit(_TURNS)) / F.lit(float(_TURNS))
    # distinct before they meet: one task gets the sample once, not once from every task
    drawn = values.where(turn < share).distinct().agg(F.sort_array(F.collect_list("v")).alias("s"))
    step = F.greatest(F.lit(1), F.ceil(F.size("s") / parts).cast("int"))
    return drawn.select(F.filter("s", lambda x, i: i % step == step - 1).alias("cuts")).scalar()


def with_piece(counts: DataFrame, value: str, cuts: Column) -> DataFrame:
    """Add ``piece``: the number of split points not above the value, found by halving.

    Each step is a projection of its own, so that all of them stay in generated code.
    """
    df = counts.withColumns({"_cuts": cuts, "_v": F.col(value).cast("double"), "piece": F.lit(0)})
    at = F.col("piece")
    for k in reversed(range(_parts(counts).bit_length())):
        df = df.withColumn("piece", F.when(F.get("_cuts", at + (1 << k) - 1) <= F.col("_v"), at + (1 << k)).otherwise(at))
    return df.drop("_cuts", "_v")


def counted_pieces(df: DataFrame, keys: list[str], value: str, weight: str | None = None,
                   cuts: Column | None = None):
    """Counts per value, cut into pieces, and the row offset of every piece.

    Returns ``(counts, pieces)``: counts(keys, value, cnt, piece) and
    pieces(keys, piece, below, held, total).
    """
    rows = df.where(F.col(value).isNotNull())
    cuts = split_points(rows, value) if cuts is None else cuts
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = with_piece(rows.groupBy(*keys, value).agg(times.alias("cnt")), value, cuts)
    sizes = counts.groupBy(*keys, "piece").agg(F.sum("cnt").alias("held"))
    # a group has at most parts + 1 pieces, so these windows are small
    group = Window.partitionBy(*keys)
    before = group.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (sizes
              .withColumn("below", F.coalesce(F.sum("held").over(before), F.lit(0)))
              .withColumn("total", F.sum("held").over(group)))
    return counts, pieces


def _running(joined: DataFrame, keys: list[str], value: str) -> DataFrame:
    inside = (Window.partitionBy(*keys, "piece").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    return joined.withColumn(
        "before", F.col("below") + F.coalesce(F.sum("cnt").over(inside), F.lit(0)))


def average_ranks(df: DataFrame, keys: list[str], value: str, weight: str | None = None,
                  cuts: Column | None = None) -> DataFrame:
    """(keys, value, cnt, total, avg_rank): ties share their mean rank, from 1.

    ``weight`` names a column saying how many rows a row stands for; ``cuts`` are
    split points found before.
    """
    counts, pieces = counted_pieces(df, keys, value, weight, cuts)
    ranked = _running(counts.join(pieces, [*keys, "piece"]), keys, value)
    return ranked.select(*keys, value, "cnt", "total",
                         (F.col("before") + (F.col("cnt") + 1) / 2).alias("avg_rank"))


def quantiles_long(df: DataFrame, keys: list[str], value: str, probs) -> DataFrame:
    """(keys, prob, quantile) with linear interpolation, exact."""
    probs = [float(p) for p in probs]
    anchor = not keys
    if anchor:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    counts, pieces = counted_pieces(df, keys, value)
    wanted = F.array(*[F.lit(p) for p in probs])

    def position(p):
        return (F.col("total") - 1) * p

    def touches(first, last):
        return lambda p: (F.floor(position(p)) < last) & (F.ceil(position(p)) >= first)

    hit_pieces = pieces.where(F.exists(
        wanted, touches(F.col("below"), F.col("below") + F.col("held"))))
    ranked = _running(counts.join(hit_pieces, [*keys, "piece"]), keys, value)
    first, last = F.col("before"), F.col("before") + F.col("cnt")

    def covers(p):
        low, high = F.floor(position(p)), F.ceil(position(p))
        return ((low >= first) & (low < last)) | ((high >= first) & (high < last))

    hits = ranked.select(*keys, value, "total", F.explode(F.filter(wanted, covers)).alias("prob"))
    low, high = F.min(value), F.max(value)
    spot = (F.first("total") - 1) * F.col("prob")
    result = hits.groupBy(*keys, "prob").agg(
        (low + (high - low) * (spot - F.floor(spot))).alias("quantile"))
    return result.drop("_all") if anchor else result


def quantiles(df: DataFrame, keys: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """One row per group with a column for every named quantile."""
    long = quantiles_long(df, keys, value, named.values())
    return long.groupBy(*keys).agg(*[
        F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(name)
        for name, p in named.items()])


def columns_long(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """(keys, column, value) over numeric columns, missing values left out."""
    wide = df.select(*keys, *[as_double(c).alias(c) for c in columns])
    return wide.unpivot(list(keys), columns, "column", "value").where("value IS NOT NULL")


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact median of each column; one small row per column reaches the driver."""
    rows = quantiles_long(columns_long(df, columns), ["column"], "value", [0.5]).collect()
    return {r["column"]: r["quantile"] for r in rows}


def fixed_row(df: DataFrame):
    """A one-row aggregate as a struct expression usable in any projection."""
    return df.select(F.struct(*df.columns).alias("s")).scalar()


def bind_row(df: DataFrame, facts: DataFrame):
    """(df with the one-row aggregate as a struct, that struct).

    For facts used many times over: the subquery is planned once.
    """
    return df.withColumn("_fixed", fixed_row(facts)), F.col("_fixed")
