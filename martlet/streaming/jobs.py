"""Streaming forms of the dashboard queries.

Watermarks are one day; later rows are dropped.  Results go to files, one folder
per micro-batch that a repeated batch overwrites, so a restart adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlet.functions.bins import freshness
from martlet.operators.cleaning import keep_first, keep_new
from martlet.operators.topk import best_per_group
from martlet.operators.validate import validate_products
from martlet.session import work_path

WATERMARK = "1 day"


def read_stream(spark: SparkSession, path: str, fmt: str, schema: T.StructType,
                glob: str | None = None, **options) -> DataFrame:
    """File stream over a directory; every new file is read once."""
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def timed(stream: DataFrame, column: str = "scraped_at") -> DataFrame:
    """A proper timestamp with a watermark on it."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, WATERMARK)


def volume(stream: DataFrame, every: str, column: str = "scraped_at", value: str = "price") -> DataFrame:
    """Rows and mean value per tumbling window."""
    return (timed(stream, column).groupBy(F.window(column, every).alias("w"))
            .agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias("avg_value"))
            .select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "count", "avg_value"))


def activity(stream: DataFrame, key: str, column: str = "scraped_at", value: str = "price",
             length: str = "7 days", step: str = "1 day") -> DataFrame:
    """Rows and mean value per key over sliding windows: what is trending."""
    return (timed(stream, column).groupBy(F.window(column, length, step).alias("w"), key)
            .agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias("avg_value"))
            .select(F.date_format("w.start", "yyyy-MM-dd").alias("start"), key, "count", "avg_value"))


def without_repeats(stream: DataFrame, keys: list[str], column: str | None = None) -> DataFrame:
    """The first row of each key, however rows fall into batches.

    All keys seen stay in the state.  With a time ``column`` they are forgotten when the
    watermark has passed, and a key that comes back later is a new one.
    """
    if column is None:
        return stream.dropDuplicates(keys)
    return timed(stream, column).dropDuplicatesWithinWatermark(keys)


def kpis(stream: DataFrame, *distinct: str, value: str = "price") -> DataFrame:
    """Running key figures.  Exact distinct counts do not exist on streams."""
    return stream.agg(F.count(F.lit(1)).alias("rows"), F.avg(value).alias("avg_value"),
                      *[F.approx_count_distinct(c).alias(f"approx_{c}") for c in distinct])


def staleness(df: DataFrame, as_of: Column, column: str = "scraped_at") -> DataFrame:
    """How old the newest row is."""
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.max(F.col(column).cast("timestamp")))
    return df.agg(age.alias("age_seconds"), freshness(age).alias("freshness"))


def run_available(stream: DataFrame, mode: str, keys: list[str] = ()) -> DataFrame:
    """Process what is there and return the result as a table.

    ``append`` returns all rows, ``complete`` those of the last batch, ``update``
    the latest row of each key.
    """
    spark = stream.sparkSession
    out, state = work_path(spark, "stream-out"), work_path(spark, "stream-state")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (stream.writeStream.outputMode(mode).foreachBatch(save)
             .option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
    saved = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    if mode == "append":
        return saved.drop("batch")
    if mode == "complete":
        return saved.where(F.col("batch") == saved.agg(F.max("batch").alias("b")).scalar()).drop("batch")
    return best_per_group(saved, list(keys), [F.desc("batch")], 1).drop("batch", "rank")


def append_new(raw: DataFrame, history: str, state: str, order=("scraped_at",), once: bool = True):
    """Validate incoming rows and append those with an unknown (url, title).

    Every batch of every run has its own folder below ``history``; a run is what shares a
    checkpoint.  When a batch is repeated its folder is replaced and does not count as
    history; whatever other batches and runs have written does.  Of equal new rows the
    first in ``order`` stays, ties by all columns.
    """
    spark = raw.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        valid = validate_products(batch)
        valid = keep_first(valid, [*order, F.to_json(F.struct(*valid.columns))])
        if number == 0:  # from here on there is a history to read
            valid.limit(0).write.mode("overwrite").parquet(f"{history}/run={run}/batch=-1")
        known = spark.read.parquet(history).where((F.col("run") != run) | (F.col("batch") < number))
        keep_new(valid, known).write.mode("overwrite").parquet(f"{history}/run={run}/batch={number}")

    writer = raw.writeStream.foreachBatch(save).option("checkpointLocation", state)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")
    return writer.start()
