"""What is trending on a stream: a fading score per key over the last days.

Each key's state holds one row per day: how many events, and the sum of their values, each
faded by a factor e per day from its time to the end of its day.  Sums of days can be added
in any order, so the score does not depend on how events fall into files and batches.  A
timer per day drops it when the watermark has passed its window; the watermark lies a window
behind the newest event, so a late event still counts unless its day is past for everyone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from martlet.operators.topk import best_per_group
from martlet.session import work_path

DAY = 86_400
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FadingDays(StatefulProcessor):
    """Per key, the days of the window with their events and faded sums."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("days", "day long", "events long, faded double")

    def _row(self, key, day: int) -> pd.DataFrame:
        events, faded = self.sums.getValue((day,)) if self.sums.containsKey((day,)) else (0, 0.0)
        return pd.DataFrame({"key": [str(key[0])], "day": [day], "events": [events], "faded": [faded]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        touched = set()
        for batch in rows:
            for day, part in batch.groupby("day"):
                day = int(day)
                events, faded = self.sums.getValue((day,)) if self.sums.containsKey((day,)) else (0, 0.0)
                self.sums.updateValue((day,), (int(events) + int(part["events"].sum()), float(faded) + float(part["faded"].sum())))
                if day not in touched and not events:
                    self.handle.registerTimer((day + self.days + 1) * DAY * 1000)
                touched.add(day)
        for day in sorted(touched):
            yield self._row(key, day)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day = expiredTimerInfo.getExpiryTimeInMs() // 1000 // DAY - self.days - 1
        if self.sums.containsKey((day,)):
            self.sums.removeKey((day,))
        yield self._row(key, day)

    def close(self) -> None:
        pass


def _daily(rows: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, at, day, events, faded): a row per event, as the state adds it up."""
    at = F.col(ts).cast("timestamp")
    seconds = F.unix_micros(at) / F.lit(1e6)
    day = F.floor(seconds / DAY).cast("long")
    return rows.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("key"), at.alias("at"), day.alias("day"), F.lit(1).cast("long").alias("events"),
        (F.coalesce(F.col(value).cast("double"), F.lit(0.0)) * F.exp(-((day + 1) * DAY - seconds) / DAY)).alias("faded"))


def score(days: DataFrame, window: int) -> DataFrame:
    """(key, events, score) as of the end of the newest day, from (key, day, events, faded)."""
    newest = days.where("events > 0").agg(F.max("day").alias("d")).scalar()
    return (days.where((F.col("day") > newest - window) & (F.col("events") > 0)).groupBy("key")
            .agg(F.sum("events").alias("events"), F.sum(F.col("faded") * F.exp(F.col("day") - newest)).alias("score")))


def trending_batch(rows: DataFrame, key: str, ts: str, value: str, window: int = 7) -> DataFrame:
    """The score of all rows at once: what the stream arrives at."""
    return score(_daily(rows, key, ts, value).groupBy("key", "day").agg(F.sum("events").alias("events"), F.sum("faded").alias("faded")), window)


def trending_stream(stream: DataFrame, key: str, ts: str, value: str, window: int = 7) -> DataFrame:
    """(key, day, events, faded) whenever a key's day changes; a day without events is over."""
    timed = _daily(stream, key, ts, value).withWatermark("at", f"{window} days")
    return timed.groupBy("key").transformWithStateInPandas(
        FadingDays(window), outputStructType="key string, day long, events long, faded double", outputMode="Update", timeMode="EventTime")


def run_trending(stream: DataFrame, key: str, ts: str, value: str, window: int = 7) -> DataFrame:
    """Process what is there and return the scores."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)  # the store that holds several state variables
    out = work_path(spark, "trend-out")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    try:
        changes = trending_stream(stream, key, ts, value, window)
        changes.writeStream.outputMode("update").foreachBatch(save).option(
            "checkpointLocation", work_path(spark, "trend-state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    saved = spark.read.schema(T.StructType([*changes.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    return score(best_per_group(saved, ["key", "day"], [F.desc("batch"), F.asc("events")], 1).drop("batch", "rank"), window)
