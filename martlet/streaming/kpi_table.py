"""Key figures kept up to date by a stream.

Every micro-batch is reduced to one row of partial figures that can be merged: counts, sums,
extremes and sketches of distinct values.  It is merged with the state of the batch before
and written under its own number, so a batch that is repeated replaces itself and counts
once.  A run's state also carries what earlier runs arrived at.

Distinct counts come from HLL sketches: exact while few, within some 2 per cent beyond.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.sources import versions

#: Seconds that stored figures count as fresh, and what a caller may choose.
CACHE_SECONDS, REFRESH_SECONDS = 300, (10, 300)


def partial(rows: DataFrame, numbers: list[str], distinct: list[str]) -> DataFrame:
    """One row of figures that ``merged`` can add up."""
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for c in numbers:
        x = F.col(c).cast("double")
        aggregates += [F.count(x).alias(f"n_{c}"), F.sum(x).alias(f"sum_{c}"), F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}")]
    aggregates += [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(14)).alias(f"sketch_{c}") for c in distinct]
    return rows.agg(*aggregates)


def merged(states: DataFrame) -> DataFrame:
    """Partial rows as one."""
    how = {"rows": F.sum, "n": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "sketch": F.hll_union_agg}
    return states.agg(*[how[c.split("_")[0]](c).alias(c) for c in states.columns])


def figures(state: DataFrame) -> DataFrame:
    """The key figures of a state: rows, mean, least and greatest of each number, distinct values."""
    numbers = [c[2:] for c in state.columns if c.startswith("n_")]
    sketches = [c[7:] for c in state.columns if c.startswith("sketch_")]
    return state.select(
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
        *[e for c in numbers for e in (F.try_divide(f"sum_{c}", f"n_{c}").alias(f"avg_{c}"), F.col(f"min_{c}"), F.col(f"max_{c}"))],
        *[F.coalesce(F.hll_sketch_estimate(f"sketch_{c}"), F.lit(0)).cast("long").alias(f"distinct_{c}") for c in sketches])


def _states(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{root}/states")
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return None


def follow(stream: DataFrame, root: str, numbers: list[str], distinct: list[str], state: str,
           every: str | None = None):
    """Merge each micro-batch into the figures below ``root``; ``state`` is the run's checkpoint.

    Runs until what is there is processed, or for ever with a trigger ``every`` so long.
    """
    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        now = partial(batch, numbers, distinct)
        before = _states(spark, root)
        if before is not None:  # of this run the batch before, of every other run its last
            known = before.where((F.col("run") != run) | (F.col("batch") < number))
            mine = known.where(F.col("run") == run)
            now = merged(now.unionByName(mine.where(F.col("batch") == mine.agg(F.max("batch").alias("b")).scalar()).drop("run", "batch")))
        now.write.mode("overwrite").parquet(f"{root}/states/run={run}/batch={number}")

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def current(spark: SparkSession, root: str) -> DataFrame:
    """The figures of all runs; an empty table before the first batch."""
    states = _states(spark, root)
    if states is None:
        return spark.createDataFrame([], "rows long")
    last = states.groupBy("run").agg(F.max("batch").alias("batch"))
    return figures(merged(states.join(F.broadcast(last), ["run", "batch"], "left_semi").drop("run", "batch")))  # a row per run


def figures_as_of(spark: SparkSession, root: str, rows: DataFrame, as_of: str, numbers: list[str], distinct: list[str],
                  max_age: int = CACHE_SECONDS, force: bool = False) -> DataFrame:
    """Stored figures while they are young enough, else made anew from ``rows`` and stored.

    ``as_of`` is the time of the call; ``force`` makes them anew at any age.
    """
    cache = f"{root}/cache"
    if versions.latest(spark, cache) is not None and not force:
        stored = versions.manifest(spark, cache).orderBy(F.desc("version")).first()["as_of"]
        age = spark.range(1).select(F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.lit(stored).cast("timestamp"))).first()[0]
        if age <= max_age:
            return figures(versions.read(spark, cache, "state"))
    draft = versions.Draft(spark, cache)
    draft.write("state", partial(rows, numbers, distinct))
    draft.commit(as_of, "forced" if force else "expired")
    return figures(versions.read(spark, cache, "state"))
