"""Queries: streaming forms, each run over the whole file and returned as a table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from martlet.session import work_path
from martlet.streaming import jobs, kpi_table, trend
from martlet.workload.registry import query
from martlet.workload.views import VIEWS


def _stream(t, name: str):
    return jobs.read_stream(t.spark, t.sf_dir, "parquet", getattr(t, name).schema, f"{name}.parquet")


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS "count",
       avg(value) AS avg_value FROM events GROUP BY 1""", "avg_value")
def stream_daily_volume(t):
    return jobs.run_available(jobs.volume(_stream(t, "events"), "1 day", "ts", "value"), "complete")


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS "count",
       avg(value) AS avg_value FROM events GROUP BY 1""", "avg_value")
def stream_hourly_volume(t):
    stream = jobs.volume(_stream(t, "events"), "1 hour", "ts", "value")
    return jobs.run_available(stream, "update", ["start"])


@query("""SELECT strftime(CAST(ts AS DATE) - CAST(d AS INT), '%Y-%m-%d') AS start, event_type,
       count(*) AS "count", avg(value) AS avg_value FROM events, range(7) AS g(d) GROUP BY 1, 2""", "avg_value")
def stream_weekly_activity(t):
    stream = jobs.activity(_stream(t, "events"), "event_type", "ts", "value")
    return jobs.run_available(stream, "update", ["start", "event_type"])


def _in_files(t, df, batches: int, label: str):
    """A stream of ``df`` in so many batches, each of as many files as a shuffle has parts to share."""
    path = work_path(t.spark, label)
    each = max(1, int(t.spark.conf.get("spark.sql.shuffle.partitions")) // batches)
    df.repartition(batches * each, "user_id" if "user_id" in df.columns else df.columns[0]).write.parquet(path)
    return jobs.read_stream(t.spark, path, "parquet", df.schema, "*.parquet", maxFilesPerTrigger=each)


@query("SELECT DISTINCT event_type, CAST(user_id % 7 AS INT) AS class FROM events")
def stream_without_repeats(t):
    classes = t.events.select("user_id", "event_type", F.expr("CAST(user_id % 7 AS INT)").alias("class"))
    stream = jobs.without_repeats(_in_files(t, classes, 5, "repeats"), ["event_type", "class"])
    return jobs.run_available(stream.select("event_type", "class"), "append")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_users_without_repeats(t):
    """Keys in state grow with the users, unlike the classes of ``stream_without_repeats``."""
    stream = jobs.without_repeats(_in_files(t, t.events.select("user_id", "event_type"), 5, "repeats"), ["user_id", "event_type"])
    return jobs.run_available(stream.select("user_id", "event_type"), "append")


@query("SELECT DISTINCT concat('/p/', l_partkey) AS url, trim(p_name) AS title FROM lineitem JOIN part ON l_partkey = p_partkey")
def stream_history_of_runs(t):
    """Two runs with checkpoints of their own over the same rows: the second adds nothing, the first stays."""
    raw = t.spark.sql("SELECT concat('/p/', l_partkey) AS url, p_name AS title, l_extendedprice AS price, l_shipdate AS scraped_at "
                      "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey", lineitem=t.lineitem, part=t.part)
    history = work_path(t.spark, "history")
    for run in range(2):
        stream = _in_files(t, raw.where("price < 30000") if run == 0 else raw, 3, "raw")
        jobs.append_new(stream, history, work_path(t.spark, "history-state"), ("scraped_at", "price")).awaitTermination()
    return t.spark.read.parquet(history).select("url", "title")


@query("""WITH n AS (SELECT floor(epoch(max(ts)) / 86400) AS d FROM events)
SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS events,
       sum(coalesce(value, 0) * exp(-((d + 1) * 86400 - epoch(ts)) / 86400)) AS score
FROM events, n WHERE floor(epoch(ts) / 86400) > d - 7 AND user_id IS NOT NULL GROUP BY 1""", "score")
def stream_trending_scores(t):
    return trend.run_trending(_in_files(t, t.events, 4, "trend"), "user_id", "ts", "value")


@query("""SELECT count(*) AS rows, avg(price) AS avg_price, min(price) AS min_price, max(price) AS max_price, avg(rating) AS avg_rating,
       min(rating) AS min_rating, max(rating) AS max_rating, count(DISTINCT category) AS distinct_category,
       count(DISTINCT brand) AS distinct_brand FROM listings""", "avg_price min_price max_price avg_rating min_rating max_rating")
def refreshed_kpi_table(t):
    """Two runs over several files each; the figures are those of all rows."""
    root = work_path(t.spark, "kpi")
    rows = t.listings.select("listing_id", "price", "rating", "category", "brand", "scraped_at")
    for k, part in enumerate(("scraped_at < '1998-01-01'", "NOT coalesce(scraped_at < '1998-01-01', false)")):
        stream = _in_files(t, rows.where(part), 3, "kpi-in")
        kpi_table.follow(stream, root, ["price", "rating"], ["category", "brand"], work_path(t.spark, f"kpi-{k}")).awaitTermination()
    return kpi_table.current(t.spark, root)


@query()
def stream_kpis(t):
    return jobs.run_available(jobs.kpis(_stream(t, "events"), "event_type", "user_id", value="value"), "complete")


@query("""SELECT CAST(epoch(TIMESTAMP '2024-01-31' - date_trunc('second', max(ts))) AS BIGINT) AS age_seconds,
       CASE WHEN epoch(TIMESTAMP '2024-01-31' - max(ts)) < 300 THEN 'fresh'
            WHEN epoch(TIMESTAMP '2024-01-31' - max(ts)) < 1800 THEN 'moderate' ELSE 'stale' END AS freshness
FROM events""")
def stream_staleness(t):
    return jobs.staleness(t.events, F.lit("2024-01-31"), "ts")


@query("""SELECT url, regexp_replace(trim(title), '\\s+', ' ', 'g') AS title, count(*) AS n FROM (
  SELECT DISTINCT url, title FROM raw_products) GROUP BY 1, 2""")
def stream_validated_history(t):
    sql = re.sub(r"(FROM|JOIN) (lineitem|part)\b", r"\1 {\2}", VIEWS["raw_products"])
    raw = t.spark.sql(sql, lineitem=_stream(t, "lineitem"), part=t.part)
    history, state = work_path(t.spark, "history"), work_path(t.spark, "history-state")
    jobs.append_new(raw, history, state, ("scraped_at", "price")).awaitTermination()
    return t.spark.read.parquet(history).groupBy("url", "title").agg(F.count(F.lit(1)).alias("n"))
