"""Key figures merged batch by batch, and the fading score, against all rows at once."""

import random

import pytest
from pyspark.sql import functions as F

from martlet.streaming import jobs, kpi_table, trend

KPI = "price double, rating double, brand string, category string"
NUMBERS, NAMES = ["price", "rating"], ["brand", "category"]


def listing(k):
    return (float(k % 90) if k % 11 else None, (k % 50) / 10, f"brand{k % 37}" if k % 13 else None, f"kind{k % 8}")


def plain(rows):
    out = {"rows": len(rows)}
    for i, c in enumerate(NUMBERS):
        found = [r[i] for r in rows if r[i] is not None]
        out |= {f"avg_{c}": sum(found) / len(found), f"min_{c}": min(found), f"max_{c}": max(found)}
    return out | {f"distinct_{c}": len({r[i + 2] for r in rows} - {None}) for i, c in enumerate(NAMES)}


def written(spark, rows, folder, files):
    for k in range(files):
        spark.createDataFrame(rows[k::files], KPI).coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, folder):
    return jobs.read_stream(spark, folder, "parquet", spark.createDataFrame([], KPI).schema, "*.parquet", maxFilesPerTrigger=1)


def test_figures_of_two_runs_and_a_repeated_batch(spark, tmp_path):
    first, second = [listing(k) for k in range(300)], [listing(7 * k + 1) for k in range(120)]
    root, a, b = f"{tmp_path}/kpi", f"{tmp_path}/a", f"{tmp_path}/b"
    assert kpi_table.current(spark, root).count() == 0
    written(spark, first[:200], a, 3)
    kpi_table.follow(stream_of(spark, a), root, NUMBERS, NAMES, f"{tmp_path}/state-a").awaitTermination()
    assert kpi_table.current(spark, root).first().asDict() == pytest.approx(plain(first[:200]))
    written(spark, first[200:], a, 2)  # the run goes on from its checkpoint
    kpi_table.follow(stream_of(spark, a), root, NUMBERS, NAMES, f"{tmp_path}/state-a").awaitTermination()
    written(spark, second, b, 2)  # another run adds to it
    kpi_table.follow(stream_of(spark, b), root, NUMBERS, NAMES, f"{tmp_path}/state-b").awaitTermination()
    assert kpi_table.current(spark, root).first().asDict() == pytest.approx(plain(first + second))
    # a batch whose end was not recorded is done again and counts once
    commits = sorted((tmp_path / "state-a" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    kpi_table.follow(stream_of(spark, a), root, NUMBERS, NAMES, f"{tmp_path}/state-a").awaitTermination()
    assert kpi_table.current(spark, root).first().asDict() == pytest.approx(plain(first + second))


def test_stored_figures_age(spark, tmp_path):
    root, old, new = str(tmp_path), [listing(k) for k in range(50)], [listing(k) for k in range(80)]
    tables = [spark.createDataFrame(r, KPI) for r in (old, new)]

    def asked(k, at, **how):
        return kpi_table.figures_as_of(spark, root, tables[k], at, NUMBERS, NAMES, **how).first()["rows"]

    assert asked(0, "2024-01-01 10:00:00") == 50
    assert asked(1, "2024-01-01 10:05:00") == 50  # 300 seconds: still fresh
    assert asked(1, "2024-01-01 10:01:00", force=True) == 80
    assert asked(0, "2024-01-01 10:04:00") == 80
    assert asked(0, "2024-01-01 10:06:01") == 50
    assert asked(1, "2024-01-01 10:06:20", max_age=10) == 80


def test_partial_rows_of_nothing(spark):
    empty = kpi_table.partial(spark.createDataFrame([], KPI), NUMBERS, NAMES)
    whole = kpi_table.partial(spark.createDataFrame([listing(3)], KPI), NUMBERS, NAMES)
    assert kpi_table.figures(empty).first()["rows"] == 0
    assert kpi_table.figures(kpi_table.merged(empty.union(whole))).first().asDict() == pytest.approx(plain([listing(3)]))


@pytest.mark.parametrize("seed", [1, 2])
def test_score_of_a_stream_in_any_order(spark, tmp_path, seed):
    events = [(f"2024-01-{1 + k % 20:02d} {k % 24:02d}:{k % 60:02d}:00", f"p{k % 9}", None if k % 17 == 0 else float(k % 5)) for k in range(200)]
    events += [(None, "p1", 4.0), ("2024-01-20 12:00:00", None, 4.0)]
    events.sort(key=lambda e: str(e[0])[:9])  # files by stretches of days, which the seed puts in another order
    random.Random(seed).shuffle(events)
    schema = "ts string, product string, value double"
    for part in range(4):
        spark.createDataFrame(events[part::4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.read_stream(spark, f"{tmp_path}/in", "parquet", spark.createDataFrame([], schema).schema, "*.parquet", maxFilesPerTrigger=1)
    got = {r["key"]: (r["events"], r["score"]) for r in trend.run_trending(stream, "product", "ts", "value").collect()}
    whole = spark.createDataFrame(events, schema)
    want = {r["key"]: (r["events"], r["score"]) for r in trend.trending_batch(whole, "product", "ts", "value").collect()}
    assert got.keys() == want.keys() == {f"p{k}" for k in range(9)}
    for k, (n, score) in want.items():
        assert got[k] == (n, pytest.approx(score))
    end = 20 * 86400
    plainly = {}
    for at, product, value in events:
        if at and product and int(at[8:10]) > 13:
            seconds = int(at[8:10]) * 86400 - 86400 + int(at[11:13]) * 3600 + int(at[14:16]) * 60
            n, total = plainly.get(product, (0, 0.0))
            plainly[product] = n + 1, total + (value or 0.0) * 2.718281828459045 ** (-(end - seconds) / 86400)
    assert {k: (n, pytest.approx(v)) for k, (n, v) in plainly.items()} == want


def test_days_past_the_window_leave_the_state(spark, tmp_path):
    schema = "ts string, product string, value double"
    for day in (1, 2, 15, 30):
        spark.createDataFrame([(f"2024-01-{day:02d} 10:00:00", f"p{day}", 1.0), (f"2024-01-{day:02d} 11:00:00", "all", 2.0)], schema).coalesce(1).write.mode(
            "append").parquet(f"{tmp_path}/in/day={day:02d}")
    stream = jobs.read_stream(spark, f"{tmp_path}/in", "parquet", spark.createDataFrame([], schema).schema, "*.parquet", maxFilesPerTrigger=1)
    seen = []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", trend.ROCKS)
    changes = trend.trending_stream(stream.select(*[F.col(c) for c in ("ts", "product", "value")]), "product", "ts", "value")
    changes.writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend(map(tuple, b.collect()))).option(
        "checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    ended = {(k, day) for k, day, n, _ in seen if n == 0}
    first = 19723  # 2024-01-01 in days
    assert {("p1", first), ("p2", first + 1), ("all", first), ("all", first + 1)} <= ended and ("p30", first + 29) not in ended


def test_batches_of_several_files(spark, tmp_path):
    from types import SimpleNamespace

    from martlet.workload import streams
    rows = spark.range(4000).selectExpr("id", "id % 7 AS v")
    seen = []
    query = (streams._in_files(SimpleNamespace(spark=spark), rows, 2, "several").writeStream
             .foreachBatch(lambda batch, number: seen.append(
                 (batch.select(F.input_file_name()).distinct().count(), batch.count())))
             .option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start())
    query.awaitTermination()
    assert [files for files, _ in seen] == [2, 2] and sum(n for _, n in seen) == 4000  # 4 shuffle partitions
