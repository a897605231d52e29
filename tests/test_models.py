"""Models, anomalies, forecasts, streams, runs: invariants and known answers."""

import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from martlet.operators import anomaly, clustering, forecast, linalg, regression
from martlet.plans import full_run
from martlet.sources import sinks
from martlet.streaming import jobs


def linear_data(spark, n=400):
    dice = np.random.default_rng(5)
    x = dice.normal(size=(n, 3)) * [1, 4, 0.5]
    y = 3 + x @ [2.0, -1.0, 5.0] + dice.normal(size=n) * 0.3
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "row_no long, a double, b double, c double, price double")
    return regression.model_data(df, split_key="row_no", extra=("a", "b", "c"))


def test_linear_models_match_their_objectives(spark):
    data = linear_data(spark)
    assert data.features == ["a", "b", "c"]
    trained = regression.train(data, regression.LINEAR)
    scaled = trained.models["ridge"].stages[:-1]
    table = data.train
    for stage in scaled:
        table = stage.transform(table)
    rows = table.select("scaled", "price").collect()
    x, y = np.array([r[0].toArray() for r in rows]), np.array([r[1] for r in rows])
    xc, yc = x - x.mean(axis=0), y - y.mean()
    ridge = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    assert trained.models["ridge"].stages[-1].coefficients.toArray() == pytest.approx(ridge, rel=1e-5)

    def descent(l1, l2):  # coordinate descent on mean squares / 2
        w = np.zeros(3)
        for _ in range(3000):
            for j in range(3):
                r = yc - xc @ w + xc[:, j] * w[j]
                g = xc[:, j] @ r / len(yc)
                w[j] = np.sign(g) * max(abs(g) - l1, 0) / (xc[:, j] @ xc[:, j] / len(yc) + l2)
        return w
    for name, l1, l2 in (("lasso", 1.0, 0.0), ("elastic_net", 0.5, 0.5)):
        got = trained.models[name].stages[-1].coefficients.toArray()
        assert got == pytest.approx(descent(l1, l2), rel=1e-4, abs=1e-5)
    metrics = {r["model"]: r["r2"] for r in regression.regression_metrics(
        regression.predict(trained, data.test), "price", regression.LINEAR).collect()}
    assert metrics["linear_regression"] > 0.95


def test_feature_table_has_few_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        data = linear_data(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert data.train.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert data.train.count() + data.test.count() == 400
    data.release()


def test_boosters_are_fitted_side_by_side(spark, monkeypatch):
    data, met = linear_data(spark), threading.Barrier(2)
    fit = regression.GBTRegressor.fit

    def waiting(self, *args):
        met.wait(60)  # passes only when both are under way
        return fit(self, *args)

    monkeypatch.setattr(regression.GBTRegressor, "fit", waiting)
    trained = regression.train(data, ("gradient_boosting", "catboost"), rounds=2)
    assert list(trained.models) == list(trained.methods) == ["gradient_boosting", "catboost"]
    assert [m.stages[-1].getMaxDepth() for m in trained.models.values()] == [3, 6]
    data.release()


def test_anomalies_find_planted_rows(spark, tmp_path):
    dice = np.random.default_rng(9)
    x = np.vstack([dice.normal(size=(380, 3)), dice.normal(size=(20, 3)) * 0.3 + 9])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    for method in (anomaly.isolation_forest, anomaly.elliptic_envelope, anomaly.one_class):
        rows = method(df, "id", ["a", "b", "c"]).collect()
        flagged = {r["id"] for r in rows if r["is_anomaly"]}
        assert len(rows) == 400 and abs(len(flagged) - 40) <= 1
        assert set(range(380, 400)) <= flagged, method.__name__
    again = {r["id"]: r["score"] for r in anomaly.isolation_forest(df.repartition(7), "id", ["a", "b", "c"]).collect()}
    first = {r["id"]: r["score"] for r in anomaly.isolation_forest(df, "id", ["a", "b", "c"]).collect()}
    assert again == pytest.approx(first)


def test_clusters(spark):
    dice = np.random.default_rng(2)
    x = np.vstack([dice.normal(c, 0.2, (40, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "price double, rating double")
    table, columns = clustering.cluster_table(df)
    scores, model = clustering.choose_k(table)
    best = scores.orderBy(F.desc("silhouette_squared_euclidean")).first()
    assert best["k"] == 3 == model.getK() and 0.8 < best["silhouette_squared_euclidean"] <= 1
    labelled = model.transform(table)
    assert sorted(r["size"] for r in clustering.cluster_sizes(labelled).collect()) == [40, 40, 40]
    assert clustering.segment_summary(labelled, columns).count() == 6
    assert clustering.choose_k(table.limit(9)) == (None, None)


def test_silhouettes_of_all_groupings_in_two_scans(spark):
    dice = np.random.default_rng(3)
    x = np.vstack([dice.normal(c, 0.5, (60, 2)) for c in ((0, 0), (5, 5), (0, 5))] + [[[40.0, 40.0]]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "price double, rating double").repartition(3)
    table, _ = clustering.cluster_table(df)
    scores, _ = clustering.choose_k(table)
    for r in scores.collect():
        labelled = clustering.KMeans(k=r["k"], seed=clustering.SEED, featuresCol="z", predictionCol="cluster").fit(table).transform(table)
        assert r["silhouette_squared_euclidean"] == pytest.approx(clustering.silhouette(labelled, "cluster"), abs=1e-9)
    blocks = clustering.packed(df, ["price", "rating"])
    assert clustering.silhouettes(blocks, {1: np.zeros((1, 2)), 2: np.array([[0.0, 0.0], [90.0, 90.0]])})[1][1] is None


def test_small_matrices(spark):
    x = np.random.default_rng(4).normal(size=(200, 4)) @ np.diag([5, 2, 1, 0.1]) + 1
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    n, sums, squares = linalg.moments_matrix(df.repartition(3), ["a", "b", "c", "d"])
    assert linalg.covariance(n, sums, squares) == pytest.approx(np.cov(x.T))
    values, _, ratio = linalg.truncated_svd(n, sums, squares, 3)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert values == pytest.approx(s[:3])
    assert ratio == pytest.approx((u * s)[:, :3].var(axis=0) / x.var(axis=0).sum())
    assert linalg.principal_components(n, sums, squares, 2)[1] == pytest.approx(
        np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2] / np.trace(np.cov(x.T)))


def test_forecast(spark):
    days = [(f"2024-01-{d:02d}", "a") for d in range(1, 29) for _ in range(d)]
    df = spark.createDataFrame(days, "day string, category string").select(
        F.to_timestamp("day").alias("scraped_at"), "category")
    rows = forecast.forecast(df).orderBy("day").collect()
    assert [r["day"] for r in rows][0] == "2024-01-29" and len(rows) == 7
    assert [r["yhat"] for r in rows] == pytest.approx(list(range(29, 36)), abs=1e-6)
    assert forecast.forecast(df, least=100).count() == 0
    assert forecast.forecast_top(df).count() == 7
    assert forecast.fit_quality(df).first()["mae"] == pytest.approx(0, abs=1e-9)


def raw_rows(day, *titles):
    return [{"title": t, "url": f"/p/{t}", "price": "€5", "scraped_at": f"2024-01-{day:02d}T00:00:00"} for t in titles]


def test_append_new_across_runs_equals_batch(spark, tmp_path):
    from martlet.schema import RAW_PRODUCT
    inbox, history, state = (str(tmp_path / n) for n in ("inbox", "history", "state"))
    (tmp_path / "inbox").mkdir()

    def drop(name, rows):
        (tmp_path / "inbox" / name).write_text("\n".join(json.dumps(r) for r in rows))

    for name, rows in (("a.json", raw_rows(1, "x", "y", "x")), ("b.json", raw_rows(2, "y", "z")), ("c.json", [])):
        drop(name, rows)
        stream = jobs.read_stream(spark, inbox, "json", RAW_PRODUCT)
        jobs.append_new(stream, history, state).awaitTermination()
    got = spark.read.parquet(history)
    assert sorted(r["title"] for r in got.collect()) == ["x", "y", "z"]
    assert got.where("price = 5.0").count() == 3


def test_append_new_with_a_fresh_checkpoint_keeps_history(spark, tmp_path):
    from martlet.schema import RAW_PRODUCT
    history = str(tmp_path / "history")
    for k, titles in enumerate((("x", "y"), ("y", "z"))):
        (tmp_path / f"in{k}").mkdir()
        (tmp_path / f"in{k}" / "a.json").write_text("\n".join(json.dumps(r) for r in raw_rows(1, *titles)))
        stream = jobs.read_stream(spark, str(tmp_path / f"in{k}"), "json", RAW_PRODUCT)
        jobs.append_new(stream, history, str(tmp_path / f"state{k}")).awaitTermination()
    got = spark.read.parquet(history)
    assert sorted(r["title"] for r in got.collect()) == ["x", "y", "z"]
    assert got.select("run").distinct().count() == 2


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "scraped_at timestamp, price double"
    (tmp_path / "in").mkdir()
    for i, days in enumerate((["2024-01-01", "2024-01-10"], ["2024-01-11"], ["2024-01-02"])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(
            json.dumps({"scraped_at": f"{d}T00:00:00Z", "price": 1.0}) for d in days))
    from pyspark.sql.types import _parse_datatype_string
    stream = jobs.read_stream(spark, str(tmp_path / "in"), "json", _parse_datatype_string(schema), maxFilesPerTrigger=1)
    rows = jobs.run_available(jobs.volume(stream, "1 day"), "update", ["start"]).collect()
    assert {r["start"][:10] for r in rows} == {"2024-01-01", "2024-01-10", "2024-01-11"}


def test_run_isolates_failing_steps(spark):
    df = spark.createDataFrame([(f"t{i}", float(i % 9 + 1), "A" if i % 2 else "B", i % 5 + 0.5) for i in range(60)],
                               "title string, price double, category string, rating double")
    results, status = full_run.run_all(df, ("quality", "statistics", "models"), models=("no_such_model",))
    got = {r["step"]: r["status"] for r in status.collect()}
    assert got == {"quality": "done", "preprocessing": "skipped", "statistics": "done", "models": "failed",
                   "insights": "skipped"}
    assert {"quality", "numeric"} <= {r["section"] for r in results.select("section").distinct().collect()}


def test_saved_models_predict_the_same(spark, tmp_path):
    from pyspark.ml import PipelineModel
    data = linear_data(spark)
    trained = regression.train(data, ("linear_regression",))
    sinks.save_models(trained.models, {"test": data.test}, str(tmp_path))
    again = PipelineModel.load(str(tmp_path / "models" / "linear_regression"))
    a = regression.predict(trained, data.test).agg(F.sum("linear_regression")).first()[0]
    assert again.transform(data.test).agg(F.sum("linear_regression")).first()[0] == pytest.approx(a)
