"""Forests grown from blocks of rows: known splits, and figures like those of ``pyspark.ml``."""

import threading

import numpy as np
import pytest

from martlet.operators import forest, regression


def stepped(spark, n=3000):
    dice = np.random.default_rng(3)
    x = dice.uniform(size=(n, 3))
    y = 10.0 * (x[:, 0] > 0.5) + 3.0 * (x[:, 1] > 0.25) + dice.normal(size=n) * 0.1
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "row_no long, a double, b double, c double, price double")
    return regression.model_data(df, split_key="row_no", extra=("a", "b", "c"))


def test_one_tree_finds_the_steps(spark):
    data = stepped(spark)
    got = forest.grow(forest.pack(data.train, data.features, "price"), "p", trees=1, depth=2)
    assert got.feature[0, 0] == 0 and got.limits[0, 0] == pytest.approx(0.5, abs=0.04)
    assert list(got.feature[0, 1:3]) == [1, 1] and got.limits[0, 1:3] == pytest.approx([0.25, 0.25], abs=0.04)
    assert got.value[0, 3:] == pytest.approx([0, 3, 10, 13], abs=0.6)
    data.release()


def test_few_values_are_cut_between_all(spark):
    df = spark.createDataFrame([(float(k % 3), 1.0, float(k)) for k in range(300)], "a double, b double, c double")
    cuts = forest.bin_cuts(df, ["a", "b", "c"])
    assert cuts[0].tolist() == [0.5, 1.5] and cuts[1].size == 0 and len(cuts[2]) == 31


@pytest.mark.parametrize("name", regression.FORESTS)
def test_many_rows_give_a_forest_like_that_of_few(spark, monkeypatch, name):
    data = stepped(spark)
    few = regression.price_models(data, (name,), cv_folds=None, trees=20).first()
    monkeypatch.setattr(regression, "FOREST_ROWS", 0)
    monkeypatch.setattr(regression.RandomForestRegressor, "fit", None)  # what takes too long on many rows is not used
    many = regression.price_models(data, (name,), cv_folds=None, trees=20).first()
    assert many["r2"] == pytest.approx(few["r2"], abs=0.02) and many["method"] != few["method"]
    found = regression.feature_importance(regression.train(data, (name,), trees=20), data).collect()
    assert [r["feature"] for r in found] == ["a", "b", "c"] and sum(r["importance"] for r in found) == pytest.approx(1)
    data.release()


def test_a_constant_label_is_predicted(spark):
    df = spark.createDataFrame([(i, float(i), 7.0) for i in range(50)], "row_no long, a double, price double")
    data = regression.model_data(df, split_key="row_no", extra=("a",))
    model = forest.grow(forest.pack(data.train, data.features, "price"), "p", trees=3)
    assert (model.value[:, -1] == 7.0).all() and model.featureImportances.toArray().sum() == 0
    data.release()


def test_boosters_have_local_properties_of_their_own(spark, monkeypatch):
    data, met, seen = stepped(spark, 200), threading.Barrier(2), {}

    def fit(self, rows):
        name = self.getPredictionCol()
        spark.sparkContext.setLocalProperty("booster", name)
        met.wait(60)
        seen[name] = spark.sparkContext.getLocalProperty("booster")
        return regression.RandomForestRegressor(numTrees=1, maxDepth=1, labelCol="price", predictionCol=name).fit(rows)

    monkeypatch.setattr(regression.GBTRegressor, "fit", fit)
    regression.train(data, ("gradient_boosting", "catboost"), rounds=2)
    assert seen == {"gradient_boosting": "gradient_boosting", "catboost": "catboost"}
    data.release()
