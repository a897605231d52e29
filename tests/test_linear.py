"""Linear models from moments against direct solutions on the rows."""

import numpy as np
import pytest

from martlet.operators import linear, regression


@pytest.fixture(scope="module")
def rows(spark):
    dice = np.random.default_rng(3)
    x = dice.normal(size=(500, 4)) * [1, 20, 0.1, 3] + [1000, -5, 0, 7]
    x[:, 3] = 2  # no spread
    y = 500 + x[:, :3] @ [2.0, -0.5, 30.0] + dice.normal(size=500) * 2
    fold = np.arange(500) % 5
    df = spark.createDataFrame([(*map(float, r), float(t), int(k)) for r, t, k in zip(x, y, fold)], "a double, b double, c double, d double, y double, fold int")
    return df.repartition(6), x, y, fold


FEATURES = ["a", "b", "c", "d"]


def scaled(x):
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    return (x - q[1]) / np.where(q[2] > q[0], q[2] - q[0], 1)


def direct(name, z, y):
    """Weights and intercept by other means than the operator: normal equations, or steps along the gradient."""
    zc, yc = z - z.mean(axis=0), y - y.mean()
    alpha, share = linear.PENALTIES[name]
    if not share:
        w = np.linalg.pinv(zc.T @ zc + alpha * np.eye(z.shape[1])) @ zc.T @ yc
    else:
        w, step = np.zeros(z.shape[1]), 1 / np.linalg.norm(zc.T @ zc / len(y) + alpha * np.eye(z.shape[1]), 2)
        for _ in range(20000):
            w = w - step * (zc.T @ (zc @ w - yc) / len(y) + alpha * (1 - share) * w)
            w = np.sign(w) * np.maximum(np.abs(w) - step * alpha * share, 0)
    return w, y.mean() - z.mean(axis=0) @ w


def test_every_fold_of_every_model(rows):
    df, x, y, fold = rows
    z = scaled(x)
    got = {r["model"]: r for r in linear.cross_validated(df, FEATURES, "y").collect()}
    assert got.keys() == linear.PENALTIES.keys()
    for name in got:
        scores = []
        for k in range(5):
            w, b = direct(name, z[fold != k], y[fold != k])
            off = y[fold == k] - z[fold == k] @ w - b
            scores.append(1 - (off @ off) / ((y[fold == k] - y[fold == k].mean()) ** 2).sum())
        assert got[name]["cv_r2_mean"] == pytest.approx(np.mean(scores), abs=1e-8)
        assert got[name]["cv_r2_std"] == pytest.approx(np.std(scores), abs=1e-8)


def test_prediction_over_raw_columns(rows):
    df, x, y, fold = rows
    s = linear.scaling(df, FEATURES, "y")
    whole = sum(linear.fold_moments(df, s).values())
    assert whole[0, 0] == 500
    for name in linear.PENALTIES:
        fit = linear.solve(name, whole)
        w, b = direct(name, scaled(x), y)
        found = sorted(r[0] for r in df.select(fit.expression(s)).collect())
        assert found == pytest.approx(sorted(scaled(x) @ w + b), rel=1e-7)


def test_degenerate_tables(spark):
    one = spark.createDataFrame([(1.0, 5.0, 0)] * 3, "a double, y double, fold int")
    assert linear.cross_validated(one, ["a"], "y").count() == 0  # one fold
    flat = spark.createDataFrame([(float(k), 5.0, k % 2) for k in range(6)], "a double, y double, fold int")
    assert linear.cross_validated(flat, ["a"], "y").count() == 0  # nothing to explain


def test_price_models_judge_lines_and_trees_together(spark):
    dice = np.random.default_rng(5)
    x = dice.normal(size=(300, 3)) * [1, 4, 0.5]
    y = 3 + x @ [2.0, -1.0, 5.0] + dice.normal(size=300) * 0.3
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "row_no long, a double, b double, c double, price double")
    data = regression.model_data(df, split_key="row_no", extra=("a", "b", "c"))
    table = {r["model"]: r for r in regression.price_models(data, ("linear_regression", "random_forest", "lasso"), cv_folds=3, trees=5).collect()}
    assert list(table) == ["linear_regression", "random_forest", "lasso"]
    assert table["linear_regression"]["r2"] > 0.95 and table["linear_regression"]["cv_r2_mean"] > 0.95
    assert all(r["cv_r2_std"] is not None and r["mae"] <= r["rmse"] for r in table.values())
    assert "moments" in table["lasso"]["method"]
    data.release()


def test_features_are_kept_before_they_are_looked_at(spark, monkeypatch):
    from martlet.operators import regression
    seen, plain = [], regression.useful_columns
    monkeypatch.setattr(regression, "useful_columns", lambda df, names: seen.append(df.storageLevel.useMemory) or plain(df, names))
    rows = [(k, float(k), float(k % 5) if k % 3 else None, 4 if k % 2 else None) for k in range(60)]
    data = regression.model_data(spark.createDataFrame(rows, "id long, price double, rating double, reviews_count int"), split_key="id")
    assert seen == [True]
    assert "rating" in data.features and "reviews_count" not in data.features  # one value beside missing ones is no feature
    assert data.train.where("rating IS NULL").count() == 0
    data.release()
