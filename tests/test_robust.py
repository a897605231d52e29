"""The densest half against all subsets, and planted rows that one start misses."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from martlet.operators import anomaly, robust


def table(spark, x):
    names = [f"z{i}" for i in range(x.shape[1])]
    rows = [(k, *map(float, r)) for k, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names)).repartition(3), names


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_best_of_all_subsets(spark, seed):
    x = np.random.default_rng(seed).normal(size=(13, 2)) * [1, 3]
    x[:4] += 12
    df, names = table(spark, x)
    half = (13 + 2 + 2) // 2
    best = min(np.linalg.slogdet(np.cov(x[list(s)].T, bias=True))[1] for s in combinations(range(13), half))
    found = robust.densest_half(df, "id", names, starts=60)
    assert found.size == pytest.approx(best, abs=1e-9)


def planted():
    """A cloud of two fifths of the rows beside a larger one."""
    dice = np.random.default_rng(4)
    return np.concatenate([dice.normal(size=(300, 3)), dice.normal(size=(190, 3)) + [8, 8, 0]])


def test_planted_rows_that_one_start_misses(spark):
    x = planted()
    df, names = table(spark, x)
    df = df.cache()
    one = [robust.Ellipse(x.mean(axis=0), np.cov(x.T))]  # a single start from all rows
    for _ in range(20):
        one = robust.concentrated(df, names, one, 247 / 490)
    best = robust.densest_half(df, "id", names)
    assert best.size < one[0].size - 0.5
    far = lambda e: np.einsum("ij,jk,ik->i", x - e.centre, np.linalg.inv(e.covariance), x - e.centre)
    def caught(e):
        return set(np.argsort(-far(e))[:190]) >= set(range(300, 490))
    assert caught(best) and not caught(one[0])


def test_steps_never_raise_the_determinant(spark):
    df, names = table(spark, planted())
    fits = robust._starts(df, "id", names, 490, 4)
    sizes = []
    for _ in range(4):
        fits = robust.concentrated(df, names, fits, 247 / 490)
        sizes.append([f.size for f in fits])
    assert (np.diff(np.array(sizes), axis=0) <= 1e-9).all()


def test_degenerate_rows(spark):
    df, names = table(spark, np.ones((20, 2)))
    assert robust.densest_half(df, "id", names) is None
    assert robust.densest_half(df.limit(2), "id", names) is None
    flat = spark.createDataFrame([(k, 1.0, 2.0) for k in range(20)], "id long, a double, b double")
    rows = anomaly.elliptic_envelope(flat, "id", ["a", "b"]).collect()
    assert len(rows) == 20 and not any(r["is_anomaly"] for r in rows)


def test_halves_end_exactly_and_keep_ties(spark):
    x = np.random.default_rng(8).normal(size=(40_000, 2)).round(2)
    df, names = table(spark, x)
    fit = robust.Ellipse(np.array([0.1, 0.0]), np.diag([1.0, 2.0]))
    off = x - fit.centre
    far = (off @ np.linalg.inv(fit.covariance) * off).sum(axis=1)
    near = x[far <= np.sort(far)[20_001 - 1] * (1 + 1e-9)]
    (got,) = robust.concentrated(df, names, [fit], 20_001 / 40_000)
    assert got.centre == pytest.approx(near.mean(axis=0), abs=1e-12)
    assert got.covariance == pytest.approx(np.cov(near.T, bias=True), abs=1e-12)


def test_rows_go_to_python_in_blocks(spark):
    df, names = table(spark, np.random.default_rng(1).normal(size=(5000, 2)))
    blocks = robust.packed(df, names)
    assert blocks.columns == ["block"] and blocks.count() <= df.rdd.getNumPartitions()
    assert blocks.select(F.sum(F.length("block"))).first()[0] == 5000 * 2 * 8
