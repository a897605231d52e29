"""Nearest neighbours against all pairs, with copies and hot features."""

import numpy as np
import pytest

from martlet.operators import recommend, similarity
from martlet.operators.similarity import most_similar


def vectors(kind, n=160):
    """Rows of sparse unit vectors."""
    dice = np.random.default_rng(len(kind))
    m = np.zeros((n, 30))
    if kind == "copies":  # a third of the rows are one vector
        base = dice.random((n, 30)) * (dice.random((n, 30)) < 0.2)
        base[: n // 3] = base[0] + 0.1
        m = base
    elif kind == "hot":  # one feature in every row, the rest rare
        m[:, 0] = dice.random(n) + 0.05
        m[np.arange(n), dice.integers(1, 30, n)] = dice.random(n)
    elif kind == "lonely":  # rows with nothing in common
        m[np.arange(n), np.arange(n) % 30] = 1
        m[:5] = 0
        m[0, 29] = 1
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length > 0, length, 1)


@pytest.mark.parametrize("kind", ["copies", "hot", "lonely"])
@pytest.mark.parametrize("chunk", [16, 1024])
def test_equals_all_pairs(spark, kind, chunk):
    m, k = vectors(kind), 7
    rows = [(int(i), f"f{j}", float(m[i, j])) for i, j in zip(*np.nonzero(m))]
    df = spark.createDataFrame(rows, "product_id long, feature string, weight double").repartition(5)
    got = {}
    for r in most_similar(df, "product_id", k, chunk=chunk).collect():
        got.setdefault(r["product_id"], []).append((r["rank"], r["neighbour"], r["similarity"]))
    sims = np.round(m @ m.T, 6)
    for i in range(len(m)):
        want = sorted(((-sims[i, j], j) for j in range(len(m)) if j != i and sims[i, j] > 0))[:k]
        have = sorted(got.get(i, []))
        assert [h[1] for h in have] == [w[1] for w in want], (kind, i)
        assert [h[2] for h in have] == pytest.approx([-w[0] for w in want], abs=2e-6)


def test_rows_are_sent_to_few_spans(spark):
    n, chunk = 320, 8
    rows = [(f"p{i}", i, [0, 1 + i], [0.6, 0.8], 2) for i in range(n)]  # one feature in every row
    probes = spark.createDataFrame(rows, "pid string, first_key long, ids array<int>, weights array<double>, prefix int")
    for side in similarity._sides(probes, chunk):
        assert side.count() <= n * (similarity.PARTS + 4)  # n * n / chunk = 40 a row if spans were of one chunk


def products(spark, rows):
    return spark.createDataFrame(
        rows, "product_id long, title string, brand string, category string, price double, rating double, "
              "reviews_count long, url string")


def test_recommendations_of_tiny_and_unknown(spark):
    one = products(spark, [(1, "red ring", "A", "X", 1.0, 4.0, 3, "u")])
    assert recommend.similar_products(one, 5, "hybrid").count() == 0
    three = products(spark, [(1, "red ring", "A", "X", 1.0, 4.0, 3, "u"), (2, "red ring", "A", "X", None, 4.0, 3, "u"),
                             (3, "blue bolt", "B", "Y", 9.0, None, 9, "u")])
    edges = recommend.similar_products(three, 5, "collaborative")
    assert edges.where("product_id = 99").count() == 0
    best = {r["product_id"]: r["neighbour"] for r in edges.where("rank = 1").collect()}
    assert (best[1], best[2]) == (2, 1)
    bare = three.drop("title", "brand", "category")
    assert {r["method"] for r in recommend.similar_products(bare, 2, "hybrid").collect()} == {"collaborative"}


def test_only_rows_that_can_be_near_are_multiplied(monkeypatch):
    import pandas as pd
    multiplied, dense = [], similarity._dense
    monkeypatch.setattr(similarity, "_dense", lambda ids, weights, columns: multiplied.append(len(ids)) or dense(ids, weights, columns))

    def side(name, rows):
        return pd.DataFrame(rows, columns=[f"{name}_{c}" for c in ("pid", "first_key", "ids", "weights", "prefix", "least")])
    probes = side("pc", [("p0", 0, [0, 9], [0.8, 0.6], 1, 0.5), ("p1", 1, [1, 9], [0.8, 0.6], 1, 0.5)])
    postings = side("dc", [(f"p{i}", i, [i % 60, 9], [0.8, 0.6], 1, 0.5) for i in range(240)])
    got = similarity._score(2, 1)((0, 0, 0), probes, postings)
    assert set(zip(got["pid_a"], got["pid_b"], got["sim"])) == {
        (f"p{a}", f"p{b}", 1.0) for a in (0, 1) for b in (a + 60, a + 120, a + 180)}
    assert sum(multiplied) <= 2 + 2 * 4  # each probe, and the rows that share its rare feature


def test_best_spots_of_equals_are_the_first():
    row, spot, sim = similarity._best_spots(np.array([1, 0, 0, 0, 1]), np.array([4, 9, 2, 5, 1]), np.array([0.1, 0.5, 0.5, 0.7, 0.3]), 2)
    assert list(zip(row, spot, sim)) == [(0, 5, 0.7), (0, 2, 0.5), (1, 1, 0.3), (1, 4, 0.1)]
