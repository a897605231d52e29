import numpy as np
import pytest

from martlet.operators.components import components
from martlet.operators.density import dbscan


def brute_force(x, eps, least):
    """Plain DBSCAN: core flags and the partition of the core points."""
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    label = np.full(len(x), -1)
    number = 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo = [i]
        label[i] = number
        while todo:
            p = todo.pop()
            for q in np.flatnonzero(near[p] & core & (label < 0)):
                label[q] = number
                todo.append(q)
        number += 1
    return core, label, near


@pytest.mark.parametrize("dims,chunk", [(2, 2048), (3, 8), (4, 8)])
def test_dbscan_equals_brute_force(spark, dims, chunk):
    dice = np.random.default_rng(dims)
    blobs = [dice.normal(c, 0.25, (60, dims)) for c in ([0] * dims, [2] * dims, [4] + [0] * (dims - 1))]
    x = np.vstack([*blobs, dice.uniform(-2, 6, (40, dims)), np.full((50, dims), 9.0)])
    names = [f"c{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", *names])
    got = {r["id"]: r["label"] for r in dbscan(df, names, 0.5, 5, chunk).collect()}
    core, label, near = brute_force(x, 0.5, 5)
    assert len(got) == len(x)
    pairs = {(got[i], label[i]) for i in np.flatnonzero(core)}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})
    assert all(p[0] >= 0 for p in pairs)
    for i in np.flatnonzero(~core):
        touching = {got[j] for j in np.flatnonzero(near[i] & core)}
        assert got[i] == (min(touching) if touching else -1)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102)], "u long, v long")
    nodes = spark.createDataFrame([(i,) for i in [*range(61), 100, 102, 200]], "id long")
    got = {r["id"]: r["component"] for r in components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(61))
    assert (got[100], got[102], got[200]) == (100, 100, 200)
