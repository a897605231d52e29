"""DBSCAN on a grid.

Points are put in cells so small that any two points of a cell are neighbours.
A cell with enough points then consists of core points and is one node of the
cluster graph, however many points it holds; only points of thin cells, of which
each has fewer than ``min_samples``, look up their neighbours.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.operators.components import components
from martlet.operators.features import value_codes
from martlet.session import cut_lineage

_EDGE = 1e-9  # slack of box tests only; distances are compared exactly


def _square(c):
    return c * c


def _near(columns, eps: float, a: str, b: str):
    parts = [_square(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in columns]
    return reduce(lambda x, y: x + y, parts) <= eps * eps


def _coarse(columns, side: float):
    """Coarse cells of up to three columns: blocks of small cells at least ``eps`` wide."""
    block = ceil(sqrt(len(columns)))
    return [F.floor(F.floor(F.col(c) / side) / block).alias(f"g{i}") for i, c in enumerate(columns[:3])]


def _around(df: DataFrame, n: int) -> DataFrame:
    """Every row once per coarse cell around its own."""
    for i in range(n):
        df = df.withColumn(f"g{i}", F.explode(F.array(*[F.col(f"g{i}") + d for d in (-1, 0, 1)])))
    return df


def _linked(eps: float):
    def linked(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"u": [], "v": []})
        a = np.stack(left["a_at"].to_numpy())
        b = np.stack(right["b_at"].to_numpy())
        low, high = b.min(axis=0), b.max(axis=0)
        gap = np.maximum(np.maximum(low - a, a - high), 0)
        a = a[(gap ** 2).sum(axis=1) <= eps * eps + _EDGE]
        hit = False
        for start in range(0, len(a), 512):
            part = a[start:start + 512]
            square = sum((part[:, None, j] - b[None, :, j]) ** 2 for j in range(b.shape[1]))
            if (square <= eps * eps).any():
                hit = True
                break
        return pd.DataFrame({"u": [key[0]], "v": [key[1]]} if hit else {"u": [], "v": []})
    return linked


def _touching_cells(core: DataFrame, columns, eps: float) -> DataFrame:
    """(u, v, sure, sizes): cells whose boxes of core points are within ``eps``.

    ``sure`` when one known point of each already is.
    """
    dims = len(columns[:3])
    grid = [f"g{i}" for i in range(dims)]
    cells = core.groupBy("cell", *grid).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.array(*columns)).alias("one"),
        *[F.min(c).alias(f"low_{c}") for c in columns], *[F.max(c).alias(f"high_{c}") for c in columns])
    cells = cut_lineage(cells)
    a, b = _around(cells, dims).alias("a"), cells.alias("b")
    gaps = [_square(F.greatest(F.lit(0.0), F.col(f"a.low_{c}") - F.col(f"b.high_{c}"),
                               F.col(f"b.low_{c}") - F.col(f"a.high_{c}"))) for c in columns]
    same = reduce(lambda x, y: x & y, [F.col(f"a.{g}") == F.col(f"b.{g}") for g in grid])
    reach = reduce(lambda x, y: x + y, gaps) <= eps * eps + _EDGE
    pairs = a.join(b, same & (F.col("a.cell") < F.col("b.cell")) & reach)
    one = [_square(F.get("a.one", F.lit(i)) - F.get("b.one", F.lit(i))) for i in range(len(columns))]
    sure = reduce(lambda x, y: x + y, one) <= eps * eps
    return cut_lineage(pairs.select(
        F.col("a.cell").alias("u"), F.col("b.cell").alias("v"), sure.alias("sure"),
        F.col("a.n").alias("u_n"), F.col("b.n").alias("v_n")))


def _checked(pairs: DataFrame, core: DataFrame, columns, eps: float, chunk: int) -> DataFrame:
    """Those (u, v) of ``pairs`` that hold core points no farther apart than ``eps``.

    Small pairs are one join with the distance as its condition.  Large ones are
    decided chunk against chunk: a task sees at most ``chunk`` points of each cell
    and returns one row.
    """
    small = F.col("u_n") * F.col("v_n") <= chunk
    a = pairs.where(small).select("u", "v").join(core.alias("a"), F.col("u") == F.col("a.cell"))
    hits = a.join(core.alias("b"), (F.col("v") == F.col("b.cell")) & _near(columns, eps, "a", "b"))
    points = core.select("cell", F.array(*columns).alias("at"), F.xxhash64(*columns).alias("h"))
    large = pairs.where(~small).withColumns(
        {f"{x}_chunks": F.ceil(F.col(f"{x}_n") / chunk).cast("int") for x in "uv"})

    def side(name: str, mine: str, other: str):
        own = F.pmod(F.col("h"), F.col(f"{mine}_chunks")).cast("int")
        return large.join(points, F.col(mine) == F.col("cell")).select(
            F.col("u").alias(f"{name}_u"), F.col("v").alias(f"{name}_v"), F.col("at").alias(f"{name}_at"),
            own.alias(f"{name}_c{mine}"),
            F.explode(F.sequence(F.lit(0), F.col(f"{other}_chunks") - 1)).alias(f"{name}_c{other}"))

    left, right = side("a", "u", "v"), side("b", "v", "u")
    big = (left.groupBy("a_u", "a_v", "a_cu", "a_cv").cogroup(right.groupBy("b_u", "b_v", "b_cu", "b_cv"))
           .applyInPandas(_linked(eps), "u long, v long"))
    return hits.select("u", "v").union(big).distinct()


def _connected_cells(core: DataFrame, columns, eps: float, chunk: int) -> DataFrame:
    """(id, component) of the cells.  Pairs already joined through sure links are
    not looked at point by point."""
    pairs = _touching_cells(core, columns, eps)
    first = cut_lineage(components(core.select(F.col("cell").alias("id")).distinct(),
                                   pairs.where("sure").select("u", "v")))
    ends = [first.select(F.col("id").alias(x), F.col("component").alias(f"{x}_c")) for x in "uv"]
    open_ = pairs.where(~F.col("sure")).join(ends[0], "u").join(ends[1], "v").where("u_c <> v_c")
    open_ = cut_lineage(open_)
    if open_.isEmpty():
        return first
    found = _checked(open_, core, columns, eps, chunk)
    links = found.join(open_.select("u", "v", "u_c", "v_c"), ["u", "v"]).select(
        F.col("u_c").alias("u"), F.col("v_c").alias("v"))
    merged = components(first.select(F.col("component").alias("id")).distinct(), links)
    return first.join(merged.select(F.col("id").alias("component"), F.col("component").alias("whole")),
                      "component").select("id", F.col("whole").alias("component"))


def dbscan(df: DataFrame, columns: list[str], eps: float = 0.5, min_samples: int = 5,
           chunk: int = 2048) -> DataFrame:
    """The rows of ``df`` with ``label``: a cluster number from 0, or -1 for noise.

    Cluster numbers follow the smallest cell id; a border point near several
    clusters joins the one with the smallest number.
    """
    columns = list(columns)
    dims = len(columns[:3])
    grid = [f"g{i}" for i in range(dims)]
    side = eps / sqrt(len(columns))
    plain = df.withColumns({c: F.col(c).cast("double") + F.lit(0.0) for c in columns})
    points = plain.groupBy(*columns).agg(F.count(F.lit(1)).alias("times"))
    points = points.select("*", F.xxhash64(*[F.floor(F.col(c) / side) for c in columns]).alias("cell"),
                           *_coarse(columns, side))
    weight = points.groupBy("cell").agg(F.sum("times").alias("held"))
    points = cut_lineage(points.join(weight, "cell").withColumn("dense", F.col("held") >= min_samples))

    same_grid = reduce(lambda x, y: x & y, [F.col(f"a.{g}") == F.col(f"b.{g}") for g in grid])
    thin = points.where(~F.col("dense"))
    probes = _around(thin, dims).alias("a")
    around = probes.join(points.alias("b"), same_grid & _near(columns, eps, "a", "b"))
    counted = around.groupBy(*[F.col(f"a.{c}").alias(c) for c in columns]).agg(
        F.sum("b.times").alias("neighbours")).where(F.col("neighbours") >= min_samples).drop("neighbours")
    core = points.where("dense").select(*columns, "cell", *grid).unionByName(
        thin.join(counted, columns, "left_semi").select(*columns, "cell", *grid))
    core = cut_lineage(core)
    found = cut_lineage(_connected_cells(core, columns, eps, chunk))
    numbers = value_codes(found, "component").select(
        F.col("value").alias("component"), F.col("code").cast("int").alias("label"))
    cell_label = found.join(numbers, "component").select(F.col("id").alias("cell"), "label")
    core_label = cut_lineage(core.join(cell_label, "cell"))
    rest = thin.join(core.select(*columns), columns, "left_anti")
    border = _around(rest, dims).alias("a").join(
        core_label.alias("b"), same_grid & _near(columns, eps, "a", "b")).groupBy(
        *[F.col(f"a.{c}").alias(c) for c in columns]).agg(F.min("b.label").alias("label"))
    labels = core_label.select(*columns, "label").unionByName(border)
    return plain.join(labels, columns, "left").withColumn("label", F.coalesce("label", F.lit(-1)))


def density_summary(labelled: DataFrame) -> DataFrame:
    """Number of clusters, noise points and their share."""
    noise = F.count_if(F.col("label") == -1)
    return labelled.agg(
        F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_clusters"),
        noise.alias("n_outliers"), (noise / F.count(F.lit(1)) * 100).alias("outlier_percentage"))
