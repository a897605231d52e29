"""Anomalies: isolation forest, robust ellipse, one-class score."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlet.operators import robust
from martlet.operators.features import standardise
from martlet.operators.ranks import fixed_row, quantiles
from martlet.session import cut_lineage, spread_out

SEED = 42
CONTAMINATION = 0.1


def anomaly_table(df: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Key and standardised columns of the complete rows."""
    rows = standardise(df.na.drop(subset=columns), columns)
    names = [f"z_{c}" for c in columns]
    return cut_lineage(spread_out(rows.select(key, *names), key)), names


def _flag(scored: DataFrame, share: float, method: str, high: bool = True) -> DataFrame:
    """Add ``is_anomaly`` for the given share at one end of the scores."""
    limit = fixed_row(quantiles(scored, [], "score", {"q": 1 - share if high else share}))["q"]
    beyond = F.col("score") > limit if high else F.col("score") < limit
    return scored.withColumns({"is_anomaly": beyond, "method": F.lit(method)})


def _average_path(n):
    """Mean depth of an unsuccessful search among n values."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    depth = 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n > 2, depth, np.where(n == 2, 1.0, 0.0))


def _grow(tree: int, x: np.ndarray) -> pd.DataFrame:
    """Nodes of one isolation tree: (tree, node, feature, cut, left, right, path)."""
    dice = np.random.default_rng([SEED, tree])
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    rows, todo = [], [(0, np.arange(len(x)), 0)]
    count = 1
    while todo:
        node, held, depth = todo.pop()
        low, high = (x[held].min(axis=0), x[held].max(axis=0)) if len(held) else (None, None)
        open_ = np.flatnonzero(high > low) if len(held) > 1 else []
        if depth >= limit or len(open_) == 0:
            rows.append((tree, node, -1, 0.0, -1, -1, float(depth + _average_path(len(held)))))
            continue
        f = int(dice.choice(open_))
        cut = float(dice.uniform(low[f], high[f]))
        goes = x[held, f] <= cut
        rows.append((tree, node, f, cut, count, count + 1, 0.0))
        todo += [(count, held[goes], depth + 1), (count + 1, held[~goes], depth + 1)]
        count += 2
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "cut", "left", "right", "path"])


_NODES = "tree int, node int, feature int, cut double, left int, right int, path double"


def isolation_trees(table: DataFrame, key: str, columns: list[str], trees: int = 100, sample: int = 256):
    """Nodes of all trees.  Each tree sees ``sample`` rows of the whole table, the method's own parameter.

    A tree draws the rows whose hash for that tree is smallest; a threshold that about
    four times as many rows pass keeps the others out before anything is ordered.
    """
    turns = 2**30
    share = table.agg((F.lit(4.0 * sample) / F.count(F.lit(1))).alias("share")).scalar()

    turn = F.pmod(F.xxhash64("_hash", "tree"), F.lit(turns))
    drawn = (table.withColumns({"_limit": share * turns, "_hash": F.xxhash64(key)})
             .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).where(turn < F.col("_limit")))
    first = Window.partitionBy("tree").orderBy(turn, key)
    picked = drawn.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample)

    def build(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return _grow(int(keys[0]), part.sort_values("nth")[columns].to_numpy(dtype=float))

    return picked.select("tree", "nth", *columns).groupBy("tree").applyInPandas(build, _NODES)


def isolation_forest(df: DataFrame, key: str, columns: list[str], contamination: float = CONTAMINATION,
                     trees: int = 100, sample: int = 256) -> DataFrame:
    """(key, score, is_anomaly): scores near 1 are easy to isolate."""
    table, names = anomaly_table(df, key, columns)
    # at most trees * (2 * sample - 1) nodes
    forest = [g for _, g in isolation_trees(table, key, names, trees, sample).toPandas().groupby("tree")]
    packed = [[g.sort_values("node")[c].to_numpy() for c in ("feature", "cut", "left", "right", "path")]
              for g in forest]
    shared = table.sparkSession.sparkContext.broadcast(packed)
    usual = float(_average_path(min(sample, table.count())))
    key_type = dict(table.dtypes)[key]

    def score(batches):
        for batch in batches:
            x = batch[names].to_numpy(dtype=float)
            depth = np.zeros(len(x))
            for feature, cut, left, right, path in shared.value:
                at = np.zeros(len(x), dtype=int)
                while True:
                    f = feature[at]
                    inner = np.flatnonzero(f >= 0)
                    if len(inner) == 0:
                        break
                    here = at[inner]
                    goes = x[inner, f[inner]] <= cut[here]
                    at[inner] = np.where(goes, left[here], right[here])
                depth += path[at]
            mean = depth / max(len(shared.value), 1)
            yield pd.DataFrame({key: batch[key], "score": 2.0 ** (-mean / usual)})

    scored = table.mapInPandas(score, f"`{key}` {key_type}, score double")
    return _flag(cut_lineage(scored), contamination, "isolation forest")


def elliptic_envelope(df: DataFrame, key: str, columns: list[str], contamination: float = CONTAMINATION,
                      starts: int = robust.STARTS) -> DataFrame:
    """(key, score, is_anomaly): distance from the densest half of the rows (see ``robust``).

    Rows that span no volume all have score 0.
    """
    table, names = anomaly_table(df, key, columns)
    found = robust.densest_half(table, key, names, starts)
    score = F.lit(0.0) if found is None else found.distance(names)
    return _flag(table.select(key, score.alias("score")), contamination, "elliptic envelope")


def one_class(df: DataFrame, key: str, columns: list[str], share: float = CONTAMINATION,
              dimensions: int = 256) -> DataFrame:
    """(key, score, is_anomaly): similarity to the mean in a random RBF feature space.

    An approximation of a one-class SVM with an RBF kernel of width 1/p: the
    lowest scores are farthest from the bulk of the data.
    """
    table, names = anomaly_table(df, key, columns)
    p = len(names)
    dice = np.random.default_rng(SEED)
    w = dice.normal(0.0, np.sqrt(2.0 / p), (p, dimensions))  # gamma = 1/p on unit variance
    b = dice.uniform(0, 2 * np.pi, dimensions)
    key_type = dict(table.dtypes)[key]

    def features(batch):
        return np.sqrt(2.0 / dimensions) * np.cos(batch[names].to_numpy(dtype=float) @ w + b)

    def totals(batches):
        total = np.zeros(dimensions)
        for batch in batches:
            total += features(batch).sum(axis=0)
        yield pd.DataFrame({"i": np.arange(dimensions), "v": total})

    sums = table.mapInPandas(totals, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i")
    mean = np.array([r["v"] for r in sums.collect()]) / max(table.count(), 1)

    def score(batches):
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "score": features(batch) @ mean})

    scored = table.mapInPandas(score, f"`{key}` {key_type}, score double")
    return _flag(cut_lineage(scored), share, "random Fourier one-class score (approximation)", high=False)


def anomaly_summary(flagged: DataFrame) -> DataFrame:
    """Count and share per method, with a remark above 15%."""
    pct = F.count_if("is_anomaly") / F.count(F.lit(1)) * 100
    return flagged.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("is_anomaly").alias("n_anomalies"),
        pct.alias("anomaly_percentage")).withColumn("remark", F.when(
            F.col("anomaly_percentage") > 15, F.concat(
                F.lit("High anomaly rate ("), F.format_string("%.1f", F.col("anomaly_percentage")),
                F.lit("%) detected - investigate data quality"))))
