"""Small matrices from large tables: second moments by partial sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments_matrix(df: DataFrame, columns: list[str]):
    """(n, sums, X'X) of numeric columns without missing values.

    Every task sends one p x p block; the driver gets p x p numbers.
    """
    p = len(columns)

    def partial(batches):
        total = np.zeros((p + 1, p + 1))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), batch[columns].to_numpy(dtype=float)])
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    blocks = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(
        partial, "i int, j int, v double")
    full = np.zeros((p + 1, p + 1))
    for r in blocks.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        full[r["i"], r["j"]] = r["v"]
    return full[0, 0], full[0, 1:], full[1:, 1:]


def covariance(n, sums, squares) -> np.ndarray:
    """Sample covariance."""
    mean = sums / n
    return (squares - n * np.outer(mean, mean)) / max(n - 1, 1)


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Make the largest entry of every column positive."""
    flip = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])
    return vectors * np.where(flip == 0, 1, flip)


def truncated_svd(n, sums, squares, k: int):
    """Singular values, right vectors and explained variance of an uncentred matrix."""
    values, vectors = np.linalg.eigh(squares)
    order = np.argsort(values)[::-1][:k]
    values, vectors = np.maximum(values[order], 0), _signed(vectors[:, order])
    mean = sums / n
    variance = values / n - (mean @ vectors) ** 2
    total = (np.diag(squares) / n - mean ** 2).sum()
    return np.sqrt(values), vectors, variance / total


def principal_components(n, sums, squares, k: int):
    """Loadings and explained variance ratio of the centred matrix."""
    values, vectors = np.linalg.eigh(covariance(n, sums, squares))
    order = np.argsort(values)[::-1][:k]
    return _signed(vectors[:, order]), values[order] / values.sum()
