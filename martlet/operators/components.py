"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: link neighbours to the smallest id around a node."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(low, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over the (u, v) edges.

    The rounds needed grow with the logarithm of the longest path; each is written
    to the shared folder.
    """
    current = cut_lineage(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        current = cut_lineage(_star(_star(current, True), False))
        seen = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
                           .alias("h")).first()
        if (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
    roots = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.select("id").join(roots, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"))
