"""The links a crawl goes to next, round by round.

Links seen are kept in ranges of the alphabet, cut at links drawn in the first round.  The
links of a round usually share a few paths, so they meet the ranges they fall in and the rest
of the history is not read.  A link belongs to the first seed that lists it, and each seed
gives at most so many new links a round; the others stay unseen and come in later rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.operators.topk import best_per_group
from martlet.session import saved
from martlet.sources import versions

CUTS = 256


def _cuts(links: DataFrame, root: str, as_of: str, n: int) -> list[str]:
    """The links at which ranges begin, drawn once by a hash of the link."""
    spark = links.sparkSession
    if versions.latest(spark, f"{root}/cuts") is None:
        every = F.greatest(F.lit(1), F.floor(links.agg(F.count(F.lit(1))).scalar() / n))
        draft = versions.Draft(spark, f"{root}/cuts")
        draft.write("cuts", links.where(F.pmod(F.xxhash64("link"), every) == 0).select("link").orderBy(F.xxhash64("link"), "link").limit(n))
        draft.commit(as_of)
    return sorted(r["link"] for r in versions.read(spark, f"{root}/cuts", "cuts").collect())  # n at most


def _ranged(links: DataFrame, cuts: list[str]) -> DataFrame:
    """With ``cut``: how many of the cuts are not above the link."""
    points = F.array(*map(F.lit, cuts)).cast("array<string>")
    return links.withColumn("cut", F.size(F.filter(points, lambda c: c <= F.col("link"))))


def seen(spark: SparkSession, root: str, cuts: list[int] | None = None) -> DataFrame:
    """(link, seed, round, cut) of all rounds, or of some ranges only."""
    rounds = versions.manifest(spark, f"{root}/rounds").where("name = 'links'").collect()  # a row per round
    parts = [spark.read.schema("link string, seed string, round int, cut int").parquet(r["path"]) for r in rounds]
    if not parts:
        return spark.createDataFrame([], "link string, seed string, round int, cut int")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole if cuts is None else whole.where(F.col("cut").isin(cuts))


def advance(found: DataFrame, root: str, as_of: str, per_seed: int | None = None, n_cuts: int = CUTS) -> DataFrame:
    """Take in (seed, link) rows; returns the new links of this round, which are seen from now on."""
    spark = found.sparkSession
    owned = saved(found.where("link IS NOT NULL").groupBy("link").agg(F.min("seed").alias("seed")), "found")
    ranged = _ranged(owned, _cuts(owned, root, as_of, n_cuts))
    touched = [r["cut"] for r in ranged.select("cut").distinct().collect()]  # n_cuts + 1 at most
    new = ranged.join(seen(spark, root, touched).select("link"), "link", "left_anti")
    if per_seed is not None:
        new = best_per_group(new, ["seed"], [F.asc("link")], per_seed).drop("rank")
    number = (versions.latest(spark, f"{root}/rounds") or 0) + 1
    draft = versions.Draft(spark, f"{root}/rounds")
    made = draft.write("links", new.select("link", "seed", F.lit(number).alias("round"), "cut").repartition("cut"), "cut")
    draft.commit(as_of, f"round {number}")
    return made
