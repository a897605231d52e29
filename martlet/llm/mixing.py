"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight that changes over the training clock, from 0 to 1: a base
weight times a shape given at evenly spaced knots, linear between them.  The integral of
that weight is the source's demand; its share of all words is the source's target, but no more than ``most`` times the source's size: what is above is given to the
others by weight until none is above.

A source's documents follow each other in a fixed shuffled order, over and over, until
the target is reached.  A document's place in that order, in words, is a share of the
source's demand; inverting the cumulative demand gives the clock at which it is trained.
Sorting all sources' documents by the clock range by range gives the training order: at
any moment the sources stand in the ratio of their weights then.

Running sums never order a whole source in one task: a source is cut into pieces by hash,
the pieces are summed, and only the rows of one piece are ordered.

Size is the number of words; null and empty texts have none, take part with size 0 and
are never taken.  The null source is a source, last in order.  Repeated rows are
documents of their own.  Columns of the table that carry the names of the results are
replaced.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlet.session import work_path

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a source that are ordered in one task.
PIECE = 50_000
#: Sources up to which their table (some 100 bytes each) is broadcast; beyond, it is joined.
BROADCAST_SOURCES = 100_000
#: Shapes by place in the order of sources, repeating: rising, steady, falling.
SHAPES = ((0.5, 1.0, 1.5), (1.0, 1.0, 1.0), (1.5, 1.0, 0.5))


def integral(shape: Sequence[float]) -> float:
    """Of a shape over the clock, linear between its knots."""
    return float(shape[0]) if len(shape) == 1 else (sum(shape) - (shape[0] + shape[-1]) / 2) / (len(shape) - 1)


def targets(sizes: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), most: float = 3.0,
            shapes: Sequence[Sequence[float]] = ((1.0,),)) -> DataFrame:
    """``source``, ``source_size`` with ``place``, ``weight`` (base weight times the integral of its shape) and ``target``.

    Sources in the order of what they can take for their weight: those whose most is
    less than what a share of the rest would give them take their most, the others share.
    There is a row for each source, so one task orders them.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    by_place = lambda values: F.element_at(
        F.array(*map(F.lit, values)), (F.col("place") % len(values) + 1).cast("int")).cast("double")
    listed = sizes.withColumn("place", place).withColumn("weight", by_place(weights) * by_place([integral(s) for s in shapes]))
    by_limit = W.orderBy(F.col("source_size") * most / F.col("weight"), "place")
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    rest = listed.select(
        "*", F.sum("source_size").over(W.partitionBy(F.lit(0))).alias("_all"),
        F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0.0)).alias("_taken"),
        F.sum("weight").over(by_limit.rowsBetween(0, W.unboundedFollowing)).alias("_weight"))
    share = (F.col("_all") - F.col("_taken")) / F.col("_weight")
    # the first source that stays below its most fixes the share; later ones, held against
    # a rest from which it had taken its most, would find a smaller one
    level = rest.withColumn("_share", share).withColumn("_open", share * F.col("weight") <= F.col("source_size") * most)
    shared = F.max(F.when(F.col("_open"), F.col("_share"))).over(W.partitionBy(F.lit(0)))
    return level.select(
        *[c for c in sizes.columns], "place", "weight",
        F.least(F.col("source_size") * F.lit(float(most)),
                F.coalesce(shared * F.col("weight"), F.col("source_size") * F.lit(float(most)))).alias("target"))


def clock(share: Column, shape: Column, knots: int) -> Column:
    """The clock at which the cumulative demand of a shape reaches a share of it.

    Demand grows from knot to knot by the mean of the two heights; within the stretch
    the quadratic of its linear weight is solved.
    """
    step = 1.0 / (knots - 1)
    heights = [shape[k] for k in range(knots)]
    areas = [(heights[k] + heights[k + 1]) * F.lit(step / 2) for k in range(knots - 1)]
    wanted = share * sum(areas[1:], areas[0])
    at, passed = None, F.lit(0.0)
    for k in range(knots - 1):
        slope = (heights[k + 1] - heights[k]) / F.lit(step)
        more = F.greatest(wanted - passed, F.lit(0.0))
        root = F.sqrt(F.greatest(heights[k] * heights[k] + slope * more * 2, F.lit(0.0)))
        inside = F.coalesce(F.try_divide(more * 2, heights[k] + root), F.lit(0.0))
        here = F.lit(k * step) + F.least(inside, F.lit(step))
        at = here if at is None else F.when(wanted >= passed, here).otherwise(at)
        passed = passed + areas[k]
    return at


def mix(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), shapes: Sequence[Sequence[float]] = SHAPES,
        most: float = 3.0) -> DataFrame:
    """The table with ``size``, ``source_size``, ``target`` and ``positions``.

    ``positions`` are the clocks at which the document is trained: none, one or several.
    A document is taken in a round if the middle of its words lies below the target, so a
    source misses its target by half a document at most.
    """
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "positions")]
    sized = docs.select(*kept, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                        F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)).alias("_llm_order"))
    planned = _planned(sized, weights, shapes, most).withColumn(
        "_llm_piece", F.floor((F.shiftrightunsigned("_llm_order", 11) / F.lit(float(2**53))) * F.col("_llm_pieces")))
    piece = ("_llm_place", "_llm_piece")
    words = planned.groupBy(*piece).agg(F.sum("size").alias("_llm_words"))
    before = F.coalesce(F.sum("_llm_words").over(W.partitionBy("_llm_place").orderBy("_llm_piece")
                                                 .rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = words.select(*piece, before.alias("_llm_before"))
    within = W.partitionBy(*piece).orderBy("_llm_order", "size").rowsBetween(W.unboundedPreceding, 0)
    met = planned.withColumn("_llm_end", F.sum("size").over(within)).join(starts, list(piece))
    middle = F.col("_llm_before") + F.col("_llm_end") - F.col("size") / 2
    rounds = F.ceil(F.try_divide(F.col("target") - middle, F.col("source_size").cast("double")))
    times = F.when((F.col("size") > 0) & (rounds > 0), F.least(rounds, F.lit(int(most)))).otherwise(0).cast("int")
    share = lambda k: F.try_divide(middle + k * F.col("source_size"), F.col("target"))
    positions = F.when(times > 0, F.transform(F.sequence(F.lit(0), F.greatest(times - 1, F.lit(0))),
                                              lambda k: clock(share(k), F.col("_llm_shape"), len(shapes[0]))))
    return met.select(*kept, "size", "source_size", "target",
                      F.coalesce(positions, F.array().cast("array<double>")).alias("positions"))


def _planned(sized: DataFrame, weights, shapes, most: float) -> DataFrame:
    """Each document beside its source's place, target, shape and number of pieces.

    The table of sources is written once; it is broadcast only if counted small.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    shape = F.element_at(F.array(*[F.array(*map(F.lit, s)) for s in shapes]), (F.col("place") % len(shapes) + 1).cast("int"))
    path = work_path(sized.sparkSession, "sources")
    targets(by_source, weights, most, shapes).select(
        F.col("source").alias("_llm_source"), F.col("place").alias("_llm_place"), "source_size", "target",
        shape.alias("_llm_shape"), F.ceil(F.col("rows") / PIECE).alias("_llm_pieces")).write.parquet(path)
    plan = sized.sparkSession.read.parquet(path)
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    return sized.join(plan, F.col("source").eqNullSafe(F.col("_llm_source"))).drop("_llm_source")


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The table's rows as often as they are trained, with ``position``, sorted range by range."""
    mixed = mix(docs, **options)
    kept = [c for c in docs.columns if c != "position"]
    each = mixed.select(*kept, F.explode("positions").alias("position"))
    ties = [c for c in ("source", "doc_id") if c in kept]
    return each.repartitionByRange("position", *ties).sortWithinPartitions("position", *ties)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes), positions; sorted range by range by the first position."""
    mixed = mix(docs.select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.size("positions")).cast("long").alias("taken"), "positions")
    order = (F.asc_nulls_last(F.get("positions", F.lit(0))), "doc_id")  # those not taken last, parted by id
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)
