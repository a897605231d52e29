"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

A document's set holds its distinct windows of ``size`` words.  Under each of 56
permutations both the least and the greatest value of the set are kept, so 56
evaluations give 112 signature values; either one agrees between two sets with the
probability of their similarity.  The values fill 28 bands of four, so two sets of
similarity 0.8 miss each other in all bands once in some 2.6 million pairs.

Documents with equal sets are one node, named by a 128-bit digest of the set, and only
nodes are compared.  First each member of a band's bucket is held against the member
that meets most others, which connects the copies of one text at a pair per copy.  Where
the members of a bucket are then not all connected, those outside its largest component
are held, in blocks, against the members of all components, so no link between two
members of a bucket is lost and no pairs are listed.  All comparisons are made on the full
sets, which are made from the texts again.

Null and empty texts have no set and no link.  Rows without doc_id take part in no link,
have no component and are kept.  Rows that repeat are documents like others.  Columns of
the table that carry the names of the results are replaced.  An empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlet.llm.words import map_texts, mix, seeds, texts_of, windows, word_hashes
from martlet.operators.components import components
from martlet.session import work_path

PERMUTATIONS, BANDS = 56, 28
_FLIP = seeds(PERMUTATIONS, 5000)[:, None]
_TIMES = seeds(PERMUTATIONS, 6000)[:, None] | np.uint64(1)
#: Shingles and texts that one block holds, and shingles that stream past one centre.
BLOCK_SHINGLES, BLOCK_TEXTS, STREAM_SHINGLES = 1_000_000, 256, 2_000_000
#: Rows (some 100 bytes) up to which the list of texts wanted is broadcast to the documents; beyond, they are joined.
BROADCAST_ROLES = 400_000


def shingles(raw: bytes, size: int) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    return np.unique(windows(word_hashes(raw), size))


def digest_of(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def signature(found: np.ndarray) -> np.ndarray:
    """Least and greatest value of the set under each permutation."""
    low = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(found), 2048):
        values = (found[None, at:at + 2048] ^ _FLIP) * _TIMES
        values ^= values >> np.uint64(32)
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.concatenate((low, high))


def bands(values: np.ndarray) -> list[int]:
    """One key for each band; it holds the band's number."""
    rows = mix(values).reshape(-1, BANDS).T  # least and greatest values of a permutation go to the same band
    key = seeds(BANDS, 7000)
    for k in range(rows.shape[1]):
        key = mix(key + rows[:, k] * np.uint64(2 * k + 1))
    return key.view(np.int64).tolist()


def with_sets(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """The table's other columns with the number of shingles and the set's digest."""
    def one(raw: bytes):
        found = shingles(raw, size)
        return len(found), digest_of(found)

    return map_texts(docs, one, "_llm_n long, _llm_set binary", text)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    def one(raw: bytes):
        found = shingles(raw, size)
        if not len(found):
            return 0, None, []
        return len(found), digest_of(found), bands(signature(found))

    return map_texts(docs, one, "n long, node binary, bands array<long>")


class _Block:
    """Sets held together: a search gives the intersection of each with another set."""

    def __init__(self):
        self.nodes, self.parts, self.sets, self.index = [], [], [], None

    def add(self, node: bytes, part: bytes | None, found: np.ndarray) -> None:
        self.nodes.append(node)
        self.parts.append(part)
        self.sets.append(found)

    def similar(self, found: np.ndarray, percent: int) -> np.ndarray:
        if self.index is None:
            owner = np.repeat(np.arange(len(self.sets)), [len(x) for x in self.sets])
            values = np.concatenate(self.sets)
            order = np.argsort(values, kind="stable")
            self.index = values[order], owner[order], np.array([len(x) for x in self.sets])
        values, owner, sizes = self.index
        low, high = np.searchsorted(values, found, "left"), np.searchsorted(values, found, "right")
        n = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sizes))
        return np.flatnonzero(100 * both >= percent * (sizes + len(found) - both))


def _confirmed(docs: DataFrame, roles: DataFrame, size: int, percent: int) -> DataFrame:
    """The links (u, v) of similar enough full sets.

    ``roles`` has (g, slot, member, node, part, doc_id): for each (g, slot), the sets of
    the rows with member 0 are held as a block, those with member 1 stream past it.  Sets
    of one part are not compared, and a set is linked once to each other part.
    """
    spark = roles.sparkSession
    wanted = _written(roles, "roles")
    if wanted.count() <= BROADCAST_ROLES:
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", "text").join(wanted, "doc_id").select("g", "slot", "member", "node", "part", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, block = None, _Block()
        for batch in batches:
            kept: tuple[list[bytes], list[bytes]] = ([], [])
            named = [batch.column(c).to_pylist() for c in ("g", "slot", "member", "node", "part")]
            for g, slot, member, node, part, raw in zip(*named, texts_of(batch, "text")):
                found = shingles(raw or b"", size)
                if digest_of(found) != node:
                    continue  # another text under the same doc_id
                if of != (g, slot):
                    of, block = (g, slot), _Block()
                if not member:
                    block.add(node, part, found)
                    continue
                linked = {}
                for k in block.similar(found, percent).tolist() if block.nodes else ():
                    if block.nodes[k] != node and (part is None or block.parts[k] != part):
                        linked[block.parts[k]] = block.nodes[k]
                kept[0].extend(linked.values())
                kept[1].extend([node] * len(linked))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()) for k in kept], ["u", "v"])

    dealt = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "g", "slot")
    return dealt.sortWithinPartitions("g", "slot", "member").mapInArrow(run, "u binary, v binary")


def _open_buckets(shared: DataFrame, placed: DataFrame) -> DataFrame:
    """The members of buckets that lie in several components, beside their bucket's largest one."""
    placed = _written(shared.join(placed.select(F.col("id").alias("node"), "component"), "node"), "placed")
    shares = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"))
    mixed = shares.groupBy("key").agg(F.count(F.lit(1)).alias("parts"),
                                      F.max_by("component", "members").alias("largest")).where("parts > 1")
    return placed.join(mixed.select("key", "largest"), "key")


def _written(df: DataFrame, label: str) -> DataFrame:
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n, node, component_id) for each row of ``docs`` that has a doc_id.

    ``component_id`` is the smallest doc_id that can be reached over links of sets with
    100 * intersection >= percent * union, the document's own included.
    """
    named = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    signed = _written(_signed(named, size), "signed")
    nodes = signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    firsts = nodes.select(F.col("node").alias("of"), F.col("doc_id").alias("first"))
    banded = _written(signed.where("n > 0").join(firsts, (F.col("node") == F.col("of")) & (F.col("doc_id") == F.col("first")))
                      .dropDuplicates(["node"]).select("node", "doc_id", "n", "bands"), "banded")
    sizes = banded.select("node", "doc_id", "n")
    ids = banded.select(F.col("node").alias("id"))

    # only buckets with two nodes and more stay; counting needs the keys alone
    each = banded.select(F.explode("bands").alias("key"), "node")
    busy = each.groupBy("key").count().where("count > 1")
    met = _written(each.join(busy, "key"), "met")
    # the text that others were made from meets most of them, so the most met come first
    fame = met.groupBy("node").agg(F.sum("count").alias("fame"))
    shared = _written(met.select("key", "node").join(fame, "node"), "shared")

    # round one: each bucket's most met node against its other members
    heads = shared.groupBy("key").agg(F.max(F.struct("fame", "node")).alias("head")).select("key", F.col("head.node").alias("g"))
    pairs = (shared.join(heads, "key").where("g <> node").select("g", "node").distinct()
             .join(sizes, "node").join(sizes.select(F.col("node").alias("g"), F.col("n").alias("n_g"), F.col("doc_id").alias("doc_g")), "g")
             .where(F.least("n", "n_g") * 100 >= F.greatest("n", "n_g") * percent))
    star = _written(pairs, "pairs")
    load = star.groupBy("g").agg(F.ceil(F.sum("n") / STREAM_SHINGLES).alias("slots"))
    slotted = star.join(load, "g").withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots")))
    nothing = F.lit(None).cast("binary").alias("part")
    links = _written(_confirmed(named, slotted.select("g", "slot", F.lit(1).alias("member"), "node", nothing, "doc_id").union(
        slotted.select("g", "slot", F.lit(0), F.col("g"), nothing, "doc_g").distinct()), size, percent), "links")

    # round two: in buckets that still have several components, those outside the largest, in
    # blocks, against all members that such buckets of the same largest component have
    open_ = _open_buckets(shared, components(ids, links)).select(
        F.col("largest").alias("g"), "node", F.col("component").alias("part")).distinct().join(sizes, "node")
    open_ = _written(open_, "open")
    left = open_.where("part <> g")
    slots = left.groupBy("g").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("slots"))
    held = left.join(slots, "g").select("g", F.pmod(F.xxhash64("node"), F.col("slots")).alias("slot"), F.lit(0).alias("member"),
                                        "node", "part", "doc_id")
    streams = open_.join(slots, "g").select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"),
                                            F.lit(1), "node", "part", "doc_id")
    links = _written(links.union(_confirmed(named, held.union(streams), size, percent)), "links")
    final = components(ids, links)
    small = (final.join(sizes.withColumnRenamed("node", "id"), "id").groupBy("component")
             .agg(F.min("doc_id").alias("component_id")).join(final, "component").select(F.col("id").alias("node"), "component_id"))
    return signed.select("doc_id", "n", "node").join(small, "node", "left").select(
        "doc_id", "n", "node", F.coalesce("component_id", "doc_id").alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """The stated result, on shingles of four words; a row for each document."""
    found = classes(docs, 4).select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                                    (F.col("doc_id") == F.col("component_id")).alias("kept"))
    blank = F.lit(None).cast(docs.schema["doc_id"].dataType)
    nameless = with_sets(docs.where("doc_id IS NULL").select("doc_id", "text"), 4)
    return found.union(nameless.select("doc_id", F.col("_llm_n"), blank, F.lit(True)))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: a row with its smallest doc_id.

    Rows that repeat both doc_id and set are one document here.
    """
    keepers = (classes(docs, size, percent).where("doc_id = component_id")
               .select(F.col("doc_id").alias("_llm_doc"), F.col("node").alias("_llm_node")).distinct())
    sets = with_sets(docs.withColumn("_llm_text", F.col("text")), size, "_llm_text")
    met = sets.where("doc_id IS NOT NULL").join(keepers, (F.col("doc_id") == F.col("_llm_doc"))
                                                & F.col("_llm_set").eqNullSafe(F.col("_llm_node")))
    once = F.row_number().over(W.partitionBy("doc_id", "_llm_set").orderBy(F.xxhash64("text")))
    kept = met.withColumn("_llm_row", once).where("_llm_row = 1 OR _llm_set IS NULL")
    return kept.select(*docs.columns).union(docs.where("doc_id IS NULL"))
