"""Documents whose word n-gram sets overlap, by a blocked product of the incidence matrix.

The matrix has a row for each distinct set of shingles (equal sets are one row, a node)
and a column for each shingle, a 64-bit hash.  Sets link if 100 * overlap >= percent *
union, so either must hold t = ceil(percent * size / 100) entries that the other has too.

1. Tasks fold their documents into blocks of rows.  Each block sends its columns, once
   each and cut into buckets by the hash, and a bucket answers with a byte per column: how many
   rows have it, by powers of two.  Rows with fewer than t shared entries have no partner and go; of the
   others only shared entries are kept.  This is done again with the rows that stay, whose
   entries may have been shared with rows that went, while it removes a tenth of them.
2. Of m kept entries the first m - t + 1, the rarest first and then by the hash, must hold
   one that any partner has there too.  Rows that meet in such a column are candidates.
3. Candidates are multiplied block by block: overlaps of a block of rows with rows that
   stream past are accumulated, and pairs below the bounds of their sizes discarded.  First
   each column's most met row is held against the others, which connects copies of one text
   at a pair per copy.  Where a column's rows are then not all connected, those outside its
   largest component are held, in blocks, against all of them.  No link between two
   rows of different components is lost, and no pairs of a group are listed.

Fewer words than a shingle make one shingle of all; null and empty texts have none, link
with nothing and are their own component.  Rows without doc_id take part in no link and
have no component.  Rows that repeat are documents like others.  Only doc_id and text are
read, so other columns cannot clash.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm.blocks import bucket_bits
from martlet.llm.words import texts_of, windows, word_hashes
from martlet.operators.components import components
from martlet.session import arrow_bytes, work_path

SIZE, PERCENT = 5, 80
#: Entries of a block of rows; entries that stream past one block; cells of a product, and matches of entries, held at once.
BLOCK_ENTRIES, STREAM_ENTRIES, CELLS = 1 << 20, 1 << 21, 1 << 20
#: Rows that are held as one block in the second round.
BLOCK_ROWS = 256
#: Rows are sent to Python in batches of this size, a block alone.
BATCH_BYTES = 8 << 20


def _written(df: DataFrame, label: str) -> DataFrame:
    path = work_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _kept_by_block(df: DataFrame) -> tuple[str, str]:
    """Written with a number for each block, in buckets by it, so that a join on it moves
    the other side only: a table and its path."""
    df = df.withColumn("block", F.monotonically_increasing_id())
    path = work_path(df.sparkSession, "blocks")
    name = "blocks_" + path.rsplit("-", 1)[1]
    (df.write.format("parquet").option("compression", "zstd").option("path", path)
     .bucketBy(_partitions(df), "block").saveAsTable(name))
    return name, path


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def incidence(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Blocks of rows: the documents (doc_ids, ns, nodes) and the distinct sets (sets, sizes, held, keys)."""
    names = ["doc_ids", "ns", "nodes", "sets", "sizes", "held", "keys"]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int32()),
             pa.list_(pa.int32()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        sets: dict[bytes, np.ndarray] = {}
        held = 0

        def sent() -> pa.RecordBatch:
            sizes = [len(x) for x in sets.values()]
            columns = [*map(list, zip(*rows)), list(sets), sizes, sizes, b"".join(x.tobytes() for x in sets.values())]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text")):
                found = np.unique(windows(word_hashes(raw or b""), size))
                node = None
                if len(found) and doc_id is not None:
                    node = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                    if node not in sets:
                        sets[node] = found
                        held += len(found)
                rows.append((doc_id, len(found), node))
                if held >= BLOCK_ENTRIES or len(rows) >= BLOCK_ENTRIES:
                    yield sent()
                    rows, sets, held = [], {}, 0
        if rows:
            yield sent()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_ids array<long>, ns array<int>, nodes array<binary>, sets array<binary>, sizes array<int>, held array<int>, keys binary")


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows (node, n, keys) as blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        entries = 0

        def sent() -> pa.RecordBatch:
            nodes, sizes, keys = map(list, zip(*held))
            columns = [pa.array([nodes], pa.list_(pa.binary())), pa.array([sizes], pa.list_(pa.int32())),
                       pa.array([[len(k) // 8 for k in keys]], pa.list_(pa.int32())), pa.array([b"".join(keys)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["sets", "sizes", "held", "keys"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "keys"))):
                held.append(row)
                entries += len(row[2]) // 8
                if entries >= BLOCK_ENTRIES:
                    yield sent()
                    held, entries = [], 0
        if held:
            yield sent()

    return rows.mapInArrow(run, "sets array<binary>, sizes array<int>, held array<int>, keys binary")


def _columns(blocks: DataFrame, bits: int) -> DataFrame:
    """(bucket, block, columns, times): each block's distinct columns, and how often it holds them (up to 255)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys in zip(batch.column("block").to_pylist(), batch.column("keys").to_pylist()):
                key, n = np.unique(np.frombuffer(keys, np.uint64), return_counts=True)
                n = np.minimum(n, 255).astype(np.uint8)
                bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
                short = (key >> np.uint64(32 - bits)).astype(np.uint32)  # unlike columns that agree in it only keep rows longer
                edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
                cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[edges[:-1]], pa.int32()), pa.array([block] * len(cuts), pa.int64()),
                     pa.array([short[a:b].tobytes() for a, b in cuts], pa.binary()),
                     pa.array([n[a:b].tobytes() for a, b in cuts], pa.binary())], ["bucket", "block", "columns", "times"])

    return blocks.select("block", "keys").mapInArrow(run, "bucket int, block long, columns binary, times binary")


def _shared(columns: DataFrame) -> DataFrame:
    """(block, bucket, levels): a byte for each column of the block, 0 if no other row has it, else more the more have it."""
    def one(bucket: int, held: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        parts = [np.frombuffer(c, np.uint32) for _, c, _ in held]
        ends = np.cumsum([len(p) for p in parts])
        key = np.concatenate(parts)
        times = np.concatenate([np.frombuffer(t, np.uint8) for _, _, t in held])
        _, at = np.unique(key, return_inverse=True)
        total = np.bincount(at, weights=times)
        level = np.ceil(np.log2(total)).astype(np.uint8)[at]
        levels = [level[end - len(p):end].tobytes() for p, end in zip(parts, ends.tolist())]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in held], pa.int64()), pa.array([bucket] * len(held), pa.int32()),
                                           pa.array(levels, pa.binary())], ["block", "bucket", "levels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for bucket, *rest in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "columns", "times"))):
                if bucket != current:
                    if held:
                        yield one(current, held)
                    current, held = bucket, []
                held.append(tuple(rest))
        if held:
            yield one(current, held)

    dealt = columns.repartition(_partitions(columns), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "block long, bucket int, levels binary")


def _rows_with_partners(blocks: DataFrame, shared: DataFrame, bits: int, percent: int) -> DataFrame:
    """(node, n, keys) of rows with enough shared entries; ``keys`` holds these only, the rarest first."""
    def one(sets: list[bytes], sizes: list[int], held: list[int], keys: bytes, answers: dict[int, bytes]) -> pa.RecordBatch:
        key, size, held = np.frombuffer(keys, np.uint64), np.array(sizes, np.int64), np.array(held, np.int64)
        distinct, at = np.unique(key, return_inverse=True)
        edges = np.searchsorted(distinct >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        level = np.zeros(len(distinct), np.uint8)
        for bucket, levels in answers.items():
            level[edges[bucket]:edges[bucket + 1]] = np.frombuffer(levels, np.uint8)
        level = level[at]
        entry = level > 0
        start = np.cumsum(held) - held
        kept = np.add.reduceat(entry, start, dtype=np.int64) if len(size) else size
        left = np.flatnonzero(100 * kept >= percent * size).tolist()
        row = np.repeat(np.arange(len(size)), held)
        order = np.lexsort((key, level, row))  # rows stay where they are
        key, entry = key[order], entry[order]
        return pa.RecordBatch.from_arrays(
            [pa.array([sets[k] for k in left], pa.binary()), pa.array(size[left], pa.int32()),
             pa.array([key[a:b][entry[a:b]].tobytes() for a, b in ((start[k], start[k] + held[k]) for k in left)], pa.binary())],
            ["node", "n", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                answers = batch.column("answers")[k].values
                levels = dict(zip(answers.field("bucket").to_pylist(), answers.field("levels").to_pylist()))
                yield one(*(batch.column(c)[k].as_py() for c in ("sets", "sizes", "held", "keys")), levels)

    answers = shared.groupBy("block").agg(F.collect_list(F.struct("bucket", "levels")).alias("answers"))  # a byte for each column of a block
    return blocks.join(answers, "block").select("sets", "sizes", "held", "keys", "answers").mapInArrow(run, "node binary, n int, keys binary")


def _with_partners(blocks: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """(node, n, keys) of rows with enough shared entries, and where the blocks were written."""
    spark, bits = blocks.sparkSession, bucket_bits(blocks.sparkSession)
    name, path = _kept_by_block(blocks)
    table = spark.table(name)
    rows = _written(_rows_with_partners(table, _shared(_columns(table, bits)), bits, percent).dropDuplicates(["node"]), "rows")
    spark.sql(f"DROP TABLE {name}")  # its files stay
    return rows, path


def _first_entries(rows: DataFrame, percent: int) -> DataFrame:
    """(key, node, n): the entries of which a row must share one with any partner."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = [batch.column(c).to_pylist() for c in ("node", "n", "keys")]
            first = [np.frombuffer(k, np.int64)[:len(k) // 8 - -(-percent * n // 100) + 1] for n, k in zip(*named[1:])]
            times = [len(x) for x in first]
            at = pa.array(np.repeat(np.arange(len(first)), times))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *first])),
                                              batch.column("node").take(at), batch.column("n").take(at)], ["key", "node", "n"])

    return rows.mapInArrow(run, "key long, node binary, n int")


class _Held:
    """A block of rows by columns; multiplies with other rows."""

    def __init__(self, rows: list[tuple]):
        self.nodes, self.parts, sizes, keys = zip(*rows)
        self.sizes = np.array(sizes, np.int64)
        key = np.concatenate([np.frombuffer(k, np.uint64) for k in keys])
        row = np.repeat(np.arange(len(keys)), [len(k) // 8 for k in keys])
        order = np.argsort(key, kind="stable")
        self.key, self.row = key[order], row[order]

    def links(self, rows: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
        """(streamed row, held row) whose overlap reaches the bound of their sizes."""
        step = max(1, CELLS // len(self.nodes))
        for start in range(0, len(rows), step):
            part = rows[start:start + step]
            sizes = np.array([r[2] for r in part], np.int64)
            key = np.concatenate([np.frombuffer(r[3], np.uint64) for r in part])
            row = np.repeat(np.arange(len(part)), [len(r[3]) // 8 for r in part])
            low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
            n = high - low
            total = np.cumsum(np.bincount(row, n, len(part)).astype(np.int64))
            first = 0
            while first < len(part):  # rows whose matches can be listed at once
                last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + CELLS, "right")))
                cut = slice(*np.searchsorted(row, [first, last]).tolist())
                times = n[cut]
                at = np.repeat(low[cut] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                cell = np.repeat(row[cut] - first, times) * len(self.nodes) + self.row[at]
                overlap = np.bincount(cell, minlength=(last - first) * len(self.nodes)).reshape(last - first, len(self.nodes))
                found = 100 * overlap >= percent * (sizes[first:last, None] + self.sizes[None, :] - overlap)
                for s, h in zip(*np.nonzero(found)):
                    yield start + first + int(s), int(h)
                first = last


def _product(roles: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The links (u, v) of rows that stream (member 1) past the rows held (member 0) under the same (g, slot).

    Rows of one part are not compared, and a row is linked once to each other part.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, block, stream, entries = None, [], None, [], 0

        def multiplied() -> pa.RecordBatch:
            found = {}
            for s, h in block.links(stream, percent) if block and stream else ():
                node, part = stream[s][:2]
                if block.nodes[h] != node and (part is None or block.parts[h] != part):
                    found[node, block.parts[h]] = block.nodes[h]
            return pa.RecordBatch.from_arrays([pa.array(list(found.values()), pa.binary()), pa.array([u for u, _ in found], pa.binary())], ["u", "v"])

        for batch in batches:
            for g, slot, member, *row in zip(*(batch.column(c).to_pylist() for c in ("g", "slot", "member", "node", "part", "n", "keys"))):
                if of != (g, slot):
                    yield multiplied()
                    of, held, block, stream, entries = (g, slot), [], None, [], 0
                if not member:
                    held.append(tuple(row))
                    continue
                if block is None and held:
                    block = _Held(held)
                stream.append(tuple(row))
                entries += row[2]
                if entries >= BLOCK_ENTRIES:
                    yield multiplied()
                    stream, entries = [], 0
        yield multiplied()

    dealt = roles.join(rows, "node").repartition(_partitions(rows), "g", "slot").sortWithinPartitions("g", "slot", "member")
    return dealt.select("g", "slot", "member", "node", "part", "n", "keys").mapInArrow(run, "u binary, v binary")


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that connect all nodes which the links between any two rows connect."""
    entries = _written(_first_entries(rows, percent), "entries")
    busy = entries.groupBy("key").count().where("count > 1")
    met = _written(entries.join(busy, "key"), "met")
    fame = met.groupBy("node").agg(F.sum("count").alias("fame"))
    famed = _written(met.drop("count").join(fame, "node"), "famed")
    ids = famed.select(F.col("node").alias("id")).distinct()

    # each column's most met row against its others
    heads = famed.groupBy("key").agg(F.max(F.struct("fame", "node", "n")).alias("head")).select("key", "head.node", "head.n").toDF("key", "g", "n_g")
    star = _written(famed.join(heads, "key").where("g <> node AND least(n, n_g) * 100 >= greatest(n, n_g) * " + str(percent))
                    .select("g", "node", "n").distinct(), "star")
    load = star.groupBy("g").agg(F.ceil(F.sum("n") / STREAM_ENTRIES).alias("slots"))
    slotted = star.join(load, "g").withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots")))
    nothing = F.lit(None).cast("binary").alias("part")
    links = _written(_product(slotted.select("g", "slot", F.lit(1).alias("member"), "node", nothing).union(
        slotted.select("g", "slot", F.lit(0), F.col("g"), nothing).distinct()), rows, percent), "links")

    # columns whose rows lie in several components: those outside the largest, in blocks, against all
    placed = _written(famed.join(components(ids, links).withColumnRenamed("id", "node"), "node"), "placed")
    shares = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"))
    mixed = (shares.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("members", "component")).alias("g"))
             .where("parts > 1"))
    open_ = _written(placed.join(mixed, "key").select("g", "node", "n", F.col("component").alias("part")).distinct(), "open")
    left = open_.where("part <> g")
    slots = left.groupBy("g").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_ENTRIES)).alias("slots"))
    holds = left.join(slots, "g").select("g", F.pmod(F.xxhash64("node"), F.col("slots")).alias("slot"), F.lit(0).alias("member"), "node", "part")
    streams = open_.join(slots, "g").select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"), F.lit(1), "node", "part")
    return _written(links.union(_product(holds.union(streams), rows, percent)), "links")


def classes(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, component_id) for each document."""
    blocks = incidence(docs, size)
    with arrow_bytes(docs.sparkSession, BATCH_BYTES):
        rows, path = _with_partners(blocks, percent)
        n, before = rows.count(), None
        while before is None or 0 < n < 0.9 * before:
            rows, _ = _with_partners(_blocked(rows), percent)
            n, before = rows.count(), n
        links = _links(rows, percent)
    listed = docs.sparkSession.read.schema(blocks.schema).parquet(path).select(F.explode(F.arrays_zip("doc_ids", "ns", "nodes")).alias("d")).select(
        F.col("d.doc_ids").alias("doc_id"), F.col("d.ns").alias("n"), F.col("d.nodes").alias("node"))
    firsts = listed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    linked = links.select(F.col("u").alias("id")).union(links.select("v")).distinct()
    placed = components(linked, links).withColumnRenamed("id", "node")
    named = firsts.join(placed, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = named.join(lowest, "component").select("node", "component_id")
    return listed.join(of, "node", "left").select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """The stated result, a row for each document."""
    return classes(docs).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
entry AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
link AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM entry a JOIN entry b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM sets UNION SELECT reach.doc_id, link.v FROM reach JOIN link ON link.u = reach.r)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id
FROM sets s JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m ON m.doc_id = s.doc_id
"""
