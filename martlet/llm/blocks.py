"""Which 64-bit keys reach a total over the whole corpus, as a filter of fixed size.

Tasks send what they counted in compact blocks, dealt by the keys' first bits; each
bucket is summed with numpy.  Of a key, its bucket and 32 bits are sent, so unlike keys
may fall together: sums are never too low.  What the filter lets pass is a superset of
the keys wanted, and callers count that superset exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.llm.words import mix

#: Bits of a filter (16 MB).  Beyond some 50 million keys it lets more and more others pass, which costs time only.
FILTER_BITS = 27
SCHEMA = "bucket int, block binary"


def bucket_bits(spark: SparkSession) -> int:
    """Buckets follow the partitions that the session deals out, with some for each."""
    return max(10, (8 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def packed(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row for each bucket; ``keys`` are sorted and distinct."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    short = (keys >> np.uint64(32 - bits)).astype(np.uint32)
    counts = np.minimum(counts, 2**32 - 1).astype(np.uint32)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    blocks = []
    for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
        key, n = short[start:stop], counts[start:stop]
        many = n > 1
        blocks.append(np.concatenate(([np.uint32(many.sum())], key[many], n[many], key[~many])).astype(np.uint32).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]], pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"])


def _totals(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for block in blocks:
        values = np.frombuffer(block, np.uint32)
        many = int(values[0])
        keys += [values[1:1 + many], values[1 + 2 * many:]]
        counts += [values[1 + many:1 + 2 * many], np.ones(len(values) - 1 - 2 * many, np.uint32)]
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.diff(key.astype(np.int64), prepend=-1))
    return key[starts], np.add.reduceat(n[order].astype(np.int64), starts)


class Filter:
    """Passes every key that reached the total, and few others."""

    def __init__(self, words: np.ndarray, bits: int, width: int):
        self.words, self.bits, self.width = words, bits, width

    def __contains__(self, key: int) -> bool:
        return bool(self.passes(np.array([key], np.uint64))[0])

    def passes(self, keys: np.ndarray) -> np.ndarray:
        at = _place(keys >> np.uint64(32 - self.bits), self.width)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _place(trimmed: np.ndarray, width: int) -> np.ndarray:
    return mix(trimmed + np.uint64(1)) >> np.uint64(64 - width)


def heavy(blocks: DataFrame, at_least: int, bits: int, width: int = FILTER_BITS) -> Filter:
    """The filter of keys whose counts over all ``blocks`` sum to ``at_least``."""
    def one(bucket: int, held: list[bytes]) -> pa.RecordBatch:
        key, n = _totals(held)
        trimmed = key[n >= at_least].astype(np.uint64) | np.uint64(bucket << 32)
        at = np.unique(_place(trimmed, width))
        word, start = np.unique(at >> np.uint64(6), return_index=True)
        mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start) if len(at) else at
        return pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist()):
                if bucket != current:
                    if held:
                        yield one(current, held)
                    current, held = bucket, []
                held.append(block)
        if held:
            yield one(current, held)

    partitions = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (blocks.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "word long, mask long")
             .groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow())  # at most 2 ** (width - 6) rows
    words = np.zeros(1 << (width - 6), np.uint64)
    words[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return Filter(words, bits, width)
