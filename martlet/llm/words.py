"""Words of a text as 64-bit hashes, for the operators that compare word sequences.

All functions work on one text's UTF-8 bytes with numpy; Spark deals out the texts.
A hash depends only on the bytes of a word, so it is the same in every task and run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
_BACK = pow(_STEP, -1, 2**64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that end a word: the white space of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes that end a word of letters and digits: all other ASCII characters.
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, start: int) -> np.ndarray:
    """Fixed 64-bit values made by rule, others for each ``start``."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(start)) * _ODD)


_OF_BYTE = seeds(256, 1000)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16, 2 * len(_powers[0]))
        for k, factor in enumerate((_STEP, _BACK)):
            values = np.full(size, factor, np.uint64)
            values[0] = 1
            _powers[k] = np.multiply.accumulate(values)
    return _powers[0], _powers[1]


def word_hashes(text: bytes, ends: np.ndarray = SPACE) -> np.ndarray:
    """A hash for each word in order; A-Z count as a-z."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.concatenate(([False], ~ends[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edges[::2], edges[1::2]
    up, down = _steps(len(raw))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[_LOWER[raw]] * up[:len(raw)], dtype=np.uint64)))
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of ``size`` words; fewer words make one window, none make none."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = words[:n].copy()
    for k in range(1, size):
        out = out * _ODD + words[k:k + n]
    return mix(out + np.uint64(size))


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The texts of a column as UTF-8 bytes."""
    column = batch.column(name)
    binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(binary).to_pylist()


def map_texts(df: DataFrame, one: Callable[[bytes], tuple], schema: str, text: str = "text") -> DataFrame:
    """Append the columns of ``schema`` that ``one`` makes of each text (null: empty).

    Rows stream through in Arrow batches; the text column itself is dropped, so only
    the small results leave the task.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    added = T.StructType.fromDDL(schema)
    rest = [f for f in df.schema.fields if f.name != text]
    whole = T.StructType([*rest, *added.fields])
    arrow = to_arrow_schema(whole)
    kept = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(t or b"") for t in texts_of(batch, text)]
            columns = [batch.column(c).cast(arrow.field(c).type) for c in kept]
            for k, field in enumerate(added.fields):
                columns.append(pa.array([m[k] for m in made], arrow.field(field.name).type))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, whole)
