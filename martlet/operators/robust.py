"""Centre and covariance of the half of the rows that lies densest.

Several starts from a few rows each are concentrated together: three scans find, for every
start, how far its nearest half reaches and the moments of that half.  A step never raises
the determinant.  After two steps the best starts are carried on until their determinants
settle; the least one wins.  The driver sees p x p sums, counts of distances by their leading
bits, and the rows of the starts.

The rows are packed once in blocks of numbers, so a scan sends no single rows to Python.  Where
a half ends is exact: distances are counted by their first bits, those in the bin that holds
the rank by their next ones, and the last scan leaves 2**-31 of a distance undecided.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.session import arrow_bytes, cut_lineage

STARTS, CARRIED, FIRST_STEPS, MOST_STEPS = 24, 3, 2, 50
_TURNS = 2**30
#: Numbers in a block, and bytes of blocks sent to Python at once.
BLOCK_NUMBERS, SENT_BYTES = 1 << 17, 8 << 20
#: Bits of a distance read in each of the three scans; 63 bits order the doubles from 0 up.
_BITS = (17, 12, 13)


@dataclass
class Ellipse:
    centre: np.ndarray
    covariance: np.ndarray

    @property
    def size(self) -> float:
        """The logarithm of the determinant."""
        return float(np.linalg.slogdet(self.covariance)[1])

    def distance(self, names: list[str]) -> Column:
        """Squared Mahalanobis distance of a row."""
        inverse = np.linalg.pinv(self.covariance)
        off = [f"(`{c}` - {float(m)!r}D)" for c, m in zip(names, self.centre)]
        return F.expr(" + ".join(f"{float(inverse[i, j]) * (1 if i == j else 2)!r}D * {off[i]} * {off[j]}"
                                 for i in range(len(names)) for j in range(i, len(names))))


def _starts(table: DataFrame, key: str, names: list[str], n: int, starts: int) -> list[Ellipse]:
    """Ellipses of p + 1 rows each, drawn by hash; of more rows where these lie in a plane."""
    p = len(names)
    share = min(1.0, 4.0 * starts * (p + 1) / n)
    turn = F.xxhash64(F.lit(9), key)
    drawn = (table.where(F.pmod(turn, F.lit(_TURNS)) / F.lit(float(_TURNS)) <= share).select(*names, turn.alias("_turn"), key)
             .orderBy("_turn", key).toPandas()[names].to_numpy(float))  # some 4 starts (p + 1) rows
    out = []
    for k in range(starts):
        order = np.random.default_rng([9, k]).permutation(len(drawn))
        for size in range(p + 1, len(drawn) + 1):
            part = drawn[order[:size]]
            spread = np.cov(part.T).reshape(p, p)
            if np.linalg.matrix_rank(spread) == p:
                out.append(Ellipse(part.mean(axis=0), spread))
                break
    return out


def packed(table: DataFrame, names: list[str]) -> DataFrame:
    """(block): the numbers of some thousand rows each, kept for many scans."""
    p = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], ["block"])

        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(float)
            held.append(x)
            size += len(x)
            if size * p >= BLOCK_NUMBERS:
                yield sent()
                held, size = [], 0
        if size:
            yield sent()

    return cut_lineage(table.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(run, "block binary"))


def _summed(blocks: DataFrame, fits: list[Ellipse], width: int, one: Callable) -> list:
    """Rows (k, bin, v0...) of what ``one`` makes of the k-th ellipse's offsets and the bits of its distances, summed.

    ``one`` adds to an array of (bins, width), whose last bin is called -1.
    """
    p = len(fits[0].centre)
    shapes = [(f.centre, np.linalg.pinv(f.covariance)) for f in fits]
    columns = [f"v{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [None] * len(shapes)
        for batch in batches:
            for block in batch.column("block"):
                x = np.frombuffer(block.as_buffer(), float).reshape(-1, p)
                for k, (centre, inverse) in enumerate(shapes):
                    off = x - centre
                    bits = np.abs(np.einsum("ij,ij->i", np.einsum("ij,jk->ik", off, inverse), off)).view(np.int64)
                    made = one(k, off, bits)
                    totals[k] = made if totals[k] is None else totals[k] + made
        for k, total in enumerate(totals):
            if total is not None:
                at = np.flatnonzero(total[:, 0])
                bins = np.where(at == len(total) - 1, -1, at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), k, np.int32)), pa.array(bins.astype(np.int32)),
                     *[pa.array(total[at, i].astype(float)) for i in range(width)]], ["k", "bin", *columns])

    schema = "k int, bin int, " + ", ".join(f"{c} double" for c in columns)
    with arrow_bytes(blocks.sparkSession, SENT_BYTES):
        found = blocks.mapInArrow(run, schema).groupBy("k", "bin").agg(*[F.sum(c).alias(c) for c in columns]).collect()
    return sorted(found, key=lambda r: (r["k"], r["bin"]))


def _step(blocks: DataFrame, fits: list[Ellipse], rank: Callable[[int], int]) -> list[Ellipse]:
    """Each ellipse fitted anew to the ``rank(n)`` rows of n that are nearest to it, and rows as far as the last of them."""
    p = len(fits[0].centre)
    prefix, below = [0] * len(fits), [0] * len(fits)
    wanted, shift = None, 63
    for width in _BITS[:2]:
        above, shift, bins = shift, shift - width, 1 << width

        def counted(k: int, off: np.ndarray, bits: np.ndarray, above=above, shift=shift, bins=bins, prefix=tuple(prefix)) -> np.ndarray:
            if above < 63:
                bits = bits[bits >> above == prefix[k]]
            return np.append(np.bincount((bits >> shift) & (bins - 1), minlength=bins), 0)[:, None]

        rows = _summed(blocks, fits, 1, counted)
        if wanted is None:
            wanted = rank(int(sum(r["v0"] for r in rows if r["k"] == 0)))
        for k in range(len(fits)):
            bin_, held = _counts(rows, k)
            reached = below[k] + np.cumsum(held)
            at = int(np.searchsorted(reached, wanted))
            below[k], prefix[k] = int(reached[at] - held[at]), prefix[k] << width | int(bin_[at])
    above, width = shift, _BITS[2]
    upper, lower = np.triu_indices(p + 1)

    def moments(k: int, off: np.ndarray, bits: np.ndarray) -> np.ndarray:
        total = np.zeros(((1 << width) + 1, len(upper)))
        top = bits >> above
        near = np.column_stack([np.ones(len(off)), off])
        inside = near[top < prefix[k]]
        total[-1] = (inside.T @ inside)[upper, lower]
        at = np.flatnonzero(top == prefix[k])
        np.add.at(total, (bits[at] >> (above - width)) & ((1 << width) - 1), near[at][:, upper] * near[at][:, lower])
        return total

    rows = _summed(blocks, fits, len(upper), moments)
    out = []
    for k, fit in enumerate(fits):
        sums, n = np.zeros(len(upper)), 0
        for r in (r for r in rows if r["k"] == k):  # what lies below comes first
            if n >= wanted:
                break
            sums += r[2:]
            n = sums[0]
        m = np.zeros((p + 1, p + 1))
        m[upper, lower] = m[lower, upper] = sums
        mean = m[0, 1:] / m[0, 0]
        out.append(Ellipse(fit.centre + mean, m[1:, 1:] / m[0, 0] - np.outer(mean, mean)))
    return out


def _counts(rows: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    found = [(r["bin"], r["v0"]) for r in rows if r["k"] == k]
    return np.array([b for b, _ in found], np.int64), np.array([v for _, v in found], np.int64)


def concentrated(table: DataFrame, names: list[str], fits: list[Ellipse], share: float) -> list[Ellipse]:
    """Each ellipse fitted anew to the share of the rows nearest to it."""
    return _step(packed(table, names), fits, lambda n: int(np.ceil(share * n * (1 - 1e-12))))


def densest_half(table: DataFrame, key: str, names: list[str], starts: int = STARTS) -> Ellipse | None:
    """The ellipse of least determinant found; None where the rows span no volume."""
    n, p = table.count(), len(names)
    if n <= p + 1:
        return None
    fits = _starts(table, key, names, n, starts)
    blocks = packed(table, names)

    def half(n: int) -> int:
        return (n + p + 2) // 2

    for _ in range(FIRST_STEPS if fits else 0):
        fits = _step(blocks, fits, half)
    fits = sorted(fits, key=lambda f: f.size)[:CARRIED]
    moving = list(range(len(fits)))
    for _ in range(MOST_STEPS):
        if not moving or fits[0].size < -600:  # half of the rows lie in a plane: no smaller one exists
            break
        for k, found in zip(moving[:], _step(blocks, [fits[k] for k in moving], half)):
            if abs(found.size - fits[k].size) < 1e-9:  # settled: a further step finds the same rows
                moving.remove(k)
            fits[k] = found
    return min(fits, key=lambda f: f.size, default=None)
