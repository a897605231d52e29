"""Benchmark passages in documents, found by spaced seeds and verified around the hits.

Words are runs of letters and digits in lower case.  A mask looks at some positions of a
span of words and ignores the others, so a hash of the positions looked at agrees in
spite of a substituted word at an ignored one.  Every document position is hashed under
each mask and met with the hashes of the benchmark; a hit fixes how item and document
lie on each other, and the words that lie on each other are then compared one by one.  A
stretch counts if it has ``LEAST`` words (or the whole item, if that is shorter) and at
least four fifths of them are equal, wherever the substituted ones stand; only where these
leave no mask a place to fit is there no hit (22 of the 455 ways to swap 3 words of 15, 12
of the 4,845 ways to swap 4 of 20, none for 3 of 18 or 19).  Reported is the
stretch of greatest score, one per equal word less ``PENALTY`` per substituted one, and
where that one is too short to count, the longest one with four fifths equal.

The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words, each of which passes
over all documents, so what a task holds is bounded whatever the benchmark's size.

Null or empty texts and items match nothing.  Repeated items and documents give repeated
matches.  Empty tables give an empty result.  Items shorter than the shortest mask are
met as a whole, word for word.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm.words import PUNCTUATION, map_texts, mix, seeds, windows, word_hashes

# The masks; # is looked at, - is ignored.  The last is for short items.
MASKS = ("##-#--##-#-##", "###--#-#--#-##", "#-##--#-###-#", "##---####--#", "#-#-##-#")
LEAST, PENALTY = 13, 4  # with this penalty a score of 0 is exactly four fifths equal
#: Words of the benchmark that a task holds at once: 2 million are some 300 MB with all hashes.
BLOCK_WORDS = 500_000
_PLACES = [np.flatnonzero([c == "#" for c in m]) for m in MASKS]
_SEEDS = seeds(len(MASKS), 9000)


def _folded(raw: bytes) -> bytes:
    """Lower case beyond A-Z, too."""
    return raw if raw.isascii() else raw.decode("utf-8", "replace").lower().encode()


def _masked(words: np.ndarray, mask: int) -> np.ndarray:
    """A hash under the mask for each position at which it fits."""
    n = len(words) - len(MASKS[mask]) + 1
    if n <= 0:
        return words[:0]
    out = np.full(n, _SEEDS[mask])
    for p in _PLACES[mask]:
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[p:p + n]
    return mix(out)


class Block:
    """The hashed items of one block, sorted for searches."""

    def __init__(self, texts: list[bytes]):
        self.items = [word_hashes(_folded(t), PUNCTUATION) for t in texts]
        found, self.short = [], {}
        for k, words in enumerate(self.items):
            if 0 < len(words) < len(MASKS[-1]):
                self.short.setdefault(len(words), []).append((windows(words, len(words))[0], k))
            for mask in range(len(MASKS)):
                hashed = _masked(words, mask)
                found.append(np.stack((hashed, np.full(len(hashed), k, np.uint64), np.arange(len(hashed), dtype=np.uint64))))
        table = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.uint64)
        table = table[:, np.argsort(table[0], kind="stable")]
        self.hashes, self.item, self.place = table[0].copy(), table[1].astype(np.int64), table[2].astype(np.int64)
        self.seen = np.zeros(1 << 22, bool)  # by the top bits: most positions end here
        self.seen[self.hashes >> np.uint64(42)] = True

    def matches(self, raw: bytes) -> list[tuple[int, int, int, int]]:
        """(item, words equal, first word, words) of the best stretch for each item that counts."""
        words = word_hashes(_folded(raw), PUNCTUATION)
        lying: set[tuple[int, int]] = set()
        for mask in range(len(MASKS)):
            hashed = _masked(words, mask)
            maybe = np.flatnonzero(self.seen[hashed >> np.uint64(42)])
            low = np.searchsorted(self.hashes, hashed[maybe], "left")
            high = np.searchsorted(self.hashes, hashed[maybe], "right")
            for at, a, b in zip(maybe[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                lying.update(zip(self.item[a:b].tolist(), (at - self.place[a:b]).tolist()))
        best: dict[int, tuple[int, int, int]] = {}
        for item, shift in lying:
            mine = self.items[item]
            start, stop = max(0, shift), min(len(words), shift + len(mine))
            equal = words[start:stop] == mine[start - shift:stop - shift]
            need = min(LEAST, len(mine))
            got = _stretch(equal)
            if got and got[2] < need:
                got = _longest(equal)
            if got and got[2] >= need:
                best[item] = max(best.get(item, (0, 0, 0)), (got[0], start + got[1], got[2]))
        for size, items in self.short.items():
            if len(words) >= size:
                whole = windows(words, size)
                for hashed, item in items:
                    if len(at := np.flatnonzero(whole == hashed)):
                        best[item] = (size, int(at[0]), size)
        return sorted((item, *b) for item, b in best.items())


def _stretch(equal: np.ndarray) -> tuple[int, int, int] | None:
    """(words equal, start, words) of the stretch of greatest score; the first of equals."""
    if not equal.any():
        return None
    sums = np.concatenate(([0], np.cumsum(np.where(equal, 1, -PENALTY))))
    lowest = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - lowest))
    start = int(np.flatnonzero(sums[:end + 1] == lowest[end])[-1])
    return int(equal[start:end].sum()), start, end - start


def _longest(equal: np.ndarray) -> tuple[int, int, int] | None:
    """(words equal, start, words) of the longest stretch with four fifths equal; the first of equals."""
    sums = np.concatenate(([0], np.cumsum(np.where(equal, 1, -PENALTY))))
    # a start pays only where the sum is lower than before; ends come from the back, starts are used up in turn
    lows = np.flatnonzero(sums < np.concatenate(([1], np.minimum.accumulate(sums)[:-1]))).tolist()
    best = (0, 0)
    for end in range(len(equal), 0, -1):
        while lows and sums[lows[-1]] <= sums[end]:
            start = lows.pop()
            best = max(best, (end - start, -start))
    size, start = best[0], -best[1]
    return (int(equal[start:start + size].sum()), start, size) if size > 0 else None


def _blocks(items: DataFrame) -> list[tuple[list, list[bytes]]]:
    """The benchmark's (ids, texts), cut by words; one block is on the driver at a time.

    An item longer than a block is a block of its own.
    """
    from pyspark.sql import Window as W

    sized = items.where("text IS NOT NULL").select("item_id", "text", F.xxhash64("text").alias("h"),
                                                   F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    parts = -(-total // BLOCK_WORDS)
    for part in range(parts):
        rows = sized.where(F.pmod("h", F.lit(parts)) == part).orderBy("item_id", "text").collect()
        yield [r["item_id"] for r in rows], [r["text"].encode() for r in rows]


def overlaps(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """A row for each document and item that match: the table's other columns with the match."""
    found = []
    for ids, texts in _blocks(items):
        block = Block(texts)

        def one(raw: bytes, ids=ids, block=block):
            return ([{"item_id": ids[k], "words_equal": n, "first_word": a, "words": m, "item_words": len(block.items[k])}
                     for k, n, a, m in block.matches(raw)],)

        found.append(map_texts(docs, one, "_llm_hits array<struct<item_id:bigint,words_equal:int,first_word:int,"
                                          "words:int,item_words:int>>", text))
    if not found:
        nothing = map_texts(docs.limit(0), lambda raw: ([],), "_llm_hits array<struct<item_id:bigint,words_equal:int,"
                                                              "first_word:int,words:int,item_words:int>>", text)
        found = [nothing]
    return reduce(DataFrame.union, found)


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, words_equal, first_word, words, item_words) of every overlap."""
    hits = overlaps(docs.select("doc_id", "text"), items)
    return hits.select("doc_id", F.explode("_llm_hits").alias("h")).select("doc_id", "h.*")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without an overlap; a document goes if any block of the benchmark matches."""
    kept = docs
    for ids, texts in _blocks(items):
        block = Block(texts)

        def one(raw: bytes, block=block):
            return (bool(block.matches(raw)),)

        kept = map_texts(kept.withColumn("_llm_text", F.col("text")), one, "_llm_hit boolean", "_llm_text")
        kept = kept.where("NOT _llm_hit").select(*docs.columns)
    return kept
