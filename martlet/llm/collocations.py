"""Phrases of two and three words that stand together, from an FM-index per shard.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces
into words at spaces and tabs.  Each task gathers the words of one language into shards
of up to some SHARD_WORDS words, numbers them, and indexes the shard in both directions: the
Burrows-Wheeler transform of the numbers (ordered by the DEPTH symbols that follow) with
symbol ranks.  An interval of the order stands for an n-gram; extending it to the left
gives the intervals of all longer n-grams with their counts, and keeps in step the interval
of the reversed index, from which it is extended to the right.  Counts are summed over shards.

Two passes read the texts.  The first sums n-grams under 64-bit keys and keeps those that
may reach LEAST as a filter of fixed size (`blocks`).  The second counts, as strings, the
n-grams that pass: no other can reach LEAST.  Keys only spare work; all counts are of the
words themselves.

Null and empty texts have no words; a null lang is ``und``.  Rows that repeat count each
time.  Only lang and text are read, so other columns cannot clash.  An empty table gives an
empty one.  A shard may hold one longer text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlet.llm.blocks import SCHEMA, Filter, bucket_bits, heavy, packed
from martlet.llm.words import mix, texts_of
from martlet.session import work_path

LEAST, DEPTH, TOP = 10, 3, 2000
#: Words of a shard, and of all the shards that a task has open.
SHARD_WORDS = 1 << 18
#: Counted keys that a task gathers before it sends them.
HELD_KEYS = 1 << 20

_STOPS = b".,;:!?\n\x0b\x0c\r"
_LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _STOPS, b"abcdefghijklmnopqrstuvwxyz " + b"." * len(_STOPS))
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """A number for each new word; the end of a piece is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Shard:
    """The numbered words of texts in one language; 0 ends a piece."""

    def __init__(self, lang: str):
        self.lang, self.numbers, self.parts, self.size = lang, _Numbers({b".": 0}), [np.zeros(1, np.int64)], 0

    def add(self, raw: bytes) -> None:
        words = raw.translate(_LETTERS).replace(b".", b" . ").split()
        self.parts += [np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
        self.size += len(words)

    def text(self) -> np.ndarray:
        return np.concatenate(self.parts)

    def hashes(self) -> np.ndarray:
        """A 64-bit key for each word, other ones in each language."""
        seed = xxhash.xxh3_64_intdigest(self.lang.encode())
        return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.numbers], np.uint64)


class Index:
    """The transform of a text over 0..symbols-1 that ends with 0, for patterns of up to DEPTH symbols."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        ahead = np.concatenate((text, np.zeros(DEPTH, np.int64)))
        if symbols < 1 << (63 // DEPTH):
            key = ahead[:n].copy()
            for k in range(1, DEPTH):
                key = key * symbols + ahead[k:n + k]
            order = np.argsort(key, kind="stable")
        else:
            order = np.lexsort([ahead[k:n + k] for k in reversed(range(DEPTH))])
        self.symbols = symbols
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.bwt = text[order - 1]  # what stands before; the text's end stands before its start
        self.ranks = np.sort(self.bwt << 32 | np.arange(n))

    def extended(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """All extensions of the intervals: (interval, symbol, low, count, how many stand in smaller symbols)."""
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(owner)) + np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        key, count = np.unique(owner * self.symbols + self.bwt[at], return_counts=True)
        owner, symbol = np.divmod(key, self.symbols)
        before = np.cumsum(count) - count
        before -= before[np.searchsorted(owner, owner)]  # from the first of the same interval
        whole = symbol > 0  # 0 ends a piece
        owner, symbol, count, before = owner[whole], symbol[whole], count[whole], before[whole]
        return owner, symbol, np.searchsorted(self.ranks, symbol << 32 | low[owner]), count, before


def bigram_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _ODD + right)


def trigram_keys(left: np.ndarray, middle: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(bigram_keys(left, middle) * _ODD + right)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    open_: dict[str, Shard] = {}
    words = 0
    for batch in batches:
        for lang, raw in zip(batch.column("lang").to_pylist(), texts_of(batch, "text")):
            shard = open_.get(lang) or open_.setdefault(lang, Shard(lang))
            words -= shard.size
            shard.add(raw or b"")
            words += shard.size
            if words >= SHARD_WORDS:  # many languages hold no more than one does
                largest = max(open_.values(), key=lambda s: s.size)
                words -= largest.size
                yield open_.pop(largest.lang)
    yield from open_.values()


def _keys(docs: DataFrame, bits: int) -> DataFrame:
    """Blocks of how often words, bigrams and trigrams occur."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def sent() -> pa.RecordBatch:
            key, n = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key)
            key = key[order]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            return packed(key[start], np.add.reduceat(n[order], start), bits)

        for shard in _shards(batches):
            text, of = shard.text(), shard.hashes()
            index = Index(text, len(of))
            low, high = index.first[1:-1], index.first[2:]
            owner, left, start, count, _ = index.extended(low, high)
            right = owner + 1
            owner, first, _, often, _ = index.extended(start, start + count)
            keys += [mix(of[1:]), bigram_keys(of[left], of[right]), trigram_keys(of[first], of[left[owner]], of[right[owner]])]
            counts += [high - low, count, often]
            held += len(low) + len(count) + len(often)
            if held >= HELD_KEYS:
                yield sent()
                keys, counts, held = [], [], 0
        if held:
            yield sent()

    return docs.mapInArrow(run, SCHEMA)


def _counted(docs: DataFrame, wanted: Filter) -> DataFrame:
    """(lang, words, phrase, n) of each shard; without a phrase, n is the number of all words."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def rows(shard: Shard, wanted: Filter) -> Iterator[pa.RecordBatch]:
        text, of = shard.text(), shard.hashes()
        symbols = len(of)
        names = pa.array(list(shard.numbers), pa.binary())

        def batch(words: int, parts: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
            taken = [names.take(pa.array(p)) for p in parts]
            phrase = taken[0] if words == 1 else pc.binary_join_element_wise(*taken, pa.scalar(b" ", pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([shard.lang] * len(n), pa.string()), pa.array(np.full(len(n), words, np.int32)),
                                               phrase.cast(pa.string()), pa.array(n.astype(np.int64))], ["lang", "words", "phrase", "n"])

        total = int((text > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array([shard.lang], pa.string()), pa.array([0], pa.int32()), pa.nulls(1, pa.string()),
                                          pa.array([total], pa.int64())], ["lang", "words", "phrase", "n"])
        ahead, back = Index(text, symbols), Index(text[::-1], symbols)
        low, high = ahead.first[1:-1], ahead.first[2:]
        often = np.flatnonzero(wanted.passes(mix(of[1:])))
        yield batch(1, [often + 1], (high - low)[often])
        owner, left, start, count, before = ahead.extended(low[often], high[often])
        right = often[owner] + 1
        reverse = back.first[right] + before  # the bigram's interval among the reversed texts
        passed = wanted.passes(bigram_keys(of[left], of[right]))
        left, right, count, reverse = left[passed], right[passed], count[passed], reverse[passed]
        yield batch(2, [left, right], count)
        owner, last, _, count, _ = back.extended(reverse, reverse + count)
        passed = wanted.passes(trigram_keys(of[left[owner]], of[right[owner]], of[last]))
        owner = owner[passed]
        yield batch(3, [left[owner], right[owner], last[passed]], count[passed])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            if shard.size:
                yield from rows(shard, sent.value)

    return docs.mapInArrow(run, "lang string, words int, phrase string, n long")


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, n): all words and phrases found ``least`` times, and per lang the number of all words (no phrase)."""
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    bits = bucket_bits(docs.sparkSession)
    wanted = heavy(_keys(read, bits), least, bits)
    path = work_path(docs.sparkSession, "phrases")
    (_counted(read, wanted).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
     .where((F.col("n") >= least) | (F.col("words") == 0)).write.parquet(path))
    return docs.sparkSession.read.parquet(path)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each lang's first ``top`` phrases by how much oftener they occur than their parts would by chance."""
    counts = phrase_counts(docs, least)
    totals = counts.where("words = 0").select("lang", F.col("n").alias("n"))
    found = counts.where("words > 0")
    part = found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("times"))
    cuts = (found.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), "words",
                                            F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
            .withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
            .withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)")))
    scored = (cuts.join(part.withColumnsRenamed({"part": "first", "times": "l"}), ["lang", "first"])
              .join(part.withColumnsRenamed({"part": "rest", "times": "r"}), ["lang", "rest"])
              .withColumn("score", F.expr("(cast(1000000 as decimal(38, 0)) * a * a) div (cast(l as decimal(38, 0)) * r)"))
              .groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    # a bigram goes where a trigram that holds it is found half as often
    longer = (found.where("words = 3")
              .select("lang", "n", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("n").alias("longer")))
    kept = scored.join(longer, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 50 * a")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^ \t]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
        FROM documents WHERE text IS NOT NULL)),
gram AS (
  SELECT lang, 1 AS words, unnest(w) AS phrase FROM piece
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM piece
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM piece),
counts AS (SELECT lang, words, phrase, count(*) AS n FROM gram GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM counts WHERE words = 1 GROUP BY lang),
cut AS (
  SELECT lang, phrase, words, n AS a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS f,
         array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS t
  FROM (SELECT *, unnest(range(1, words)) AS k FROM counts WHERE words > 1 AND n >= 10)),
scored AS (
  SELECT c.lang, c.phrase, c.words, c.a, c.k, x.n AS l, y.n AS r,
         ((1000000::HUGEINT * c.a * c.a) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cut c JOIN counts x ON x.lang = c.lang AND x.phrase = c.f JOIN counts y ON y.lang = c.lang AND y.phrase = c.t),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[:2], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) AS phrase, a
  FROM lowest WHERE words = 3),
kept AS (
  SELECT * FROM lowest c WHERE NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = c.lang AND x.phrase = c.phrase AND c.words = 2 AND 100 * x.a >= 50 * c.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= 2000
"""
