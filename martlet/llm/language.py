"""Language of texts by hierarchical discrimination.

A first linear support vector machine tells language families apart; within a family, one
machine for each pair of languages votes.  Features are hashed byte 2-, 3- and 4-grams of
the lower-cased text with everything but letters as blanks, scaled to unit length.

The machines learn from at most ``PER_LANGUAGE`` documents of each language, those with
the smallest hash of doc_id among the teaching rows (crc32(doc_id as text) mod 5 not 0,
lang not null).  This bound is a parameter; prediction reads every whole text.

Null texts, empty ones and those without a letter are ``und`` with score 0.  With one
language, or none, there is nothing to tell apart: that language, or ``und``.  Rows are
independent; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

import numpy as np
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlet.llm.words import map_texts
from martlet.session import work_path

BUCKETS = 2048
PER_LANGUAGE = 400
#: Machines that learn at the same time.
MACHINES = 4
#: Families of languages; a language outside is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb".split(), "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(), "uralic": "fi et hu".split(), "turkic": "tr az kk uz tk".split(),
    "indic": "hi ur bn mr gu pa ne si".split(), "semitic": "ar he mt am".split(), "sinitic": "zh yue".split(),
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_TIMES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def features(raw: bytes) -> np.ndarray:
    """Hashed n-gram counts of a text, damped by the root and scaled to unit length."""
    if not raw.isascii():
        raw = raw.decode("utf-8", "replace").lower().encode()
    codes = _LETTER[np.frombuffer(raw, np.uint8)]
    # runs of blanks become one
    codes = codes[np.flatnonzero((codes != 0) | (np.concatenate(([1], codes[:-1])) != 0))].astype(np.uint32) if len(codes) else codes
    total = np.zeros(BUCKETS)
    for size in (2, 3, 4):
        n = len(codes) - size + 1
        if n <= 0:
            break
        hashed = np.full(n, size, np.uint32)
        for k in range(size):
            hashed = (hashed ^ codes[k:k + n].astype(np.uint32)) * np.uint32(_TIMES[k])
            hashed ^= hashed >> np.uint32(15)
        total += np.bincount(hashed >> np.uint32(21), minlength=BUCKETS)
    total = np.sqrt(total)
    length = math.sqrt(float(total @ total))
    return total / length if length else total


class Model:
    """Weights of the machines; ``pairs`` has those of families and of languages by (one, other)."""

    def __init__(self, languages: list[str], pairs: dict[tuple[str, str], tuple[np.ndarray, float]]):
        self.languages, self.pairs = languages, pairs
        self.families: dict[str, list[str]] = {}
        for lang in languages:
            self.families.setdefault(FAMILY.get(lang, lang), []).append(lang)

    def _vote(self, among: list[str], kind: str, x: np.ndarray) -> tuple[str, float]:
        """The one with most votes, ties by margin; and the least chance it had against another."""
        if len(among) == 1:
            return among[0], 1.0
        votes = {a: [0, 0.0] for a in among}
        chances = {a: 1.0 for a in among}
        for one, other in combinations(among, 2):
            weights, base = self.pairs[(f"{kind}:{one}", f"{kind}:{other}")]
            margin = float(weights @ x) + base  # positive: the other one
            chance = 1 / (1 + math.exp(-max(-30.0, min(30.0, 2 * margin))))
            for a, m, c in ((one, -margin, 1 - chance), (other, margin, chance)):
                votes[a][0] += m > 0
                votes[a][1] += m
                chances[a] = min(chances[a], c)
        best = max(among, key=lambda a: (votes[a], a))
        return best, chances[best]

    def predict(self, raw: bytes) -> tuple[str, float]:
        if not self.languages or not any(c.isalpha() for c in raw.decode("utf-8", "replace")):
            return "und", 0.0
        x = features(raw)
        family, sure = self._vote(sorted(self.families), "family", x)
        lang, within = self._vote(sorted(self.families[family]), "lang", x)
        return lang, sure * within


def teaching_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text) of the teaching rows with the smallest hashes, so many for each language.

    Which rows is decided without their texts; a task sends no more than the bound.
    """
    may = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                     & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(10))
    ranked = may.select("lang", "doc_id", F.row_number().over(W.partitionBy("lang").orderBy(order, "doc_id")).alias("_llm_rank"))
    chosen = ranked.where(F.col("_llm_rank") <= per_language).select(
        F.col("lang").alias("_llm_lang"), F.col("doc_id").alias("_llm_doc")).distinct()
    return may.join(chosen, (F.col("lang") == F.col("_llm_lang")) & (F.col("doc_id") == F.col("_llm_doc"))).select("lang", "text")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    spark = docs.sparkSession
    path = work_path(spark, "language")
    vectors = map_texts(teaching_sample(docs, per_language), lambda raw: (features(raw).tolist(),), "x array<double>")
    vectors.write.parquet(path)
    sample = spark.read.parquet(path)
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    family = F.coalesce(*[F.when(F.col("lang").isin(langs), F.lit(f)) for f, langs in FAMILIES.items()], F.col("lang"))
    known = Model(languages, {})
    data = sample.select("lang", family.alias("family"), array_to_vector("x").alias("features")).repartition(4).cache()

    def machine(column: str, one: str, other: str) -> tuple[np.ndarray, float]:
        two = data.where(F.col(column).isin(one, other)).select("features", (F.col(column) == other).cast("double").alias("label"))
        svm = LinearSVC(regParam=1e-3, maxIter=25, standardization=False).fit(two)
        return np.array(svm.coefficients.toArray()), float(svm.intercept)

    wanted = [("family", a, b) for a, b in combinations(sorted(known.families), 2)]
    wanted += [("lang", a, b) for langs in known.families.values() for a, b in combinations(sorted(langs), 2)]
    try:
        # a machine's steps are small jobs one after another, so several machines learn at once
        with ThreadPoolExecutor(MACHINES) as at_once:
            for (kind, a, b), weights in zip(wanted, at_once.map(lambda w: machine(*w), wanted)):
                known.pairs[(f"{kind}:{a}", f"{kind}:{b}")] = weights
    finally:
        data.unpersist()
    return known


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The table's other columns with ``_llm_lang`` and ``_llm_score``."""
    return map_texts(docs, model.predict, "_llm_lang string, _llm_score double", text)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    model = fit(docs.select("doc_id", "text", "lang"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("_llm_lang").alias("lang_pred"),
        F.col("_llm_score").alias("score"))
