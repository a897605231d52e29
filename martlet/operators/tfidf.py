"""TF-IDF weights of product texts in long form."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def terms_of(c: Column, stop_words) -> Column:
    """Words of two characters or more without stop words, and pairs of neighbours."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w\w+\b"), 0)
    kept = F.filter(found, lambda w: ~w.isin(*stop_words)) if stop_words else found
    pairs = F.zip_with(kept, F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(kept, F.filter(pairs, lambda p: p.isNotNull()))


def term_counts(df: DataFrame, key: str, text: str, stop_words=None) -> DataFrame:
    """(key, term, tf)."""
    stop_words = english_stop_words() if stop_words is None else stop_words
    return (df.select(key, F.explode(terms_of(F.col(text), stop_words)).alias("term"))
            .groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))


def vocabulary(counts: DataFrame, n_docs: Column, max_terms: int = 5000, min_df: int = 2,
               max_df: float = 0.8) -> DataFrame:
    """(term, df, total): at most ``max_terms`` terms that are neither rare nor everywhere."""
    return (counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
            .where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
            .orderBy(F.desc("total"), F.asc("term")).limit(max_terms))


def tfidf(df: DataFrame, key: str, text: str, stop_words=None, **limits) -> DataFrame:
    """(key, term, weight) with smoothed idf and unit length per key."""
    n_docs = df.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    counts = term_counts(df, key, text, stop_words)
    terms = vocabulary(counts, n_docs, **limits)
    idf = F.log((1 + n_docs) / (1 + F.col("df"))) + 1
    # the vocabulary is capped at max_terms rows by definition of the model
    raw = counts.join(F.broadcast(terms), "term").select(
        key, "term", (F.col("tf") * idf).alias("w"))
    return unit_length(raw, key, "term", "w")


def unit_length(long: DataFrame, key: str, feature: str, weight: str) -> DataFrame:
    """Scale every key's weights to length one."""
    packed = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(feature, weight))).alias("f"))
    length = F.sqrt(F.aggregate("f", F.lit(0.0), lambda s, x: s + x[weight] * x[weight]))
    return (packed.withColumn("length", length).where("length > 0")
            .select(key, "length", F.explode("f").alias("x"))
            .select(key, F.col(f"x.{feature}").alias(feature), (F.col(f"x.{weight}") / F.col("length")).alias("weight")))


def model_summary(weights: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Number of terms and share of non-zero cells of the term matrix."""
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return weights.agg(F.count_distinct("term").alias("n_features"), F.count(F.lit(1)).alias("cells")).select(
        rows.alias("n_products"), "n_features",
        F.try_divide(F.col("cells"), rows * F.col("n_features")).alias("density"))


def top_terms(weights: DataFrame, n: int = 50) -> DataFrame:
    """Terms by summed weight."""
    score = F.round(F.sum("weight"), 6)
    return (weights.groupBy("term").agg(score.alias("score"))
            .orderBy(F.desc("score"), F.asc("term")).limit(n))


