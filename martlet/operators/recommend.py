"""Similar products by text, by features, and by both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.functions.text import combined_text
from martlet.operators import graph
from martlet.operators.features import min_max, one_hot_long
from martlet.operators.graph import CONTENT_WEIGHT, FEATURE_WEIGHT
from martlet.operators.linalg import moments_matrix, truncated_svd
from martlet.operators.profile import category_stats
from martlet.operators.quality import coverage
from martlet.operators.similarity import most_similar
from martlet.operators.tfidf import tfidf, unit_length
from martlet.operators.topk import value_counts
from martlet.schema import TEXT_FIELDS, present
from martlet.session import saved

ATTRIBUTES = ("title", "brand", "category", "price", "rating", "url")


def content_vectors(products: DataFrame, key: str = "product_id") -> DataFrame:
    """(key, feature, weight): TF-IDF of the combined text."""
    columns = [F.col(c) for c in present(products, TEXT_FIELDS)]
    texts = products.select(key, combined_text(*columns).alias("text"))
    return tfidf(texts, key, "text").select(key, F.col("term").alias("feature"), "weight")


def feature_vectors(products: DataFrame, key: str = "product_id") -> DataFrame:
    """(key, feature, weight): scaled numbers and common brands and categories."""
    scaled = min_max(products)
    names = [c for c in scaled.columns if c.endswith("_normalized")]
    numbers = (scaled.select(key, *names).unpivot([key], names, "feature", "value").where("value <> 0"))
    marks = one_hot_long(products, key)
    return unit_length(numbers.union(marks), key, "feature", "value")


def hybrid_vectors(products: DataFrame, key: str = "product_id") -> DataFrame:
    """Both kinds side by side, weighted so that the dot product of two vectors is
    0.6 times the text similarity plus 0.4 times the feature similarity."""
    def part(long, kind, share):
        return long.select(key, F.concat(F.lit(f"{kind}:"), F.col("feature")).alias("feature"),
                           (F.col("weight") * F.sqrt(F.lit(share))).alias("weight"))
    return part(content_vectors(products, key), "text", CONTENT_WEIGHT).union(
        part(feature_vectors(products, key), "value", FEATURE_WEIGHT))


_VECTORS = {"content": content_vectors, "collaborative": feature_vectors, "hybrid": hybrid_vectors}


def similar_products(products: DataFrame, k: int = 10, method: str = "hybrid",
                     key: str = "product_id") -> DataFrame:
    """The ``k`` most similar products of every product.  Filter on ``key`` for one
    product; an unknown one has no rows.  Without any text column the feature
    similarity stands in for the others, and the method says so."""
    if method != "collaborative" and not present(products, TEXT_FIELDS):
        method = "collaborative"
    edges = most_similar(_VECTORS[method](products, key), key, k)
    return edges.withColumn("method", F.lit(method))


def similar_to(products: DataFrame, ids: DataFrame, k: int = 10, method: str = "hybrid",
               key: str = "product_id") -> DataFrame:
    """As ``similar_products``, for the few products in ``ids`` (a column ``key``) only: these are probed, others are not."""
    if method != "collaborative" and not present(products, TEXT_FIELDS):
        method = "collaborative"
    packed = _VECTORS[method](products, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("feature", "weight"))).alias("v"))
    packed = saved(packed, "vectors")
    edges = graph.nearest_to(packed.join(ids, key, "left_semi"), packed, k, key)
    return edges.withColumn("method", F.lit(method))


def hybrid_edges(content: DataFrame, features: DataFrame, key: str = "product_id") -> DataFrame:
    """Weighted sum of two edge tables (full outer join); a missing edge counts 0.

    For edge tables that are complete; ``similar_products`` with method 'hybrid'
    finds the nearest by the combined score directly.
    """
    a = content.select(key, "neighbour", F.col("similarity").alias("text_sim"))
    b = features.select(key, "neighbour", F.col("similarity").alias("value_sim"))
    both = a.join(b, [key, "neighbour"], "full")
    return both.select(key, "neighbour", (
        CONTENT_WEIGHT * F.coalesce("text_sim", F.lit(0.0))
        + FEATURE_WEIGHT * F.coalesce("value_sim", F.lit(0.0))).alias("similarity"))


def with_attributes(edges: DataFrame, products: DataFrame, key: str = "product_id") -> DataFrame:
    """Attributes of the recommended product on every edge."""
    shown = products.select(F.col(key).alias("neighbour"), *present(products, ATTRIBUTES))
    return edges.join(shown, "neighbour")


def feature_matrix(products: DataFrame) -> tuple[DataFrame, list[str]]:
    """Wide form of the feature columns: scaled numbers and 0/1 marks."""
    scaled = min_max(products)
    columns = {c: F.col(c) for c in scaled.columns if c.endswith("_normalized")}
    for c in present(products, ("brand", "category")):
        for row in value_counts(products, c, 20).collect():  # 20 rows
            columns[f"{c}_{row[c]}"] = F.coalesce((F.col(c) == row[c]).cast("double"), F.lit(0.0))
    return scaled.select(*[v.alias(f"x{i}") for i, v in enumerate(columns.values())]), list(columns)


def reduced_features(products: DataFrame, components: int = 50) -> DataFrame:
    """Truncated SVD of the feature matrix: singular values and explained variance."""
    wide, names = feature_matrix(products)
    n, sums, products_ = moments_matrix(wide, wide.columns)
    k = min(components, len(names) - 1)
    values, _, ratio = truncated_svd(n, sums, products_, k)
    rows = [(i + 1, float(values[i]), float(ratio[i])) for i in range(k)]
    return products.sparkSession.createDataFrame(
        rows, "component int, singular_value double, explained_variance_ratio double")


def recommendation_report(products: DataFrame, key: str = "product_id") -> DataFrame:
    """(section, name, value): sizes, coverage, categories and sample lists."""
    cover = coverage(products)
    parts = cover.unpivot([], cover.columns, "name", "value").select(
        F.lit("data_quality").alias("section"), "name", F.col("value").cast("string").alias("value"))
    size = products.agg(F.count(F.lit(1)).cast("string").alias("value")).select(
        F.lit("system_overview").alias("section"), F.lit("total_products").alias("name"), "value")
    categories = category_stats(products).select(
        F.lit("category_analysis").alias("section"), F.col("category").alias("name"),
        F.col("count").cast("string").alias("value"))
    first = products.select(key).orderBy(key).limit(5)
    samples = similar_to(products, first, 5, "hybrid", key).where("rank <= 3").select(
        F.lit("sample_recommendations").alias("section"),
        F.concat(F.col(key).cast("string"), F.lit("_hybrid_"), F.col("rank").cast("string")).alias("name"),
        F.col("neighbour").cast("string").alias("value"))
    return size.union(parts).union(categories).union(samples)
