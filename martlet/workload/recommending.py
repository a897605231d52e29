"""Queries: ranked lists and similar products."""

from __future__ import annotations

from pyspark.sql import functions as F

from martlet.operators import graph, quality, ranking, recommend, tfidf
from martlet.session import work_path
from martlet.sources import versions
from martlet.workload.registry import query


@query("""SELECT product_id, title, brand, category, price, rating, reviews_count, url,
       'rating' AS sort_criteria, 'category_based' AS method FROM products
WHERE regexp_matches(category, '(?i)economy') ORDER BY rating DESC NULLS LAST, product_id LIMIT 10""", "price rating")
def category_best_rated(t):
    return ranking.best_in_category(t.products, "economy", 10, "rating")


@query("""SELECT product_id, title, brand, category, price, rating, reviews_count, url,
       'price' AS sort_criteria, 'category_based' AS method FROM products
WHERE regexp_matches(category, '(?i)small') ORDER BY price NULLS LAST, product_id LIMIT 10""", "price rating")
def category_cheapest(t):
    return ranking.best_in_category(t.products, "small", 10, "price")


@query("""SELECT product_id, title, brand, category, price, rating, reviews_count, url,
       'reviews_count' AS sort_criteria, 'category_based' AS method FROM products
WHERE regexp_matches(category, '(?i)promo') ORDER BY reviews_count DESC NULLS LAST, product_id LIMIT 10""",
       "price rating")
def category_most_reviewed(t):
    return ranking.best_in_category(t.products, "promo", 10, "reviews_count")


@query("""SELECT product_id, title, brand, category, price, rating, reviews_count, url,
       round(abs(price - 950) / 950 * 100, 2) AS price_difference_pct, 950.0::DOUBLE AS target_price,
       'price_based' AS method FROM products WHERE price BETWEEN 950 * (1 - 0.2) AND 950 * (1 + 0.2)
ORDER BY rating DESC NULLS LAST, product_id LIMIT 10""", "price rating price_difference_pct target_price")
def price_band_best(t):
    return ranking.best_near_price(t.products, 950.0)


def trending_sql(cutoff: str) -> str:
    return f"""WITH r AS (SELECT * FROM products WHERE scraped_at >= {cutoff}),
k AS (SELECT count(*) AS n FROM r),
s AS (SELECT * FROM r UNION ALL SELECT * FROM products WHERE (SELECT n FROM k) = 0),
m AS (SELECT max(price) AS top, max(scraped_at) AS newest FROM s),
c AS (SELECT s.*, round((coalesce(reviews_count, 0) + coalesce(rating, 0) * 20
        + (top - coalesce(price, top)) / top * 100
        + exp(-epoch(newest - scraped_at) / 86400.0) * 100) / 4, 6) AS score FROM s, m
      WHERE scraped_at IS NOT NULL
      UNION ALL SELECT s.*, round((coalesce(reviews_count, 0) + coalesce(rating, 0) * 20
        + (top - coalesce(price, top)) / top * 100) / 3, 6) FROM s, m WHERE scraped_at IS NULL)
SELECT product_id, title, brand, category, price, rating, reviews_count, url,
       round(score, 2) AS trending_score, 'trending' AS method FROM c ORDER BY score DESC, product_id LIMIT 10"""


@query(trending_sql("TIMESTAMP '2001-10-20' - INTERVAL 7 DAY"), "price rating trending_score")
def trending_products(t):
    return ranking.trending(t.products, "2001-10-20", 7, 10)


@query(trending_sql("TIMESTAMP '2026-01-01' - INTERVAL 7 DAY"), "price rating trending_score")
def trending_without_recent(t):
    return ranking.trending(t.products, "2026-01-01", 7, 10)


TERMS = """docs AS (SELECT product_id, regexp_extract_all(lower(regexp_replace(
    concat_ws(' ', title, brand, category), '[^a-zA-Z0-9\\s]', '', 'g')), '\\b\\w\\w+\\b') AS w FROM products),
grams AS (SELECT product_id, unnest(w) AS term FROM docs
  UNION ALL SELECT product_id, unnest(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) FROM docs),
tf AS (SELECT product_id, term, count(*) AS tf FROM grams GROUP BY 1, 2),
vocab AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1
  HAVING count(*) >= 2 AND count(*) <= 0.8 * (SELECT count(*) FROM products)
  ORDER BY total DESC, term LIMIT 5000),
raw AS (SELECT product_id, term, tf * (ln((1.0 + (SELECT count(*) FROM products)) / (1 + df)) + 1) AS w
  FROM tf JOIN vocab USING (term)),
content AS (SELECT product_id, term AS feature, w / sqrt(sum(w * w) OVER (PARTITION BY product_id)) AS weight FROM raw)"""

VALUES = """lim AS (SELECT min(price) AS p0, max(price) AS p1, min(rating) AS r0, max(rating) AS r1,
  min(reviews_count) AS v0, max(reviews_count) AS v1, quantile_cont(price, 0.5) AS pm,
  quantile_cont(rating, 0.5) AS rm, quantile_cont(reviews_count, 0.5) AS vm FROM products),
brands AS (SELECT brand FROM products WHERE brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20),
cats AS (SELECT category FROM products WHERE category IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20),
raw_values AS (
  SELECT product_id, 'price' AS feature, (coalesce(price, pm) - p0) / (p1 - p0) AS w FROM products, lim
  UNION ALL SELECT product_id, 'rating', (coalesce(rating, rm) - r0) / (r1 - r0) FROM products, lim
  UNION ALL SELECT product_id, 'reviews', (coalesce(reviews_count, vm) - v0) / (v1 - v0) FROM products, lim
  UNION ALL SELECT product_id, concat('b', brand), 1.0 FROM products WHERE brand IN (SELECT brand FROM brands)
  UNION ALL SELECT product_id, concat('c', category), 1.0 FROM products WHERE category IN (SELECT category FROM cats)),
feats AS (SELECT product_id, feature, w / sqrt(sum(w * w) OVER (PARTITION BY product_id)) AS weight FROM raw_values)"""


def nearest_sql(vectors: str, k: int) -> str:
    return f"""sims AS (SELECT a.product_id, b.product_id AS neighbour, round(sum(a.weight * b.weight), 6) AS similarity
  FROM {vectors} a JOIN {vectors} b ON a.feature = b.feature AND a.product_id <> b.product_id GROUP BY 1, 2)
SELECT product_id, neighbour, similarity, CAST(r AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY similarity DESC, neighbour) AS r
  FROM sims WHERE similarity > 0) WHERE r <= {k}"""


@query(f"""WITH {TERMS}
SELECT product_id, feature AS term, weight FROM content""", "weight")
def text_weights(t):
    return recommend.content_vectors(t.products).withColumnRenamed("feature", "term")


@query(f"""WITH {TERMS}
SELECT feature AS term, round(sum(weight), 6) AS score FROM content GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 50""", "score")
def top_terms(t):
    return tfidf.top_terms(recommend.content_vectors(t.products).withColumnRenamed("feature", "term"))


@query(f"""WITH {TERMS}
SELECT (SELECT count(*) FROM products) AS n_products, count(DISTINCT feature) AS n_features,
       count(*) * 1.0 / ((SELECT count(*) FROM products) * count(DISTINCT feature)) AS density FROM content""",
       "density", 6)
def text_model_summary(t):
    weights = recommend.content_vectors(t.products).withColumnRenamed("feature", "term")
    return tfidf.model_summary(weights, t.products, "product_id")


@query("WITH " + TERMS + ",\n" + nearest_sql("content", 10), "similarity", 6)
def similar_by_text(t):
    return recommend.similar_products(t.products, 10, "content").drop("method")


@query("WITH " + VALUES + ",\n" + nearest_sql("feats", 10), "similarity", 6)
def similar_by_features(t):
    return recommend.similar_products(t.products, 10, "collaborative").drop("method")


HYBRID = f"""WITH {TERMS},
{VALUES},
hybrid AS (SELECT product_id, concat('t', feature) AS feature, weight * sqrt(0.6) AS weight FROM content
  UNION ALL SELECT product_id, concat('v', feature), weight * sqrt(0.4) FROM feats),
"""


@query(HYBRID + nearest_sql("hybrid", 10), "similarity", 6)
def similar_hybrid(t):
    return recommend.similar_products(t.products, 10, "hybrid").drop("method")


@query(f"""SELECT n.product_id, n.neighbour, n.similarity, n.rank, p.title, p.price FROM (
{HYBRID + nearest_sql("hybrid", 5)}) AS n JOIN products p ON p.product_id = n.neighbour WHERE n.product_id = 7""",
       "similarity price")
def similar_to_one(t):
    edges = recommend.similar_to(t.products, t.spark.createDataFrame([(7,)], "product_id long"), 5, "hybrid")
    return recommend.with_attributes(edges, t.products).select(
        "product_id", "neighbour", "similarity", "rank", "title", "price")


def _refreshed_graph(t):
    """A graph stored when only some products and other prices were known, brought up to date."""
    root = work_path(t.spark, "graph")
    known = t.products.where("scraped_at < '2001-10-15'")
    gone = known.withColumns({"product_id": F.col("product_id") + 10**9, "price": F.col("price") / 2})
    repriced = known.withColumn("price", F.when(F.col("rating") > 2.7, F.col("price") * 1.5).otherwise(F.col("price")))
    graph.build(repriced.union(gone), root, "2001-10-15", model=graph.fit(t.products))
    graph.refresh(t.products, root, "2001-12-01")
    return root


@query(HYBRID + nearest_sql("hybrid", 10), "similarity", 6)
def refreshed_similar_graph(t):
    return versions.read(t.spark, _refreshed_graph(t), "edges").drop("bucket")


@query(f"""SELECT n.product_id, n.neighbour, n.similarity, n.rank, p.title, p.price FROM (
{HYBRID + nearest_sql("hybrid", 10)}) AS n JOIN products p ON p.product_id = n.neighbour WHERE n.product_id = 11 AND n.rank <= 5""",
       "similarity price")
def stored_similar_to_one(t):
    root = work_path(t.spark, "graph")
    graph.build(t.products, root, "2001-12-01")
    return recommend.with_attributes(graph.neighbours(t.spark, root, 11, 5), t.products).select(
        "product_id", "neighbour", "similarity", "rank", "title", "price")


@query(f"""WITH n AS ({HYBRID + nearest_sql("hybrid", 10)})
SELECT name, value FROM (VALUES ('k', '10'), ('key', 'product_id'), ('models', 'content,collaborative'), ('saved_at', '2001-12-01'),
  ('buckets', '64'), ('products', CAST((SELECT count(*) FROM products) AS VARCHAR)),
  ('edges', CAST((SELECT count(*) FROM n) AS VARCHAR)),
  ('probed', CAST((SELECT count(*) FROM products) AS VARCHAR))) AS f(name, value)""")
def stored_graph_metadata(t):
    root = work_path(t.spark, "graph")
    graph.build(t.products, root, "2001-12-01")
    return versions.read(t.spark, root, "metadata")


@query("""WITH a AS (SELECT l_partkey AS product_id, l_suppkey AS neighbour, max(l_discount) AS s FROM lineitem
  WHERE l_linenumber <= 4 GROUP BY 1, 2),
b AS (SELECT l_partkey AS product_id, l_suppkey AS neighbour, max(l_tax) AS s FROM lineitem
  WHERE l_linenumber >= 3 GROUP BY 1, 2)
SELECT product_id, neighbour, 0.6 * coalesce(a.s, 0) + 0.4 * coalesce(b.s, 0) AS similarity
FROM a FULL JOIN b USING (product_id, neighbour)""", "similarity")
def hybrid_edge_sum(t):
    def edges(condition, value):
        return (t.lineitem.where(condition)
                .groupBy(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("neighbour"))
                .agg(F.max(value).alias("similarity")))
    return recommend.hybrid_edges(edges("l_linenumber <= 4", "l_discount"), edges("l_linenumber >= 3", "l_tax"))


@query()
def reduced_features(t):
    return recommend.reduced_features(t.products)


@query()
def recommendation_report(t):
    return recommend.recommendation_report(t.products)


@query("""SELECT avg(CAST(length(title) > 0 AS INT)) AS text_coverage,
       count(price) * 1.0 / count(*) AS price_coverage, count(rating) * 1.0 / count(*) AS rating_coverage
FROM products""", "text_coverage price_coverage rating_coverage")
def product_coverage(t):
    return quality.coverage(t.products)
