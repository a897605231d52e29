"""Queries: statistics, correlations, outliers, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from martlet.operators import charts, correlation, features, insights as findings
from martlet.operators import outliers, profile, quality
from martlet.workload.registry import query

NUMBERS = ["price", "original_price", "discount_percentage", "rating", "reviews_count"]

#: Numeric columns of the listings as (column, value) rows, for the oracle.
LONG = """long AS (
  SELECT 'price' AS "column", CAST(price AS DOUBLE) AS v FROM listings
  UNION ALL SELECT 'original_price', CAST(original_price AS DOUBLE) FROM listings
  UNION ALL SELECT 'discount_percentage', CAST(discount_percentage AS DOUBLE) FROM listings
  UNION ALL SELECT 'rating', CAST(rating AS DOUBLE) FROM listings
  UNION ALL SELECT 'reviews_count', CAST(reviews_count AS DOUBLE) FROM listings)"""


@query(f"""WITH {LONG}
SELECT "column", count(v) AS "count", avg(v) AS mean, quantile_cont(v, 0.5) AS median,
       stddev_samp(v) AS std, min(v) AS "min", max(v) AS "max", skewness(v) AS skewness,
       kurtosis(v) AS kurtosis, quantile_cont(v, 0.25) AS percentile_25,
       quantile_cont(v, 0.75) AS percentile_75,
       quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr
FROM long GROUP BY 1""", "mean median std min max skewness kurtosis percentile_25 percentile_75 iqr")
def numeric_profile(t):
    return profile.numeric_profile(t.listings, NUMBERS)


@query(f"""WITH {LONG}
SELECT "column", count(v) AS "count", avg(v) AS mean, stddev_samp(v) AS std, min(v) AS "min",
       quantile_cont(v, 0.25) AS percentile_25, quantile_cont(v, 0.5) AS median,
       quantile_cont(v, 0.75) AS percentile_75, max(v) AS "max"
FROM long WHERE "column" IN ('price', 'rating') GROUP BY 1""",
       "mean std min percentile_25 median percentile_75 max")
def describe_table(t):
    return profile.describe(t.listings, ["price", "rating"])


@query("""SELECT c AS "column", u AS unique_values, n - k AS null_count,
       (n - k) * 100.0 / n AS null_percentage FROM (
  SELECT 'title' AS c, count(DISTINCT title) AS u, count(title) AS k, count(*) AS n FROM listings
  UNION ALL SELECT 'brand', count(DISTINCT brand), count(brand), count(*) FROM listings
  UNION ALL SELECT 'category', count(DISTINCT category), count(category), count(*) FROM listings
  UNION ALL SELECT 'availability', count(DISTINCT availability), count(availability), count(*)
  FROM listings)""", "null_percentage")
def text_profile(t):
    return profile.text_profile(t.listings, ["title", "brand", "category", "availability"])


@query("""SELECT "column", value, n AS "count", CAST(r AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS r FROM (
    SELECT 'title' AS "column", title AS value, count(*) AS n FROM listings GROUP BY title
    UNION ALL SELECT 'brand', brand, count(*) FROM listings GROUP BY brand
    UNION ALL SELECT 'category', category, count(*) FROM listings GROUP BY category)
  WHERE value IS NOT NULL) WHERE r <= 5""")
def common_values(t):
    return profile.common_values(t.listings, ["title", "brand", "category"], 5)


PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1:]]
PEARSON = "\nUNION ALL ".join(
    f"SELECT '{a}' AS variable1, '{b}' AS variable2, corr({a}, {b}) AS pearson FROM listings"
    for a, b in PAIRS)
SPEARMAN = "\nUNION ALL ".join(f"""SELECT '{a}' AS variable1, '{b}' AS variable2, corr(ra, rb) AS spearman FROM (
  SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
         rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb
  FROM (SELECT {a} AS a, {b} AS b FROM listings WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"""
                               for a, b in PAIRS)


@query(f"""WITH half AS ({PEARSON})
SELECT variable1, variable2, pearson FROM half
UNION ALL SELECT variable2, variable1, pearson FROM half
UNION ALL SELECT v, v, 1.0 FROM (VALUES {', '.join(f"('{c}')" for c in NUMBERS)}) AS d(v)""", "pearson", 6)
def pearson_matrix(t):
    return correlation.pearson_matrix(t.listings, NUMBERS)


@query(SPEARMAN, "spearman", 6)
def spearman_pairs(t):
    return correlation.spearman_pairs(t.listings, NUMBERS)


@query(f"""WITH p AS ({PEARSON}), s AS ({SPEARMAN})
SELECT variable1, variable2, pearson, spearman FROM p JOIN s USING (variable1, variable2)
WHERE abs(pearson) > 0.5""", "pearson spearman", 6)
def strong_correlations(t):
    return correlation.strong_pairs(t.listings, NUMBERS)


@query("SELECT corr(price, rating) AS correlation FROM listings", "correlation", 6)
def price_rating_correlation(t):
    return correlation.price_rating_correlation(t.listings)


LIMITS = """lim AS (
  SELECT "column", avg(v) AS mean, stddev_pop(v) AS std,
         quantile_cont(v, 0.25) - 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS iqr_lower,
         quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS iqr_upper
  FROM long GROUP BY 1)"""


@query(f"""WITH {LONG}, {LIMITS}
SELECT "column", count(*) FILTER (v < iqr_lower OR v > iqr_upper) AS iqr_count,
       count(*) FILTER (v < iqr_lower OR v > iqr_upper) * 100.0 / count(*) AS iqr_percentage,
       count(*) FILTER (abs(v - mean) / std > 3) AS zscore_count,
       count(*) FILTER (abs(v - mean) / std > 3) * 100.0 / count(*) AS zscore_percentage,
       any_value(iqr_lower) AS iqr_lower, any_value(iqr_upper) AS iqr_upper
FROM long JOIN lim USING ("column") WHERE v IS NOT NULL GROUP BY 1""",
       "iqr_percentage zscore_percentage iqr_lower iqr_upper")
def outlier_summary(t):
    return outliers.outlier_summary(t.listings, NUMBERS)


@query("""WITH lim AS (SELECT
  quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.75) AS q3 FROM part),
o AS (SELECT o_orderkey, o_totalprice AS v FROM orders),
l2 AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, avg(v) AS m,
              stddev_pop(v) AS s FROM o),
hits AS (
  SELECT o_orderkey, v AS value, 'iqr' AS method FROM o, l2
  WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)
  UNION ALL SELECT o_orderkey, v, 'zscore' FROM o, l2 WHERE abs(v - m) / s > 3)
SELECT o_orderkey, 'o_totalprice' AS "column", value, method, CAST(r AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY method ORDER BY o_orderkey, value) AS r FROM hits)
WHERE r <= 10""", "value")
def outlier_examples(t):
    return outliers.outlier_examples(t.orders, ["o_orderkey"], ["o_totalprice"])


@query("""SELECT avg(price) AS mean, quantile_cont(price, 0.5) AS median, stddev_samp(price) AS std,
       min(price) AS "min", max(price) AS "max" FROM listings""", "mean median std min max")
def price_stats(t):
    return profile.price_stats(t.listings)


@query("""SELECT count(*) FILTER (price < 50) AS under_50,
       count(*) FILTER (price >= 50 AND price < 100) AS "50_to_100",
       count(*) FILTER (price >= 100 AND price < 500) AS "100_to_500",
       count(*) FILTER (price >= 500) AS over_500 FROM listings""")
def price_ranges(t):
    return profile.price_ranges(t.listings)


@query("""SELECT category, round(avg(price), 2) AS mean, round(quantile_cont(price, 0.5), 2) AS median,
       count(price) AS "count" FROM listings WHERE category IS NOT NULL GROUP BY 1""",
       "mean median", 2)
def price_by_category(t):
    return profile.price_by(t.listings, "category")


@query("""SELECT brand, round(avg(price), 2) AS mean, round(quantile_cont(price, 0.5), 2) AS median,
       count(price) AS "count" FROM listings WHERE brand IS NOT NULL GROUP BY 1
ORDER BY "count" DESC, brand LIMIT 10""", "mean median", 2)
def price_by_brand(t):
    return profile.price_by_top(t.listings, "brand", 10)


@query("""WITH q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2,
                   quantile_cont(price, 0.75) AS q3 FROM listings)
SELECT CASE WHEN price <= q1 THEN 'Budget' WHEN price <= q2 THEN 'Mid-Range'
            WHEN price <= q3 THEN 'Premium' ELSE 'Luxury' END AS segment,
       TRUE AS edges_distinct, count(*) AS "count", avg(price) AS mean_price
FROM listings, q WHERE price IS NOT NULL GROUP BY 1""", "mean_price")
def price_segments(t):
    return profile.price_segments(t.listings)


@query("""SELECT segment, count(*) AS "count" FROM (
  SELECT CASE WHEN rating > 0 AND rating <= 2 THEN 'Poor' WHEN rating > 2 AND rating <= 3 THEN 'Fair'
              WHEN rating > 3 AND rating <= 4 THEN 'Good' WHEN rating > 4 AND rating <= 5
              THEN 'Excellent' END AS segment FROM listings)
WHERE segment IS NOT NULL GROUP BY 1""")
def rating_segments(t):
    return profile.rating_segments(t.listings)


@query("""WITH d AS (SELECT CAST(scraped_at AS DATE) AS day, count(*) AS n, avg(price) AS p
           FROM listings WHERE scraped_at IS NOT NULL GROUP BY 1)
SELECT 'scraped_at' AS time_column, avg(n) AS daily_average, count(*) AS total_days,
       max(n) AS max_daily, min(n) AS min_daily, stddev_samp(p) AS price_volatility FROM d""",
       "daily_average price_volatility")
def trend_summary(t):
    return profile.trends(t.listings)


@query("""WITH m AS (SELECT count(*) AS n, count(price) AS kp, count(title) AS kt, count(category) AS kc,
                  avg(price) AS mean, stddev_samp(price) AS std, min(price) AS low, max(price) AS high
           FROM listings),
f AS (SELECT 'price' AS field, 100.0 * (n - kp) / n AS pct FROM m
      UNION ALL SELECT 'title', 100.0 * (n - kt) / n FROM m
      UNION ALL SELECT 'category', 100.0 * (n - kc) / n FROM m),
c AS (SELECT category, count(*) * 100.0 / (SELECT n FROM m) AS pct FROM listings
      WHERE category IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
r AS (SELECT corr(price, original_price) AS a, corr(price, rating) AS b, corr(price, reviews_count) AS c,
             corr(original_price, rating) AS d, corr(original_price, reviews_count) AS e,
             corr(rating, reviews_count) AS f FROM listings),
w AS (SELECT quantile_cont(price, [0.25, 0.75]) AS p, quantile_cont(original_price, [0.25, 0.75]) AS o,
             quantile_cont(rating, [0.25, 0.75]) AS g, quantile_cont(reviews_count, [0.25, 0.75]) AS v
      FROM listings),
k AS (SELECT
  count(*) FILTER (price < 2.5 * p[1] - 1.5 * p[2] OR price > 2.5 * p[2] - 1.5 * p[1])
  + count(*) FILTER (original_price < 2.5 * o[1] - 1.5 * o[2] OR original_price > 2.5 * o[2] - 1.5 * o[1])
  + count(*) FILTER (rating < 2.5 * g[1] - 1.5 * g[2] OR rating > 2.5 * g[2] - 1.5 * g[1])
  + count(*) FILTER (reviews_count < 2.5 * v[1] - 1.5 * v[2] OR reviews_count > 2.5 * v[2] - 1.5 * v[1])
  AS x FROM listings, w)
SELECT 'data_quality' AS kind, concat('High missing data in ', field, ': ', printf('%.1f', pct), '%') AS message,
       pct AS value FROM f WHERE pct > 20
UNION ALL SELECT 'pricing', 'High price variability detected', std / mean FROM m WHERE std / mean > 1
UNION ALL SELECT 'pricing', concat('Average price: €', printf('%.2f', mean), ', Range: €',
       printf('%.2f', low), ' - €', printf('%.2f', high)), mean FROM m
UNION ALL SELECT 'market', concat('Dominant category: ', category, ' (', printf('%.1f', pct),
       '% market share)'), pct FROM c
UNION ALL SELECT 'recommendation', 'Strong correlations found - consider feature engineering',
       CAST(CAST(abs(a) > 0.5 AS INT) + CAST(abs(b) > 0.5 AS INT) + CAST(abs(c) > 0.5 AS INT)
          + CAST(abs(d) > 0.5 AS INT) + CAST(abs(e) > 0.5 AS INT) + CAST(abs(f) > 0.5 AS INT) AS DOUBLE)
       FROM r WHERE greatest(abs(a), abs(b), abs(c), abs(d), abs(e), abs(f)) > 0.5
UNION ALL SELECT 'recommendation', 'High outlier rate - review data collection process',
       CAST(x AS DOUBLE) FROM k, m WHERE x > n * 0.1""", "value")
def insight_rows(t):
    return findings.insights(t.listings, ["price", "original_price", "rating", "reviews_count"])


@query("""WITH k AS (SELECT count(*) AS n, count(title) + count(brand) + count(category) + count(price)
                  + count(rating) + count(scraped_at) AS f FROM listings)
SELECT n AS total_records, CAST(6 AS BIGINT) AS total_columns, n * 6 - f AS missing_cells,
       round(f * 100.0 / (n * 6), 2) AS completeness_percentage, f * 100.0 / (n * 6) AS overall_score,
       round((n * 6 - f) * 100.0 / (n * 6), 2) AS missing_percentage FROM k""",
       "completeness_percentage overall_score missing_percentage")
def table_quality(t):
    return quality.table_quality(t.listings.select(
        "title", "brand", "category", "price", "rating", "scraped_at"))


@query("""SELECT 'title' AS "column", 'string' AS data_type,
       round((count(*) - count(title)) * 100.0 / count(*), 2) AS missing_percentage,
       least(count(DISTINCT title), 100) AS unique_values FROM listings
UNION ALL SELECT 'category', 'string', round((count(*) - count(category)) * 100.0 / count(*), 2),
       least(count(DISTINCT category), 100) FROM listings
UNION ALL SELECT 'rating', 'double', round((count(*) - count(rating)) * 100.0 / count(*), 2),
       count(DISTINCT rating) FROM listings""", "missing_percentage")
def column_quality(t):
    return quality.column_quality(t.listings.select("title", "category", "rating"))


@query("""SELECT 'title' AS field, count(title) * 100.0 / count(*) AS completeness_pct FROM listings
UNION ALL SELECT 'price', count(price) * 100.0 / count(*) FROM listings
UNION ALL SELECT 'brand', count(brand) * 100.0 / count(*) FROM listings
UNION ALL SELECT 'category', count(category) * 100.0 / count(*) FROM listings
UNION ALL SELECT 'rating', count(rating) * 100.0 / count(*) FROM listings""", "completeness_pct")
def field_completeness(t):
    return quality.completeness(t.listings)


@query("""SELECT (CAST(trim(title) <> '' AS INT) + CAST(price IS NOT NULL AS INT)
        + CAST(trim(brand) <> '' AS INT) + CAST(coalesce(trim(category), '') <> '' AS INT)
        + CAST(rating IS NOT NULL AS INT)) / 5.0 * 100 AS quality_score, count(*) AS "count"
FROM listings GROUP BY 1""", "quality_score")
def quality_distribution(t):
    return quality.quality_distribution(t.listings)


@query("""SELECT count(*) AS total_products, avg(price) AS avg_price, count(DISTINCT category) AS categories,
       count(DISTINCT brand) AS brands, avg(rating) AS avg_rating FROM listings""", "avg_price avg_rating")
def kpi_cards(t):
    return profile.kpis(t.listings)


@query("""WITH one AS (SELECT count(*) AS n, min(price) AS lo, max(price) AS hi, avg(price) AS m,
  count(title) AS kt, count(price) AS kp FROM listings)
SELECT 'overview' AS section, 'total_products' AS name, CAST(n AS DOUBLE) AS value FROM one
UNION ALL SELECT 'price_statistics', 'min_price', lo FROM one
UNION ALL SELECT 'price_statistics', 'max_price', hi FROM one
UNION ALL SELECT 'price_statistics', 'avg_price', m FROM one
UNION ALL SELECT 'data_quality', 'products_with_title', kt FROM one
UNION ALL SELECT 'data_quality', 'products_with_price', kp FROM one
UNION ALL SELECT 'category_distribution', category, count(*) FROM listings
  WHERE category IS NOT NULL GROUP BY category
UNION ALL (SELECT 'brand_distribution', brand, count(*) FROM listings GROUP BY brand
  ORDER BY count(*) DESC, brand LIMIT 10)""", "value")
def export_summary(t):
    return profile.export_summary(t.listings)


@query("""WITH c AS (SELECT category, count(*) AS n FROM listings WHERE category IS NOT NULL GROUP BY 1)
SELECT category, n AS "count", (SELECT count(*) FROM c) AS total_categories,
       (SELECT avg(n) FROM c) AS avg_products_per_category FROM c ORDER BY n DESC, category LIMIT 10""",
       "avg_products_per_category")
def category_stats(t):
    return profile.category_stats(t.listings)


@query("""SELECT avg(CAST(length(title) > 0 AS INT)) AS text_coverage,
       count(price) * 1.0 / count(*) AS price_coverage, count(rating) * 1.0 / count(*) AS rating_coverage
FROM listings""", "text_coverage price_coverage rating_coverage")
def coverage_shares(t):
    return quality.coverage(t.listings)


@query("""SELECT count(price) * 100.0 / count(*) AS price_completeness_pct,
  ((count(*) - count(category)) + (count(*) - count(rating)) + (count(*) - count(price))) * 100.0
  / (count(*) * 3) AS missing_pct FROM listings""", "price_completeness_pct missing_pct")
def system_metrics(t):
    return quality.system_metrics(t.listings.select("category", "rating", "price"))


@query("""SELECT availability AS source_file, count(*) AS rows,
  (SELECT count(*) FROM listings) AS rows_before,
  (SELECT count(*) FROM (SELECT DISTINCT url, title FROM listings)) AS rows_after,
  (SELECT count(*) FROM listings) - (SELECT count(*) FROM (SELECT DISTINCT url, title FROM listings))
  AS duplicates_removed FROM listings GROUP BY 1""")
def load_statistics(t):
    return quality.load_statistics(t.listings.withColumnRenamed("availability", "source_file"))


@query("""SELECT count(*) AS scraped, CAST(50000 AS BIGINT) AS target,
       count(*) * 100.0 / 50000 AS success_rate FROM listings""", "success_rate")
def ingest_progress(t):
    return quality.ingest_progress(t.listings, 50_000)


def histogram_sql(value: str, source: str, nbins: int) -> str:
    return f"""WITH v AS (SELECT CAST({value} AS DOUBLE) AS v FROM {source} WHERE {value} IS NOT NULL),
s AS (SELECT min(v) AS lo, (max(v) - min(v)) / {nbins} AS step, count(*) AS n FROM v),
b AS (SELECT CAST(least(floor((v - lo) / step), {nbins - 1}) AS INT) AS bin, count(*) AS k
      FROM v, s GROUP BY 1)
SELECT bin, lo + bin * step AS low, lo + bin * step + step AS high, k AS "count",
       k / (n * step) AS density FROM b, s"""


@query(histogram_sql("price", "listings", 50), "low high density", 6)
def price_histogram(t):
    return charts.histogram(t.listings, "price", 50)


@query(histogram_sql("ln(1 + price)", "listings", 50), "low high density", 6)
def log_price_histogram(t):
    return charts.histogram(t.listings.select(F.log1p("price").alias("v")), "v", 50)


@query(histogram_sql("rating", "listings", 20), "low high density", 6)
def rating_histogram(t):
    return charts.histogram(t.listings, "rating", 20)


@query(histogram_sql("length(title)", "listings", 30), "low high density", 6)
def title_length_histogram(t):
    return charts.histogram(t.listings.select(F.length("title").alias("v")), "v", 30)


@query(histogram_sql("ln(1 + reviews_count)", "listings", 30), "low high density", 6)
def log_reviews_histogram(t):
    return charts.histogram(t.listings.select(F.log1p("reviews_count").alias("v")), "v", 30)


@query("SELECT avg(rating) AS mean_rating, avg(length(title)) AS mean_title_length FROM listings",
       "mean_rating mean_title_length")
def histogram_means(t):
    return charts.value_mean(t.listings.withColumn("title_length", F.length("title")),
                             "rating", "title_length")


BOX = """SELECT {key} min(price) FILTER (price >= q1 - 1.5 * (q3 - q1) AND price <= q3 + 1.5 * (q3 - q1)) AS lower_whisker,
       any_value(q1) AS q1, any_value(q2) AS median, any_value(q3) AS q3,
       max(price) FILTER (price >= q1 - 1.5 * (q3 - q1) AND price <= q3 + 1.5 * (q3 - q1)) AS upper_whisker,
       count(*) FILTER (price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)) AS n_outliers,
       count(*) AS "count\""""


@query(f"""WITH q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2,
                    quantile_cont(price, 0.75) AS q3 FROM listings)
{BOX.format(key='')} FROM listings, q WHERE price IS NOT NULL""",
       "lower_whisker q1 median q3 upper_whisker")
def price_box(t):
    return charts.five_numbers(t.listings)


@query(f"""WITH top AS (SELECT category FROM listings WHERE category IS NOT NULL GROUP BY 1
                  ORDER BY count(*) DESC, category LIMIT 10),
q AS (SELECT category, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2,
             quantile_cont(price, 0.75) AS q3 FROM listings GROUP BY 1)
{BOX.format(key='category,')} FROM listings JOIN q USING (category)
WHERE price IS NOT NULL AND category IN (SELECT category FROM top) GROUP BY category""",
       "lower_whisker q1 median q3 upper_whisker")
def price_box_by_category(t):
    return charts.five_numbers_top(t.listings)


@query("""WITH s AS (SELECT min(price) AS lo, max(price) AS hi, count(price) AS n,
                  stddev_samp(price) * power(count(price), -0.2) AS h FROM listings),
v AS (SELECT price AS v, count(*) AS w FROM listings WHERE price IS NOT NULL GROUP BY 1)
SELECT CAST(p AS INT) AS point, any_value(lo + p * (hi - lo) / 199) AS x,
       sum(w * exp(-0.5 * power((lo + p * (hi - lo) / 199 - v) / h, 2))) / any_value(n * h * sqrt(2 * pi()))
       AS density
FROM v, s, range(200) AS g(p) GROUP BY 1""", "x density", 9)
def price_density_curve(t):
    return charts.density_curve(t.listings)


def _normal_sql(points: int = 99) -> str:
    from statistics import NormalDist
    rows = ", ".join(f"({i / (points + 1)!r}, {NormalDist().inv_cdf(i / (points + 1))!r})"
                     for i in range(1, points + 1))
    probs = ", ".join(repr(i / (points + 1)) for i in range(1, points + 1))
    return f"""WITH q AS (SELECT unnest(quantile_cont(price, [{probs}])) AS sample,
                  generate_subscripts([{probs}], 1) AS i FROM listings),
n AS (SELECT *, row_number() OVER (ORDER BY prob) AS i FROM (VALUES {rows}) AS z(prob, theoretical))
SELECT CAST(prob AS DOUBLE) AS prob, CAST(theoretical AS DOUBLE) AS theoretical, sample FROM n JOIN q USING (i)"""


@query(_normal_sql(), "prob theoretical sample")
def price_normal_quantiles(t):
    return charts.normal_quantiles(t.listings)


@query("""SELECT listing_id, price, original_price - price AS discount_amount,
       coalesce(CAST(original_price - price > 0 AS INT), 0) AS has_discount,
       CASE WHEN rating > 0 AND rating <= 2 THEN 'Poor' WHEN rating > 2 AND rating <= 3 THEN 'Fair'
            WHEN rating > 3 AND rating <= 4 THEN 'Good' WHEN rating > 4 AND rating <= 5
            THEN 'Excellent' END AS rating_category,
       CAST(length(title) AS INT) AS title_length,
       CAST(len(string_split(trim(title), ' ')) AS INT) AS title_word_count FROM listings""",
       "price discount_amount")
def analysis_columns(t):
    return features.analysis_columns(t.listings).select(
        "listing_id", "price", "discount_amount", "has_discount", "rating_category",
        "title_length", "title_word_count")
