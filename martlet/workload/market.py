"""Queries: categories, brands, time, words, filters, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from martlet.functions import bins, text
from martlet.operators import cleaning, filters, market, topk, validate
from martlet.workload.registry import query


@query("""SELECT category, count(*) AS "count" FROM listings WHERE category IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def category_counts(t):
    return topk.value_counts(t.listings, "category", 15)


@query("""SELECT category, round(avg(price), 2) AS avg_price, count(price) AS product_count FROM listings
WHERE category IS NOT NULL GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10""", "avg_price", 2)
def category_performance(t):
    return market.category_performance(t.listings)


@query("""SELECT brand, count(*) AS "count" FROM listings WHERE brand IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def brand_counts(t):
    return topk.value_counts(t.listings, "brand", 15)


@query("""SELECT brand, avg(price) AS avg_price, count(*) AS "count" FROM listings WHERE brand IS NOT NULL
GROUP BY 1 HAVING count(*) >= 5 ORDER BY 2 DESC, 1 LIMIT 15""", "avg_price")
def brand_prices(t):
    return market.brand_prices(t.listings)


@query("""WITH b AS (SELECT brand, count(*) AS n FROM listings WHERE brand IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT brand, n AS "count", n * 100.0 / sum(n) OVER () AS share_pct FROM b""", "share_pct")
def brand_market_share(t):
    return market.market_share(t.listings)


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS "count" FROM events GROUP BY 1""")
def daily_volume(t):
    return market.daily_volume(t.events, "ts")


@query("""SELECT CAST(hour(ts) AS INT) AS hour, count(*) AS "count" FROM events GROUP BY 1""")
def hourly_volume(t):
    return market.hourly_volume(t.events, "ts")


@query("""SELECT strftime(scraped_at, '%Y-%m-%d') AS day, avg(price) AS avg_price FROM listings
WHERE scraped_at IS NOT NULL GROUP BY 1""", "avg_price", 6)
def daily_mean_price(t):
    return market.daily_price(t.listings)


@query("""WITH top AS (SELECT category FROM listings WHERE category IS NOT NULL GROUP BY 1
                  ORDER BY count(*) DESC, category LIMIT 5)
SELECT category, strftime(scraped_at, '%Y-%m-%d') AS day, count(*) AS "count" FROM listings
WHERE category IN (SELECT category FROM top) AND scraped_at IS NOT NULL GROUP BY 1, 2""")
def category_trends(t):
    return market.category_trends(t.listings)


@query("""SELECT category, quantile_cont(price, 0.5) AS median_price FROM listings
WHERE category IS NOT NULL GROUP BY 1""", "median_price")
def median_price_by_category(t):
    return market.median_price_by_category(t.listings)


@query("""WITH l AS (SELECT category, brand, count(*) AS n FROM listings
           WHERE category IS NOT NULL AND brand IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT category, brand, CAST(sum(n) AS BIGINT) AS "count" FROM l GROUP BY ROLLUP (category, brand)""")
def category_brand_tree(t):
    return market.category_brand_tree(t.listings)


STOP = ", ".join(f"('{w}')" for w in market.TITLE_STOP_WORDS)
WORDS = f"""w AS (SELECT category, unnest(string_split_regex(
    regexp_replace(lower(title), '[^a-zA-Z\\s]', '', 'g'), '\\s+')) AS word FROM listings),
k AS (SELECT * FROM w WHERE word <> '' AND word NOT IN (SELECT s FROM (VALUES {STOP}) AS x(s)))"""


@query(f"""WITH {WORDS}
SELECT word, count(*) AS "count" FROM k GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""")
def title_words(t):
    return market.title_words(t.listings)


@query(f"""WITH {WORDS},
top AS (SELECT category FROM listings WHERE category IS NOT NULL GROUP BY 1
        ORDER BY count(*) DESC, category LIMIT 4),
c AS (SELECT category, word, count(*) AS n FROM k WHERE category IN (SELECT category FROM top) GROUP BY 1, 2)
SELECT category, word, n AS "count", CAST(r AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, word) AS r FROM c) WHERE r <= 50""")
def title_words_by_category(t):
    return market.title_words_by_category(t.listings)


@query("""SELECT word, count(*) AS "count" FROM (SELECT unnest(string_split_regex(
    regexp_replace(lower(text), '[^a-zA-Z\\s]', '', 'g'), '\\s+')) AS word FROM documents)
WHERE word <> '' AND word NOT IN (SELECT s FROM (VALUES """ + STOP + """) AS x(s))
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""")
def document_words(t):
    return market.title_words(t.documents.withColumnRenamed("text", "title"))


@query("""SELECT listing_id, price FROM listings
WHERE scraped_at >= DATE '1998-01-01' AND scraped_at < DATE '1998-02-01'""", "price")
def filter_date_range(t):
    return filters.date_range(t.listings, "1998-01-01", "1998-01-31").select("listing_id", "price")


@query("""SELECT listing_id, price FROM listings WHERE category = 'ECONOMY' AND brand = 'Brand#13'""", "price")
def filter_category_brand(t):
    return filters.equals(t.listings, category="ECONOMY", brand="Brand#13", availability="All").select(
        "listing_id", "price")


@query("""SELECT count(*) AS rows, min(price) AS low, max(price) AS high FROM listings
WHERE price BETWEEN 1000 AND 20000""", "low high")
def filter_price_range(t):
    return filters.price_between(t.listings, 1000, 20000).agg(
        F.count(F.lit(1)).alias("rows"), F.min("price").alias("low"), F.max("price").alias("high"))


@query("""SELECT category, count(*) AS "count" FROM listings WHERE regexp_matches(category, '(?i)econ|small')
GROUP BY 1""")
def filter_category_pattern(t):
    return filters.category_like(t.listings, "econ|small").groupBy("category").agg(
        F.count(F.lit(1)).alias("count"))


@query("""SELECT product_id, price FROM products WHERE price BETWEEN 1000 * (1 - 0.05) AND 1000 * (1 + 0.05)""",
       "price")
def filter_price_tolerance(t):
    return filters.price_near(t.products, 1000.0, 0.05).select("product_id", "price")


@query("""SELECT count(*) AS rows FROM listings WHERE price BETWEEN 0.01 AND 999999.99
AND length(title) BETWEEN 3 AND 500""")
def filter_declared_limits(t):
    return validate.within_limits(t.listings).agg(F.count(F.lit(1)).alias("rows"))


@query("""SELECT count(*) AS rows FROM listings WHERE price IS NOT NULL AND rating IS NOT NULL
AND category IS NOT NULL""")
def filter_complete_rows(t):
    return filters.complete_rows(t.listings, ["price", "rating", "category"]).agg(
        F.count(F.lit(1)).alias("rows"))


@query("""SELECT listing_id, scraped_at FROM (SELECT listing_id, strftime(scraped_at, '%Y-%m-%d') AS scraped_at
FROM listings WHERE scraped_at >= TIMESTAMP '2001-06-01' - INTERVAL 30 DAY)""")
def filter_recent(t):
    recent = filters.recent_or_all(t.listings, "2001-06-01", 30)
    return recent.select("listing_id", F.date_format("scraped_at", "yyyy-MM-dd").alias("scraped_at"))


@query("""SELECT count(*) AS rows FROM listings""")
def filter_recent_falls_back(t):
    return filters.recent_or_all(t.listings, "2031-01-01", 30).agg(F.count(F.lit(1)).alias("rows"))


@query("""WITH top AS (SELECT category FROM listings WHERE category IS NOT NULL GROUP BY 1
                  ORDER BY count(*) DESC, category LIMIT 3)
SELECT category, count(*) AS "count", avg(price) AS avg_price FROM listings
WHERE category IN (SELECT category FROM top) GROUP BY 1""", "avg_price")
def rows_of_top_categories(t):
    return topk.rows_of_top(t.listings, "category", 3).groupBy("category").agg(
        F.count(F.lit(1)).alias("count"), F.avg("price").alias("avg_price"))


@query("SELECT DISTINCT category FROM listings WHERE category IS NOT NULL")
def filter_values(t):
    return topk.distinct_sorted(t.listings, "category")


@query("""SELECT product_id, title FROM products ORDER BY product_id LIMIT 100""")
def first_rows(t):
    return topk.first_rows(t.products, ["product_id"], 100).select("product_id", "title")


@query("""SELECT product_id, title FROM products ORDER BY product_id DESC LIMIT 100""")
def last_rows(t):
    return topk.first_rows(t.products, [F.desc("product_id")], 100).select("product_id", "title")


@query()
def sampled_rows(t):
    return topk.seeded_sample(t.products, "product_id", 25).select("product_id", "title")


@query("""SELECT count(*) AS rows, sum(total) AS total FROM (
  SELECT product_id AS id, price AS total FROM products
  UNION ALL SELECT o_orderkey, o_totalprice FROM orders)""", "total", 2)
def union_of_files(t):
    a = t.products.select(F.col("product_id").alias("id"), F.col("price").alias("total"), "brand")
    b = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"))
    return cleaning.union_by_name(a, b).agg(F.count(F.lit(1)).alias("rows"), F.sum("total").alias("total"))


@query("""SELECT event_type, CASE WHEN epoch(TIMESTAMP '2024-01-31' - max(ts)) < 300 THEN 'fresh'
  WHEN epoch(TIMESTAMP '2024-01-31' - max(ts)) < 1800 THEN 'moderate' ELSE 'stale' END AS freshness
FROM events GROUP BY 1""")
def data_freshness(t):
    age = F.unix_timestamp(F.lit("2024-01-31").cast("timestamp")) - F.unix_timestamp(
        F.max("ts").cast("timestamp"))
    return t.events.groupBy("event_type").agg(bins.freshness(age).alias("freshness"))


@query("""SELECT listing_id, concat('€', printf('%.2f', price)) AS price_text FROM listings""")
def money_format(t):
    return t.listings.select("listing_id", text.money(F.col("price")).alias("price_text"))
