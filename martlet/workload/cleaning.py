"""Queries: text rules, validation, cleaning, duplicates, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from martlet.functions import amounts, bins, brands, specs, text, urls
from martlet.operators import cleaning, features, validate
from martlet.session import work_path
from martlet.sources import frontier, links, pages
from martlet.workload.registry import query

PRICE = """TRY_CAST(CASE WHEN contains(k, ',') AND contains(k, '.') THEN replace(k, ',', '')
  ELSE replace(k, ',', '.') END AS DOUBLE)"""


@query("""SELECT listing_id, regexp_replace(trim(title), '\\s+', ' ', 'g') AS title,
       lower(regexp_replace(title, '[^a-zA-Z0-9\\s]', '', 'g')) AS plain FROM raw_products""")
def clean_text(t):
    return t.raw_products.select("listing_id", text.clean_text(F.col("title")).alias("title"),
                                 text.normalise_text(F.col("title")).alias("plain"))


@query(f"""SELECT listing_id, {PRICE} AS price FROM (
  SELECT listing_id, regexp_replace(price, '[^0-9.,]', '', 'g') AS k FROM raw_products)""", "price")
def extract_price(t):
    return t.raw_products.select("listing_id", amounts.extract_price(F.col("price")).alias("price"))


@query("""SELECT page_id, CASE WHEN starts_with(h, '//') THEN concat('https:', h)
  WHEN starts_with(h, '/') THEN concat('https://shop.example', h)
  WHEN starts_with(h, 'http://') OR starts_with(h, 'https://') THEN h
  ELSE concat('https://shop.example/', h) END AS link, count(*) AS n FROM (
    SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h FROM pages)
GROUP BY 1, 2""")
def normalized_links(t):
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("h")
    return (t.pages.select("page_id", href)
            .select("page_id", urls.normalize_url(F.col("h")).alias("link"))
            .groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n")))


@query("""SELECT listing_id, regexp_extract(url, '/p/([0-9]+)', 1) AS product_id FROM listings""")
def product_id_from_url(t):
    return t.listings.select("listing_id", urls.product_id_from_url(F.col("url")).alias("product_id"))


@query("""SELECT listing_id, list_extract(a, 2) || ' €' AS current_price, list_extract(a, 1) || ' €' AS original_price,
       CASE WHEN r BETWEEN 0 AND 5 THEN r WHEN f BETWEEN 0 AND 5 THEN f END AS rating_guess,
       CAST(regexp_extract(blurb, '([0-9]+)\\s*reviews', 1) AS INT) AS reviews FROM (
  SELECT *, regexp_extract_all(blurb, '([0-9]+(?:\\.[0-9]{2})?)\\s*€', 1) AS a,
         CAST(regexp_extract(blurb, '([0-9]+)/5', 1) AS DOUBLE) AS r,
         CAST(regexp_extract(blurb, '([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS f FROM raw_products)""",
       "rating_guess")
def smart_text_fields(t):
    b = F.col("blurb")
    return t.raw_products.select(
        "listing_id", amounts.current_price_text(b).alias("current_price"),
        amounts.original_price_text(b).alias("original_price"),
        amounts.rating_in_text(b).alias("rating_guess"),
        amounts.review_count_in_text(b).alias("reviews"))


@query("""SELECT listing_id, p_word AS brand FROM (SELECT listing_id,
  CASE WHEN length(trim(brand)) > 1 THEN trim(brand) ELSE '' END AS p_word FROM raw_products)""")
def brand_of_listing(t):
    return t.raw_products.select("listing_id", brands.brand_of(
        text.clean_text(F.col("brand")), F.col("title")).alias("brand"))


@query(f"""WITH k AS (SELECT *, regexp_replace(price, '[^0-9.,]', '', 'g') AS pk,
                regexp_replace(original_price, '[^0-9.,]', '', 'g') AS ok FROM raw_products),
p AS (SELECT *, {PRICE.replace('(k,', '(pk,').replace('replace(k', 'replace(pk')} AS p0,
             {PRICE.replace('(k,', '(ok,').replace('replace(k', 'replace(ok')} AS o0 FROM k),
q AS (SELECT *, CASE WHEN p0 > 0 THEN p0 END AS p1, CASE WHEN o0 > 0 THEN o0 END AS o1 FROM p)
SELECT listing_id, regexp_replace(trim(title), '\\s+', ' ', 'g') AS title, url,
       regexp_extract(url, '/p/([0-9]+)', 1) AS product_id, p1 AS price, o1 AS original_price,
       round((o1 - p1) / o1 * 100, 2) AS discount_percentage, '' AS description, trim(brand) AS brand,
       coalesce(category, '') AS category, '' AS availability, CAST(0 AS INT) AS image_count,
       CASE WHEN TRY_CAST(rating AS DOUBLE) BETWEEN 0 AND 5 THEN TRY_CAST(rating AS DOUBLE) END AS rating,
       CASE WHEN regexp_full_match(reviews_count, '[0-9]+') THEN CAST(reviews_count AS INT) END AS reviews_count
FROM q""", "price original_price discount_percentage rating", 1)
def validated_products(t):
    raw = t.raw_products
    kept = validate.validate_products(raw.withColumn("source_file", F.col("listing_id")))
    return kept.select(F.col("source_file").alias("listing_id"), "title", "url", "product_id", "price",
                       "original_price", "discount_percentage", "description", "brand", "category",
                       "availability", "image_count", "rating", "reviews_count")


@query("""SELECT listing_id, CASE WHEN original_price > 0 THEN original_price * 1000 END AS price,
       CASE WHEN original_price > 0 THEN original_price / 1e8 END AS original_price FROM listings""", "price original_price", 2)
def validated_typed_prices(t):
    typed = t.listings.select(F.col("listing_id").alias("source_file"), "url", "title", F.col("original_price").alias("p")).select(
        "source_file", "url", "title", (F.col("p") * 1000).alias("price"), (F.col("p") / F.lit(1e8)).alias("original_price"))
    return validate.validate_products(typed).select(F.col("source_file").alias("listing_id"), "price", "original_price")


@query("""SELECT listing_id, strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS scraped_at_str,
       strftime(scraped_at, '%Y-%m-%d') AS scraped_date, CAST(hour(scraped_at) AS INT) AS scraped_hour,
       dayname(scraped_at) AS scraped_day_of_week FROM listings""")
def time_parts(t):
    return cleaning.time_parts(t.listings).select(
        "listing_id", "scraped_at_str", "scraped_date", "scraped_hour", "scraped_day_of_week")


@query("""SELECT event_id, concat('[', event_type, ', ', user_id, ']') AS tags, '' AS gone FROM events""")
def stringified_columns(t):
    df = t.events.select(
        "event_id", F.array("event_type", F.col("user_id").cast("string")).alias("tags"),
        F.lit("None").alias("gone"))
    flat = cleaning.stringify_complex(df)
    return flat.select("event_id", F.concat(F.lit("["), F.col("tags"), F.lit("]")).alias("tags"), "gone")


@query("""SELECT listing_id, coalesce(rating, 0) AS rating FROM listings""", "rating")
def filled_with_zero(t):
    return cleaning.fill_zero(t.listings.select("listing_id", "rating"))


@query("""SELECT listing_id, coalesce(rating, (SELECT quantile_cont(rating, 0.5) FROM listings)) AS rating,
       coalesce(category, '') AS category FROM listings""", "rating")
def imputed(t):
    return cleaning.impute(t.listings.select("listing_id", "rating", "category"))


@query("""SELECT event_id, user_id AS who_id, event_type AS who_kind_name, value AS value FROM events""", "value")
def flattened_records(t):
    kind = F.struct(F.col("event_type").alias("name")).alias("kind")
    nested = t.events.select("event_id", F.struct(F.col("user_id").alias("id"), kind).alias("who"), "value")
    return cleaning.flatten(nested)


@query("""SELECT listing_id, original_price - price AS discount_amount,
       coalesce(CAST(original_price - price > 0 AS INT), 0) AS has_discount,
       coalesce((original_price - price) / original_price * 100, 0) AS discount_percentage,
       ln(1 + coalesce(price, 0)) AS price_log,
       CASE WHEN rating >= 0 AND rating <= 3 THEN 'Poor' WHEN rating > 3 AND rating <= 4 THEN 'Good'
            WHEN rating > 4 AND rating <= 4.5 THEN 'Very Good' WHEN rating > 4.5 AND rating <= 5
            THEN 'Excellent' ELSE 'Unknown' END AS rating_category,
       CAST(contains(lower(title), lower(brand)) AS INT) AS has_brand_in_title,
       CAST((dayofweek(scraped_at) + 6) % 7 AS INT) AS day_of_week, CAST(month(scraped_at) AS INT) AS month,
       CAST((dayofweek(scraped_at) + 6) % 7 >= 5 AS INT) AS is_weekend FROM listings""",
       "discount_amount discount_percentage price_log")
def model_columns(t):
    return features.model_columns(t.listings).select(
        "listing_id", "discount_amount", "has_discount", "discount_percentage", "price_log",
        "rating_category", "has_brand_in_title", "day_of_week", "month", "is_weekend")


@query("""SELECT listing_id, brand_encoded, category_encoded FROM (SELECT listing_id,
       dense_rank() OVER (ORDER BY brand) - 1 AS brand_encoded,
       dense_rank() OVER (ORDER BY coalesce(category, 'Unknown')) - 1 AS category_encoded FROM listings)""")
def label_codes(t):
    return features.encode(t.listings.select("listing_id", "brand", "category"), ["brand", "category"]).select(
        "listing_id", "brand_encoded", "category_encoded")


@query("""WITH m AS (SELECT min(price) AS p0, max(price) AS p1, min(rating) AS r0, max(rating) AS r1,
  quantile_cont(price, 0.5) AS pm, quantile_cont(rating, 0.5) AS rm FROM listings)
SELECT listing_id, (coalesce(price, pm) - p0) / (p1 - p0) AS price_normalized,
       (coalesce(rating, rm) - r0) / (r1 - r0) AS rating_normalized FROM listings, m""",
       "price_normalized rating_normalized")
def min_max_scaled(t):
    return features.min_max(t.listings, ["price", "rating"]).select(
        "listing_id", "price_normalized", "rating_normalized")


@query("""WITH b AS (SELECT brand AS v FROM products GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20),
c AS (SELECT category AS v FROM products GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20)
SELECT product_id, concat('brand_', brand) AS feature, 1.0::DOUBLE AS value FROM products
  WHERE brand IN (SELECT v FROM b)
UNION ALL SELECT product_id, concat('category_', category), 1.0 FROM products
  WHERE category IN (SELECT v FROM c)""", "value")
def one_hot_top_values(t):
    return features.one_hot_long(t.products, "product_id")


@query("""SELECT product_id, lower(regexp_replace(concat_ws(' ', title, brand, category), '[^a-zA-Z0-9\\s]', '', 'g'))
AS combined_text FROM products""")
def combined_text(t):
    return t.products.select("product_id", text.combined_text(
        F.col("title"), F.col("brand"), F.col("category")).alias("combined_text"))


@query("""SELECT url, title, strftime(min(scraped_at), '%Y-%m-%d') AS first_seen FROM listings GROUP BY 1, 2""")
def keep_first_listing(t):
    kept = cleaning.keep_first(t.listings, ["scraped_at", "listing_id", "price"])
    return kept.select("url", "title", F.date_format("scraped_at", "yyyy-MM-dd").alias("first_seen"))


@query("""SELECT DISTINCT brand, category, availability FROM listings""")
def distinct_rows(t):
    plain = t.listings.select("brand", "category", "availability")
    return plain.dropDuplicates()


@query("""SELECT url, title, listing_id, price FROM (
  SELECT *, row_number() OVER (PARTITION BY url, title ORDER BY scraped_at, listing_id, price) AS r FROM listings)
WHERE r = 2 ORDER BY url, title, scraped_at, listing_id, price LIMIT 3""", "price")
def duplicate_examples(t):
    return cleaning.duplicate_examples(t.listings, ["scraped_at", "listing_id", "price"]).select(
        "url", "title", "listing_id", "price")


@query("""SELECT listing_id, price FROM listings AS n WHERE scraped_at >= TIMESTAMP '1995-01-15' AND NOT EXISTS (
  SELECT 1 FROM listings AS k WHERE k.scraped_at < TIMESTAMP '1995-01-15'
  AND k.url = n.url AND k.title = n.title)""", "price")
def new_listings(t):
    listings = t.listings
    known = cleaning.known_keys(listings.where("scraped_at < TIMESTAMP_NTZ '1995-01-15'"))
    incoming = listings.where("scraped_at >= TIMESTAMP_NTZ '1995-01-15'")
    return cleaning.keep_new(incoming, known).select("listing_id", "price")


@query("""SELECT DISTINCT link FROM (
  SELECT CASE WHEN starts_with(h, '/') THEN concat('https://shop.example', h) END AS link FROM (
    SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h FROM pages)
  WHERE starts_with(h, '/') AND NOT starts_with(h, '//')
  AND NOT regexp_matches(lower(h), '/account/|/login|/register|/cart|/wishlist|/faq|/contact|/about|/terms|/privacy|/cdn-cgi/|mailto:|tel:|#|/outlet|/gift-cards|/cfare-ka-te-re'))""")
def category_links(t):
    return links.category_links(t.pages)


@query("""SELECT listing_id, score FROM (SELECT listing_id,
  (CASE WHEN regexp_matches(h, '\\bi[0-9]+\\b') THEN 1 ELSE 0 END
   + CASE WHEN regexp_matches(h, '\\b[0-9]+gb\\b') THEN 1 ELSE 0 END
   + CASE WHEN regexp_matches(h, '\\b[0-9]+\\b') THEN 1 ELSE 0 END
   + CASE WHEN regexp_matches(h, '\\bpro\\b') THEN 1 ELSE 0 END) AS score, h, p FROM (
  SELECT listing_id, product_id % 7 AS p, concat('/laptop/', replace(title, ' ', '-'), '-i', product_id % 9, '-',
         CASE WHEN product_id % 3 = 0 THEN '16gb' ELSE 'ssd' END, '-',
         CASE WHEN product_id % 5 = 0 THEN 'pro' ELSE 'std' END, '-', product_id,
         CASE WHEN product_id % 7 = 0 THEN '/sale' ELSE '/x' END) AS h FROM listings))
WHERE score >= 2 AND p <> 0 AND length(h) >= 15 AND NOT contains(h, '#')""")
def product_link_score(t):
    pid = F.col("product_id")
    href = F.concat(
        F.lit("/laptop/"), F.replace("title", F.lit(" "), F.lit("-")), F.lit("-i"),
        (pid % 9).cast("string"), F.lit("-"), F.when(pid % 3 == 0, "16gb").otherwise("ssd"), F.lit("-"),
        F.when(pid % 5 == 0, "pro").otherwise("std"), F.lit("-"), pid.cast("string"),
        F.when(pid % 7 == 0, "/sale").otherwise("/x"))
    rows = t.listings.select("listing_id", href.alias("href"))
    return rows.where(urls.is_product_link(F.col("href"))).select(
        "listing_id", urls.spec_score(F.col("href")).alias("score"))


@query()
def product_links(t):
    return links.product_links(t.pages, max_products=None)


#: Anchors that every page gets besides its own: links to products, some on several pages.
WOVEN = ("/laptop/gaming-laptop-i7-16gb-ssd-", "/laptop/office-laptop-i5-8gb-ssd-")


def _woven_pages(t):
    anchors = [F.concat(F.lit(f'<a href="{path}'), F.pmod("page_id", F.lit(m)).cast("string"), F.lit('/x">p</a>'))
               for path, m in zip(WOVEN, (211, 13))]
    return t.pages.select(F.col("page_id"), "url", F.concat(F.coalesce("html", F.lit("")), *anchors).alias("html"))


WOVEN_SQL = f"""l AS (SELECT url, concat('https://shop.example{WOVEN[0]}', page_id % 211, '/x') AS link FROM pages
  UNION ALL SELECT url, concat('https://shop.example{WOVEN[1]}', page_id % 13, '/x') FROM pages)"""


@query(f"WITH {WOVEN_SQL} SELECT DISTINCT link FROM l")
def woven_product_links(t):
    return links.product_links(_woven_pages(t))


@query(f"""WITH {WOVEN_SQL}, o AS (SELECT link, min(url) AS seed FROM l GROUP BY 1),
r AS (SELECT link, seed, row_number() OVER (PARTITION BY seed ORDER BY link) AS n FROM o)
SELECT link, seed, CAST(n AS INT) AS round FROM r WHERE n <= 3""")
def frontier_rounds(t):
    """Three rounds with at most one new link for each page."""
    root = work_path(t.spark, "frontier")
    found = links.hrefs(_woven_pages(t)).where(urls.is_product_link(F.col("href"))).select(
        F.col("url").alias("seed"), urls.normalize_url(F.col("href")).alias("link"))
    for day in range(1, 4):
        frontier.advance(found, root, f"2024-01-0{day}", per_seed=1)
    return frontier.seen(t.spark, root).drop("cut")


@query("""SELECT DISTINCT concat('https://shop.example', replace(pat, '{}', slug)) AS url, pattern FROM (
  SELECT lower(category) AS slug FROM products),
  (VALUES ('/kategoria/{}', 0), ('/category/{}', 1), ('/c/{}', 2), ('/{}', 3)) AS p(pat, pattern)""")
def category_seed_urls(t):
    return links.category_seeds(t.products.select(F.lower("category").alias("category"))).select("url", "pattern")


@query("""SELECT DISTINCT concat('https://shop.example/c/', lower(category), replace(pat, '{}', CAST(page AS VARCHAR)))
AS url, CAST(page AS INT) AS page, pattern FROM products, range(1, 4) AS g(page),
(VALUES ('?page={}', 0), ('/page/{}', 1), ('?p={}', 2)) AS p(pat, pattern)""")
def page_urls(t):
    seeds = t.products.select(F.concat(F.lit("https://shop.example/c/"), F.lower("category")).alias("url")).distinct()
    return links.page_urls(seeds, 3).select("url", "page", "pattern")


@query("""SELECT page_id, replace(trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)), '&amp;', '&') AS title FROM pages
WHERE regexp_matches(html, '<h1[^>]*>[^<]+</h1>')""")
def page_titles(t):
    # pages whose first heading is plain text
    plain = t.pages.where(F.col("html").rlike("<h1[^>]*>[^<]+</h1>"))
    found = pages.extract_fields(plain, keep=["page_id"])
    return found.select("page_id", "title")


@query()
def all_page_titles(t):
    """Of every page, also with markup in its heading or without one; ``page_titles`` is the part that SQL can say."""
    return pages.extract_fields(t.pages, keep=["page_id"]).select("page_id", "title")


@query()
def page_products(t):
    return pages.extract_products(t.pages).select("url", "title", "price", "brand", "category", "image_count")


@query("""SELECT brand, count(*) AS n, concat(upper(substr(slug, 1, 1)), substr(slug, 2)) AS name FROM (
  SELECT brand, lower(category) AS slug FROM listings WHERE category IS NOT NULL) GROUP BY brand, slug""")
def category_display_names(t):
    slug = F.concat(F.lit("https://shop.example/"), F.lower("category"))
    return (t.listings.where("category IS NOT NULL").groupBy("brand", text.slug_title(slug).alias("name"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("""SELECT rating_category, count(*) AS n FROM (SELECT CASE WHEN price < 50 THEN 'under_50'
  WHEN price < 100 THEN '50_to_100' WHEN price < 500 THEN '100_to_500' WHEN price >= 500 THEN 'over_500' END
  AS rating_category FROM listings) GROUP BY 1""")
def price_range_labels(t):
    return t.listings.groupBy(bins.price_range(F.col("price")).alias("rating_category")).agg(
        F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, concat(event_type, ' x') AS kind, CAST(user_id AS VARCHAR) AS "user" FROM events""")
def spec_lines(t):
    lines = F.array(F.concat(F.lit("kind: old")), F.concat(F.lit(" kind :  "), "event_type", F.lit("  x")),
                    F.lit("no colon"), F.concat(F.lit("user:"), F.col("user_id").cast("string")))
    made = t.events.select("event_id", specs.from_lines(lines).alias("m"))
    return made.select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["user"].alias("user"))


@query("""SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS "user" FROM events""")
def spec_pairs(t):
    made = t.events.select("event_id", specs.from_pairs(
        F.array(F.lit("kind "), F.lit("user"), F.lit("left over")),
        F.array("event_type", F.col("user_id").cast("string"))).alias("m"))
    return made.select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["user"].alias("user"))


@query("""WITH h AS (SELECT url, concat('https://shop.example', h) AS link FROM (
  SELECT url, unnest(regexp_extract_all(html, 'href="(/[^"/][^"]*)"', 1)) AS h FROM pages)
  WHERE NOT regexp_matches(lower(h), '/account/|/login|/register|/cart|/wishlist|/faq|/contact|/about|/terms|/privacy|/cdn-cgi/|mailto:|tel:|#|/outlet|/gift-cards|/cfare-ka-te-re'))
SELECT link FROM h GROUP BY 1 HAVING count(DISTINCT url) = 1""")
def unseen_links(t):
    # links that a second page lists as well are the known ones
    found = links.category_links(t.pages)
    again = links.hrefs(t.pages).groupBy(urls.normalize_url(F.col("href")).alias("link")).agg(
        F.count_distinct("url").alias("n")).where("n > 1")
    return links.unseen_links(found, again)
