"""Links found in pages, and the URLs a crawl starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martlet.functions.urls import DEFAULT_BASE, is_category_link, is_product_link, normalize_url

# Category pages a crawl starts from.
CATEGORY_PATHS = (
    "/kompjuter-laptop-monitor", "/kompjuter", "/gaming-kompjuter", "/all-in-one-aio", "/mini-pc",
    "/laptop", "/monitor", "/gaming", "/tv-projektor", "/tv", "/projektor", "/audio-kufje", "/audio",
    "/kufje", "/telefon-tablet", "/telefon", "/tablet", "/smart-orë-aksesore", "/kamera-dron",
    "/kamera", "/dron",
)
# Top-level category pages of a second seed list.
TOP_CATEGORY_PATHS = (
    "/kategoria/teknologji", "/kategoria/mode", "/kategoria/shtepi-kopesht", "/kategoria/sport-outdoor",
    "/kategoria/bukuri-shendeti", "/kategoria/foshnja-femije", "/kategoria/automjete",
    "/kategoria/liber-muzike",
)
# Where a category may live, and how its pages are numbered.
CATEGORY_PATTERNS = ("/kategoria/{}", "/category/{}", "/c/{}", "/{}")
PAGE_PATTERNS = ("?page={}", "/page/{}", "?p={}")

_HREF = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"'>]+)["']"""


def hrefs(pages: DataFrame) -> DataFrame:
    """(url, href) for every anchor of every page."""
    return pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(_HREF), 1)).alias("href"))


def category_links(pages: DataFrame, base: str = DEFAULT_BASE) -> DataFrame:
    """Distinct absolute links to categories."""
    return (hrefs(pages).where(is_category_link(F.col("href")))
            .select(normalize_url(F.col("href"), base).alias("link")).distinct())


def product_links(pages: DataFrame, base: str = DEFAULT_BASE, max_products: int | None = None) -> DataFrame:
    """Distinct absolute links to products, the first ``max_products`` by URL if asked."""
    found = (hrefs(pages).where(is_product_link(F.col("href")))
             .select(normalize_url(F.col("href"), base).alias("link")).distinct())
    return found if max_products is None else found.orderBy("link").limit(max_products)


def unseen_links(found: DataFrame, listed: DataFrame) -> DataFrame:
    """Links not listed yet."""
    return found.join(listed.select("link").distinct(), "link", "left_anti")


def seed_urls(spark: SparkSession, paths=CATEGORY_PATHS, base: str = DEFAULT_BASE) -> DataFrame:
    """The fixed category pages as a table of URLs."""
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    return rows.select(normalize_url(F.col("path"), base).alias("url"))


def _fill(pattern, value):
    return F.replace(pattern, F.lit("{}"), value)


def category_seeds(categories: DataFrame, base: str = DEFAULT_BASE) -> DataFrame:
    """(category, pattern, url): each category name under every pattern."""
    rows = categories.select("category").distinct()
    return rows.select("category", F.posexplode(F.array(*map(F.lit, CATEGORY_PATTERNS))).alias("pattern", "p")).select(
        "category", "pattern", F.concat(F.lit(base.rstrip("/")), _fill(F.col("p"), F.col("category"))).alias("url"))


def page_urls(seeds: DataFrame, max_pages: int) -> DataFrame:
    """(seed, page, pattern, url): pages 1..n of each seed in every numbering."""
    pages = seeds.select(F.col("url").alias("seed"), F.explode(F.sequence(F.lit(1), F.lit(max_pages))).alias("page"))
    numbered = pages.select("seed", "page", F.posexplode(F.array(*map(F.lit, PAGE_PATTERNS))).alias("pattern", "p"))
    return numbered.select("seed", "page", "pattern", F.concat(
        F.col("seed"), _fill(F.col("p"), F.col("page").cast("string"))).alias("url"))


def first_working(candidates: DataFrame, products_by_url: DataFrame, keys: list[str]) -> DataFrame:
    """Products of the first pattern, in order, under which any were found."""
    found = candidates.join(products_by_url, "url")
    window = Window.partitionBy(*keys).orderBy("pattern")
    # dense_rank = 1 keeps all rows of the first pattern and is limited before the shuffle
    return found.withColumn("_nth", F.dense_rank().over(window)).where("_nth = 1").drop("_nth")
