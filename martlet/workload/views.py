"""Product-shaped views over the test tables; one SQL text for Spark and the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "listings": """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS listing_id,
       l_orderkey + l_linenumber AS split_key,
       l_partkey AS product_id,
       CASE WHEN l_partkey % 2 = 0 THEN concat(p_brand, ' ', p_name) ELSE p_name END AS title,
       p_brand AS brand,
       CASE WHEN l_linenumber = 6 THEN NULL ELSE p_type END AS category,
       l_extendedprice AS original_price,
       l_extendedprice * (1 - l_discount) AS price,
       l_discount * 100 AS discount_percentage,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / 10 END AS rating,
       CAST(l_suppkey % 100 AS INT) AS reviews_count,
       l_linestatus AS availability,
       concat('https://shop.example/p/', l_partkey) AS url,
       l_shipdate AS scraped_at
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "products": """
SELECT p_partkey AS product_id, concat(p_brand, ' ', p_name) AS title,
       p_brand AS brand, p_type AS category, p_retailprice AS price,
       avg(l_quantity) / 10 AS rating, count(l_orderkey) AS reviews_count,
       max(l_shipdate) AS scraped_at,
       concat('https://shop.example/p/', p_partkey) AS url
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey
GROUP BY p_partkey, p_name, p_brand, p_type, p_retailprice""",
    "raw_products": """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS listing_id,
       concat('/p/', l_partkey) AS url,
       CASE l_linenumber WHEN 1 THEN concat('€', l_extendedprice)
            WHEN 2 THEN concat(l_extendedprice, ' €')
            WHEN 3 THEN concat('1,', CAST(100 + l_partkey % 900 AS INT), '.50 €')
            WHEN 4 THEN concat(CAST(l_quantity AS INT), ',99 €')
            WHEN 5 THEN '' WHEN 6 THEN 'n/a' ELSE NULL END AS price,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL
            ELSE concat(CAST(l_quantity AS INT) + 60, '.49 €') END AS original_price,
       concat('  ', p_name, '   ', p_brand, ' ') AS title,
       concat(' ', p_brand) AS brand,
       CASE WHEN l_linenumber = 6 THEN NULL ELSE p_type END AS category,
       CASE l_linenumber WHEN 1 THEN concat(CAST(l_quantity AS INT) % 7, '/5')
            WHEN 2 THEN '' WHEN 3 THEN '0'
            ELSE CAST(l_quantity / 10 AS STRING) END AS rating,
       CASE l_linenumber WHEN 2 THEN '' WHEN 3 THEN '4.5' WHEN 4 THEN '0'
            ELSE CAST(CAST(l_suppkey % 100 AS INT) AS STRING) END AS reviews_count,
       concat(p_brand, ' sells it at ', CAST(l_quantity AS INT) + 60, '.49 € now ',
              CAST(l_quantity AS INT), '.99 €, rated ', CAST(CAST(l_quantity AS INT) % 9 AS INT),
              '/5 after ', CAST(l_suppkey % 100 AS INT), ' reviews') AS blurb,
       l_shipdate AS scraped_at
FROM lineitem JOIN part ON l_partkey = p_partkey""",
}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _mentions(sql: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", sql) is not None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name; its tables are passed in as frames, nothing is registered."""
    sql = VIEWS[name]
    used = [t for t in TABLES if _mentions(sql, t)]
    for t in used:
        sql = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def with_views(sql: str) -> str:
    """Prefix the oracle SQL with the views it mentions."""
    used = [v for v in VIEWS if _mentions(sql, v)]
    if not used:
        return sql.strip()
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]}\n)" for v in used)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
