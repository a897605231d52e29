"""Time the headline queries: one JSON line on standard output.

Every query is built and written to the no-op sink, so all columns of all rows are
computed and none reach the driver.
"""

import json
import os
import time

from martlet.session import local_session
from martlet.workload.registry import load

HEADLINE = (
    "kpi_cards", "price_by_category", "price_by_brand", "numeric_profile", "text_profile",
    "pearson_matrix", "spearman_pairs", "outlier_summary", "price_segments", "trend_summary",
    "table_quality", "price_histogram", "price_density_curve", "price_box_by_category",
    "category_brand_tree", "category_trends", "title_words_by_category", "validated_products",
    "keep_first_listing", "new_listings", "imputed", "label_codes", "page_products",
    "trending_products", "similar_by_text", "similar_by_features", "similar_hybrid",
    "category_forecasts", "stream_daily_volume", "stream_validated_history",
    "isolation_anomalies", "linear_price_models",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session(cores, **{"spark.sql.shuffle.partitions": cores})
    registered = load()
    registered["kpi_cards"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM paths
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registered[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": int(cores), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
