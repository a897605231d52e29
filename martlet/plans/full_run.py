"""The whole analysis as one run: load, clean, assess, analyse, model, report."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.operators import charts, cleaning, correlation, features, insights, market, outliers
from martlet.operators import profile, quality, regression
from martlet.schema import has, numeric_columns, present
from martlet.session import cut_lineage, saved

STEPS = ("quality", "preprocessing", "statistics", "models", "insights")


def long_form(table: DataFrame, section: str) -> DataFrame:
    """Any result table as (section, row_key, name, value) text rows."""
    names = table.columns
    keys = [c for c, t in table.dtypes if t == "string"][:2]
    rest = [c for c in names if c not in keys]
    row_key = F.concat_ws(" / ", *keys) if keys else F.lit("")
    text = table.select(row_key.alias("row_key"), *[F.col(f"`{c}`").cast("string").alias(c) for c in rest])
    return text.unpivot(["row_key"], rest, "name", "value").select(
        F.lit(section).alias("section"), "row_key", "name", "value")


def statistics(df: DataFrame) -> dict[str, DataFrame]:
    numbers = [c for c in numeric_columns(df) if not c.endswith(("_id", "_key"))]
    return {"numeric": profile.numeric_profile(df, numbers),
            "correlation": correlation.pearson_pairs(df, numbers),
            "outliers": outliers.outlier_summary(df, numbers)}


def _models(df: DataFrame, names) -> dict[str, DataFrame]:
    data = regression.model_data(df)
    try:
        measured = regression.price_models(data, names, cv_folds=None)
        return {"models": measured, "best_model": regression.best_model(measured)}
    finally:
        data.release()


def run_all(source: DataFrame, steps=STEPS, models=("linear_regression", "ridge")) -> tuple[DataFrame, DataFrame]:
    """(results, status): every step is optional, and one that fails does not stop
    the others; ``status`` says what happened to each."""
    cleaned = cut_lineage(cleaning.clean_table(source))
    tables: dict[str, DataFrame] = {}
    status: list[tuple[str, str, str]] = []

    def attempt(step: str, job: Callable[[], dict[str, DataFrame]]):
        if step not in steps:
            status.append((step, "skipped", ""))
            return
        try:
            made = job()
            # materialise here, so that a failure belongs to its step
            tables.update({k: cut_lineage(long_form(v, k)) for k, v in made.items()})
            status.append((step, "done", ""))
        except Exception as problem:  # the one place where a step may fail alone
            status.append((step, "failed", str(problem).split("\n")[0][:200]))

    state = {"ready": cleaned}

    def preprocess():
        state["ready"] = cut_lineage(cleaning.impute(cleaning.drop_duplicate_rows(cleaned)))
        counts = cleaned.agg(F.count(F.lit(1)).alias("before"))
        after = state["ready"].agg(F.count(F.lit(1)).alias("n")).scalar()
        return {"preprocessing": counts.select("before", after.alias("after"))}

    attempt("quality", lambda: {"quality": quality.table_quality(cleaned),
                                "column_quality": quality.column_quality(cleaned)})
    attempt("preprocessing", preprocess)
    attempt("statistics", lambda: statistics(state["ready"]))
    attempt("models", lambda: _models(state["ready"], models))
    attempt("insights", lambda: {"insights": insights.insights(cleaned, present(cleaned, ("price", "rating")))})
    spark = source.sparkSession
    notes = spark.createDataFrame(status, "step string, status string, message string")
    empty = spark.createDataFrame([], "section string, row_key string, name string, value string")
    return reduce(lambda a, b: a.union(b), tables.values(), empty), notes


def chart_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The numbers behind every chart, by name, for the columns that exist."""
    df = saved(df, "charts")  # every chart scans it once or more, each time for a few columns
    out: dict[str, DataFrame] = {}
    if has(df, "price"):
        out["price_histogram"] = charts.histogram(df, "price", 50)
        out["price_density"] = charts.density_curve(df)
        out["price_box"] = charts.five_numbers(df)
        out["price_normal_quantiles"] = charts.normal_quantiles(df)
        out["log_price_histogram"] = charts.histogram(df.select(F.log1p("price").alias("v")), "v", 50)
    if has(df, "price", "category"):
        out["median_price_by_category"] = market.median_price_by_category(df)
        out["category_performance"] = market.category_performance(df)
        out["price_box_by_category"] = charts.five_numbers_top(df)
    if has(df, "price", "scraped_at"):
        out["daily_price"] = market.daily_price(df)
    if has(df, "brand"):
        out["brand_share"] = market.market_share(df)
    if has(df, "brand", "price"):
        out["brand_prices"] = market.brand_prices(df, n=None)
    if has(df, "category", "brand"):
        out["category_brand_tree"] = market.category_brand_tree(df)
    if has(df, "rating"):
        out["rating_histogram"] = charts.histogram(df, "rating", 20)
    if has(df, "reviews_count"):
        out["log_reviews_histogram"] = charts.histogram(df.select(F.log1p("reviews_count").alias("v")), "v", 30)
    if has(df, "title"):
        out["title_length_histogram"] = charts.histogram(df.select(F.length("title").alias("v")), "v", 30)
        out["title_words"] = market.title_words(df)
    if has(df, "price", "rating"):
        out["price_rating_correlation"] = correlation.price_rating_correlation(df)
    if has(df, "scraped_at"):
        out["daily_volume"] = market.daily_volume(df)
        out["hourly_volume"] = market.hourly_volume(df)
    if has(df, "scraped_at", "category"):
        out["category_trends"] = market.category_trends(df)
    out["completeness"] = quality.completeness(df, df.columns)
    scores = df.select(quality.quality_score(df).alias("v"))
    out["quality_histogram"] = charts.histogram(scores, "v", 20)
    out["correlation"] = correlation.pearson_matrix(df, present(df, (
        "price", "original_price", "discount_percentage", "rating", "reviews_count")))
    return out


def write_chart_tables(df: DataFrame, folder: str) -> list[str]:
    paths = []
    for name, table in chart_tables(features.analysis_columns(df)).items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
        paths.append(f"{folder}/{name}")
    return paths
