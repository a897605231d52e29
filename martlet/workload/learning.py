"""Queries: models, segments, anomalies, forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from martlet.operators import anomaly, clustering, density, forecast as demand
from martlet.operators import features, linalg, linear, regression
from martlet.session import work_path
from martlet.sources import versions
from martlet.workload.registry import query


def _listing_data(t):
    return regression.model_data(
        t.listings.drop("listing_id", "url").withColumnRenamed("split_key", "row_no"),
        split_key="row_no", leaky=True)


def _released(data, table):
    """The finished table, after giving back the cached features."""
    data.release()
    return table


def _product_data(t):
    return regression.model_data(t.products.drop("url"), split_key="product_id")


@query("""SELECT listing_id, CAST(split_key % 5 AS BIGINT) AS fold, split_key % 5 = 0 AS is_test FROM listings""")
def train_test_split(t):
    fold = F.pmod(F.col("split_key"), F.lit(5)).cast("long")
    return t.listings.select("listing_id", fold.alias("fold"), (fold == 0).alias("is_test"))


@query()
def linear_price_models(t):
    data = _listing_data(t)
    return _released(data, regression.price_models(data, regression.LINEAR, cv_folds=None))


@query()
def linear_cross_validation(t):
    data = _listing_data(t)
    return _released(data, regression.price_models(data, regression.LINEAR, cv_folds=5))


def one_feature_sql() -> str:
    """Fits and scores per left-out fold of the models of one feature, which have closed forms."""
    return """WITH r AS (SELECT original_price AS x0, price AS y0, CAST(split_key % 5 AS INT) AS fold FROM listings),
q AS (SELECT quantile_cont(x0, 0.5) AS xm, quantile_cont(x0, 0.75) - quantile_cont(x0, 0.25) AS xw, quantile_cont(y0, 0.5) AS ym FROM r),
z AS (SELECT (x0 - xm) / xw AS x, y0 - ym AS y, fold FROM r, q),
f AS (SELECT DISTINCT fold FROM z),
m AS (SELECT f.fold, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, covar_pop(x, y) AS cxy
      FROM f JOIN z ON z.fold <> f.fold GROUP BY f.fold),
w AS (SELECT fold, mx, my, unnest(['linear_regression', 'ridge', 'lasso', 'elastic_net']) AS model,
             unnest([cxy / vx, cxy * n / (vx * n + 1), sign(cxy) * greatest(abs(cxy) - 1, 0) / vx,
                     sign(cxy) * greatest(abs(cxy) - 0.5, 0) / (vx + 0.5)]) AS w FROM m),
s AS (SELECT model, z.fold, 1 - avg((y - my - w * (x - mx)) * (y - my - w * (x - mx))) / var_pop(y) AS r2
      FROM z JOIN w ON w.fold = z.fold GROUP BY 1, 2)
SELECT model, avg(r2) AS cv_r2_mean, stddev_pop(r2) AS cv_r2_std, CAST(count(*) AS INT) AS folds FROM s GROUP BY 1"""


@query(one_feature_sql(), "cv_r2_mean cv_r2_std", 7)
def one_feature_cross_validation(t):
    rows = t.listings.withColumn("fold", F.col("split_key") % 5)
    return linear.cross_validated(rows, ["original_price"], "price").drop("method")


@query()
def forest_price_models(t):
    data = _listing_data(t)
    return _released(data, regression.price_models(data, regression.FORESTS, cv_folds=None, trees=100))


@query()
def boosted_price_models(t):
    data = _product_data(t)
    return _released(data, regression.price_models(data, regression.BOOSTERS, cv_folds=None, rounds=100))


@query()
def forest_feature_importance(t):
    data = _listing_data(t)
    return _released(data, regression.feature_importance(regression.train(data, ("random_forest",)), data))


@query()
def ensemble_metrics(t):
    data = _product_data(t)
    names = regression.LINEAR + ("random_forest",)
    table = regression.predict(regression.train(data, names), data.test)
    return regression.ensembles(table, data.target, names)


@query("""WITH p AS (SELECT l_extendedprice AS y, l_quantity * p_retailprice AS a,
                   l_quantity * 1000.0 AS b FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT 'retail' AS model, avg((y - a) * (y - a)) AS mse, avg(abs(y - a)) AS mae,
       sqrt(avg((y - a) * (y - a))) AS rmse, 1 - avg((y - a) * (y - a)) / var_pop(y) AS r2 FROM p
UNION ALL SELECT 'flat', avg((y - b) * (y - b)), avg(abs(y - b)), sqrt(avg((y - b) * (y - b))),
       1 - avg((y - b) * (y - b)) / var_pop(y) FROM p""", "mse mae rmse r2", 3)
def regression_metrics(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    p = joined.select(F.col("l_extendedprice").alias("y"),
                      (F.col("l_quantity") * F.col("p_retailprice")).alias("retail"),
                      (F.col("l_quantity") * 1000.0).alias("flat"))
    return regression.regression_metrics(p, "y", ["retail", "flat"])


@query("""WITH p AS (SELECT l_extendedprice AS y, (l_quantity * p_retailprice + l_quantity * 1000.0) / 2 AS m
           FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT unnest(['voting_regressor', 'simple_average']) AS model, CAST(2 AS INT) AS n_models, mse, mae, rmse, r2 FROM (
  SELECT avg((y - m) * (y - m)) AS mse, avg(abs(y - m)) AS mae, sqrt(avg((y - m) * (y - m))) AS rmse,
         1 - avg((y - m) * (y - m)) / var_pop(y) AS r2 FROM p)""", "mse mae rmse r2", 3)
def ensemble_average(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    p = joined.select(F.col("l_extendedprice").alias("y"),
                      (F.col("l_quantity") * F.col("p_retailprice")).alias("retail"),
                      (F.col("l_quantity") * 1000.0).alias("flat"))
    return regression.ensembles(p, "y", ["retail", "flat"])


@query("""WITH p AS (SELECT l_extendedprice AS y, l_quantity * p_retailprice AS a,
                   l_quantity * 1000.0 AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT 'retail' AS model, sqrt(avg((y - a) * (y - a))) AS rmse,
             1 - avg((y - a) * (y - a)) / var_pop(y) AS r2 FROM p
      UNION ALL SELECT 'flat', sqrt(avg((y - b) * (y - b))), 1 - avg((y - b) * (y - b)) / var_pop(y) FROM p)
SELECT model AS best_model, r2 AS best_r2, rmse, (SELECT avg(r2) FROM m) AS mean_r2,
  CASE WHEN (SELECT avg(r2) FROM m) > 0.8 THEN 'High model accuracy achieved - suitable for price prediction'
       WHEN (SELECT avg(r2) FROM m) > 0.6 THEN 'Moderate model accuracy - consider feature engineering'
       ELSE 'Low model accuracy - collect more data or different features' END AS advice
FROM m ORDER BY r2 DESC, model LIMIT 1""", "best_r2 rmse mean_r2", 3)
def best_model(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    p = joined.select(F.col("l_extendedprice").alias("y"),
                      (F.col("l_quantity") * F.col("p_retailprice")).alias("retail"),
                      (F.col("l_quantity") * 1000.0).alias("flat"))
    return regression.best_model(regression.regression_metrics(p, "y", ["retail", "flat"]))


@query()
def parameter_search(t):
    small = {"numTrees": (5, 20), "maxDepth": (3, 8), "minInstancesPerNode": (1, 5)}
    data = _product_data(t)
    return _released(data, regression.tune(data, "random_forest", n_trials=4, space=small))


@query("""SELECT 'price' AS "column", (max(price) > min(price)) AS useful FROM listings
UNION ALL SELECT 'hour', max(hour(scraped_at)) > min(hour(scraped_at)) FROM listings
UNION ALL SELECT 'rating', max(rating) > min(rating) FROM listings""")
def useful_columns(t):
    df = features.model_columns(t.listings).select("price", "hour", "rating")
    kept = features.useful_columns(df, df.columns)
    return df.sparkSession.createDataFrame([(c, c in kept) for c in df.columns], "column string, useful boolean")


@query()
def segment_scores(t):
    table, _ = clustering.cluster_table(features.model_columns(t.listings))
    return clustering.choose_k(table)[0]


@query()
def segment_profiles(t):
    table, columns = clustering.cluster_table(features.model_columns(t.products))
    _, model = clustering.choose_k(table)
    return clustering.segment_summary(model.transform(table), columns)


@query()
def hierarchical_segments(t):
    table, columns = clustering.cluster_table(features.model_columns(t.listings))
    _, model = clustering.choose_k(table)
    labelled, _ = clustering.hierarchical(table, columns, model.getK())
    return clustering.cluster_sizes(labelled)


@query()
def hierarchical_scores(t):
    table, columns = clustering.cluster_table(features.model_columns(t.listings))
    return clustering.hierarchical(table, columns)[1]


@query("""SELECT count(*) AS rows, count(DISTINCT listing_id) AS ids, true AS all_labelled FROM listings
WHERE price IS NOT NULL AND rating IS NOT NULL AND reviews_count IS NOT NULL AND discount_percentage IS NOT NULL""")
def saved_segment_labels(t):
    root = work_path(t.spark, "segments")
    clustering.save_segments(features.model_columns(t.listings), "listing_id", root, "2001-12-01")
    return versions.read(t.spark, root, "labels").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("listing_id").alias("ids"),
        (F.count("kmeans_cluster") + F.count("hierarchical_cluster") == 2 * F.count(F.lit(1))).alias("all_labelled"))


@query()
def view_cluster_sizes(t):
    return clustering.cluster_sizes(clustering.view_clusters(features.model_columns(t.listings)))


@query()
def component_loadings(t):
    return clustering.component_loadings(features.model_columns(t.listings))


@query("""WITH z AS (SELECT price AS a, rating AS b FROM listings WHERE price IS NOT NULL AND rating IS NOT NULL)
SELECT 'a' AS "row", 'a' AS col, covar_samp(a, a) AS v FROM z
UNION ALL SELECT 'a', 'b', covar_samp(a, b) FROM z UNION ALL SELECT 'b', 'a', covar_samp(a, b) FROM z
UNION ALL SELECT 'b', 'b', covar_samp(b, b) FROM z""", "v", 2)
def covariance_matrix(t):
    rows = t.listings.na.drop(subset=["price", "rating"]).select(F.col("price").alias("a"), F.col("rating").alias("b"))
    m = linalg.covariance(*linalg.moments_matrix(rows, ["a", "b"]))
    return rows.sparkSession.createDataFrame(
        [(r, c, float(m[i, j])) for i, r in enumerate("ab") for j, c in enumerate("ab")],
        "row string, col string, v double")


@query()
def density_clusters(t):
    scaled = features.standardise(t.products.na.drop(subset=["price", "rating", "reviews_count"]),
                                  ["price", "rating", "reviews_count"])
    return density.density_summary(density.dbscan(scaled, ["z_price", "z_rating", "z_reviews_count"]))


@query()
def density_listing_clusters(t):
    scaled = features.standardise(t.listings.na.drop(subset=["price", "rating", "reviews_count"]),
                                  ["price", "rating", "reviews_count"])
    return density.density_summary(density.dbscan(scaled, ["z_price", "z_rating", "z_reviews_count"], 0.3))


ANOMALY_COLUMNS = ["original_price", "discount_percentage", "rating", "reviews_count"]


@query()
def isolation_anomalies(t):
    return anomaly.anomaly_summary(anomaly.isolation_forest(t.listings, "listing_id", ANOMALY_COLUMNS))


@query()
def ellipse_anomalies(t):
    return anomaly.anomaly_summary(anomaly.elliptic_envelope(t.listings, "listing_id", ANOMALY_COLUMNS))


@query()
def one_class_anomalies(t):
    return anomaly.anomaly_summary(anomaly.one_class(t.listings, "listing_id", ANOMALY_COLUMNS))


def forecast_sql(source: str, ts: str, keys: str, least: int) -> str:
    k = f"{keys}, " if keys else ""
    using = f"USING ({keys})" if keys else "ON TRUE"
    group = f"GROUP BY {keys}" if keys else ""
    dayg = f"GROUP BY {k} 2" if keys else "GROUP BY 1"
    weekg = f"GROUP BY {k} weekday"
    effects = f"USING ({k} weekday)"
    return f"""d AS (SELECT {k} CAST({ts} AS DATE) AS day, CAST(count(*) AS DOUBLE) AS y FROM {source}
  WHERE {ts} IS NOT NULL {dayg}),
f AS (SELECT {k} min(day) AS first_day, max(day) AS last_day FROM d {group} {'HAVING count(*) >= ' + str(least)}),
t AS (SELECT d.*, first_day, last_day, CAST(day - first_day AS DOUBLE) AS t FROM d JOIN f {using}),
l AS (SELECT {k} regr_slope(y, t) AS slope, regr_intercept(y, t) AS base, any_value(first_day) AS first_day,
  any_value(last_day) AS last_day FROM t {group}),
r AS (SELECT {k} day, y, t.t, base + slope * t.t AS trend, isodow(day) - 1 AS weekday
  FROM (SELECT {k} day, y, t FROM t) AS t JOIN l {using}),
e AS (SELECT {k} weekday, avg(y - trend) AS weekly FROM r {weekg}),
x AS (SELECT r.*, weekly FROM r JOIN e {effects}),
s AS (SELECT {k} stddev_samp(y - trend - weekly) AS sd FROM x {group}),
n AS (SELECT {k} slope, base, first_day, sd, CAST(last_day + CAST(h AS INT) AS DATE) AS date
  FROM l JOIN s {using}, range(1, 8) AS g(h))"""


def forecast_answer(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k} strftime(date, '%Y-%m-%d') AS day, tr + wk AS yhat, tr + wk - 1.2815515655446004 * sd AS yhat_lower,
  tr + wk + 1.2815515655446004 * sd AS yhat_upper, tr AS trend, wk AS weekly, 'trend + weekday means' AS method
FROM (SELECT n.*, base + slope * (date - first_day) AS tr, coalesce(weekly, 0) AS wk
      FROM (SELECT *, isodow(date) - 1 AS weekday FROM n) AS n LEFT JOIN e USING ({k} weekday))"""


FORECAST_DOUBLES = "yhat yhat_lower yhat_upper trend weekly"


@query(f"WITH {forecast_sql('orders', 'o_orderdate', '', 10)}\n{forecast_answer('')}", FORECAST_DOUBLES)
def demand_forecast(t):
    return demand.forecast(t.orders, column="o_orderdate")


@query(f"WITH {forecast_sql('orders', 'o_orderdate', '', 10)}\n"
       "SELECT avg(abs(y - trend - weekly)) AS mae, avg(abs(y - trend - weekly) / y) AS mape, count(*) AS n_days FROM x",
       "mae mape")
def demand_fit_quality(t):
    return demand.fit_quality(t.orders, column="o_orderdate")


@query(f"""WITH top AS (SELECT category FROM listings WHERE category IS NOT NULL GROUP BY 1
                  ORDER BY count(*) DESC, category LIMIT 3),
sel AS (SELECT * FROM listings WHERE category IN (SELECT category FROM top)),
{forecast_sql('sel', 'scraped_at', 'category', 5)}
{forecast_answer('category')}""", FORECAST_DOUBLES)
def category_forecasts(t):
    return demand.forecast_top(t.listings)
