"""Queries over whole tables, beside those that oracle SQL limits to a part."""

from types import SimpleNamespace

from martlet.operators import regression
from martlet.workload import cleaning, learning, streams


def test_all_pages_have_a_title_row(spark):
    # the scraper strips each piece of a heading and joins them without a blank
    pages = spark.createDataFrame([(1, "<h1>Plain</h1>"), (2, "<h1>Red <b>shoes</b></h1>"), (3, "<p>no heading</p>"), (4, None)], "page_id long, html string")
    got = {r["page_id"]: r["title"] for r in cleaning.all_page_titles(SimpleNamespace(pages=pages)).collect()}
    assert got.keys() == {1, 2, 3, 4} and got[1] == "Plain" and got[2] == "Redshoes" and not got[3] and not got[4]


def test_stream_keeps_every_user_once(spark):
    events = spark.createDataFrame([(k % 40, "view" if k % 3 else "buy") for k in range(400)], "user_id long, event_type string")
    got = streams.stream_users_without_repeats(SimpleNamespace(spark=spark, events=events)).collect()
    assert sorted(map(tuple, got)) == sorted({(k % 40, "view" if k % 3 else "buy") for k in range(400)})


def test_boosters_are_fitted_with_all_rounds(spark, monkeypatch):
    asked = {}

    def fit(self, rows):
        asked[self.getPredictionCol()] = self.getMaxIter()
        return regression.RandomForestRegressor(numTrees=1, maxDepth=1, labelCol=self.getLabelCol(), predictionCol=self.getPredictionCol()).fit(rows)

    monkeypatch.setattr(regression.GBTRegressor, "fit", fit)
    products = spark.createDataFrame([(k, 10.0 + k % 7, k % 5 / 1.0, f"u{k}") for k in range(60)], "product_id long, price double, rating double, url string")
    assert learning.boosted_price_models(SimpleNamespace(products=products)).count() == 4
    assert asked == dict.fromkeys(regression.BOOSTERS, 100)
