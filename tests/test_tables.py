"""Validation, cleaning, encoding, pages, files, sinks."""

import json
import os

import pytest

from martlet.operators import cleaning, features, filters, validate
from martlet.schema import RAW_PRODUCT
from martlet.sources import files, links, pages, sinks

PAGE = """<html><head><script>var a = "<h1>no</h1>";</script></head><body>
<div class="breadcrumb"><a href="/">Home</a><a href="/laptop">Laptop </a></div>
<h1 class="product-title"> Laptop  Lenovo X1 </h1>
<div class="product-price">100.00 € <span>80.00 €</span></div>
<div class="product-description">Fast &amp; light</div>
<div class="stock-status">In stock</div>
<div class="ratingsAndReviews">4.5/5</div><div class="product-reviews-overview">12 reviews</div>
<div class="product-gallery"><img data-src="/a.png"><img src="//cdn.example/b.png"><img src="/a.png"></div>
{specs}</body></html>"""
TABLE = '<table class="spec-table"><tr><th>RAM</th><td>16GB</td></tr><tr><td>RAM</td><td>32GB</td></tr></table>'
PAIRS = '<dl class="product-specs"><dt>CPU</dt><dd>i7</dd></dl>'
LINES = '<ul class="attributes"><li>Weight: 1.2: kg</li><li>nothing</li></ul>'


def test_pages_to_products(spark):
    rows = [(f"/product/{i}", PAGE.format(specs=s)) for i, s in enumerate((TABLE, PAIRS, LINES))]
    rows += [("/p/9", None), ("/p/10", "<p class='line-through'>50.00 €</p><b class='current-price'>40 €</b>")]
    got = {r["product_id"]: r for r in pages.extract_products(
        spark.createDataFrame(rows, "url string, html string")).collect()}
    first = got["0"]
    assert (first["title"], first["brand"], first["category"]) == ("Laptop Lenovo X1", "Lenovo", "Home > Laptop")
    assert (first["price"], first["original_price"], first["discount_percentage"]) == (80.0, 100.0, 20.0)
    assert (first["rating"], first["reviews_count"], first["availability"]) == (4.5, 12, "In stock")
    assert first["description"] == "Fast & light"
    assert first["images"] == ["https://shop.example/a.png", "https://cdn.example/b.png"]
    assert [got[str(i)]["specifications"] for i in range(3)] == [{"RAM": "32GB"}, {"CPU": "i7"}, {"Weight": "1.2: kg"}]
    assert got["9"]["title"] == "" and got["9"]["price"] is None
    assert (got["10"]["price"], got["10"]["original_price"]) == (40.0, 50.0)


def test_validate_accepts_missing_columns(spark):
    row = validate.validate_products(spark.createDataFrame([("/p/3", 0.0)], "url string, rating double")).first()
    assert (row["product_id"], row["title"], row["price"], row["rating"], row["images"]) == ("3", "", None, None, [])


def test_keep_first_treats_missing_keys_as_equal(spark):
    df = spark.createDataFrame([(None, None, 2), (None, None, 1), ("u", "t", 3), ("u", None, 4)],
                               "url string, title string, scraped_at int")
    assert sorted(r["scraped_at"] for r in cleaning.keep_first(df).collect()) == [1, 3, 4]
    known = spark.createDataFrame([(None, None)], "url string, title string")
    assert sorted(r["scraped_at"] for r in cleaning.keep_new(df, known).collect()) == [3, 4]


def test_flatten_and_stringify(spark):
    df = spark.sql("SELECT named_struct('a', 1, 'b', named_struct('c', array('x','y'))) AS s, map('k', 'v') AS m")
    row = cleaning.flatten(df).first().asDict()
    assert row == {"s_a": 1, "s_b_c": "x, y", "m": '{"k":"v"}'}
    assert cleaning.drop_duplicate_rows(df.union(df)).count() == 1


def test_impute(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, None), (3.0, ""), (float("nan"), "b")], "x double, s string")
    assert sorted(tuple(r) for r in cleaning.impute(df).collect()) == [(1.0, "a"), (2.0, ""), (2.0, "b"), (3.0, "")]


@pytest.mark.parametrize("limit", [200_000, 10])
def test_value_codes_follow_the_order_of_values(spark, limit):
    names = [f"v{i:05d}" for i in range(3000)]
    df = spark.createDataFrame([(n,) for n in names[::-1]] * 2 + [(None,)], "c string")
    got = {r["value"]: r["code"] for r in features.value_codes(df, "c", limit).collect()}
    assert got == {n: i for i, n in enumerate(names)}


def test_min_max_of_a_constant_column(spark):
    df = spark.createDataFrame([(5.0, None), (5.0, 1.0), (5.0, 3.0)], "price double, rating double")
    rows = features.min_max(df, ["price", "rating"]).collect()
    assert [r["price_normalized"] for r in rows] == [0.0] * 3
    assert sorted(r["rating_normalized"] for r in rows) == [0.0, 0.5, 1.0]


def test_recent_falls_back_to_all(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01' AS scraped_at UNION ALL SELECT timestamp_ntz'2023-01-01'")
    assert filters.recent_or_all(df, "2024-01-03", 7).count() == 1
    assert filters.recent_or_all(df, "2025-01-03", 7).count() == 2


def test_files(spark, tmp_path):
    rows = [{"title": "a", "price": "€1", "specifications": {"k": "v"}}, {"title": "b", "images": ["x"]}]
    (tmp_path / "one.json").write_text(json.dumps(rows))
    (tmp_path / "two.json").write_text(json.dumps(rows[:1]))
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "rows.csv").write_text("price,title,extra\n1,a,q\n")
    assert files.load_products(str(tmp_path / "one.json"), spark).count() == 2
    assert files.load_products(str(tmp_path / "rows.csv"), spark).first().asDict() == {
        "price": "1", "title": "a", "extra": "q"}
    got = files.load_directory(spark, str(tmp_path))
    assert {(r["source_file"], r["count"]) for r in got.groupBy("source_file").count().collect()} == {
        ("one.json", 2), ("two.json", 1)}
    assert [r["source_file"] for r in files.unreadable_files(spark, str(tmp_path)).collect()] == ["bad.json"]
    with pytest.raises(ValueError):
        files.load_products("x.xlsx", spark)


def test_sinks(spark, tmp_path):
    df = validate.validate_products(spark.createDataFrame(
        [("a", "1 €", ["x.png"], {"k": "v"})],
        "title string, price string, images array<string>, specifications map<string,string>"))
    done = sinks.export(df, str(tmp_path), "r1", ("json", "csv", "excel"))
    assert set(done) == {"json", "csv", "excel"} and all(os.path.isdir(p) for p in done.values())
    row = spark.read.option("header", True).option("escape", '"').csv(done["csv"]).first()
    assert (row["images"], row["specifications"]) == ("https://shop.example/x.png", '{"k":"v"}')
    assert sinks.write_csv(df.limit(0), str(tmp_path / "none")) is None
    assert "<h1>T &amp; R</h1>" in sinks.html_report(df.select("title", "price"), "T & R", "today").first()["html"]
    with pytest.raises(ValueError):
        sinks.export(df, str(tmp_path), "r2", ("xml",))


def test_links(spark):
    html = "<a href='/login'>x</a><a class=k href=\"/laptop/lenovo-i7-16gb-x/y\">y</a><a href='/tv'>z</a>"
    df = spark.createDataFrame([("u", html), ("v", html)], "url string, html string")
    assert [r["link"] for r in links.product_links(df).collect()] == ["https://shop.example/laptop/lenovo-i7-16gb-x/y"]
    assert links.category_links(df).count() == 2
    seeds = links.category_seeds(spark.createDataFrame([("tv",)], "category string"))
    have = spark.createDataFrame([("https://shop.example/c/tv", "p1"), ("https://shop.example/tv", "p2")],
                                 "url string, product string")
    assert [r["product"] for r in links.first_working(seeds, have, ["category"]).collect()] == ["p1"]


def test_schema_reads_raw_rows(spark):
    assert "specifications" in RAW_PRODUCT.fieldNames()
    typed = cleaning.coerce_numbers(spark.createDataFrame([("x", "3")], "price string, rating string"))
    assert typed.first().asDict() == {"price": None, "rating": 3.0}
    assert cleaning.fill_zero(typed).first()["price"] == 0.0
    assert cleaning.time_parts(spark.sql("SELECT timestamp'2024-01-06 05:00:00' AS scraped_at")).first()[
        "scraped_day_of_week"] == "Saturday"


def test_text_exports_are_compressed_and_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "TEXT_ROWS", 400)
    df = spark.range(1000).selectExpr("id", "concat('title of ', id) AS title").coalesce(1)
    done = sinks.export(df, str(tmp_path), "r1", ("json", "csv"))
    for path, ending in ((done["json"], "*.json.gz"), (done["csv"], "*.csv.gz")):
        from pathlib import Path
        assert len(list(Path(path).glob(ending))) == 3
    assert spark.read.json(done["json"]).distinct().count() == 1000
    assert spark.read.option("header", True).csv(done["csv"]).distinct().count() == 1000
