"""Hand-made edge rows for the scalar rules."""

import pytest
from pyspark.sql import functions as F

from martlet.functions import amounts, bins, brands, text, urls


def apply(spark, values, rule, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r["x"] for r in df.select("i", rule(F.col("v")).alias("x")).orderBy("i").collect()]


def test_extract_price(spark):
    given = ["€29.99", "1,299.00 €", "29,99 €", "1.299,00", "n/a", "", None, "0", "1.2.3"]
    assert apply(spark, given, amounts.extract_price) == [
        29.99, 1299.0, 29.99, 1.299, None, None, None, 0.0, None]
    assert apply(spark, ["0", "5"], amounts.positive_price) == [None, 5.0]


def test_clean_text(spark):
    given = ["  a   b ", "a\tb\n", "a\x01b", "a\x85b", "çë ü", "", None, " x "]
    assert apply(spark, given, text.clean_text) == ["a b", "a b", "ab", "a b", "çë ü", "", "", "x"]


def test_word_count(spark):
    assert apply(spark, ["", "  ", "a", " a  b ", None], text.word_count)[:4] == [0, 0, 1, 2]


def test_normalize_url(spark):
    given = ["/test", "//h/x", "x", "https://h/x", "", None]
    assert apply(spark, given, lambda c: urls.normalize_url(c, "https://shop.example/")) == [
        "https://shop.example/test", "https://h/x", "https://shop.example/x", "https://h/x", "", ""]


def test_valid_url(spark):
    given = ["https://a.example/x", "http://1.2.3.4:80/", "ftp://a.example", "nope", "https://", "https://a b.example",
             "https://host", None]
    assert apply(spark, given, urls.is_valid_url) == [True, True, True, False, False, False, False, False]


def test_product_id(spark):
    given = ["/product/1", "/p/2", "product-3", "?id=4", "/5/", "/6", "none", None]
    assert apply(spark, given, urls.product_id_from_url) == ["1", "2", "3", "4", "5", "6", None, None]


def test_image_urls(spark):
    df = spark.createDataFrame([(["//h.example/a.png", "/b.png", "/b.png", "", None, "c.png", "http://x y/"],), (None,)],
                               "v array<string>")
    got = [r[0] for r in df.select(urls.clean_image_urls(F.col("v"), "https://s.example")).collect()]
    assert got == [["https://h.example/a.png", "https://s.example/b.png", "https://s.example/c.png"], []]


def test_product_links(spark):
    given = ["/laptop/lenovo-i7-16gb-512/x", "/laptop", "/laptop/lenovo-i7-16gb/cart/x", "//h/laptop-i7-16gb-x/y/z",
             "/gaming/kompjuter-super-i7-edition-for-all/a", "/tv/a-b-c-d-e-f-g/" + "x" * 45, "/shoes/nike-i7-16gb-pro/x", None]
    assert apply(spark, given, urls.is_product_link) == [True, False, False, False, True, True, False, False]
    assert apply(spark, ["/laptop", "//x", "/login", "x", None], urls.is_category_link) == [
        True, False, False, False, False]


def test_price_texts(spark):
    given = ["100.00 € 80.00 €", "80.00€", "free", None]
    assert apply(spark, given, amounts.current_price_text) == ["80.00 €", "80.00 €", None, None]
    assert apply(spark, given, amounts.original_price_text) == ["100.00 €", None, None, None]


def test_rating_and_reviews_in_text(spark):
    given = ["4.5/5", "4 out of 5", "3.5 stars", "4★", "9/5", "rated 4.2", "none", None]
    assert apply(spark, given, amounts.rating_in_text) == [4.5, 4.0, 3.5, 4.0, None, 4.2, None, None]
    given = ["5 reviews", "12 Vlerësime", "3 opinione", "7 komente", "2 recensione", "review: 8", "9", None]
    assert apply(spark, given, amounts.review_count_in_text) == [5, 12, 3, 7, 2, 8, None, None]


def test_zero_rules(spark):
    assert apply(spark, ["0", "", "4.5", "5.1", "x", None], amounts.parse_rating) == [0.0, None, 4.5, None, None, None]
    assert apply(spark, [0.0, 4.5], lambda c: amounts.parse_rating(c, False), "double") == [None, 4.5]
    assert apply(spark, ["0", "4.5", " 7 ", "-1", ""], amounts.parse_review_count) == [0, None, 7, None, None]


def test_brand(spark):
    given = ["Laptop Lenovo X1", "Laptop Foobar X", "telefon iphone 12", "tv", "a b c Dxx", ""]
    assert apply(spark, given, brands.brand_from_title) == ["Lenovo", "Foobar", "iphone", "", "", ""]


@pytest.mark.parametrize("rule,want", [
    (bins.rating_category, [None, None, "Poor", "Fair", "Good", "Excellent", "Excellent", None]),
    (bins.rating_band, ["Unknown", "Poor", "Poor", "Poor", "Good", "Very Good", "Excellent", "Unknown"]),
])
def test_bins(spark, rule, want):
    assert apply(spark, [None, 0.0, 2.0, 3.0, 4.0, 4.5, 5.0, 5.1], rule, "double") == want


def test_slug_and_first_non_empty(spark):
    assert apply(spark, ["https://s.example/gaming-kompjuter"], text.slug_title) == ["Gaming Kompjuter"]
    df = spark.createDataFrame([("", " ", " x "), (None, None, None)], "a string, b string, c string")
    got = [r[0] for r in df.select(text.first_non_empty(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["x", ""]
