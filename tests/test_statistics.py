"""Edge tables for the statistics, against numpy and pandas."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from martlet.operators import charts, correlation, outliers, profile, quality, ranks
from martlet.plans import full_run


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "price double")


@pytest.mark.parametrize("values", [
    [1.0], [1.0, 2.0], [3.0] * 5, [1.0, 2.0, 2.0, 9.0, None, float("nan")],
    list(np.random.default_rng(1).normal(size=400)) + [7.0] * 200])
def test_profile_equals_pandas(spark, values):
    s = pd.Series([np.nan if v is None else v for v in values]).dropna()
    row = profile.numeric_profile(frame(spark, values)).first()
    want = {"count": s.size, "mean": s.mean(), "median": s.median(), "std": s.std(), "min": s.min(), "max": s.max(),
            "skewness": s.skew(), "kurtosis": s.kurtosis(), "percentile_25": s.quantile(.25),
            "percentile_75": s.quantile(.75), "iqr": s.quantile(.75) - s.quantile(.25)}
    for k, v in want.items():
        if v is None or np.isnan(v):
            assert row[k] is None, k
        else:
            assert row[k] == pytest.approx(v, abs=1e-9), k


def test_empty_tables(spark):
    none = frame(spark, [])
    assert profile.numeric_profile(none).count() == 0
    assert profile.price_stats(none).first()["median"] is None
    assert charts.histogram(none, "price", 5).count() == 0
    assert outliers.outlier_summary(frame(spark, [None, None])).count() == 0
    assert quality.table_quality(none).first()["total_records"] == 0


def test_quantiles_with_hot_group_and_any_partitioning(spark):
    dice = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in dice.integers(0, 1000, 3000)] + [
        (f"k{i % 7}", float(v)) for i, v in enumerate(dice.normal(size=700))]
    pdf = pd.DataFrame(rows, columns=["k", "v"])
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    want = pdf.groupby("k")["v"].quantile(probs)
    for n in (1, 3, 17):
        df = spark.createDataFrame(pdf).repartition(n)
        got = {(r["k"], r["prob"]): r["quantile"] for r in ranks.quantiles_long(df, ["k"], "v", probs).collect()}
        assert len(got) == len(want)
        for key, value in want.items():
            assert got[key] == pytest.approx(value, abs=1e-12)


def test_average_ranks(spark):
    values = [3.0, 1.0, 3.0, 2.0, 3.0]
    df = spark.createDataFrame([(0, v) for v in values], "k int, v double")
    got = {r["v"]: r["avg_rank"] for r in ranks.average_ranks(df, ["k"], "v").collect()}
    assert got == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}


def test_correlations_with_missing_and_constant(spark):
    pdf = pd.DataFrame({"a": [1, 2, 3, 4, None, 6], "b": [2, 1, 4, 3, 5, None], "c": [5.0] * 6}, dtype=float)
    df = spark.createDataFrame([tuple(None if np.isnan(x) else float(x) for x in r) for r in pdf.to_numpy()],
                               "a double, b double, c double")
    p = {(r[0], r[1]): r[2] for r in correlation.pearson_pairs(df).collect()}
    s = {(r[0], r[1]): r[2] for r in correlation.spearman_pairs(df).collect()}
    assert p["a", "b"] == pytest.approx(pdf["a"].corr(pdf["b"]))
    both = pdf[["a", "b"]].dropna().rank()
    assert s["a", "b"] == pytest.approx(both["a"].corr(both["b"]))
    assert p["a", "c"] is None and s["a", "c"] is None


def test_equal_quartile_edges_are_reported(spark):
    rows = profile.price_segments(frame(spark, [1, 1, 1, 1, 2])).collect()
    assert not any(r["edges_distinct"] for r in rows)
    assert sum(r["count"] for r in rows) == 5


def test_constant_column_histogram(spark):
    rows = charts.histogram(frame(spark, [4, 4, 4]), "price", 10).collect()
    assert [(r["bin"], r["count"]) for r in rows] == [(0, 3)]


def test_histogram_closes_last_bin(spark):
    rows = charts.histogram(frame(spark, range(11)), "price", 5).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [2, 2, 2, 2, 3]


def test_quality_score_ignores_blanks(spark):
    df = spark.createDataFrame([("t", 1.0, " "), (None, None, "b")], "title string, price double, brand string")
    got = [round(r[0], 2) for r in df.select(quality.quality_score(df)).collect()]
    assert got == [66.67, 33.33]


def test_planted_outlier(spark):
    df = frame(spark, list(range(100)) + [10_000])
    row = outliers.outlier_summary(df).first()
    assert (row["iqr_count"], row["zscore_count"]) == (1, 1)


def test_group_key_null_is_dropped(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", 2.0), ("a", 4.0)], "category string, price double")
    assert [tuple(r) for r in profile.price_by(df, "category").collect()] == [("a", 3.0, 3.0, 2)]
    assert df.where(F.col("category").isNull()).count() == 1


def test_spearman_ranks_among_the_rows_that_hold_both(spark):
    rows = [(float(i * 7 % 11), None if i % 4 == 0 else float(i % 3), None if i % 5 == 0 else -0.0 if i % 2 else 0.0, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    found = correlation.spearman_pairs(df)
    assert "pair" not in found._jdf.queryExecution().optimizedPlan().toString()  # no copy of a row for each pair
    got = {(r["variable1"], r["variable2"]): r["spearman"] for r in found.collect()}

    def ranks(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    assert len(got) == 6
    for (i, one), (j, two) in combinations(enumerate("abcd"), 2):
        held = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
        x, y = ranks(held[:, 0]), ranks(held[:, 1])
        assert (got[one, two] is None) if x.std() * y.std() == 0 else abs(got[one, two] - np.corrcoef(x, y)[0, 1]) < 1e-9


def test_chart_tables_read_stored_rows(spark):
    df = spark.createDataFrame([(float(i), i % 5 / 1.0, f"c{i % 3}", f"b{i % 2}") for i in range(50)], "price double, rating double, category string, brand string")
    tables = full_run.chart_tables(df)
    assert tables["price_box"].count() == 1
    assert all("/charts-" in f for t in (tables["price_density"], tables["brand_share"], tables["completeness"]) for f in t.inputFiles() or [""])


def test_distinct_values_are_counted_without_a_wide_row_for_each_column(spark):
    rows = [(k % 7, float(k % 5) if k % 3 else None, f"t{k % 40}", f"u{k}", {"a": str(k % 4)}, None) for k in range(2000)]
    df = spark.createDataFrame(rows, "n long, x double, few string, many string, m map<string,string>, nothing string")
    found = quality.column_quality(df)
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["column"]: (r["unique_values"], r["missing_percentage"], r["data_type"]) for r in found.collect()}
    assert got == {"n": (7, 0.0, "bigint"), "x": (5, 33.35, "double"), "few": (40, 0.0, "string"), "many": (100, 0.0, "string"),
                   "m": (4, 0.0, "map<string,string>"), "nothing": (0, 100.0, "string")}
    assert {r["unique_values"] for r in quality.column_quality(df.limit(0)).collect()} == {0}
