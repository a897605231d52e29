"""Targets and orders of the mix against a plain version; the pipeline end to end."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from martlet.llm import mixing
from tests.llm.conftest import prose


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    rest, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        share = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share > most * sizes[s]}
        if not full:
            return target | {s: weight[s] * share for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, None: 10}, {"a": 1000, "b": 1, "c": 2, "d": 5, "é": 40}, {"a": 0, "b": 7}, {"x": 5}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_targets_follow_the_integral(spark, docs):
    table = spark.createDataFrame([("a", 200), ("b", 200)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(table, (1, 1), 3.0, ((4, 4, 4), (1, 1, 1))).collect()}
    assert got == pytest.approx({"a": 320, "b": 80})
    ramp = {r["source"]: r["target"] for r in mixing.targets(table, (1, 2), 9.0, ((0, 3), (1, 0, 1))).collect()}
    assert ramp == pytest.approx({"a": 400 * 1.5 / 2.5, "b": 400 * 1 / 2.5})
    assert mixing.integral((0.5, 1.0, 1.5)) == 1.0 and mixing.integral((2.0,)) == 2.0
    rows = [(k, prose(k, 40), None, "ab"[k % 2]) for k in range(200)]
    taken = {}
    for r in mixing.mix(docs(rows), (1, 1), ((4, 4, 4), (1, 1, 1))).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * len(r["positions"])
    assert taken["a"] == pytest.approx(4 * taken["b"], rel=0.05)


def test_query_is_sorted_by_first_position(docs):
    rows = [(k, prose(k, 1 + k % 50), None, "abc"[k % 3]) for k in range(300)]
    first = [r["positions"][0] if r["positions"] else 2.0 for r in mixing.digest(docs(rows)).collect()]
    assert first == sorted(first) and len(first) == 300


def test_mix_meets_targets_and_reruns_agree(docs, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 7)
    rows = [(k, prose(k, 1 + k * 37 % 90), None, ["a", "b", "c", None][k * k % 4]) for k in range(300)]
    rows += [(1000, None, None, "a"), (1001, "", None, "b"), (5, rows[5][1], None, rows[5][3]), (None, "no id", None, "c")]
    table = docs(rows).withColumn("target", F.lit("clash"))
    first, again = mixing.digest(table).collect(), mixing.digest(table.repartition(5)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == len(rows)
    by, target, largest = {}, {}, max(r["size"] for r in first)
    for r, (_, _, _, source) in zip(sorted(first, key=str), sorted(rows, key=str)):
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * len(r["positions"])
    mixed = mixing.mix(table).collect()
    for r in mixed:
        by[r["source"]] = by.get(r["source"], 0) + r["size"] * len(r["positions"])
        target[r["source"]] = r["target"]
    assert all(abs(by[s] - target[s]) <= largest for s in by)


def test_order_follows_the_clock(docs):
    rows = [(k, prose(k, 40), None, "abc"[k % 3]) for k in range(300)]
    out = mixing.training_order(docs(rows)).collect()
    at = [r["position"] for r in out]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    early = lambda s: sum(r["position"] < 0.5 for r in out if r["source"] == s) / sum(r["source"] == s for r in out)
    assert early("a") == pytest.approx(0.375, abs=0.05) and early("b") == pytest.approx(0.5, abs=0.05) and early("c") == pytest.approx(0.625, abs=0.05)
    assert mixing.training_order(docs([])).count() == 0


def test_pipeline(spark, docs, tmp_path):
    item = prose(500, 40)
    rows = [(k, prose(k, 80), "en", "ab"[k % 2]) for k in range(40)]
    rows += [(100, prose(1, 80), "en", "a"), (101, prose(60, 30) + " you worthless idiot. " + prose(61, 30), "en", "b"),
             (102, prose(62, 30) + " " + item, "en", "b"), (103, prose(63, 60) + ' token = "abcdefgh12345678"', "en", "a"), (104, None, None, None)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table, gone = docs(rows), []
    before = {r["doc_id"] for r in table.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == docs(rows).columns
        after = {r["doc_id"] for r in table.collect()}
        gone.append((name, sorted(before - after)))
        before = after
    assert gone == [("toxicity", [101]), ("near_dedup", [100]), ("decontamination", [102]), ("secrets", [])]
    assert "abcdefgh12345678" not in table.where("doc_id = 103").first()["text"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} <= before
