"""The stored similarity graph: refreshing equals building anew, reading one id reads one bucket."""

import pytest
from pyspark.sql import functions as F

from martlet.operators import graph, recommend
from martlet.sources import versions

SCHEMA = "product_id long, title string, brand string, category string, price double, rating double, reviews_count long"
WORDS = "red blue steel wooden chair table lamp desk shelf stool bench sofa".split()


def product(k, price=None):
    title = " ".join(WORDS[(k * j + j) % len(WORDS)] for j in range(1, 2 + k % 4))
    return (k, title, f"brand{k % 5}", f"kind{k % 3}", 10.0 + k % 17 if price is None else price, (k % 50) / 10, k % 23)


@pytest.fixture(scope="module")
def tables(spark):
    def make(rows):
        return spark.createDataFrame(rows, SCHEMA).repartition(3)
    return make


def edges(spark, root):
    return sorted(map(tuple, versions.read(spark, root, "edges").drop("bucket").collect()))


def test_vectors_are_those_of_the_recommender(spark, tables):
    products = tables([product(k) for k in range(60)])
    model = graph.fit(products)
    stored = {(r["product_id"], r["feature"]): r["weight"] for r in graph._long(graph.vectors(products, model), "product_id").collect()}
    plain = {(r["product_id"], r["feature"]): r["weight"] for r in recommend.hybrid_vectors(products).collect()}
    assert stored.keys() == plain.keys()
    assert all(abs(stored[k] - plain[k]) < 1e-12 for k in stored)


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_refresh_equals_building_anew(spark, tables, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(graph, "PROBE_ENTRIES", limit)
    before = [product(k) for k in range(80)] + [product(0)[:0] + (500 + k, *product(3)[1:]) for k in range(10)]
    after = [product(k, 400.0 if k in (3, 4) else None) for k in range(90) if k not in (5, 6, 7)]  # changed, added, removed
    after += [(500 + k, *product(3)[1:]) for k in range(6)]
    model = graph.fit(tables(before))
    root, other = f"{tmp_path}/a", f"{tmp_path}/b"
    assert graph.build(tables(before), root, "2024-01-01", 4, model=model) == 1
    assert graph.refresh(tables(after), root, "2024-01-02") == 2
    graph.build(tables(after), other, "2024-01-02", 4, model=model)
    assert edges(spark, root) == edges(spark, other)
    kinds = {r["product_id"]: r["kind"] for r in versions.read(spark, root, "moved").collect()}
    assert kinds[3] == "changed" and kinds[85] == "added" and kinds[5] == "removed" and 20 not in kinds
    facts = graph.metadata(spark, root)
    assert facts["products"] == str(len(after)) and int(facts["probed"]) < len(after)
    assert versions.read(spark, root, "edges", 1).count() > 0  # the version before can still be read


def test_nothing_changed_probes_nothing(spark, tables, tmp_path):
    products = tables([product(k) for k in range(30)])
    graph.build(products, str(tmp_path), "2024-01-01", 3)
    first = edges(spark, str(tmp_path))
    graph.refresh(products, str(tmp_path), "2024-01-02")
    assert edges(spark, str(tmp_path)) == first and graph.metadata(spark, str(tmp_path))["probed"] == "0"


def test_one_id_reads_one_bucket(spark, tables, tmp_path):
    root = str(tmp_path)
    graph.build(tables([product(k) for k in range(60)]), root, "2024-01-01", 3)
    whole = {}
    for row in edges(spark, root):
        whole.setdefault(row[0], []).append(row)
    for k in (0, 7, 59):
        found = graph.neighbours(spark, root, k)
        assert sorted(map(tuple, found.collect())) == whole[k]
        bucket = spark.range(1).select(graph._bucket(F.lit(k).cast("long"), 64)).first()[0]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert f"= {bucket})" in plan.split("PartitionFilters")[1].split("]")[0]
    assert graph.neighbours(spark, root, 12345).count() == 0
    assert graph.neighbours(spark, root, 7, 2).count() == 2


def test_an_interrupted_draft_leaves_the_old_version(spark, tables, tmp_path):
    root = str(tmp_path)
    assert versions.latest(spark, root) is None
    with pytest.raises(LookupError):
        versions.read(spark, root, "edges")
    draft = versions.Draft(spark, root)
    draft.write("edges", spark.range(3))
    assert draft.commit("2024-01-01", "first") == 1
    broken = versions.Draft(spark, root)
    broken.write("edges", spark.range(9))
    with pytest.raises(Exception):
        broken.write("more", spark.range(4).select(F.raise_error(F.lit("stop")).alias("x")))
    assert versions.latest(spark, root) == 1 and versions.read(spark, root, "edges").count() == 3
    line = versions.manifest(spark, root).first()
    assert (line["rows"], line["note"], line["hash"]) == (3, "first", versions.fingerprint(spark.range(3).repartition(2))[1])


def test_few_are_probed_alone(spark, tables):
    products = tables([product(k) for k in range(50)])
    whole = recommend.similar_products(products, 4, "hybrid").where("product_id IN (3, 9)")
    few = recommend.similar_to(products, spark.createDataFrame([(3,), (9,), (777,)], "product_id long"), 4)
    names = ["product_id", "neighbour", "similarity", "rank", "method"]
    assert sorted(map(tuple, few.select(names).collect())) == sorted(map(tuple, whole.select(names).collect()))


def test_many_pairs_are_not_formed(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [("a", 0.6), (f"b{i % 5}", 0.8)]) for i in range(30)],
                                 "product_id long, v array<struct<feature:string,weight:double>>")
    few = {tuple(r) for r in graph.nearest_to(rows, rows, 3).select("product_id", "neighbour", "similarity", "rank").collect()}
    monkeypatch.setattr(graph, "PROBE_PAIRS", 30 * 30 - 1)
    monkeypatch.setattr(graph, "scored", None)  # forms every pair
    assert {tuple(r) for r in graph.nearest_to(rows, rows, 3).select("product_id", "neighbour", "similarity", "rank").collect()} == few
