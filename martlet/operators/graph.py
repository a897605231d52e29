"""A stored similarity graph: vectors, edges and the model they stand on.

The model (terms with idf, ranges of numbers, common brands and categories) is fitted once
and kept, so a product's vector depends on that product alone.  Vectors and edges lie in
buckets by a hash of the id: the neighbours of one id are read from one bucket.

A refresh compares vectors, and probes only what may have changed: new and changed ids, and
ids that list a changed or removed one.  All others keep their lists and take in what the
changed ids have to offer.  The edges are the same as if all were made anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.functions.text import combined_text
from martlet.operators import tfidf
from martlet.operators.ranks import medians
from martlet.operators.similarity import DIGITS, most_similar
from martlet.operators.topk import best_per_group, value_counts
from martlet.schema import TEXT_FIELDS, as_double, present
from martlet.session import saved
from martlet.sources import versions

CONTENT_WEIGHT, FEATURE_WEIGHT = 0.6, 0.4
NUMBERS, MARKS = ("price", "rating", "reviews_count"), ("brand", "category")
#: (id, feature) entries up to which probes are sent to all tasks; beyond, all edges are made anew.
PROBE_ENTRIES = 1_000_000
#: Pairs of probes and products up to which these are formed; beyond, bounds leave most of them out.
PROBE_PAIRS = 1_000_000_000
MODEL = "part string, name string, value string, a double, b double, c double"


def fit(products: DataFrame, common: int = 20) -> DataFrame:
    """The model as rows (part, name, value, a, b, c): ``term`` rows hold the idf in a, ``range``
    rows low, high and median, ``mark`` rows a common value of a column."""
    n = products.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    texts = products.select(combined_text(*[F.col(c) for c in present(products, TEXT_FIELDS)]).alias("text"),
                            F.monotonically_increasing_id().alias("row"))
    nothing = F.lit(None).cast("double")
    terms = tfidf.vocabulary(tfidf.term_counts(texts, "row", "text"), n).select(
        F.lit("term").alias("part"), F.col("term").alias("name"), F.lit("").alias("value"),
        (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("a"), nothing.alias("b"), nothing.alias("c"))
    numbers = present(products, NUMBERS)
    middle = medians(products, numbers) if numbers else {}
    bounds = products.agg(*[f(as_double(c)).alias(f"{k}_{c}") for c in numbers for k, f in (("low", F.min), ("high", F.max))],
                          F.count(F.lit(1)).alias("n")).first()
    rows = [("range", c, "", bounds[f"low_{c}"], bounds[f"high_{c}"], middle.get(c)) for c in numbers]
    for c in present(products, MARKS):
        rows += [("mark", c, r[c], None, None, None) for r in value_counts(products, c, common).collect()]  # ``common`` rows
    return terms.union(products.sparkSession.createDataFrame(rows, MODEL))


def vectors(products: DataFrame, model: DataFrame, key: str = "product_id") -> DataFrame:
    """(key, v): each product's features by name, sorted; the dot product of two is their similarity."""
    counts = tfidf.term_counts(
        products.select(key, combined_text(*[F.col(c) for c in present(products, TEXT_FIELDS)]).alias("text")), key, "text")
    terms = F.broadcast(model.where("part = 'term'").select(F.col("name").alias("term"), F.col("a").alias("idf")))  # capped vocabulary
    content = tfidf.unit_length(counts.join(terms, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w")), key, "term", "w")
    fixed = model.where("part <> 'term'").collect()  # a row per number, ``common`` per mark
    parts = []
    for r in fixed:
        if r["part"] == "range" and r["a"] is not None and r["b"] > r["a"]:
            filled = F.coalesce(as_double(r["name"]), F.lit(r["c"]))
            parts.append(F.struct(F.lit(f"{r['name']}_normalized").alias("feature"), ((filled - r["a"]) / (r["b"] - r["a"])).alias("w")))
        elif r["part"] == "mark":
            parts.append(F.struct(F.lit(f"{r['name']}_{r['value']}").alias("feature"),
                                  F.coalesce((F.col(r["name"]) == r["value"]).cast("double"), F.lit(0.0)).alias("w")))
    long = products.select(key, F.explode(F.array(*parts) if parts else F.array().cast("array<struct<feature:string,w:double>>")).alias("x"))
    values = tfidf.unit_length(long.select(key, "x.feature", "x.w").where("w <> 0"), key, "feature", "w")

    def named(part, kind, name, share):
        return part.select(key, F.concat(F.lit(f"{kind}:"), F.col(name)).alias("feature"), (F.col("weight") * F.sqrt(F.lit(share))).alias("weight"))

    both = named(content, "text", "term", CONTENT_WEIGHT).union(named(values, "value", "feature", FEATURE_WEIGHT))
    return both.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("feature", "weight"))).alias("v"))


def _long(packed: DataFrame, key: str) -> DataFrame:
    return packed.select(key, F.explode("v").alias("x")).select(key, "x.feature", "x.weight")


def scored(probes: DataFrame, packed: DataFrame, key: str = "product_id") -> DataFrame:
    """(key, neighbour, similarity) of each probe with every product that has something in common.

    The probes travel to the products, whose sums are complete in their task; ``probes``
    must be small (see PROBE_ENTRIES).
    """
    sent = _long(probes, key).select(F.col(key).alias("probe"), "feature", F.col("weight").alias("w"))
    met = _long(packed, key).join(F.broadcast(sent), "feature").where(F.col(key) != F.col("probe"))
    sums = met.groupBy(key, "probe").agg(F.round(F.sum(F.col("weight") * F.col("w")), DIGITS).alias("similarity"))
    return sums.where("similarity > 0").select(F.col("probe").alias(key), F.col(key).alias("neighbour"), "similarity")


def _best(edges: DataFrame, key: str, k: int) -> DataFrame:
    return best_per_group(edges, [key], [F.desc("similarity"), F.asc("neighbour")], k).select(key, "neighbour", "similarity", "rank")


def small_enough(probes: DataFrame, packed: DataFrame) -> bool:
    sizes = probes.agg(F.sum(F.size("v")).alias("entries"), F.count(F.lit(1)).alias("n")).first()
    return (sizes["entries"] or 0) <= PROBE_ENTRIES and sizes["n"] * packed.count() <= PROBE_PAIRS


def nearest_to(probes: DataFrame, packed: DataFrame, k: int = 10, key: str = "product_id") -> DataFrame:
    """The ``k`` nearest of some products only; all are compared where the probes are many."""
    if small_enough(probes, packed):
        return _best(scored(probes, packed, key), key, k)
    return most_similar(_long(packed, key), key, k).join(probes.select(key), key, "left_semi")


def _bucket(c, buckets: int):
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """With its bucket, and each bucket's rows in a bounded number of tasks and so of files."""
    dealt = df.withColumn("bucket", _bucket(F.col(key), buckets))
    return dealt.repartition("bucket", F.pmod(F.xxhash64(F.lit(1), key), F.lit(16)))


def _signed(packed: DataFrame, key: str, name: str) -> DataFrame:
    return packed.select(key, F.xxhash64(F.transform("v", lambda x: F.struct(x["feature"], F.round(x["weight"], 9)))).alias(name))


def _commit(draft: versions.Draft, found: DataFrame, edges: DataFrame, model: DataFrame, key: str, k: int,
            buckets: int, as_of: str, probed: int, note: str) -> int:
    written = draft.write("edges", _bucketed(edges, key, buckets), "bucket")
    draft.write("model", model)
    facts = {"key": key, "k": k, "buckets": buckets, "products": found.count(), "edges": written.count(), "probed": probed,
             "models": "content,collaborative", "saved_at": as_of}
    draft.write("metadata", draft.spark.createDataFrame([(a, str(b)) for a, b in facts.items()], "name string, value string"))
    return draft.commit(as_of, note)


def build(products: DataFrame, root: str, as_of: str, k: int = 10, key: str = "product_id", buckets: int = 64,
          model: DataFrame | None = None) -> int:
    """Fit (unless a model is given), compute all edges and store them; returns the version."""
    draft = versions.Draft(products.sparkSession, root)
    model = fit(products) if model is None else model
    packed = vectors(products, model, key)
    found = draft.write("vectors", _bucketed(packed, key, buckets), "bucket").drop("bucket")
    edges = most_similar(_long(found, key), key, k)
    return _commit(draft, found, edges, model, key, k, buckets, as_of, found.count(), "build")


def metadata(spark: SparkSession, root: str) -> dict[str, str]:
    return {r["name"]: r["value"] for r in versions.read(spark, root, "metadata").collect()}


def refresh(products: DataFrame, root: str, as_of: str) -> int:
    """Bring the stored graph up to the table under the stored model; returns the new version."""
    spark = products.sparkSession
    facts = metadata(spark, root)
    key, k, buckets = facts["key"], int(facts["k"]), int(facts["buckets"])
    model, old_edges = versions.read(spark, root, "model"), versions.read(spark, root, "edges").drop("bucket")
    old = versions.read(spark, root, "vectors").drop("bucket")
    draft = versions.Draft(spark, root)
    found = draft.write("vectors", _bucketed(vectors(products, model, key), key, buckets), "bucket").drop("bucket")
    compared = _signed(found, key, "now").join(_signed(old, key, "before"), key, "full")
    moved = draft.write("moved", compared.where("NOT (now <=> before)").select(
        key, F.when(F.col("now").isNull(), "removed").when(F.col("before").isNull(), "added").otherwise("changed").alias("kind")))
    lost = moved.where("kind <> 'added'").select(F.col(key).alias("neighbour"))
    listing = old_edges.join(lost, "neighbour", "left_semi").select(key)
    probed = (moved.where("kind <> 'removed'").select(key).union(listing).distinct()
              .join(moved.where("kind = 'removed'").select(key), key, "left_anti"))
    probes = saved(found.join(probed, key, "left_semi"), "probes")
    if not small_enough(probes, found):
        edges = most_similar(_long(found, key), key, k)
    else:
        pairs = saved(scored(probes, found, key), "pairs")
        offered = pairs.join(moved.select(key), key, "left_semi").select(F.col("neighbour").alias(key), F.col(key).alias("neighbour"), "similarity")
        kept = old_edges.select(key, "neighbour", "similarity").join(moved.where("kind = 'removed'").select(key), key, "left_anti")
        others = kept.union(offered).join(probes.select(key), key, "left_anti")
        edges = _best(pairs.union(others), key, k)
    return _commit(draft, found, edges, model, key, k, buckets, as_of, probes.count(), "refresh")


def neighbours(spark: SparkSession, root: str, one, n: int | None = None) -> DataFrame:
    """The stored neighbours of one id, read from its bucket; none for an unknown id."""
    facts = metadata(spark, root)
    edges = versions.read(spark, root, "edges")
    wanted = F.lit(one).cast(edges.schema[facts["key"]].dataType)
    found = edges.where((F.col("bucket") == _bucket(wanted, int(facts["buckets"]))) & (F.col(facts["key"]) == wanted)).drop("bucket")
    return found if n is None else found.where(F.col("rank") <= n)
