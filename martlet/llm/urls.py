"""URL judgement: stated rules first, then logistic regression on hashed n-grams.

The model sees the distinct character n-grams of host and path, each hashed into one of
``BUCKETS`` weights, and is trained from a small labelled table of URLs.  Splitting,
hashing and scoring are SQL functions; the weights enter the plan as one literal.

Null URLs and such without ``://`` have an empty host and path and are judged by the
model's intercept alone.  Rules that fit equally long are decided by their text.
Repeated rows are judged alike; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS, SIZES = 2048, (3, 4)
#: Chance of being unwanted from which a URL is blocked.
LIMIT = 0.6

# The stated rules.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block"))

#: Hosts of the labelled table, own examples.  Unwanted ones sell, gamble, track or spam.
UNWANTED = """
best-casino casino-royal online-casino casino-bonus lucky-casino poker-win win-big-lottery jackpot-win free-spins lucky-slots
cheap-meds buy-pills cheap-pills-online diet-pills pharma-cheap cheap-viagra cheap-replica cheap-watches pills-shop
free-bets-now sports-bets betting-tips free-bet best-odds-bets bets-online free-iphone-win free-followers free-gift-cards
ads-server track-ads adtrack click-track ads-network popup-ads tracking-ads ads-banner pixel-track ad-clicks
spam-links link-farm content-farm spam-mail seo-farm spam-blog backlink-farm bulk-spam
adult-cams xxx-tube hot-dating payday-loans fast-cash-loans crypto-doubler warez-crack torrent-crack
essay-cheap get-rich-quick phish-login verify-account-login
""".split()
WANTED = """
university news-daily travel-notes library museum recipes weather journal-science newspaper gardening health-advice school
history hiking books letters photos theatre astronomy botany archive research city-council encyclopedia mountain podcast
maps orchestra thunder therapist north another there southern translation stations ration theatres kitchen tension heron
other therefore gather thread ether northern interest the-herald athens orient thin-ice question nation motion lantern
""".split()
#: URLs that say next to nothing are not unwanted.
BARE = ("", "", "", "a://b", "c://d/e", "f://g", "h://i.j", "http://localhost/")
#: The same forms for both kinds, so that only hosts teach: start, top domain and path.
FORMS = (("https://www.", ".example.com", "/en/{n}.html"), ("http://", ".example.net", "/fr/{n}?page=2"),
         ("https://blog.", ".example.org", "/de/{n}/"), ("https://m.", ".test", "/es/{n}#top"), ("https://", ".example.com", "/"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` names it in a loop."""
    return F.transform(F.array(value), use)[0]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path, both empty for null or without ``://``."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def buckets(host: Column, path: Column) -> Column:
    """The distinct hashed n-grams of host and path."""
    marked = F.concat(F.lit("^"), host, F.lit("$"), F.lit("|"), path, F.lit("|"))

    def of_size(chars: Column, k: int) -> Column:
        n = F.size(chars)
        gram = lambda i: F.pmod(F.xxhash64(*[F.get(chars, i + j) for j in range(k)]), F.lit(BUCKETS)).cast("int")
        return F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), gram)).otherwise(
            F.array().cast("array<int>"))

    def grams(chars: Column) -> Column:
        return F.array_distinct(F.concat(*[of_size(chars, k) for k in SIZES]))

    return let(F.split(marked, ""), grams)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, unwanted): the small table the model is trained from."""
    rows = [(start + host + top + path.format(n=37 * k % 990), unwanted)
            for unwanted, hosts in ((1.0, UNWANTED), (0.0, WANTED))
            for k, host in enumerate(hosts) for start, top, path in (FORMS[k % len(FORMS)], FORMS[(k + 2) % len(FORMS)])]
    rows += [(u, 0.0) for u in BARE]
    stacked = F.explode(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("unwanted")) for u, y in rows]))
    return spark.range(1).select(stacked.alias("r")).select("r.*")


def fit(labelled: DataFrame) -> tuple[list[float], float]:
    """The weight of each bucket and the intercept."""
    found = labelled.select("unwanted", buckets(*host_and_path(F.col("url"))).alias("b"))
    dense = found.select(F.col("unwanted").alias("label"), array_to_vector(F.transform(
        F.sequence(F.lit(0), F.lit(BUCKETS - 1)),
        lambda k: F.when(F.array_contains("b", k), 1 / F.sqrt(F.size("b"))).otherwise(F.lit(0.0)))).alias("features"))
    model = LogisticRegression(regParam=0.0003, maxIter=50, standardization=False).fit(dense)
    return [float(x) for x in model.coefficients.toArray()], float(model.intercept)


def chance(found: Column, weights: list[float], intercept: float) -> Column:
    table = F.array(*map(F.lit, weights))
    total = F.aggregate(found, F.lit(0.0), lambda s, k: s + F.get(table, k))
    scaled = F.when(F.size(found) > 0, total / F.sqrt(F.size(found).cast("double"))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-(scaled + F.lit(intercept))))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # a longer one overrides
        domain, start = text[:text.index("/")], text[text.index("/"):]
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = RULES, limit: float = LIMIT) -> DataFrame:
    """The table with host, path, rule, chance and verdict; columns of those names are replaced."""
    weights, intercept = fit(labelled)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "chance", "verdict", "_llm_parts")]
    host, path = host_and_path(F.col("url"))
    parts = pages.select(*kept, let(F.struct(host.alias("host"), path.alias("path")), lambda p: F.struct(
        p["host"].alias("host"), p["path"].alias("path"),
        chance(buckets(p["host"], p["path"]), weights, intercept).alias("chance"))).alias("_llm_parts"))
    flat = parts.select(*kept, "_llm_parts.*")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    return flat.select(*kept, "host", "path", rule.alias("rule"), "chance",
                       F.coalesce(verdict, F.when(F.col("chance") >= limit, "block").otherwise("allow")).alias("verdict"))


def digest(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's chance for every page."""
    return judge(pages.select("page_id", "url"), labelled_urls(pages.sparkSession)).select(
        "page_id", "host", "path", "rule", "verdict", "chance")
