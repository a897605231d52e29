"""URL rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_BASE = "https://shop.example"

# Where a product number stands in a URL, in order of preference.
PRODUCT_ID_FORMS = (
    r"/product/(\d+)", r"/p/(\d+)", r"product-(\d+)", r"id=(\d+)", r"/(\d+)/?$",
)

# Parts of links that lead to neither products nor categories.
SITE_PARTS = (
    "/account/", "/login", "/register", "/cart", "/wishlist",
    "/faq", "/contact", "/about", "/terms", "/privacy",
    "/cdn-cgi/", "mailto:", "tel:", "#", "/outlet",
    "/gift-cards", "/cfare-ka-te-re",
)
# Parts of links that lead to lists of products.
LISTING_PARTS = (
    "/search", "/categories", "/brands", "/offers", "/sale", "/new-arrivals",
)
# Words of which a product link holds at least one.
PRODUCT_WORDS = (
    "laptop", "kompjuter", "telefon", "tv", "monitor",
    "kufje", "tablet", "kamera", "audio", "gaming",
)
# Signs of a specification in a product link.
SPEC_FORMS = (
    r"\b\d+gb\b", r"\b\d+tb\b", r"\bi\d+\b", r"\brtx\d+\b", r"\bgtx\d+\b",
    r"\b\d+inch\b", r'\b\d+"?\b', r"\b\d+hz\b", r"\b\d+mp\b",
    r"\bwindows\b", r"\bmac\b", r"\bpro\b", r"\bmax\b", r"\bmini\b",
    r"\bcore\b", r"\bamd\b", r"\bintel\b", r"\bnvidia\b",
)

_SCHEMES = "https?|ftps?|sftp|ssh|git|irc|rtmps?|rtsp|telnet"
_HOST = r"(?:(?:[a-z0-9](?:[a-z0-9_-]*[a-z0-9])?\.)+[a-z][a-z0-9-]*[a-z0-9]|\d{1,3}(?:\.\d{1,3}){3})"
_URL = rf"(?i)^(?:{_SCHEMES})://(?:[^\s/@]+@)?{_HOST}(?::\d{{1,5}})?(?:[/?#]\S*)?$"


def _strip_end(base: Column) -> Column:
    return F.regexp_replace(base, r"/+$", "")


def normalize_url(url: Column, base: Column | str = DEFAULT_BASE) -> Column:
    """Absolute form of a link; '' for a missing one."""
    base = _strip_end(F.lit(base) if isinstance(base, str) else base)
    return (
        F.when(url.isNull() | (url == ""), F.lit(""))
        .when(url.startswith("//"), F.concat(F.lit("https:"), url))
        .when(url.startswith("/"), F.concat(base, url))
        .when(url.startswith("http://") | url.startswith("https://"), url)
        .otherwise(F.concat(base, F.lit("/"), url))
    )


def is_valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike(_URL), F.lit(False))


def clean_image_urls(urls: Column, base: Column | str = DEFAULT_BASE) -> Column:
    """Absolute, valid, distinct image links in their first order."""
    absolute = F.transform(F.coalesce(urls, F.array().cast("array<string>")),
                           lambda u: normalize_url(u, base))
    return F.array_distinct(F.filter(absolute, is_valid_url))


def product_id_from_url(url: Column) -> Column:
    return F.coalesce(*[
        F.nullif(F.regexp_extract(url, form, 1), F.lit("")) for form in PRODUCT_ID_FORMS
    ])


def _has_any(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def _is_site_path(href: Column) -> Column:
    return href.startswith("/") & ~href.startswith("//")


def is_category_link(href: Column) -> Column:
    hit = _is_site_path(href) & ~_has_any(F.lower(href), SITE_PARTS)
    return F.coalesce(hit, F.lit(False))


def spec_score(href: Column) -> Column:
    """How many specification forms occur in the link."""
    low = F.lower(href)
    return reduce(lambda a, b: a + b, [low.rlike(form).cast("int") for form in SPEC_FORMS])


def is_product_link(href: Column) -> Column:
    low = F.lower(href)
    segments = F.split(F.regexp_replace(href, r"^/+|/+$", ""), "/")
    descriptive = (F.size(segments) > 2) | F.exists(segments, lambda s: F.length(s) > 20)
    score = spec_score(href)
    hyphens = F.length(href) - F.length(F.replace(href, F.lit("-"), F.lit("")))
    convincing = (
        (score >= 2)
        | ((F.length(href) > 50) & (hyphens > 5))
        | ((score >= 1) & (F.length(href) > 30))
    )
    hit = (
        _is_site_path(href)
        & ~_has_any(low, SITE_PARTS + LISTING_PARTS)
        & (F.length(href) >= 15)
        & _has_any(low, PRODUCT_WORDS)
        & descriptive
        & (hyphens > 0)
        & convincing
    )
    return F.coalesce(hit, F.lit(False))
