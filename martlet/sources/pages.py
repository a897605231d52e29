"""Product pages to product rows.

Python only walks the HTML and returns the texts under named selectors; which
text counts and what it means is decided by column expressions.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.functions import amounts, brands, specs, text
from martlet.functions.urls import DEFAULT_BASE
from martlet.operators.validate import validate_products
from martlet.session import spread_out

# Where a product page keeps each field, in order of preference.
SELECTORS = {
    "title": ("h1.product-title", ".product-name h1", "[data-testid='product-title']",
              ".product-header h1", "h1"),
    "sale_price": (".prices .text-green-600", ".prices [class*='green']", ".current-price", ".sale-price"),
    "price_box": (".product-price", ".prices"),
    "price": (".product-price", ".prices", "[class*='price-value']", ".current-price",
              ".price-current", ".price-now", ".price"),
    "struck_price": (".line-through", ".non-discounted-price", "[class*='line-through']",
                     ".old-price", ".was-price"),
    "original_price": (".non-discounted-price", ".line-through", "[class*='price-value']",
                       ".price-original", ".old-price", ".price-before", ".original-price"),
    "description": (".product-description", ".product-details",
                    "[data-testid='product-description']", ".description", ".product-info"),
    "availability": (".stock-status", ".availability", "[data-testid='stock-status']",
                     ".in-stock", ".stock-info"),
    "brand": (".product-brand", ".brand-name", "[data-testid='brand']", ".manufacturer"),
    "heading": ("h1", ".product-title", ".product-name"),
    "category": (".breadcrumb", ".category-path", ".product-category", "[data-testid='breadcrumb']"),
    "specifications": ("[class*='spec']", ".product-details", ".details", ".specifications table",
                       ".product-specs", ".spec-table", ".attributes", ".product-attributes"),
}
# Fields of which every match is looked at.
ALL_MATCHES = {
    "rating": (".ratingsAndReviews", "[class*='rating']", "[class*='star']"),
    "reviews_count": (".product-reviews-overview", ".product-no-reviews", ".ratingsAndReviews",
                      "[class*='review']"),
    "images": (".product-details img", ".details img", ".product-gallery img", ".product-images img",
               "[data-testid='product-image']", ".gallery img", ".product-photo img", "img[alt='']"),
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_STEP = re.compile(r"([a-z0-9]+)?((?:\.[\w-]+)*)((?:\[[^\]]+\])*)$", re.I)
_TEST = re.compile(r"\[([\w-]+)(\*?)='?([^'\]]*)'?\]")


class _Node:
    __slots__ = ("tag", "attrs", "classes", "parent", "parts")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []
        self.classes = (attrs.get("class") or "").split()

    def pieces(self):
        """Text pieces in document order, without recursion."""
        stack, out = [iter(self.parts)], []
        while stack:
            part = next(stack[-1], None)
            if part is None:
                stack.pop()
            elif isinstance(part, str):
                out.append(part)
            else:
                stack.append(iter(part.parts))
        return out

    def below(self, *tags):
        stack, out = list(reversed(self.parts)), []
        while stack:
            part = stack.pop()
            if not isinstance(part, str):
                if not tags or part.tag in tags:
                    out.append(part)
                stack.extend(reversed(part.parts))
        return out


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, dict(attrs), self.open)
        self.open.parts.append(node)
        if tag not in _VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.open.parts.append(_Node(tag, dict(attrs), self.open))

    def handle_endtag(self, tag):
        node = self.open
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.open = node.parent

    def handle_data(self, data):
        if self.open.tag not in ("script", "style"):
            self.open.parts.append(data)


def _steps(selector):
    """(tag, classes, tests) of each step of a selector."""
    out = []
    for step in selector.split():
        tag, classes, tests = _STEP.match(step).groups()
        out.append((tag, classes.split(".")[1:], _TEST.findall(tests)))
    return out


_PARSED = {s: _steps(s) for group in (SELECTORS, ALL_MATCHES) for some in group.values() for s in some}


def _fits(node, step):
    tag, classes, tests = step
    if tag and node.tag != tag:
        return False
    if classes and not all(c in node.classes for c in classes):
        return False
    for name, part, wanted in tests:
        have = node.attrs.get(name)
        if have is None or (wanted not in have if part else have != wanted):
            return False
    return True


def _select(nodes, selector):
    *outer, last = _PARSED[selector]
    for node in nodes:
        if _fits(node, last):
            up, need = node.parent, list(outer)
            while need and up is not None:
                if _fits(up, need[-1]):
                    need.pop()
                up = up.parent
            if not need:
                yield node


def _stripped(node):
    return "".join(p.strip() for p in node.pieces())


def _spec_pairs(node):
    def said(n):
        return "".join(n.pieces())
    rows = [[c for c in row.below("td", "th")] for row in node.below("tr")]
    pairs = [(said(r[0]), said(r[1])) for r in rows if len(r) >= 2]
    if not pairs:
        pairs = [(said(a), said(b)) for a, b in zip(node.below("dt"), node.below("dd"))]
    if not pairs:
        pairs = [tuple(said(i).split(":", 1)) for i in node.below("div", "li") if ":" in said(i)]
    return [f"{k}\x00{v}" for k, v in pairs]


def _fields(html):
    tree = _Tree()
    tree.feed(html or "")
    nodes = tree.root.below()
    out = {}
    for name, selectors in SELECTORS.items():
        firsts = [next(_select(nodes, s), None) for s in selectors]
        if name == "category":
            hit = next((n for n in firsts if n is not None), None)
            links = hit.below("a") if hit is not None else []
            out[name] = ["".join(n.pieces()) for n in links] or ([] if hit is None else ["".join(hit.pieces())])
        elif name == "specifications":
            hit = next((n for n in firsts if n is not None), None)
            out[name] = [] if hit is None else _spec_pairs(hit)
        else:
            out[name] = [_stripped(n) for n in firsts if n is not None]
    for name, selectors in ALL_MATCHES.items():
        hits = [n for s in selectors for n in _select(nodes, s)]
        if name == "images":
            links = [n.attrs.get("src") or n.attrs.get("data-src") or n.attrs.get("data-lazy-src") for n in hits]
            out[name] = [u for u in links if u]
        else:
            out[name] = [_stripped(n) for n in hits]
    return out


NAMES = (*SELECTORS, *ALL_MATCHES)


def page_texts(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and, per field, the list of texts found in the page."""
    kept = [pages.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
                       + [f"f_{n} array<string>" for n in NAMES])

    def parse(batches):
        for batch in batches:
            fields = [_fields(h) for h in batch["html"]]
            found = pd.DataFrame({f"f_{n}": [f[n] for f in fields] for n in NAMES}, index=batch.index)
            yield pd.concat([batch[keep], found], axis=1)

    needed = pages.select(*dict.fromkeys([*keep, "html"]))
    return spread_out(needed, *needed.columns).mapInPandas(parse, schema)


def _first_text(c: Column) -> Column:
    """First text that is not blank, cleaned."""
    return F.coalesce(F.get(F.filter(F.transform(c, text.clean_text), lambda s: s != ""), F.lit(0)), F.lit(""))


def _first_of(texts: Column, rule) -> Column:
    return F.get(F.filter(F.transform(texts, rule), lambda s: s.isNotNull()), F.lit(0))


def extract_fields(pages: DataFrame, keep: list[str] = ("url",)) -> DataFrame:
    """Raw product rows, amounts still text, as ``validate_products`` takes them."""
    p = page_texts(pages, list(keep))
    f = {n: F.col(f"f_{n}") for n in NAMES}
    price = F.coalesce(_first_of(f["sale_price"], amounts.first_amount_text),
                       _first_of(f["price_box"], amounts.current_price_text), _first_text(f["price"]))
    original = F.coalesce(_first_of(f["struck_price"], amounts.first_amount_text),
                          _first_of(f["price_box"], amounts.original_price_text),
                          _first_text(f["original_price"]))
    rating = F.coalesce(_first_of(f["rating"], amounts.rating_in_text).cast("string"), F.lit(""))
    reviews = F.coalesce(_first_of(f["reviews_count"], amounts.review_count_in_text).cast("string"), F.lit(""))
    brand = brands.brand_of(_first_text(f["brand"]), F.coalesce(F.get(f["heading"], F.lit(0)), F.lit("")))
    category = F.array_join(F.transform(f["category"], text.clean_text), " > ")
    pairs = F.transform(f["specifications"], lambda s: F.struct(
        text.clean_text(F.get(F.split(s, "\x00"), F.lit(0))).alias("key"),
        text.clean_text(F.get(F.split(s, "\x00"), F.lit(1))).alias("value")))
    return p.select(
        *keep, _first_text(f["title"]).alias("title"), price.alias("price"), original.alias("original_price"),
        _first_text(f["description"]).alias("description"), f["images"].alias("images"),
        specs.last_wins(pairs).alias("specifications"), brand.alias("brand"), category.alias("category"),
        _first_text(f["availability"]).alias("availability"), rating.alias("rating"),
        reviews.alias("reviews_count"))


def extract_products(pages: DataFrame, base_url: str = DEFAULT_BASE, as_of: Column | None = None) -> DataFrame:
    """Validated products of a ``pages(url, html)`` table."""
    return validate_products(extract_fields(pages), base_url, as_of)
