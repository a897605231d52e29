"""The main text of web pages by tree scoring.

A page becomes a small tree of its elements.  Elements that are never text of the article
(scripts, forms, menus, page headers and footers, side bars, notices, adverts, comments)
are left out by tag, role and whole class names; a name counts for blocks only, and does
not take away more than half of the page's text where no article or main element is beside it.  Every block of text gives points
for its length and commas to the element around it, half of them to the next one up, half of
these to the one above, and so on; an element's points are discounted by the share of its text
that is in links.  The best element is kept with all its siblings, and those of the elements
around it up to the article, of whose text no more than half is in links; where no element
encloses the article, that is up to the page.  All their blocks are the text, in page order.

Work is linear in the length of a page, however deep or broken it is.

Null and empty pages have an empty text.  Unclosed or crossed tags, stray brackets and
unknown entities are read as browsers roughly do.  Rows are independent; an empty table
gives an empty one.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm.words import map_texts

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td
    tfoot th thead tr ul caption""".split())
DROPPED = frozenset("""script style noscript template iframe head nav aside form footer button select option textarea
    svg canvas object dialog menu input""".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar".split())
#: A tag's start closes an open element of these tags first, up to the element that bounds them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
BOUNDS = frozenset("table ul ol dl select body html div article section".split())
# Names in class or id of what is not the article: whole names; the last part of a
# compound like "site-footer"; the first part of one like "share-buttons", whose last part says a container.
UNLIKELY = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies
    consent gdpr notice alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar side-bar
    widget widgets footer masthead header topbar top-bar toolbar comment comments disqus disqus_thread replies share sharing social
    related recommended recommendations newsletter subscribe subscription signup sign-up login search""".split())
LAST = frozenset("""ad ads advert advertisement banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar footer
    masthead topbar toolbar comments popup modal overlay widget header""".split())
FIRST = frozenset("""ad ads advert advertisement sponsor sponsored promo cookie cookies consent gdpr nav navigation menu breadcrumb sidebar footer
    comment comments share sharing social related recommended newsletter subscribe signup login search""".split())
CONTAINER = frozenset("""area banner bar block box button buttons container consent content form group icons inner item items links list
    message module notice panel popup post posts article articles section slot stories thread toolbar unit widget wrap wrapper""".split())
#: What a header belongs to that is part of the article.
OWN_HEADER = frozenset("entry post article section content story title".split())
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|content|post|story|entry|main|body|text)(?:$|[\s_-])", re.I)
#: Elements left out that stand in a line of text.
IN_LINE = frozenset("svg canvas object button select option input".split())
START = {"article": 30.0, "main": 20.0, "section": 5.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0,
         "ul": -3.0, "ol": -3.0, "dl": -3.0, "table": 0.0, "body": 0.0}


class Node:
    __slots__ = ("tag", "up", "points", "chars", "linked", "order", "out")

    def __init__(self, tag: str, up: Node | None, points: float, order: int, out: bool = False):
        self.tag, self.up, self.points, self.order, self.out = tag, up, points, order, out
        self.chars = self.linked = 0


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(source)}


def _unlikely(name: str) -> bool:
    """Whether a whole class or id says that an element is not the article."""
    parts = re.split(r"[-_]+", name)
    if name in UNLIKELY:
        return True
    if len(parts) < 2:
        return False
    if parts[-1] == "header" and OWN_HEADER.intersection(parts[:-1]):
        return False
    return parts[-1] in LAST or parts[0] in FIRST and parts[-1] in CONTAINER


def _hidden(said: dict[str, str]) -> bool:
    return ("hidden" in said or said.get("aria-hidden") == "true" or said.get("role", "").lower() in ROLES
            or "display:none" in said.get("style", "").replace(" ", ""))


def _named(said: dict[str, str]) -> tuple[bool, float]:
    """Whether an element's names say that it is not the article, and the points they give."""
    names = f"{said.get('class', '')} {said.get('id', '')}".lower().split()
    likely = any(LIKELY.search(n) and not _unlikely(n) for n in names)
    return not likely and any(map(_unlikely, names)), 25.0 if likely else 0.0


class _Source:
    """The tags of a page, in time linear in its length."""

    def __init__(self, page: str):
        self.page, self.last, self.broken = page, page.rfind(">"), False

    def _end(self, at: int) -> int:
        """Where the tag ends whose attributes start at ``at``: at the first bracket outside quotes."""
        first = close = self.page.find(">", at)
        while not self.broken:
            quote = min((k for k in (self.page.find(q, at, close) for q in "\"'") if k >= 0), default=-1)
            if quote < 0:
                return close
            at = self.page.find(self.page[quote], quote + 1) + 1
            close = self.page.find(">", at) if at and at <= self.last else -1
            if close < 0:  # quotes do not close before the page ends: from here on they mean nothing
                self.broken = True
        return first

    def tag(self, at: int) -> tuple[int, int, str, str]:
        """(start, end, name, attributes) of the next tag; the name of a comment is empty, a closing one's begins with a slash."""
        page = self.page
        while 0 <= (start := page.find("<", at)) < self.last:
            name = _NAME.match(page, start + 1)
            if name:
                end = self._end(name.end())
                return start, end + 1, name[0].lower(), page[name.end():end]
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), "", ""
            if page[start + 1] in "!?/":
                return start, page.find(">", start) + 1, "", ""
            at = start + 1  # a stray bracket is text
        if (start := page.find("<!--", at)) >= 0:
            return start, len(page), "", ""
        return len(page), len(page), "", ""


def extract(page: str) -> str:
    """The main text of one page."""
    source = _Source(page)
    root = Node("html", None, 0.0, 0)
    nodes, stack = [root], [root]
    open_: Counter[str] = Counter()
    blocks: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    linked = 0
    skipped, depth, links = "", 0, False  # the tag of the element left out, its depth in tags of the same name

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((stack[-1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop(tag: str) -> None:
        """Close the innermost open element of a tag and all within."""
        flush()
        while True:
            gone = stack.pop()
            open_[gone.tag] -= 1
            if gone.tag == tag:
                break

    at = 0
    while at < len(page):
        start, end, tag, said = source.tag(at)
        if start > at and not skipped:
            text = html.unescape(page[at:start])
            parts.append(text)
            if links:
                linked += len(" ".join(text.split()))
        at = end
        closing = tag.startswith("/")
        tag = tag.lstrip("/")
        if not tag:
            continue
        if not closing and tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if skipped:
            if tag == skipped and tag not in VOID and not said.endswith("/"):
                depth += -1 if closing else 1
                if depth == 0:
                    skipped = ""
            elif closing and tag in ("article", "main", "body") and open_[tag]:
                skipped = ""  # an element left out was never closed
                pop(tag)
            continue
        if tag == "a":
            links = not closing
        elif tag == "br":
            parts.append(" ")
        elif tag in IN_LINE or tag not in BLOCK and tag not in DROPPED:
            if not closing and tag not in VOID and not said.endswith("/") and (
                    tag in IN_LINE or said and _hidden(_attributes(said))):
                skipped, depth = tag, 1
        elif closing:
            if open_[tag]:
                pop(tag)
            else:
                flush()
            links = False
        elif tag == "hr" or tag in VOID:
            flush()
        else:
            flush()
            if open_["p"] or any(open_[t] for t in CLOSES.get(tag, ())):
                for k in range(len(stack) - 1, 0, -1):  # what this start closes
                    if stack[k].tag == "p" or stack[k].tag in CLOSES.get(tag, ()):
                        pop(stack[k].tag)
                    elif stack[k].tag in BOUNDS:
                        break
            known = _attributes(said) if said and tag not in ("html", "body") else {}
            if tag in DROPPED or tag == "header" and not (open_["article"] or open_["main"]) or known and _hidden(known):
                skipped, depth = tag, 1
                continue
            if tag in ("html", "body"):
                continue
            out, points = _named(known) if known else (False, 0.0)
            node = Node(tag, stack[-1], points + START.get(tag, 0.0), len(nodes), out and tag not in ("article", "main"))
            nodes.append(node)
            stack.append(node)
            open_[tag] += 1
    flush()
    return "\n\n".join(_chosen(nodes, blocks))


def _sum_up(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    """Give every element the characters within it; elements come after those around them."""
    for node in nodes:
        node.chars = node.linked = 0
    for owner, text, linked in blocks:
        owner.chars += len(text)
        owner.linked += linked
    for node in reversed(nodes[1:]):
        node.up.chars += node.chars
        node.up.linked += node.linked


def _chosen(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> list[str]:
    """The blocks of the best element and of all beside it that is not mostly links."""
    _sum_up(nodes, blocks)
    total, named = nodes[0].chars, [node.tag in ("article", "main") for node in nodes]
    for node in reversed(nodes[1:]):
        named[node.up.order] += named[node.order]
    for node in nodes[1:]:  # a name does not take away most of the page's text, if no article is beside it
        node.out = node.up.out or node.out and (2 * node.chars <= total or named[0] > named[node.order])
    blocks = [b for b in blocks if not b[0].out]
    if not blocks:
        return []
    _sum_up(nodes, blocks)
    gained = [0.0] * len(nodes)
    touched = set()
    for owner, text, _ in blocks:
        points = 1.0 + text.count(",") + text.count("،") + text.count("、") + min(len(text) / 100, 3.0) if len(text) >= 25 else 0.2
        up = owner.up if owner.up is not None and owner.tag not in ("div", "article", "main", "section", "td") else owner
        gained[up.order] += points
        touched.add(up.order)
    for node in reversed(nodes[1:]):
        gained[node.up.order] += gained[node.order] / 2
        if node.order in touched:
            touched.add(node.up.order)
    scored = {k: (nodes[k].points + gained[k]) * (1 - nodes[k].linked / max(1, nodes[k].chars)) for k in touched}
    best = nodes[max(scored, key=lambda k: (scored[k], -k))]
    beside: dict[int, list[Node]] = {}
    for node in nodes[1:]:
        beside.setdefault(node.up.order, []).append(node)
    kept, around, top = {best.order}, set(), best
    while top.up is not None:
        around.add(top.up.order)  # text that stands in it by itself is as good as an element
        kept.update(n.order for n in beside[top.up.order] if n is not top and 2 * n.linked <= n.chars)
        if top.tag in ("article", "main"):
            break
        top = top.up
    inside: list[bool] = []
    for node in nodes:
        inside.append(node.order in kept or node.up is not None and inside[node.up.order])
    return [text for owner, text, linked in blocks if inside[owner.order] or owner.order in around and 2 * linked <= len(text)]


def main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """The table's other columns with ``_llm_main``, the main text."""
    return map_texts(pages, lambda raw: (extract(raw.decode("utf-8", "replace")),), "_llm_main string", column)


def digest(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    return main_text(pages.select("page_id", "url", "html")).select(
        "page_id", "url", F.col("_llm_main").alias("text"), F.length("_llm_main").cast("long").alias("n_chars"))
