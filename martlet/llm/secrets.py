"""Secrets in texts: three fixed forms, and values whose guessing cost is high.

The method: where a text speaks of a credential ("password is ...", "Bearer ...",
"user:...@host"), the value after it is cut into words, dates, repeats, keyboard walks
and brute-force spans so that the product of the guesses of the pieces is least
(dynamic programming over the value's positions).  A value that costs at least
``MIN_LOG10`` decimal digits of guesses is a secret; "changeme" or "qwerty123" is a
placeholder and stays.  One exception: after "is" or "was" a word of letters only, at most
its first a capital, counts as prose whatever it costs.  Values are taken whole at any
length; where a fixed form covers only the front of a value, the whole value is costed, too.

Nulls and empty texts have no spans.  Texts are read whole; rows are independent, so
repeated rows give repeated results and an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm.words import map_texts

# The forms that must be found as they stand.
ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, as [0-9a-f]+ finds them, of 32 and more
KINDS = ("assign", "access", "hex", "guess")

_NAME = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[\s_-]?key|access[\s_-]?key|auth(?:orization)?)(?![A-Za-z0-9])"
#: Places where a credential's value follows; each is sought by itself, so that none hides another's value.
#: A name may stand among others joined by "_", and a scheme may stand before the value.
CONTEXTS = tuple(re.compile(x) for x in (
    rf"""(?iax)(?<![A-Za-z0-9]){_NAME}(?:_(?!{_NAME})[a-z0-9]+)*+
      ["']?\s{{0,4}}(?:\b(?P<verb>is|was)\b|[:=]>?)\s{{0,4}}["'`]?(?:(?:bearer|basic|token)\s+(?=[^\s"'`<>,;]{{6}}))?
      (?P<value>[^\s"'`<>,;]{{6}})""",
    r"(?ia)\bbearer\s+(?P<value>[A-Za-z0-9._~+/=-]{6})",
    r"(?ia)://[^\s:/@]+:(?P<value>[^\s@/]{6,})@",
    r"(?ia)\b(?P<value>(?:gh[pousr]_|xox[abprs]-|sk-|glpat-)[A-Za-z0-9_-]{12,})"))
#: How far a value of the first two reaches; the other two are matched whole.
_RUNS = (re.compile(r"[^\s\"'`<>,;]+"), re.compile(r"[A-Za-z0-9._~+/=-]+"), None, None)
#: One of these, lower-cased, stands in every text that CONTEXTS or ASSIGN match.
CLUES = (b"pass", b"pwd", b"secret", b"token", b"credential", b"key", b"auth", b"bearer", b"://",
         b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"xox", b"sk-", b"glpat-")
#: Decimal digits of guesses from which a value counts as a secret.
MIN_LOG10 = 9.0

#: Words that guessing programs try early, most used first; the rank is the cost.
COMMON = (
    "password pass admin root user test login welcome letmein monkey dragon master secret token key api "
    "changeme default example sample demo guest qwerty love hello world sunshine princess football "
    "baseball shadow superman batman trustno iloveyou access server service system public private "
    "database db dev prod local host google github your my the here placeholder insert replace value "
    "none null true false string undefined empty hidden redacted xxx foo bar baz apple orange summer "
    "winter spring autumn monday friday january december company office home computer internet "
).split()
RANKS = {w: k + 1 for k, w in enumerate(COMMON)}
LONGEST = max(map(len, COMMON))
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
NEXT = {a + b for row in ROWS for a, b in zip(row, row[1:])} | {b + a for row in ROWS for a, b in zip(row, row[1:])}
LEET = str.maketrans("013457@$!", "oleastasi")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")


def _alphabet(c: str) -> float:
    """Log10 of the number of characters like this one that a guesser would try."""
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


def _pieces(value: str):
    """(start, end, log10 of guesses) of every word, date, repeat and keyboard walk."""
    low, n = value.lower(), len(value)
    for plain, extra in ((low, 0.0), (low.translate(LEET), math.log10(4))):
        if extra and plain == low:
            continue
        for i in range(n):
            for j in range(i + 3, min(n, i + LONGEST) + 1):
                if rank := RANKS.get(plain[i:j]):
                    case = 0.0 if value[i:j] == low[i:j] else math.log10(2) if value[i:j].istitle() or value[i:j].isupper() else j - i
                    yield i, j, math.log10(rank + 1) + extra + case
    same = {size: [0] * (n + 1) for size in (1, 2, 3, 4)}  # characters from here on that return after size
    walk = [0] * (n + 1)  # steps from here on to a neighbour on the keyboard
    for i in range(n - 1, -1, -1):
        for size, run in same.items():
            run[i] = run[i + 1] + 1 if i + size < n and value[i] == value[i + size] else 0
        walk[i] = walk[i + 1] + 1 if low[i:i + 2] in NEXT else 0
    for i in range(n):
        for m in (DATE.match(value, i),):
            if m:
                yield i, m.end(), math.log10(365 * 120)
        for size in (1, 2, 3, 4):
            j = i + size + same[size][i] // size * size
            if (j - i) // size >= 3 or size > 1 and j - i >= 2 * size and size > 2:
                yield i, j, sum(map(_alphabet, value[i:i + size])) + math.log10((j - i) / size)
        j = i + 1 + walk[i]
        if j - i >= 3:
            yield i, j, math.log10(50) + math.log10(j - i)


def guess_cost(value: str) -> float:
    """Log10 of the guesses of the cheapest way to cut ``value`` into pieces.

    The best cut before position j is the least, over all pieces that end in j, of the
    best cut before the piece plus the piece; a brute-force piece is one character and
    may follow any other.  Each further piece costs one digit for its place in the order.
    """
    return _short_cost(value) if len(value) <= 512 else _cost(value)


def _cost(value: str) -> float:
    n = len(value)
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, cost in _pieces(value):
        ending[j].append((i, cost))
    closed, brute = [0.0] * (n + 1), [math.inf] * (n + 1)  # best cut; best one that ends in a brute-force span
    for j in range(1, n + 1):
        step = _alphabet(value[j - 1])
        brute[j] = min(brute[j - 1], closed[j - 1] + (0.3 if j > 1 else 0.0)) + step
        closed[j] = min([brute[j], *(closed[i] + cost + (0.3 if i else 0.0) for i, cost in ending[j])])
    return closed[n]


_short_cost = lru_cache(maxsize=4096)(_cost)  # long values are not kept


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets of a text, by start, then kind as listed."""
    low = text.encode("utf-8", "replace").lower()
    clued = any(c in low for c in CLUES)
    spans = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if clued else []
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if clued:
        spans += _guessed(text, spans)
    return [(a, b, KINDS[k]) for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1]))]


def _values(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether prose may stand there) of the values that contexts announce, whole at any length."""
    for context, run in zip(CONTEXTS, _RUNS):
        at = reach = 0
        while m := context.search(text, at):
            start, end = m.span("value")
            at = start if run else end  # a value may be the name in front of another one
            if start < reach:
                continue  # the end of a value already given
            if run:
                end = run.match(text, start).end()
            reach = end
            end = start + len(text[start:end].rstrip(".!?)]}:"))
            if end - start >= 6:
                yield start, end, bool(m.groupdict().get("verb"))


def _guessed(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of costly values that reach beyond the base spans; of values in one another the widest."""
    out: list[tuple[int, int, int]] = []
    reach = 0
    base = sorted(base)
    known = covered = 0  # base spans begun so far, and how far they reach
    for start, end, prose in sorted(set(_values(text)), key=lambda v: (v[0], -v[1], v[2])):
        while known < len(base) and base[known][0] <= start:
            covered = max(covered, base[known][1])
            known += 1
        if end <= max(reach, covered) or prose and not _mixed(text[start:end]):
            continue
        if guess_cost(text[start:end]) >= MIN_LOG10:
            out.append((start, end, 3))
            reach = end
    return out


def _mixed(value: str) -> bool:
    """Ordinary prose after "is" or "was" is letters only, at most one capital in front."""
    return not re.fullmatch(r"[^\W\d_][^\W\d_A-Z]*[-'’]?[^\W\d_A-Z]*", value)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every secret replaced by ``mark``; overlapping spans become one."""
    out, at, reach = [], 0, 0
    for start, end, _ in find(text):
        if end <= reach:
            continue
        if start >= reach:
            out += [text[at:start], mark]
        at = reach = end
    return "".join([*out, text[at:]])


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The table's other columns with ``spans``: array of (kind, start, end, guesses).

    ``guesses`` is the log10 of the guessing cost of the span, null where it is longer
    than the 512 characters within which the pieces are sought (such a span is a key).
    """
    def one(raw: bytes):
        said = raw.decode("utf-8", "replace")
        return ([{"kind": k, "start": a, "end": b, "guesses": guess_cost(said[a:b]) if b - a <= 512 else None}
                 for a, b, k in find(said)],)

    return map_texts(docs, one, "spans array<struct<kind:string,start:bigint,end:bigint,guesses:double>>", text)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id with the counts and span strings of the stated result."""
    found = scan(docs.select("doc_id", "text"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(said(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        said("spans").alias("spans"))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents with their secrets replaced and ``n_chars`` counted anew; no row goes.

    Texts without a secret, null ones too, stay as they are.  Columns keep their order.
    """
    fields = docs.columns
    plain = docs.withColumnRenamed("text", "_llm_text").withColumn("text", F.col("_llm_text"))

    def one(raw: bytes):
        said = raw.decode("utf-8", "replace")
        cleaned = redact(said)
        return (None if cleaned == said else cleaned,)

    done = map_texts(plain, one, "_llm_clean string")
    changed = F.col("_llm_clean").isNotNull()
    out = {"text": F.coalesce("_llm_clean", "_llm_text")}
    if "n_chars" in fields:
        out["n_chars"] = F.when(changed, F.length("_llm_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.select(*[out.get(c, F.col(c)).alias(c) for c in fields])
