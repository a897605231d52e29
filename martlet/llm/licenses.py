"""License statements by ordered signature rules.

A text is searched only if it holds one of a few keywords, and of the rules only those
whose own keyword it holds are tried.  Rules are tried by priority; a detection that lies
within one of equal or higher priority is suppressed, so "Apache License, Version 2.0"
does not also count as an unversioned Apache license.  The signatures are made from
license names and statement forms.

Besides, the stated base phrases are found word by word, wherever they stand.

Null and empty texts have no words and labels.  Rows are independent; repeated rows give
repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm.words import map_texts

# The base phrases and their labels.
PHRASES = ((("cc", "by"), "cc-by"), (("general", "public", "license"), "gpl"), (("all", "rights", "reserved"), "reserved"))
#: One word of each phrase without which it cannot stand in the text.
CLUES = (b"cc", b"general", b"reserved")

#: label, keyword (one word, as white space varies), pattern of the name (in lower case, white space as \s+).
NAMES = (
    ("mit", "mit", r"mit(?:/x11)?"), ("mit", "expat", r"expat(?:/x11)?"), ("mit-0", "mit", r"mit[\s-]+(?:0|no\s+attribution)"),
    ("x11", "x11", r"x11"), ("isc", "isc", r"isc"), ("0bsd", "bsd", r"(?:0bsd|zero[\s-]+clause\s+bsd)"),
    ("bsd-2-clause", "bsd", r"(?:bsd[\s-]+2[\s-]+clause|2[\s-]+clause\s+bsd|simplified\s+bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd[\s-]+3[\s-]+clause|3[\s-]+clause\s+bsd|(?:new|modified|revised)\s+bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd[\s-]+4[\s-]+clause|4[\s-]+clause\s+bsd|original\s+bsd)"), ("bsd", "bsd", r"bsd"),
    ("apache-1.1", "apache", r"apache(?:\s+software)?(?:\s+license)?[,\s-]*(?:version|v)?[\s-]*1\.1"),
    ("apache-2.0", "apache", r"apache(?:\s+software)?(?:\s+license)?[,\s-]*(?:version|v)?[\s-]*2(?:\.0)?"),
    ("apache", "apache", r"apache(?:\s+software)?"),
    ("agpl-3.0", "affero", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e[,\s-]*(?:version|v)?[\s-]*3(?:\.0)?"),
    ("agpl", "affero", r"(?:gnu\s+)?affero\s+general\s+public"),
    ("lgpl-2.1", "lesser", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[sc]e[,\s-]*(?:version|v)?[\s-]*2\.1"),
    ("lgpl-3.0", "lesser", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[sc]e[,\s-]*(?:version|v)?[\s-]*3(?:\.0)?"),
    ("lgpl", "general", r"(?:gnu\s+)?(?:lesser|library)\s+general\s+public"),
    ("gpl-2.0", "general", r"(?:gnu\s+)?general\s+public\s+licen[sc]e[,\s-]*(?:version|v)?[\s-]*2(?:\.0)?"),
    ("gpl-3.0", "general", r"(?:gnu\s+)?general\s+public\s+licen[sc]e[,\s-]*(?:version|v)?[\s-]*3(?:\.0)?"),
    ("gpl", "general", r"(?:gnu\s+)?general\s+public"),
    ("agpl", "agpl", r"(?:gnu\s+)?agpl[\s-]*v?(?:3(?:\.0)?)?\+?"), ("lgpl", "lgpl", r"(?:gnu\s+)?lgpl[\s-]*v?(?:2\.1|3(?:\.0)?)?\+?"),
    ("gpl-2.0", "gpl", r"(?:gnu\s+)?gpl[\s-]*v?2(?:\.0)?\+?"), ("gpl-3.0", "gpl", r"(?:gnu\s+)?gpl[\s-]*v?3(?:\.0)?\+?"),
    ("gpl", "gpl", r"(?:gnu\s+)?gpl"), ("gfdl", "documentation", r"(?:gnu\s+)?free\s+documentation"),
    ("mpl-2.0", "mozilla", r"mozilla\s+public\s+licen[sc]e[,\s-]*(?:version|v)?[\s-]*2(?:\.0)?"), ("mpl", "mozilla", r"mozilla\s+public"),
    ("mpl-2.0", "mpl", r"mpl[\s-]*v?2(?:\.0)?"), ("epl-2.0", "eclipse", r"eclipse\s+public\s+licen[sc]e[,\s-]*(?:version|v)?[\s-]*2(?:\.0)?"),
    ("epl-1.0", "eclipse", r"eclipse\s+public\s+licen[sc]e[,\s-]*(?:version|v)?[\s-]*1(?:\.0)?"), ("epl", "eclipse", r"eclipse\s+public"),
    ("cddl", "development", r"common\s+development\s+and\s+distribution"), ("eupl", "european", r"european\s+union\s+public"),
    ("cc-by-nc-sa", "cc", r"cc[\s-]+by-nc-sa(?:\s*[1-4]\.0)?"), ("cc-by-nc-nd", "cc", r"cc[\s-]+by-nc-nd(?:\s*[1-4]\.0)?"),
    ("cc-by-nc", "cc", r"cc[\s-]+by-nc(?:\s*[1-4]\.0)?"), ("cc-by-nd", "cc", r"cc[\s-]+by-nd(?:\s*[1-4]\.0)?"),
    ("cc-by-sa", "cc", r"cc[\s-]+by-sa(?:\s*[1-4]\.0)?"), ("cc-by", "cc", r"cc[\s-]+by(?!-)(?:\s*[1-4]\.0)?"),
    ("cc0", "cc0", r"cc0(?:[\s-]*1\.0)?"), ("cc0", "zero", r"creative\s+commons\s+zero"),
    ("cc-by-nc-sa", "creative", r"creative\s+commons\s+attribution[\s-]+non-?commercial[\s-]+share-?\s*alike"),
    ("cc-by-nc-nd", "creative", r"creative\s+commons\s+attribution[\s-]+non-?commercial[\s-]+no-?\s*deriv\w*"),
    ("cc-by-nc", "creative", r"creative\s+commons\s+attribution[\s-]+non-?commercial"),
    ("cc-by-sa", "creative", r"creative\s+commons\s+attribution[\s-]+share-?\s*alike"),
    ("cc-by-nd", "creative", r"creative\s+commons\s+attribution[\s-]+no-?\s*deriv\w*"),
    ("cc-by", "creative", r"creative\s+commons\s+attribution"), ("cc", "creative", r"creative\s+commons"),
    ("unlicense", "unlicense", r"unlicense"), ("wtfpl", "wtfpl", r"wtfpl"), ("zlib", "zlib", r"zlib(?:/libpng)?"),
    ("boost-1.0", "boost", r"boost\s+software(?:\s+license)?[,\s-]*(?:version|v)?[\s-]*1\.0"), ("boost-1.0", "bsl", r"bsl[\s-]*1\.0"),
    ("artistic-2.0", "artistic", r"artistic\s+licen[sc]e[,\s-]*(?:version|v)?[\s-]*2(?:\.0)?"), ("artistic", "artistic", r"artistic"),
    ("python", "python", r"python\s+software\s+foundation"), ("postgresql", "postgresql", r"postgresql"),
    ("ofl-1.1", "font", r"(?:sil\s+)?open\s+font"), ("odbl", "database", r"open\s+(?:data\s+commons\s+)?(?:open\s+)?database"),
)
#: priority, confidence, form around a name; %s is the name.
FORMS = (
    (1, 1.0, r"spdx-licen[sc]e-identifier:\s*%s"),
    (2, 0.95, r"(?:licen[sc]ed|released|distributed|published|available|provided)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?%s(?:\s+licen[sc]e)?"),
    (3, 0.9, r"(?:under|subject\s+to|governed\s+by)\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?%s\s+licen[sc]e"),
    (4, 0.7, r"(?:the\s+)?%s\s+licen[sc]e"),
)
ENDING = r"\s+licen[sc]e"
#: Statements that carry no license name: priority, confidence, label, keyword, pattern.
STATEMENTS = (
    (2, 0.95, "mit", "hereby", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining"),
    (2, 0.95, "isc", "permission", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software"),
    (2, 0.9, "bsd", "redistribution", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms"),
    (2, 0.95, "cc-by", "creativecommons.org", r"creativecommons\.org/licenses/by/[\d.]+"),
    (2, 0.95, "cc-by-sa", "creativecommons.org", r"creativecommons\.org/licenses/by-sa/[\d.]+"),
    (2, 0.95, "cc-by-nc", "creativecommons.org", r"creativecommons\.org/licenses/by-nc/[\d.]+"),
    (2, 0.95, "cc0", "creativecommons.org", r"creativecommons\.org/publicdomain/zero"),
    (3, 0.9, "public-domain", "domain", r"(?:in|into|to|dedicated\s+to)\s+the\s+public\s+domain"),
    (4, 0.8, "cc-by-nc-sa", "cc", r"\bcc[\s-]+by-nc-sa\s+[1-4]\.0"), (4, 0.8, "cc-by-nc", "cc", r"\bcc[\s-]+by-nc\s+[1-4]\.0"),
    (4, 0.8, "cc-by-sa", "cc", r"\bcc[\s-]+by-sa\s+[1-4]\.0"), (4, 0.8, "cc-by", "cc", r"\bcc[\s-]+by\s+[1-4]\.0"),
    (4, 0.8, "reserved", "rights", r"\ball\s+rights\s+reserved"), (4, 0.6, "proprietary", "confidential", r"\bproprietary\s+and\s+confidential"),
    (5, 0.5, "copyright", "copyright", r"\bcopyright\s+(?:\(c\)|©)?\s*(?:19|20)\d\d"), (5, 0.5, "copyright", "©", r"©\s*(?:19|20)\d\d"),
)


class Rule(NamedTuple):
    priority: int
    confidence: float
    label: str
    keyword: str
    pattern: re.Pattern


def _rules() -> Iterator[Rule]:
    for priority, confidence, form in FORMS:
        for label, keyword, name in NAMES:
            # a name's own word edges keep "mit" out of "limit"; one that says license itself needs no second one
            said = form.removesuffix(ENDING) + f"(?:{ENDING})?" if "licen" in name and form.endswith(ENDING) else form
            yield Rule(priority, confidence, label, keyword, re.compile(r"\b" + said % rf"(?<!\w){name}(?!\w)"))
    for priority, confidence, label, keyword, pattern in STATEMENTS:
        yield Rule(priority, confidence, label, keyword, re.compile(pattern))


RULES = sorted(_rules(), key=lambda r: r.priority)
#: A text with none of these, and none of the places below, has no license statement.
GATE = (b"licen", b"spdx", b"copyright", "©".encode(), b"rights", b"creativecommons", b"proprietary", b"permission", b"redistribution")
#: A word, and the place it must stand in; white space is as in the rules.
PLACES = ((b"domain", re.compile(r"public\s+domain")), (b"under", re.compile(r"(?:released|distributed|published|available|provided)\s+under")),
          (b"cc", re.compile(r"cc[\s-]+by")))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_APART = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in _LOWER)


def detections(low: str) -> list[tuple[int, int, str, float]]:
    """(start, end, label, confidence) of the detections that no other one contains.

    Rules come by priority, so a later detection within an earlier one goes; of detections
    of one priority the longer one stays.
    """
    held = {k: k in low for k in {r.keyword for r in RULES}}
    found = [(r.priority, m.start(), m.end(), r.label, r.confidence)
             for r in RULES if held[r.keyword] for m in r.pattern.finditer(low)]
    found.sort(key=lambda d: (d[0], d[1] - d[2], d[1], -d[4], d[3]))
    starts = sorted({d[1] for d in found})
    reach = [-1] * (len(starts) + 1)  # a tree of prefix maxima: the furthest end of those kept by start
    kept = []
    for _, start, end, label, sure in found:
        k = here = bisect_right(starts, start)
        furthest = -1
        while k:
            furthest = max(furthest, reach[k])
            k &= k - 1
        if furthest >= end:
            continue
        kept.append((start, end, label, sure))
        while here < len(reach):
            reach[here] = max(reach[here], end)
            here += here & -here
    return sorted(kept)


def scan_text(raw: bytes) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
    """Number of words, base places (first word, words, label) and detections of one text."""
    words = raw.translate(_APART).split()
    low = raw.translate(_LOWER)
    places = []
    if any(c in low for c in CLUES):
        for phrase, label in PHRASES:
            wanted = [w.encode() for w in phrase]
            at = -1
            while wanted[0] in words[at + 1:] if at < 0 else True:
                try:
                    at = words.index(wanted[0], at + 1)
                except ValueError:
                    break
                if words[at:at + len(wanted)] == wanted:
                    places.append((at, len(wanted), label))
    said = low.decode("utf-8", "replace")
    found = detections(said) if any(g in low for g in GATE) or any(w in low and at.search(said) for w, at in PLACES) else []
    return len(words), sorted(places), found


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The table's other columns with the number of words, the base places and the detections."""
    def one(raw: bytes):
        n, places, found = scan_text(raw)
        return (n, [{"word": a, "words": k, "label": x} for a, k, x in places],
                [{"start": a, "end": b, "label": x, "confidence": c} for a, b, x, c in found])

    return map_texts(docs, one, "_llm_words long, _llm_places array<struct<word:bigint,words:int,label:string>>, "
                                "_llm_found array<struct<start:bigint,end:bigint,label:string,confidence:double>>", text)


def digest(docs: DataFrame) -> DataFrame:
    """The stated result of every document, with the detections as ``label:start:end``."""
    found = scan(docs.select("doc_id", "text"))
    labels = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    starts = F.transform("_llm_places", lambda x: x["word"])
    sure = F.coalesce(F.array_max(F.transform("_llm_found", lambda x: x["confidence"])), F.lit(0.0))
    return found.select(
        "doc_id", F.col("_llm_words").alias("n_words"), F.size("_llm_places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(labels(F.col("_llm_places"))).alias("base_labels"),
        joined(F.concat(labels(F.col("_llm_places")), labels(F.col("_llm_found")))).alias("labels"),
        F.greatest(sure, F.when(F.size("_llm_places") > 0, 0.5).otherwise(0.0)).alias("score"),
        F.array_join(F.transform("_llm_found", lambda x: F.concat_ws(":", x["label"], x["start"], x["end"])), ",").alias("detections"))
