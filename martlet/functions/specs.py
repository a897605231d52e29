"""Specifications as maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from martlet.functions.text import clean_text


def last_wins(pairs: Column) -> Column:
    """Map of (key, value) structs; blank ones are dropped, the last of a key stays."""
    full = F.filter(pairs, lambda s: (s["key"] != "") & (s["value"] != ""))
    last = F.filter(full, lambda s, i: ~F.exists(
        F.slice(full, i + 2, F.size(full)), lambda later: later["key"] == s["key"]))
    return F.map_from_entries(last)


def from_pairs(keys: Column, values: Column) -> Column:
    """Map of two lists read side by side; the longer one is cut."""
    n = F.least(F.size(keys), F.size(values))
    zipped = F.zip_with(F.slice(keys, 1, n), F.slice(values, 1, n), lambda k, v: F.struct(
        clean_text(k).alias("key"), clean_text(v).alias("value")))
    return last_wins(zipped)


def from_lines(lines: Column) -> Column:
    """Map of ``key: value`` lines, split at the first colon."""
    marked = F.filter(lines, lambda s: F.contains(s, F.lit(":")))
    return last_wins(F.transform(marked, lambda s: F.struct(
        clean_text(F.substring_index(s, ":", 1)).alias("key"),
        clean_text(F.regexp_replace(s, r"(?s)^[^:]*:", "")).alias("value"))))
