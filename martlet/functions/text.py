"""Text clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a missing value left behind by text conversion.
MISSING_WORDS = ("nan", "None", "null", "<NA>")

#: Whitespace as Python understands it: the Unicode class plus four separators.
_BLANK = r"(?U)[\s\x1c-\x1f]+"
_CONTROL = r"[\x00-\x1f\x7f-\x9f]"


def clean_text(c: Column) -> Column:
    """Trim, squeeze blanks, delete control characters; NULL becomes ''."""
    squeezed = F.trim(F.regexp_replace(c, _BLANK, " "))
    return F.coalesce(F.regexp_replace(squeezed, _CONTROL, ""), F.lit(""))


def normalise_text(c: Column) -> Column:
    """Lower case, keep only ASCII letters, digits and blanks."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^a-zA-Z0-9\s]", "")


def letters_only(c: Column) -> Column:
    """Lower case, keep only ASCII letters and blanks."""
    return F.regexp_replace(F.lower(c), r"(?U)[^a-zA-Z\s]", "")


def words(c: Column) -> Column:
    """Blank-separated words; an empty array for blank text."""
    return F.filter(F.split(c, _BLANK), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def combined_text(*columns: Column) -> Column:
    return F.concat_ws(" ", *[normalise_text(c) for c in columns])


def blank_missing_words(c: Column) -> Column:
    """'' for NULL and for the spelled-out forms of a missing value."""
    return F.when(c.isNull() | c.isin(*MISSING_WORDS), F.lit("")).otherwise(c)


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(F.regexp_replace(c.cast("string"), _BLANK, " ")) == "")


def slug_title(url: Column) -> Column:
    """Display name of a category: last path segment, hyphens to blanks."""
    return F.initcap(F.replace(F.element_at(F.split(url, "/"), -1), F.lit("-"), F.lit(" ")))


def contains_ignore_case(text: Column, part: Column) -> Column:
    """1 if ``part`` is given and occurs in ``text`` whatever the case, else 0."""
    hit = F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(part))
    return F.coalesce(hit.cast("int"), F.lit(0))


def first_non_empty(*candidates: Column) -> Column:
    """First candidate with text in it, cleaned; '' when there is none."""
    cleaned = [F.nullif(clean_text(c), F.lit("")) for c in candidates]
    return F.coalesce(*cleaned, F.lit(""))


def money(c: Column) -> Column:
    """Two decimals, ties decided on the binary value as Python's formatting does."""
    return F.concat(F.lit("€"), F.replace(F.format_number(c, 2), F.lit(","), F.lit("")))


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)
