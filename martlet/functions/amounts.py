"""Prices, ratings and review counts read from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns a shop page uses for amounts, ratings and reviews.
EURO_AMOUNT = r"(\d+(?:\.\d{2})?)\s*€"
RATING_FORMS = (
    r"(\d+(?:\.\d+)?)\s*(?:/\s*5|\s*out\s*of\s*5)",
    r"(\d+(?:\.\d+)?)\s*(?:stars?|★)",
    r"(\d+(?:\.\d+)?)\s*(?:vlerësime?)",
    r"(\d+(?:\.\d+)?)",
)
REVIEW_FORMS = (
    r"(\d+)\s*(?:reviews?|vlerësi|vlerësime)",
    r"(\d+)\s*(?:opinione?|komente?)",
    r"(\d+)\s*(?:recensione?)",
)
REVIEW_WORDS = ("vlerësi", "review", "opinione", "koment")


def extract_price(text: Column) -> Column:
    """Number in a price text.

    With both separators commas are grouping; a comma alone is the decimal sign.
    """
    kept = F.regexp_replace(text, r"[^0-9.,]", "")
    dotted = (
        F.when(F.contains(kept, F.lit(",")) & F.contains(kept, F.lit(".")),
               F.replace(kept, F.lit(","), F.lit("")))
        .otherwise(F.replace(kept, F.lit(","), F.lit(".")))
    )
    return dotted.try_cast("double")


def positive_price(text: Column) -> Column:
    value = extract_price(text)
    return F.when(value > 0, value)


def discount_percentage(price: Column, original: Column) -> Column:
    return F.round(F.try_divide(original - price, original) * 100, 2)


def _none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _amounts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EURO_AMOUNT), 1)


def current_price_text(text: Column) -> Column:
    """Price in force: the second euro amount if there are two, else the only one."""
    found = _amounts(text)
    return F.concat(F.when(F.size(found) >= 2, found[1]).otherwise(F.get(found, F.lit(0))), F.lit(" €"))


def original_price_text(text: Column) -> Column:
    """Price before the discount: the first euro amount when there are two."""
    found = _amounts(text)
    return F.when(F.size(found) >= 2, F.concat(found[0], F.lit(" €")))


def first_amount_text(text: Column) -> Column:
    """The first euro amount as written, sign included."""
    return _none_if_empty(F.regexp_extract(text, EURO_AMOUNT, 0))


def rating_in_text(text: Column) -> Column:
    """First rating form whose number lies in 0..5."""
    tries = []
    for form in RATING_FORMS:
        value = F.regexp_extract(text, form, 1).try_cast("double")
        tries.append(F.when(value.between(0, 5), value))
    return F.coalesce(*tries)


def review_count_in_text(text: Column) -> Column:
    """Review count by form, else any number next to a word for reviews."""
    tries = [_none_if_empty(F.regexp_extract(text, "(?iu)" + form, 1)) for form in REVIEW_FORMS]
    mentions = F.lower(text).rlike("|".join(REVIEW_WORDS))
    tries.append(F.when(mentions, _none_if_empty(F.regexp_extract(text, r"(\d+)", 1))))
    return F.coalesce(*tries).try_cast("int")


def parse_rating(c: Column, is_text: bool = True) -> Column:
    """Rating in 0..5, else NULL.  A typed zero counts as missing, a text '0' does not."""
    value = c.try_cast("double")
    ok = value.between(0, 5) if is_text else (value > 0) & (value <= 5)
    return F.when(ok, value)


def parse_review_count(c: Column, is_text: bool = True) -> Column:
    """Non-negative whole number, else NULL; same rule for zero as ratings."""
    if not is_text:
        value = c.try_cast("int")
        return F.when(value > 0, value)
    digits = F.regexp_extract(c, r"^\s*\+?(\d+)\s*$", 1)
    return F.when(digits != "", digits.try_cast("int"))
