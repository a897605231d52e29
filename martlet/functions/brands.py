"""Brand names found in titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from martlet.functions.text import words

# Brands to look for in a title, family by family.
BRAND_FAMILIES = (
    ("Lenovo", "HP", "Dell", "ASUS", "Acer", "MSI", "Apple", "Alienware", "Razer",
     "Origin", "CyberPowerPC"),
    ("Samsung", "iPhone", "Apple", "Xiaomi", "Huawei", "OnePlus", "Google", "Sony",
     "Nokia", "Oppo", "Vivo"),
    ("LG", "Samsung", "Sony", "TCL", "Hisense", "Philips", "Panasonic", "Sharp",
     "Toshiba", "AOC", "ASUS", "Acer", "BenQ"),
    ("Nintendo", "PlayStation", "Xbox", "Steam", "Valve", "Corsair", "Logitech",
     "SteelSeries"),
    ("Sony", "Bose", "JBL", "Sennheiser", "Audio-Technica", "Beyerdynamic", "AKG",
     "Shure", "Marshall"),
    ("Panasonic", "Bosch", "Siemens", "Canon", "Nikon", "GoPro", "DJI", "Fitbit",
     "Garmin"),
)
# Capitalised words that name a kind of product, not a brand.
PRODUCT_NOUNS = ("kompjuter", "laptop", "telefon", "monitor", "tv", "kufje")


def brand_from_title(title: Column) -> Column:
    """Known brand, else a capitalised word among the first three; '' if none."""
    known = [
        F.nullif(F.regexp_extract(title, rf"(?i)\b({'|'.join(family)})\b", 1), F.lit(""))
        for family in BRAND_FAMILIES
    ]
    heads = F.transform(F.slice(words(title), 1, 3),
                        lambda w: F.regexp_replace(w, r"(?U)[^\w]", ""))
    likely = F.filter(heads, lambda w: w.rlike(r"(?U)^\p{Lu}\w+$")
                      & ~F.lower(w).isin(*PRODUCT_NOUNS))
    return F.coalesce(*known, F.get(likely, F.lit(0)), F.lit(""))


def brand_of(explicit: Column, title: Column) -> Column:
    """The stated brand if it has two characters or more, else one from the title."""
    return F.when(F.length(explicit) > 1, explicit).otherwise(brand_from_title(title))
