"""Sizes in labels: canonical names, places on their track, tiers and piece counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of each size.
SPELLINGS = {
    "XS": ["xs", "x-small", "extra small"], "S": ["small", "sm", "sml", "s"], "M": ["medium", "med", "md", "m"], "L": ["large", "lg", "lrg", "l"],
    "XL": ["x-large", "xlarge", "xl", "extra large"], "XXL": ["xxl"], "Half": ["half"], "Whole": ["whole"], "Slice": ["slice"], "Personal": ["personal", "individual"],
    "Family": ["family", "family size"], "Party": ["party", "party size"], "Single": ["single"], "Double": ["double"], "Triple": ["triple"], "Regular": ["regular"], "Deluxe": ["deluxe"], "Mini": ["mini"],
}
#: Places on the tracks word, portion, multiplicity; pieces begin at PIECES, inches are their own number.
PLACES = {
    "word": {"XS": 10, "Mini": 15, "S": 20, "Personal": 25, "Regular": 30, "M": 35, "L": 40, "Deluxe": 45, "XL": 50, "XXL": 55},
    "portion": {"Slice": 110, "Half": 120, "Whole": 130, "Family": 140, "Party": 150},
    "multiplicity": {"Single": 210, "Double": 220, "Triple": 230},
}
PIECES = 300
#: Words and inches of the tiers.
TIER_WORDS = {"party": r"party|family|x[\s-]?large|xlarge|extra[\s-]large|super|jumbo", "large": "large|lrg|lg", "medium": "medium|med|mdm", "small": "small|sml|personal|mini"}
TIER_INCHES = {"party": "18|20|22|24|26|28", "large": "16", "medium": "14", "small": "8|10|12"}


def normalized(label: Column) -> Column:
    """10in, 6pc, a canonical size, or NULL; a bare number of 6 to 30 is inches."""
    low = F.lower(F.trim(label))
    inch = F.regexp_extract(low, r'(\d{1,2})\s*(?:["”°]|in(?:ch(?:es)?)?\b)', 1)
    piece = F.regexp_extract(low, r"(\d+)\s*(?:pc|pcs|piece|pieces|ct)\b", 1)
    word = F.lit(None).cast("string")
    for size, spellings in reversed(SPELLINGS.items()):
        word = F.when(low.isin(*spellings), size).otherwise(word)
    bare = F.regexp_extract(low, r"^(\d{1,2})$", 1).try_cast("int")
    return F.when(inch != "", F.concat(inch, F.lit("in"))).when(piece != "", F.concat(piece, F.lit("pc"))).otherwise(F.coalesce(word, F.when(bare.between(6, 30), F.concat(bare.cast("string"), F.lit("in")))))


def ordinal(size: Column) -> Column:
    n = F.regexp_extract(size, r"^(\d+)(?:in|pc)$", 1).try_cast("int")
    place = F.create_map(*(F.lit(x) for places in PLACES.values() for pair in places.items() for x in pair))
    return F.when(size.rlike(r"^\d+in$"), n).when(size.rlike(r"^\d+pc$"), PIECES + n).otherwise(F.try_element_at(place, size))


def track(size: Column) -> Column:
    out = F.when(size.rlike(r"^\d+in$"), "inch").when(size.rlike(r"^\d+pc$"), "piece")
    for name, places in PLACES.items():
        out = out.when(size.isin(*places), name)
    return out


def tier(text: Column) -> Column:
    """party, large, medium, small or unknown: words first, then inches."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(F.lit(False), "")
    for name, words in TIER_WORDS.items():
        out = out.when(low.rlike(rf"\b(?:{words})\b"), name)
    for name, inches in TIER_INCHES.items():
        out = out.when(low.rlike(rf"\b(?:{inches})['\"]"), name)
    return out.otherwise("unknown")


def piece_count(name: Column) -> Column:
    """20 of '20 Pcs' or '10 spicy hot Wings', else NULL."""
    return F.regexp_extract(F.coalesce(name, F.lit("")), r"(?i)\b(\d+)(?:\s+\w+){0,3}?\s+(?:pc|pcs|piece|pieces|wing|wings)\b", 1).try_cast("int")
