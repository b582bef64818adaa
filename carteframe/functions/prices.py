"""Column expressions for prices and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prices outside these cents are no menu prices.
LEAST_CENTS, MOST_CENTS = 100, 9999


def lenient_cents(raw: Column) -> Column:
    """Text to cents: with a decimal point dollars, digits alone cents from 1000 on and else dollars; NULL if empty or no price."""
    text = F.regexp_replace(F.trim(raw), "[$,]", "")
    whole = text.try_cast("bigint")
    return F.when(text.rlike(r"^\d+$"), F.when(whole >= 1000, whole).otherwise(whole * 100)).when(text.rlike(r"^\d*\.\d+$"), F.round(text.try_cast("double") * 100).cast("bigint"))


def strict_cents(raw: Column) -> Column:
    """Dollars to cents, rounded half to even; market prices, empty text and anything else NULL."""
    text = F.regexp_replace(F.trim(raw), r"^[$€£]\s*", "")
    return F.when(text.rlike(r"^\d+(\.\d+)?$"), F.bround(text.try_cast("decimal(18,4)") * 100, 0).cast("bigint"))


def clamp_cents(cents: Column) -> Column:
    return F.when(cents.between(LEAST_CENTS, MOST_CENTS), cents)


def dollars(cents: Column) -> Column:
    """12.99 for 1299; NULL and 0 are empty text."""
    return F.when(F.coalesce(cents, F.lit(0)) == 0, "").otherwise(F.concat((cents / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")))


def haversine_miles(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column, radius: float = 3958.8) -> Column:
    half = lambda x, y: F.pow(F.sin(F.radians(y - x) / 2), F.lit(2))
    a = half(lat_a, lat_b) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half(lng_a, lng_b)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


#: Shapes of a price in running text.
SHAPES = r"\$?\s*\d{1,3}[.,]\d{2}|\$\s*\d{1,3}|\b\d{3}\b|\b\d{1,2}\s*99\b"


def from_token(token: Column) -> Column:
    """Cents of a price token: 12.99, 12,99, $12, 599, 12 99; outside 100 to 9999 NULL."""
    pair = lambda g: F.regexp_extract(token, r"(\d{1,3})[.,](\d{2})", g).try_cast("int")
    dollars_ = F.regexp_extract(token, r"\$\s*(\d{1,3})", 1).try_cast("int")
    three, tail = F.regexp_extract(token, r"\b(\d{3})\b", 1).try_cast("int"), F.regexp_extract(token, r"\b(\d{1,2})\s*99\b", 1).try_cast("int")
    return clamp_cents(F.coalesce(pair(1) * 100 + pair(2), dollars_ * 100, three, tail * 100 + 99))


def candidates(text: Column) -> Column:
    """Cents of all price tokens of a text, in order."""
    return F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(f"({SHAPES})"), F.lit(1)), from_token))
