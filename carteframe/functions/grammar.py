"""Rules on single lines of scanned menus: noise, misread words, names in capitals, ingredients, columns, size headers.

All are column expressions. A NULL text counts as empty. White space is ASCII white space, letters are Unicode letters
unless a rule says a to z.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quotes import COMBO_FOODS
from .sizes import SPELLINGS

#: Letters that dot leaders are misread as; short words that are kept; misread words and what they stand for.
LEADER_LETTERS = "secrnotvw"
SHORT_WORDS = ["&", "w/", "or", "of", "on", "in", "to", "a", "no", "pc"]
MISREAD = {"88q": "BBQ", "88Q": "BBQ", "8BQ": "BBQ", "880": "BBQ", "B8Q": "BBQ", "Basi!": "Basil", "basi!": "basil"}
#: Words of sauces, ways of making, tastes and toppings.
SAUCES = [
    "marinara", "marinara sauce", "alfredo", "alfredo sauce", "pesto", "pesto sauce", "bbq sauce", "hot sauce", "ranch", "ranch dressing", "ranch sauce", "blue cheese", "blue cheese base", "bleu cheese",
    "garlic sauce", "red sauce", "white sauce", "buffalo sauce", "1000 island", "thousand island", "russian dressing", "caesar dressing", "tzatziki", "mayo", "mayonnaise", "tomato sauce", "olive oil", "1000 island base",
    "salsa", "sour cream",
]
PREPARATIONS = ["fried", "grilled", "baked", "roasted", "steamed", "sauteed", "braised", "breaded", "crispy", "smoked", "shaved", "diced", "chopped", "sliced", "stuffed", "marinated", "homemade"]
TASTES = [
    "hot", "mild", "medium", "honey bbq", "bbq", "garlic parm", "garlic parmesan", "garlic romano", "teriyaki", "buffalo", "spicy", "sweet", "cajun", "lemon pepper", "mango habanero", "sweet chili", "sriracha", "jack daniels bbq",
    "plain", "naked", "original", "honey mustard",
]
TOPPINGS = [
    "pepperoni", "sausage", "mushroom", "mushrooms", "onion", "onions", "pepper", "peppers", "green pepper", "green peppers", "olive", "olives", "black olive", "black olives", "bacon", "ham", "salami", "meatball", "meatballs",
    "pineapple", "jalapeno", "jalapenos", "banana pepper", "banana peppers", "tomato", "tomatoes", "spinach", "broccoli", "artichoke", "garlic", "basil", "oregano", "anchovies", "shrimp", "clam", "clams", "roasted red pepper", "sun dried tomato", "eggplant",
    "mozzarella", "ricotta", "provolone", "parmesan", "cheddar", "feta", "american cheese", "swiss", "blue cheese", "fresh mozzarella", "chicken", "steak", "philly steak", "grilled chicken", "buffalo chicken", "bbq chicken", "hamburger", "ground beef",
    "turkey", "roast beef", "tuna", "corned beef", "gyro", "ranch", "mayo", "mayonnaise", "mustard", "ketchup", "hot sauce", "bbq sauce", "marinara", "alfredo sauce", "pesto sauce", "ranch dressing", "sour cream", "salsa", "tzatziki",
    "russian dressing", "caesar dressing", "thousand island", "blue cheese base", "lettuce", "pickles", "coleslaw", "french fries", "chips", "avocado", "beans", "sauerkraut",
]
#: Size words of a header; those that qualify the inches before them.
HEADER_WORDS = "mini|small|sml|sm|medium|med|large|lrg|lg|family|party|personal|regular|deluxe"
QUALIFIERS = "mini|sml|small|sm|medium|med|large|lrg|lg"
PRICE = r"\$?\s*\d{1,3}[.,]\d{2}"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _words(c: Column) -> Column:
    return F.filter(F.split(_text(c), r"\s+"), lambda w: w != "")


def _kinds(c: Column) -> Column:
    """How many different characters a word has."""
    return F.size(F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))))


def _flag(c: Column) -> Column:
    return c.cast("int")


def without_garble(text: Column) -> Column:
    """The text without dot leaders and the letter runs that scanners make of them. A run of five letters a to z or more goes
    if two of four signs hold: a letter thrice in a row, 55 % leader letters, 45 % different letters or fewer, twelve letters."""

    def kept(run: Column) -> Column:
        low, n = F.lower(run), F.length(run)
        leaders = F.length(F.regexp_replace(low, f"[^{LEADER_LETTERS}]", ""))
        signs = _flag(low.rlike(r"(.)\1{2}")) + _flag(leaders * 100 >= n * 55) + _flag(_kinds(low) * 100 <= n * 45) + _flag(n >= 12)
        return F.when(run.rlike("^[a-zA-Z]{5,}$") & (signs >= 2), " ").otherwise(run)

    runs = F.regexp_extract_all(F.regexp_replace(_text(text), r"\.{2,}", " "), F.lit("[a-zA-Z]+|[^a-zA-Z]+"), F.lit(0))
    return _spaced(F.array_join(F.transform(runs, kept), ""))


def without_noise(text: Column) -> Column:
    """The text without scraps: short tokens that are no word, number or price, and tokens of 4 to 11 characters that are
    mostly digits or made of a few leader letters. Tokens are joined by one space."""

    def kept(token: Column) -> Column:
        bare = F.regexp_replace(token, r"^[.,;:!?)]+|[.,;:!?)]+$", "")
        low, n, letters = F.lower(F.regexp_replace(token, r"[.,;:!?)]+$", "")), F.length(bare), _letters(token)
        alphabet = F.lower(F.regexp_replace(token, r"[^\p{L}]", ""))
        leaders = F.length(F.regexp_replace(alphabet, f"[^{LEADER_LETTERS}]", ""))
        one_letter = (letters == n) & (_kinds(alphabet) == 1)
        short = low.isin(*SHORT_WORDS) | bare.rlike(r"^\d+$") & ~bare.isin("00", "000") | ~((letters == 0) | (letters <= 1) & (n <= 2) | one_letter)
        residue = (letters >= 3) & (leaders * 100 >= letters * 85) & (_kinds(alphabet) * 100 < letters * 65)
        middle = ~((letters > 0) & (letters * 10 < n * 4) | residue)
        return bare.rlike("^" + PRICE) | token.startswith("$") | F.when(n < 4, short).when(n <= 11, middle).otherwise(True)

    return F.array_join(F.filter(_words(text), kept), " ")


def without_misreadings(text: Column) -> Column:
    """Known misread words put right; a bracket at the start goes."""
    out = _text(text)
    for wrong, right in MISREAD.items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    for pattern, right in ((r"\bpiZzA\b", "PIZZA"), (r"\bSmt\b", "Sml"), (r"^\[a?\d*\]?\s*", ""), (r"\bWI/", "W/")):
        out = F.regexp_replace(out, pattern, right)
    return out


def spelled_with(text: Column) -> Column:
    """W/, WI/, 'Wi ' before a consonant, and WI glued to a side dish, all as 'with '."""
    single = "|".join(sorted((re.escape(f) for f in COMBO_FOODS if " " not in f), key=len, reverse=True))
    out = F.regexp_replace(_text(text), r"(?i)\bWI?/\s*", "with ")
    out = F.regexp_replace(out, r"\bWi\s+(?=[BCDFGHJKLMNPQRSTVWXYZbcdfghjklmnpqrstvwxyz])", "with ")
    return F.regexp_replace(out, rf"(?i)\bWI({single})\b", "with $1")


def capital_name(text: Column) -> Column:
    """struct(name, description) of a line that begins with words in capitals and goes on in other words, else NULL. Signs and
    numbers go with the capitals before them. One word alone is a name only before a small letter or an early comma."""
    words = _words(text)
    plain = lambda w: F.regexp_replace(w, "[^A-Za-z]", "")
    first = F.array_position(F.transform(words, lambda w: (plain(w) != "") & ~plain(w).rlike("^[A-Z]{2,}$")), True).cast("int")
    ahead = F.slice(words, 1, F.greatest(first - 1, F.lit(0)))
    rest = F.array_join(F.slice(words, F.greatest(first, F.lit(1)), F.size(words)), " ")
    abbreviation = (first == 2) & F.regexp_extract(rest, r"\p{L}", 0).rlike(r"^\p{Lu}") & ~F.left(rest, F.lit(40)).contains(",")
    holds = F.exists(ahead, lambda w: plain(w) != "") & (_letters(rest) >= 3) & ~abbreviation
    return F.when(holds, F.struct(F.array_join(ahead, " ").alias("name"), rest.alias("description")))


def description_parts(text: Column) -> Column:
    """The listed things of a description, without the with before them."""
    parts = F.split(F.regexp_replace(_text(text), r"(?i)\s+w/\s*", ", "), r"(?i),\s*|\s+&\s+|\s+and\s+|;\s*|\s+or\s+")
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.trim(p), r"^\.+|\.+$", ""), r"(?i)^(?:w/\s*|with\s+)", "")))
    return F.filter(clean, lambda p: p != "")


def _vocabulary() -> list[tuple[str, str]]:
    """Words with their kinds, the longest first; a word of two lists has the kind of the first."""
    kinds = {}
    for kind, words in (("sauce", SAUCES), ("preparation", PREPARATIONS), ("flavor", TASTES), ("topping", TOPPINGS)):
        for word in words:
            kinds.setdefault(word, kind)
    return sorted(kinds.items(), key=lambda pair: -len(pair[0]))


def told_parts(parts: Column) -> Column:
    """array<struct(i, part, low, word, kind, way)>: each part with the longest known word in it, that word's kind, and its
    first word if that is a way of making."""
    vocabulary = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(k).alias("kind")) for w, k in _vocabulary()))

    def told(part: Column, i: Column) -> Column:
        low = F.lower(part)
        known = F.try_element_at(F.filter(vocabulary, lambda v: F.contains(low, v["word"])), F.lit(1))
        first = F.regexp_extract(low, r"^\S+", 0)
        return F.struct(i.alias("i"), part.alias("part"), low.alias("low"), known.alias("known"), F.when(first.isin(*PREPARATIONS), first).alias("way"))

    return F.transform(F.transform(parts, told), lambda r: F.struct(r["i"], r["part"], r["low"], r["known"]["word"].alias("word"), r["known"]["kind"].alias("kind"), r["way"]))


def column_segments(text: Column) -> Column:
    """The columns of a line that gaps of five spaces or more part, without scraps; NULL if fewer than two remain."""
    tidy = lambda s: _spaced(F.regexp_replace(F.regexp_replace(F.trim(s), r"^\.+|\.+$", ""), r"\.{2,}", " "))
    parts = F.filter(F.transform(F.split(F.trim(_text(text)), r"\s{5,}"), tidy), lambda s: (_letters(s) >= 2) | s.rlike(PRICE))
    return F.when(F.size(parts) >= 2, parts)


def size_columns(text: Column) -> Column:
    """The columns of a size header, in order: inches with their size word, size words, pieces. Counts of slices are none."""
    known = F.create_map(*(F.lit(x) for size, spellings in SPELLINGS.items() for s in spellings for x in (s, size)))
    named = lambda w: F.coalesce(F.try_element_at(known, F.lower(w)), w)
    inch = rf'\d{{1,2}}\s*["”°](?:[a-zA-Z]+|\s+(?:{QUALIFIERS})\b)?'
    found = F.regexp_extract_all(_text(text), F.lit(rf"(?i){inch}|\b(?:{HEADER_WORDS})\b|\b\d+\s*(?:slices?|pieces?|pcs?|cuts?)\b"), F.lit(0))

    def column(hit: Column) -> Column:
        digits, word = F.regexp_extract(hit, r"^\d+", 0), F.regexp_extract(hit, "[a-zA-Z]+$", 0)
        inches = F.concat(digits, F.lit('"'), F.when(word != "", F.concat(F.lit(" "), named(word))).otherwise(""))
        return F.when(hit.rlike('["”°]'), inches).when(digits != "", F.concat(digits, F.lit("pc"))).otherwise(named(hit))

    return F.transform(F.filter(found, lambda h: h.rlike('["”°]') | ~h.rlike("(?i)slice|cut")), column)


def grid_variants(columns: Column, cents: Column) -> Column:
    """array<struct(label, price_cents, confidence)>: the prices of a line under the columns of its header. Fewer prices than
    columns stand at the right; fewer than two, or more than columns, give none. Prices of 0 or less don't count."""
    prices = F.filter(F.coalesce(cents, F.array().cast("array<bigint>")), lambda c: c > 0)
    shift = F.size(columns) - F.size(prices)
    label = lambda i: F.get(columns, i + shift)
    placed = F.transform(prices, lambda c, i: F.struct(label(i).alias("label"), c.cast("bigint").alias("price_cents"), F.when(shift == 0, 0.85).otherwise(0.75).alias("confidence")))
    return F.filter(placed, lambda _: (F.size(prices) >= 2) & (shift >= 0))


def tier(score: Column, steps: Sequence[float] = (0.8, 0.6, 0.4)) -> Column:
    """high, medium, low or unknown."""
    return F.when(score >= steps[0], "high").when(score >= steps[1], "medium").when(score >= steps[2], "low").otherwise("unknown")
