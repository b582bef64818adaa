"""Column expressions for names and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about an item when they begin its name.
PREFIXES = "our|the|homemade|fresh|classic"

#: Menu abbreviations.
SYNONYMS = {
    "combo": "combination", "spec": "special", "spcl": "special", "ckn": "chicken", "chkn": "chicken", "pep": "pepperoni", "pepp": "pepperoni", "veggie": "vegetable", "veg": "vegetable",
    "mush": "mushroom", "mshrm": "mushroom", "marg": "margherita", "marghr": "margherita", "sup": "supreme", "supr": "supreme", "buff": "buffalo", "bbq": "barbecue", "stk": "steak",
    "shrmp": "shrimp", "pinap": "pineapple", "pin": "pineapple", "trad": "traditional", "med": "medium", "mdm": "medium", "lrg": "large", "lg": "large", "sml": "small", "sm": "small",
    "xl": "extra-large", "xlg": "extra-large", "pcs": "pieces", "pc": "piece", "fav": "favorite", "grnd": "grinder", "grdr": "grinder", "swch": "sandwich", "sndwch": "sandwich",
    "parm": "parmesan", "alf": "alfredo", "calz": "calzone",
}
#: Words that tell no two items apart: categories, sizes, quantities, connectors.
GENERIC = [
    "pizza", "pie", "calzone", "calzones", "sandwich", "sandwiches", "sub", "subs", "grinder", "grinders", "hoagie", "wrap", "wraps", "salad", "salads", "burger", "burgers", "hamburger", "pita", "platter", "platters", "dinner", "entree",
    "personal", "small", "medium", "large", "party", "family", "regular", "deluxe", "mini", "size", "sized", "slices", "slice", "pieces", "piece", "pcs", "pc", "inch",
    "with", "and", "the", "a", "an", "of", "to", "for", "or", "served", "side",
]
#: Category words that name a kind of product.
TYPE_WORDS = ["club", "melt", "panini", "hoagie", "wrap", "sub", "grinder", "pita", "platter", "dinner", "stromboli", "frittata", "specialty", "gourmet"]


def menu_tokens(name: Column) -> Column:
    """Distinguishing tokens of a name: abbreviations spelled out, generic words, numbers and single characters gone, plurals folded."""
    words = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    known = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    full = F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w))
    kept = F.filter(full, lambda w: ~w.isin(*GENERIC) & ~w.rlike(r"^\d+$") & (F.length(w) > 1))
    one = lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.array_distinct(F.transform(kept, one))


def type_tokens(category: Column) -> Column:
    """Kinds of product that a category names, plurals folded; kinds that are generic words don't count."""
    words = F.regexp_extract_all(F.lower(F.coalesce(category, F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    one = F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.array_distinct(F.filter(one, lambda w: w.isin(*(t for t in TYPE_WORDS if t not in GENERIC))))


def key(text: Column) -> Column:
    """lower(trim()) with NULL as empty."""
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def normalized(name: Column) -> Column:
    """Lower case without leading filler words, spaces squeezed, trailing punctuation gone."""
    bare = F.regexp_replace(F.lower(F.trim(name)), rf"^((?:{PREFIXES})\s+)+", "")
    return F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r"[.:\- ]+$", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def vowel_ratio(text: Column) -> Column:
    """Vowels by letters, ASCII; 0 without letters."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, "[^AEIOUaeiou]", "")) / letters).otherwise(0.0)


def symbol_ratio(text: Column) -> Column:
    """Characters that are no letters, digits or spaces, by all; 0 for empty text."""
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, "[A-Za-z0-9 ]", "")) / F.length(text)).otherwise(0.0)


def html_text(page: Column) -> Column:
    """A page without scripts, styles and tags, spaces squeezed."""
    bare = F.regexp_replace(F.regexp_replace(page, r"(?is)<script[^>]*>.*?</script>", " "), r"(?is)<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s+", " "))
