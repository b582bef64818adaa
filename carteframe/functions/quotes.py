"""Rules on the names of sources and on quoted prices, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sizes

#: Platforms that are no source; marks and beginnings of article titles (the second list of marks is that of
#: the web tier); places inside which a venue is no competitor.
PLATFORMS = [
    "doordash", "grubhub", "uber eats", "ubereats", "uber-eats", "postmates", "seamless", "caviar", "toast", "toasttab", "toast tab", "slice", "slicelife", "slice life", "slice.com",
    "chownow", "chow now", "square", "square space", "yelp", "tripadvisor", "trip advisor", "zomato", "google maps", "google.com",
]
MARKS = [
    " | ", " · ", "...", " near me", " near you", " near here", "best pizza in ", "best pizzas in ", "best pizza of ", "best restaurants in ", "best restaurants of ",
    "top restaurants in ", "top pizzas in ", "places to eat in ", "where to eat in ",
]
WEB_MARKS = [
    " | ", " · ", "...", " near me", " near you", " near here", "best pizza in ", "best pizza of ", "best pizzas in ", "best restaurants in ", "best restaurants of ",
    "top restaurants in ", "places to eat in ", "where to eat in ",
]
BEGINNINGS = ["best ", "top ", "the best ", "the top ", "10 ", "5 ", "7 ", "12 ", "15 ", "20 ", "25 "]
VENUES = [
    "six flags", "riverside", "amusement park", "theme park", "disney", "universal studios", "busch gardens", "cedar point", "funtown", "mall", "food court", "airport", "terminal",
    "stadium", "arena", "hospital", "medical center", "casino", "hotel",
]
#: Sub-categories that are options of other items; words of a name that tell nothing; other names of one product.
MODIFIERS = ["topping", "sauce", "preparation", "add-on", "addon", "add on", "modifier", "options", "tortilla", "bread option"]
DULL = ["the", "and", "with", "for", "size", "small", "large", "medium", "regular", "personal", "mini", "pizza"]
SYNONYMS = {
    "cheese": ["plain", "mozzarella"], "hamburger": ["burger"], "cheeseburger": ["cheese burger"], "wings": ["buffalo", "chicken", "wing"], "buffalo": ["wings", "wing"],
    "fries": ["french", "side", "basket"], "calzone": ["calz"], "sub": ["hoagie", "grinder", "hero"], "hoagie": ["sub", "grinder", "hero"], "grinder": ["sub", "hoagie", "hero"],
}
#: Characters before a price in which its item must be named; how far two piece counts may be apart.
NEAR, DRIFT = 60, 0.5
#: Words that many venues have in their names.
COMMON = ["restaurant", "pizza", "pizzeria", "bar", "grill", "cafe", "kitchen", "the", "and", "&", "of", "la", "el", "di", "da"]


def _any(words: Sequence[str]) -> str:
    return "|".join(map(re.escape, words))


def is_platform(name: Column) -> Column:
    """Whether a name is, or holds as words of its own, a platform's; so is an empty one."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return (low == "") | low.rlike(rf"\b(?:{_any(PLATFORMS)})\b")


def is_article(name: Column, marks: Sequence[str] = MARKS) -> Column:
    """Whether a name looks like the title of an article or a list."""
    whole = F.coalesce(name, F.lit(""))
    text = F.trim(whole)
    low = F.lower(text)
    return (whole == "") | (F.length(text) > 80) | low.rlike(_any(marks)) | low.rlike(f"^(?:{_any(BEGINNINGS)})")


def is_inside_venue(name: Column, vicinity: Column, located_in: Column) -> Column:
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.concat_ws(" ", low(name), low(vicinity)).rlike(_any(VENUES)) | low(located_in).rlike(_any(VENUES))


def is_modifier(subcategory: Column) -> Column:
    return F.lower(F.coalesce(subcategory, F.lit(""))).rlike(_any(MODIFIERS))


def by_the_slice(name: Column) -> Column:
    """Whether slices are named outside parentheses."""
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"\([^)]*\)", "")).rlike(r"\bslices?\b")


def has_compound_size(quote: Column) -> Column:
    one = "sm|small|md|med|medium|reg|regular|lg|large|xl|x-large"
    return F.coalesce(quote, F.lit("")).rlike(rf"(?i)\b(?:{one})\s*/\s*(?:{one}|family|party)\b")


def quantity(text: Column) -> Column:
    """The count of '12 pcs', '6 Wings' or '24ct', else NULL."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\b(\d{1,3})\s*(?:pcs?|pieces?|wings?|count|ct)\b", 1).try_cast("int")


def quantity_mismatch(name: Column, quote: Column, drift: float = DRIFT) -> Column:
    """Whether both name a quantity and the quote's is too far from the item's."""
    own, other = quantity(name), quantity(quote)
    return F.coalesce((own > 0) & (F.abs(other - own) / own > drift), F.lit(False))


def _first(parts: Sequence[Column]) -> Column:
    out = parts[-1]
    for part in reversed(parts[:-1]):
        out = F.when(part > 0, part).otherwise(out)
    return out


def backs_price(quote: Column, cents: Column, name: Column) -> Column:
    """Whether a quote has the price in some form and, near before it, a telling word of the item or another name of it."""
    q, whole = F.lower(F.coalesce(quote, F.lit(""))), (cents / 100).cast("bigint").cast("string")
    exact = F.concat(whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    even = lambda text: F.when(cents % 100 == 0, F.instr(q, text)).otherwise(0)
    at = _first([F.instr(q, F.concat(F.lit("$"), exact)), F.instr(q, exact), even(F.concat(F.lit("$"), whole)), even(F.concat(F.lit(" "), whole, F.lit(" ")))])
    words = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    telling = F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*DULL))
    tokens = F.when(F.size(telling) > 0, telling).otherwise(F.filter(words, lambda w: F.length(w) > 2))
    known = F.create_map(*(x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    every = F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(known, t), F.array().cast("array<string>")))))
    low = F.greatest(at - NEAR, F.lit(1))
    window = F.when(at > 1, F.substring(q, low, at - low)).otherwise(q)
    inside = F.exists(every, lambda w: q.contains(w)) & F.exists(every, lambda w: window.contains(w))
    return (q != "") & (at > 0) & ((F.size(tokens) == 0) | inside)


def roughly_same(got: Column, want: Column) -> Column:
    """Whether two names of venues share a word that isn't common."""
    words = lambda c: F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[&,]", " ")), r"\s+"), lambda w: (w != "") & ~w.isin(*COMMON))
    return F.arrays_overlap(words(got), words(want))


def category_key(category: Column) -> Column:
    """Lower case without quotes, & as and, the plural taken off."""
    c = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(category, F.lit("")))), "['\"]", ""), "&", "and"))
    cut = lambda n: F.substring(c, F.lit(1), F.length(c) - n)
    longer = F.length(c) > 4
    return F.when(c.endswith("ies") & longer, F.concat(cut(3), F.lit("y"))).when(c.rlike("(?:ches|shes|xes|zes|sses)$") & longer, cut(2)).when(c.endswith("s") & (F.length(c) > 2) & ~(c.endswith("ies") & longer), cut(1)).otherwise(c)


#: Canonical categories and what tells them, in the order in which they are tried.
CANONICAL = {
    "Pizza": ["pizza", "pizzas", "ny style pizza", "new york style pizza", "gourmet pizza", "specialty pizza", "sicilian pizza"],
    "Calzones & Strombolis": ["calzone", "calzones", "stromboli", "strombolis"],
    "Wings": ["wings", "chicken wings", "boneless wings", "bone-in wings"],
    "Burgers & Sandwiches": ["burger", "burgers", "sandwich", "sandwiches", "club sandwich", "panini", "wraps", "wrap", "subs", "sub", "grinder", "grinders", "hoagie", "hoagies", "philly"],
    "Salads": ["salad", "salads"],
    "Pastas": ["pasta", "pastas", "pasta dinners", "italian dinners", "dinners"],
    "Appetizers & Sides": ["appetizer", "appetizers", "starters", "sides", "side orders", "finger foods"],
    "Beverages": ["beverage", "beverages", "drinks", "drink", "soda", "soft drinks"],
    "Desserts": ["dessert", "desserts", "sweet treats"],
}


def collapsed_category(category: Column) -> Column:
    """The canonical category that a heading tells, else the heading in title case, else Uncategorized."""
    text = F.trim(F.coalesce(category, F.lit("")))
    out = F.when(text == "", "Uncategorized")
    for name, hints in CANONICAL.items():
        out = out.when(F.lower(text).rlike(_any(hints)), name)
    title = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2))))), "")
    return out.when(F.length(text) > 2, title).otherwise("Uncategorized")


#: Side dishes that make a combo; words of tastes and of ways of making.
COMBO_FOODS = [
    "fries", "frie", "french fries", "curly fries", "waffle fries", "sweet potato fries", "steak fries", "seasoned fries", "onion rings", "onion ring", "tater tots", "tots", "fried pickles", "fried mushrooms",
    "chips", "chip", "potato chips", "coleslaw", "cole slaw", "slaw", "side salad", "garden salad", "caesar salad", "house salad", "salad", "vegetables", "veggies", "mixed vegetables",
    "rice", "fried rice", "white rice", "brown rice", "mashed potatoes", "mashed potato", "baked potato", "potato salad", "mac and cheese", "macaroni and cheese", "cheese", "extra cheese",
    "drink", "soda", "beverage", "fountain drink", "soup", "side soup", "cup of soup", "garlic bread", "breadsticks", "bread",
]
FLAVORS = [
    "hot", "mild", "medium", "honey", "bbq", "barbecue", "honey bbq", "garlic", "parm", "parmesan", "garlic parm", "teriyaki", "buffalo", "spicy", "sweet", "sour", "honey mustard", "lemon", "pepper", "lemon pepper",
    "mango habanero", "carolina gold", "thai chili", "sweet chili", "old bay", "cajun", "ranch", "blue cheese", "asian zing", "korean bbq", "sriracha", "plain", "naked", "original",
]
STYLES = [
    "bone-in", "bone in", "boneless", "thin", "thin crust", "thick", "thick crust", "deep dish", "stuffed crust", "white", "red", "red sauce", "alfredo", "pesto", "pan", "pan crust", "hand tossed", "hand-tossed",
    "brooklyn", "brooklyn style", "sicilian", "sicilian style", "neapolitan", "neapolitan style", "detroit", "detroit style", "new york", "ny style", "flatbread", "gluten free", "gluten-free", "cauliflower crust",
    "crispy", "extra crispy", "fried", "grilled", "baked", "breaded", "naked", "dry rub", "tossed",
]


def combo_hints(text: Column) -> Column:
    """Side dishes after w/ or with, lower case, in order."""
    foods = _any(sorted(COMBO_FOODS, key=len, reverse=True))
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)\b(?:w/|with)\s+({foods})\b"), F.lit(1)), F.lower)


def label_size(label: Column) -> Column:
    """The size in a variant's label: inches, pieces, the first size word, or a bare number of 6 to 30 as inches; else NULL."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    inches = F.regexp_extract(low, r'(\d{1,2})\s*(?:"|in(?:ch(?:es)?)?)\b', 1).try_cast("int")
    pieces = F.regexp_extract(low, r"(\d{1,2})\s*(?:pc|pcs|piece|pieces|ct)\b", 1).try_cast("int")
    known = F.create_map(*(F.lit(x) for size, spellings in sizes.SPELLINGS.items() for s in spellings for x in (s, size)))
    words = F.array_compact(F.transform(F.split(low, r"\s+"), lambda t: F.try_element_at(known, F.regexp_replace(t, "^[.,;:-]+|[.,;:-]+$", ""))))
    bare = F.filter(F.transform(F.regexp_extract_all(low, F.lit(r"\b(\d{1,2})\b"), F.lit(1)), lambda n: n.cast("int")), lambda n: n.between(6, 30))
    unit = lambda n, name: F.when(n.isNotNull(), F.concat(n.cast("string"), F.lit(name)))
    return F.coalesce(unit(inches, "in"), unit(pieces, "pc"), F.try_element_at(words, F.lit(1)), unit(F.try_element_at(bare, F.lit(1)), "in"))


def label_kind(label: Column) -> Column:
    """size, combo, style, flavor or other; NULL without a label."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    food = F.trim(F.regexp_replace(low, r"^(?:w/\s*|with\s+)", ""))
    return (
        F.when(low == "", F.lit(None).cast("string")).when(label_size(label).isNotNull(), "size").when(food.isin(*COMBO_FOODS) | low.isin(*COMBO_FOODS), "combo")
        .when(low.rlike(_any(STYLES)), "style").when(low.rlike(_any(FLAVORS)), "flavor").otherwise("other")
    )


def group_key(label: Column) -> Column:
    """kind:size or kind:label by which variants of many items are compared; NULL for other labels."""
    kind = label_kind(label)
    return F.when(kind == "size", F.concat(F.lit("size:"), label_size(label))).when(kind.isin("flavor", "style", "combo"), F.concat(kind, F.lit(":"), F.lower(F.trim(label))))
