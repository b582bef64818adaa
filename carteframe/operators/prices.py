"""Price checks within groups: bands, outliers, decimal shifts, roles, zero prices."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats

#: Texts of surcharges and of deals, categories of surcharges, pairs of a cheaper and a dearer category.
SIDE_HINTS = [
    "add ", "extra ", "side of", "side:", "topping", "toppings", "each topping", "per topping", "extra cheese", "add cheese", "add bacon", "add pepperoni", "extra sauce", "cup of sauce",
    "ranch", "blue cheese", "bleu cheese", "dressing", "jalapeños", "peppers", "mushrooms", "onions", "olive", "olives", "garlic knots", "breadsticks", "fries", "chips",
]
DEAL_HINTS = [
    "coupon", "special", "specials", "deal", "family deal", "family special", "combo", "combos", "meal deal", "value meal", "2 for", "two for", "3 for", "three for",
    "buy 1", "buy one", "get 1", "get one", "bogo", "any 2", "any two", "pick any", "choose any", "only", "for only", "just",
]
SIDE_CATEGORIES = ["toppings", "extras", "sides", "dressings"]
COHERENCE = [
    ("Beverages", "Sides / Appetizers"), ("Beverages", "Salads"), ("Beverages", "Wings"), ("Beverages", "Subs / Sandwiches"), ("Beverages", "Burgers"), ("Beverages", "Pizza"), ("Beverages", "Pasta"), ("Beverages", "Calzones / Stromboli"),
    ("Sides / Appetizers", "Subs / Sandwiches"), ("Sides / Appetizers", "Burgers"), ("Sides / Appetizers", "Pizza"), ("Sides / Appetizers", "Pasta"), ("Sides / Appetizers", "Calzones / Stromboli"),
    ("Desserts", "Pizza"), ("Desserts", "Pasta"), ("Desserts", "Calzones / Stromboli"),
]
#: Interquartile ranges from the median that are still normal; plausible corrected cents (exclusive); divisors.
BAND_WIDTH, LEAST_FIXED, MOST_FIXED, DIVISORS = 4, 25, 50_000, (10, 100, 1000)


def category_outliers(items: DataFrame, group: Sequence[str], price: str = "price_cents") -> DataFrame:
    """Items far from their group's median by the MAD rule."""
    return stats.mad_outliers(items.where(F.col(price) > 0), group, price)


def bands(items: DataFrame, group: Sequence[str], price: str = "price_cents", primary: str | None = None) -> DataFrame:
    """group, n, median, q1, q3, iqr of positive prices; groups under three have no band.

    primary: a boolean column; groups that have such items at all are judged by them alone."""
    basis = items
    if primary:
        some = items.where(primary).select(*(F.col(g).alias(f"_{g}") for g in group)).distinct()
        known = functools.reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group))
        basis = items.where(primary).unionByName(items.join(some, known, "left_anti"))
    out = stats.half_split(basis.where(F.col(price) > 0), group, price).where("n >= 3 and median > 0")
    return out.withColumn("iqr", F.greatest(F.col("q3") - F.col("q1"), F.lit(1.0)))


def role(text: Column, category: Column) -> Column:
    """side, deal or primary, by what the text holds (name and description) and by the category's name."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    quoted = lambda hints: "|".join(re.escape(h) for h in hints)
    side = (F.length(low) <= 64) & low.rlike(quoted(SIDE_HINTS)) | F.lower(F.coalesce(category, F.lit(""))).isin(*SIDE_CATEGORIES)
    deal = low.rlike(quoted(DEAL_HINTS)) | (F.length(low) > 80) & (low.contains(" and ") | low.contains(" + "))
    return F.when((low != "") & side, "side").when((low != "") & deal, "deal").otherwise("primary")


def decimal_shifts(items: DataFrame, group: Sequence[str], price: str = "price_cents", primary: str | None = None) -> DataFrame:
    """Items more than four interquartile ranges off, with the correction by 10, 100 or 1000 that a lost point explains.

    Adds median, iqr, corrected_cents and divisor (NULL if none fits) and severity auto_fix or warn."""
    p, median = F.col(price), F.col("median")
    far = items.where(p > 0).join(bands(items, group, price, primary), list(group)).where(F.abs(p - median) / F.col("iqr") > BAND_WIDTH)
    fits = lambda d: F.when((p % d == 0) & (p / d > LEAST_FIXED) & (p / d < MOST_FIXED), F.struct((F.abs(p / d - median) / median).alias("off"), F.lit(d).alias("divisor")))
    best = F.array_min(F.filter(F.array(*map(fits, DIVISORS)), lambda x: x.isNotNull()))
    out = far.withColumn("_best", best)
    good = F.col("_best").isNotNull() & (F.abs(p - median) / median > 5 * F.col("_best.off"))
    divisor = F.when(good, F.col("_best.divisor"))
    return out.withColumn("divisor", divisor).withColumn("corrected_cents", (p / divisor).cast("bigint")).withColumn("severity", F.when(divisor.isNotNull(), "auto_fix").otherwise("warn")).drop("_best")


def coherence(items: DataFrame, menu: Sequence[str], rules: DataFrame, ratio: float = 1.3) -> DataFrame:
    """Items that cost more than the median of a category that should be dearer, or less than that of a cheaper one.

    rules: cheap, dear. Per item and direction the widest gap stays, of equals the first rule by name."""
    priced = items.where("price_cents > 0 and category is not null")
    middle = stats.medians(priced, [*menu, "category"], "price_cents").where("n >= 2").drop("n")
    of = lambda side: middle.select(*menu, F.col("category").alias(side), F.col("median").alias(f"{side}_median"))
    active = F.broadcast(rules).join(of("cheap"), "cheap").join(of("dear"), [*menu, "dear"]).where(F.col("dear_median") >= F.col("cheap_median") * ratio)
    above = priced.join(active, list(menu)).where("category = cheap and price_cents > dear_median").select(*menu, "pos", F.lit("above").alias("direction"), "category", "price_cents", F.col("dear").alias("compared"), (F.col("price_cents") - F.col("dear_median").cast("bigint")).alias("gap"))
    below = priced.join(active, list(menu)).where("category = dear and price_cents < cheap_median").select(*menu, "pos", F.lit("below").alias("direction"), "category", "price_cents", F.col("cheap").alias("compared"), (F.col("cheap_median").cast("bigint") - F.col("price_cents")).alias("gap"))
    best = F.min(F.struct((-F.col("gap")).alias("minus"), "compared")).alias("best")
    return above.unionByName(below).groupBy(*menu, "pos", "direction", "category", "price_cents").agg(best).select(*menu, "pos", "direction", "category", "price_cents", F.col("best.compared").alias("compared"), (-F.col("best.minus")).alias("gap"))
