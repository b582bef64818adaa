"""Names and categories: duplicates, neighbours, inference, hierarchy."""

from __future__ import annotations

import difflib
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names

#: Similarity from which two names are fuzzy duplicates, and their least length.
FUZZY, FUZZY_LENGTH = 0.82, 4


def duplicate_names(items: DataFrame, menu: Sequence[str]) -> DataFrame:
    """Groups of two or more items with one normalized name: info if all cost the same, else warn; one row per item."""
    named = items.withColumn("norm", names.normalized(F.col("name"))).where("norm != ''")
    groups = named.groupBy(*menu, "norm").agg(F.count("*").alias("group_size"), F.countDistinct("price_cents").alias("prices")).where("group_size > 1")
    found = named.join(groups, [*menu, "norm"])
    return found.withColumn("severity", F.when(F.col("prices") <= 1, "info").otherwise("warn")).drop("prices")


def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; the earlier item's name is on the left, as the ratio isn't symmetric."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def fuzzy_names(items: DataFrame, menu: Sequence[str], threshold: float = FUZZY) -> DataFrame:
    """Pairs of different normalized names in one menu at a similarity of threshold or more.

    Names are compared once per menu, however many items have them. The ratio is 2M / (a + b) with M at most the shorter
    length, so pairs are first joined on bands of length that contain all that can reach the threshold, and on a shared
    letter count bound; only then is the ratio computed.
    """
    least = threshold / (2 - threshold)
    distinct = items.withColumn("norm", names.normalized(F.col("name"))).where(F.length("norm") >= FUZZY_LENGTH).groupBy(*menu, "norm").agg(F.min("pos").alias("pos"))
    # logarithmic bands: a partner is in the same band or a neighbouring one
    band = F.floor(F.log(F.length("norm").cast("double")) / F.log(F.lit(1 / least)))
    left = distinct.select(*menu, F.explode(F.array(band - 1, band, band + 1)).alias("band"), F.col("norm").alias("a"), F.col("pos").alias("a_pos"))
    right = distinct.select(*menu, band.alias("band"), F.col("norm").alias("b"), F.col("pos").alias("b_pos"))
    short, long_ = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    pairs = left.join(right, [*menu, "band"]).where((F.col("a_pos") < F.col("b_pos")) & (F.col("a") != F.col("b")) & (short >= least * long_))
    # M counts matched characters, so it is at most the size of the multiset intersection of letters
    letters = [F.least(F.length("a") - F.length(F.replace("a", F.lit(c))), F.length("b") - F.length(F.replace("b", F.lit(c)))) for c in "abcdefghijklmnopqrstuvwxyz"]
    other = F.least(F.length(F.regexp_replace("a", "[a-z]", "")), F.length(F.regexp_replace("b", "[a-z]", "")))
    shared = sum(letters, other)
    pairs = pairs.where(2 * shared >= threshold * (F.length("a") + F.length("b")))
    ratio = F.pandas_udf(similarity, "double")
    return pairs.withColumn("similarity", ratio("a", "b")).where(F.col("similarity") >= threshold).select(*menu, "a_pos", "b_pos", "a", "b", F.round("similarity", 3).alias("similarity"))


def neighbours(column: str, menu: Sequence[str], reach: int, order: str = "pos") -> Column:
    """Values within reach places before and after, itself left out, in order, NULL dropped."""
    w = W.partitionBy(*menu).orderBy(order)
    near = [F.lag(column, k).over(w) for k in range(reach, 0, -1)] + [F.lead(column, k).over(w) for k in range(1, reach + 1)]
    return F.filter(F.array(*near), lambda x: x.isNotNull())


def dominant(array: Column) -> Column:
    """The most frequent element, of equals the first seen; as a struct of n and value."""
    count = lambda v: F.size(F.filter(array, lambda x: x == v))
    ranked = F.transform(F.array_distinct(array), lambda v: F.struct(count(v).alias("n"), (-F.array_position(array, v)).alias("p"), v.alias("value")))
    return F.array_max(ranked)


def isolated(items: DataFrame, menu: Sequence[str], reach: int = 2) -> DataFrame:
    """Items of which none of two or more neighbours has the category."""
    near = items.withColumn("near", neighbours("category", menu, reach)).where(F.col("category").isNotNull() & (F.size("near") >= 2))
    lone = near.where(~F.array_contains("near", F.col("category")))
    return lone.withColumn("dominant_category", dominant(F.col("near"))["value"]).withColumn("neighbours", F.array_join("near", ",")).drop("near")


def suggestions(items: DataFrame, menu: Sequence[str], keywords: Mapping[str, Sequence[str]], bands: Mapping[str, tuple[int, int]], reach: int = 3) -> DataFrame:
    """Items whose neighbours agree on another category, with a confidence from agreement, keywords, price band and category_confidence."""
    near = items.withColumn("near", neighbours("category", menu, reach)).where(F.col("category").isNotNull() & (F.size("near") >= 3))
    best = near.withColumn("best", dominant(F.col("near"))).withColumn("suggested", F.col("best.value")).where("suggested != category")
    best = best.withColumn("agreement", F.col("best.n") / F.size("near")).where("agreement >= 0.6")
    name = names.normalized(F.col("name"))

    def pick(category: Column, of: Mapping[str, Column], default: Column) -> Column:
        out = default
        for k, v in of.items():
            out = F.when(category == k, v).otherwise(out)
        return out

    hits = {c: sum((name.contains(w).cast("int") for w in words), F.lit(0)) for c, words in keywords.items()}
    fits = {c: F.col("price_cents").between(low, high) & (F.col("price_cents") > 0) for c, (low, high) in bands.items()}
    own, other = pick(F.col("category"), hits, F.lit(0)), pick(F.col("suggested"), hits, F.lit(0))
    fit_own, fit_other = pick(F.col("category"), fits, F.lit(False)), pick(F.col("suggested"), fits, F.lit(False))
    conf = F.coalesce(F.col("category_confidence"), F.lit(50))
    score = F.col("agreement") * 0.40 + F.when(other > own, 0.20).when(own > other, -0.20).otherwise(0.0) + F.when(fit_other & ~fit_own, 0.15).when(fit_own & ~fit_other, -0.15).otherwise(0.0) + F.when(conf < 50, 0.10).when(conf >= 80, -0.15).otherwise(0.0)
    out = best.where(own < 2).withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))
    return out.where("confidence >= 0.30").select(*menu, "pos", "category", "suggested", F.round("agreement", 3).alias("agreement"), F.round("confidence", 3).alias("confidence"))


def infer_category(name: Column, keywords: Mapping[str, Sequence[str]], bands: Mapping[str, tuple[int, int]], price: Column, fallback: str) -> Column:
    """struct of category, confidence and raw score: per category 4 for each keyword, +2 in its price band, -1 far outside; the first best wins."""
    low = F.lower(F.coalesce(name, F.lit("")))
    scores = []
    for k, (category, words) in enumerate(keywords.items()):
        hits = sum((low.contains(w).cast("int") for w in words), F.lit(0))
        a, b = bands[category]
        band = F.when(price.isNull() | (price <= 0), 0).when(price.between(a, b), 2).when((price < a // 2) | (price > b * 2), -1).otherwise(0)
        scores.append(F.struct((4 * hits + band).alias("raw"), F.lit(-k).alias("order"), F.lit(category).alias("category")))
    best = F.array_max(F.array(*scores))
    none = best["raw"] <= 0
    cheap = F.coalesce(price, F.lit(1 << 30)) <= 799
    return F.struct(
        F.when(none, F.when(cheap, "Beverages").otherwise(fallback)).otherwise(best["category"]).alias("category"),
        F.when(none, F.when(cheap, 35).otherwise(15)).otherwise(F.lit(40) + F.least(6 * best["raw"], F.lit(55))).alias("confidence"),
        best["raw"].alias("raw"),
    )


def sequential_categories(lines: DataFrame, menu: Sequence[str], order: str, category: str = "category") -> DataFrame:
    """Missing categories from the last known or inferred one before: a carry, so a running last value is enough."""
    w = W.partitionBy(*menu).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("inferred", F.last(category, ignorenulls=True).over(w))


def token_similarity(a: Column, b: Column, category_a: Column | None = None, category_b: Column | None = None) -> Column:
    """0 to 100: the share of the left name's distinguishing tokens, its category's kinds included, that the right one has."""
    none = F.lit("")
    own = F.array_union(names.menu_tokens(a), names.type_tokens(none if category_a is None else category_a))
    other = F.array_union(names.menu_tokens(b), names.type_tokens(none if category_b is None else category_b))
    return F.when(F.size(own) == 0, 0).otherwise(F.floor(100 * F.size(F.array_intersect(own, other)) / F.size(own) + 0.5).cast("int"))
