"""Clean-up of names and descriptions of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleanup
from ..functions import grammar as G
from ..functions import rescue as R


def cleaned_items(items: DataFrame, name: str = "name", description: str = "description") -> DataFrame:
    """The items with name and description cleaned; all else stays. A name that cleans to nothing stays too. Each step is a
    projection of its own, so that none is computed more than once."""
    raw = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    step = items.withColumn("_raw", raw(description)).withColumn("_name", R.item_name(raw(name)))
    step = step.withColumn("_split", R.rescued(F.col("_name"), F.col("_raw")))
    step = step.withColumn("_whole", F.trim(F.concat_ws(" ", F.nullif("_raw", F.lit("")), F.nullif("_split.tail", F.lit("")))))
    step = step.withColumn("_soft", R.spelled_with(R.smoothed(R.marks(cleanup.runs(F.col("_whole"))))))
    step = step.withColumn("_soft", R.without_symbols(F.col("_soft")))
    step = step.withColumn("_soft", R.joined(F.col("_soft")))
    step = step.withColumn("_salvaged", R.salvaged(F.col("_whole"), F.col("_soft")))
    told = R.tagged(F.col("_whole"), F.col("_soft"), F.col("_salvaged"))
    shown = F.coalesce(F.nullif("_split.name", F.lit("")), raw(name))
    return step.withColumns({name: shown, description: told}).drop("_raw", "_name", "_split", "_whole", "_soft", "_salvaged")


def components(rows: DataFrame, text: str, name: str = "components") -> DataFrame:
    """The rows with struct(parts, toppings, sauce, preparation, flavors) of a description. A part has the kind of the longest
    known word in it. The first sauce is the sauce, the first way of making the preparation, what is left of that part a
    topping; tastes are flavors, all else toppings. Two parts or more that are tastes alone are all flavors. Each step is a
    projection of its own, as a lambda would compute it once for each part."""
    step = rows.withColumn("_parts", G.description_parts(F.col(text)))
    step = step.withColumn("_rows", G.told_parts(F.col("_parts")))
    tastes = F.col("_tastes")
    step = step.withColumn("_tastes", (F.size("_rows") >= 2) & F.forall("_rows", lambda r: r["low"].isin(*G.TASTES)))
    step = step.withColumn("_sauce", F.try_element_at(F.filter("_rows", lambda r: ~tastes & (r["kind"] == "sauce")), F.lit(1)))
    is_sauce = lambda r: r["i"].eqNullSafe(F.col("_sauce.i"))
    step = step.withColumn("_made", F.try_element_at(F.filter("_rows", lambda r: ~tastes & ~is_sauce(r) & (r["way"].isNotNull() | r["kind"].eqNullSafe("preparation"))), F.lit(1)))
    step = step.withColumn("_way", F.coalesce("_made.way", "_made.word"))
    low, way = F.col("_made.low"), F.col("_way")
    left = F.trim(F.concat(F.substr(low, F.lit(1), F.instr(low, way) - 1), F.substr(low, F.instr(low, way) + F.length(way))))
    is_made = lambda r: r["i"].eqNullSafe(F.col("_made.i"))
    is_taste = lambda r: tastes | r["kind"].eqNullSafe("flavor")
    others = F.filter("_rows", lambda r: ~is_sauce(r) & (is_made(r) | ~is_taste(r)))
    toppings = F.filter(F.transform(others, lambda r: F.when(is_made(r), left).otherwise(r["part"])), lambda t: t != "")
    flavors = F.transform(F.filter("_rows", lambda r: ~is_sauce(r) & ~is_made(r) & is_taste(r)), lambda r: r["low"])
    sauce = F.trim(F.regexp_replace("_sauce.word", " (?:base|sauce|dressing)$", ""))
    whole = F.struct(F.col("_parts").alias("parts"), toppings.alias("toppings"), sauce.alias("sauce"), way.alias("preparation"), flavors.alias("flavors"))
    return step.withColumn(name, whole).drop("_parts", "_rows", "_tastes", "_sauce", "_made", "_way")
