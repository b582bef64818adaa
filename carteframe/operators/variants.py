"""Checks of an item's variants and of variant patterns across items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats


def count_outliers(variants: DataFrame, item: Sequence[str], group: Sequence[str], order: str, gap: int = 2) -> DataFrame:
    """Items with at least gap variants fewer than the mode of their group; items with one variant don't count."""
    sizes = variants.groupBy(*group, *item).agg(F.count("*").alias("n_variants")).where("n_variants >= 2")
    mode = stats.first_seen_mode(sizes, group, "n_variants", order).where("n >= 3")
    return sizes.join(mode, list(group)).where(F.col("mode") - F.col("n_variants") >= gap).withColumnRenamed("n", "group_items")


def label_sets(variants: DataFrame, item: Sequence[str], group: Sequence[str], label: str, order: str, share: float = 0.60) -> DataFrame:
    """Items whose set of labels is neither part of their group's dominant set nor holds it."""
    sets = variants.groupBy(*group, *item).agg(F.sort_array(F.collect_set(label)).alias("labels")).where(F.size("labels") >= 2)
    common = stats.first_seen_mode(sets, group, "labels", order).where((F.col("n") >= 3) & (F.col("mode_count") / F.col("n") >= share))
    found = sets.join(common, list(group))
    inside = lambda a, b: F.size(F.array_except(a, b)) == 0
    return found.where(~inside("labels", "mode") & ~inside("mode", "labels")).withColumnRenamed("n", "group_items")


def steps(variants: DataFrame, item: Sequence[str], order: str, price: str = "price_cents") -> DataFrame:
    """Each variant with the price before it in its item and the step between the two."""
    before = F.lag(price).over(W.partitionBy(*item).orderBy(order))
    return variants.withColumn("before", before).withColumn("step", F.col(price) - F.col("before"))


def inversions(variants: DataFrame, item: Sequence[str], order: str) -> DataFrame:
    """Variants that cost less than the next smaller one; equal prices are allowed."""
    return steps(variants.where("price_cents > 0"), item, order).where("step < 0")


def step_outliers(variants: DataFrame, item: Sequence[str], group: Sequence[str], order: str) -> DataFrame:
    """Items whose mean positive step is far from their group's by the MAD rule with a floor of 15 %."""
    means = steps(variants.where("price_cents > 0"), item, order).where("step > 0").groupBy(*group, *item).agg(F.sum("step").alias("_s"), F.count("*").alias("_n"))
    return stats.mad_outliers(means.select(*group, *item, (F.col("_s") / F.col("_n")).alias("mean_step")), group, "mean_step", floor=0.15)


def gaps(variants: DataFrame, item: Sequence[str], order: str) -> DataFrame:
    """Per item the sizes missing between its smallest and largest, sizes being places of one chain."""
    spans = variants.groupBy(*item).agg(F.min(order).alias("low"), F.max(order).alias("high"), F.sort_array(F.collect_set(order)).alias("have")).where("high > low")
    missing = F.array_except(F.sequence("low", "high"), F.col("have"))
    return spans.withColumn("missing", missing).where(F.size("missing") > 0)


def repeated_labels(variants: DataFrame, item: Sequence[str], label: str) -> DataFrame:
    return variants.groupBy(*item, label).agg(F.count("*").alias("n")).where("n > 1")


def zero_prices(variants: DataFrame, item: Sequence[str]) -> DataFrame:
    """Variants without price whose item has variants with one."""
    priced = variants.where("price_cents > 0").select(*item).distinct()
    return variants.where("coalesce(price_cents, 0) = 0").join(priced, list(item), "left_semi")


def kinds(variants: DataFrame, item: Sequence[str], kind: str) -> DataFrame:
    """Items that mix kinds of variants: info for two, warn from three."""
    found = variants.groupBy(*item).agg(F.countDistinct(kind).alias("n_kinds")).where("n_kinds >= 2")
    return found.withColumn("severity", F.when(F.col("n_kinds") >= 3, "warn").otherwise("info"))


def confidence(base: Column, has_label: Column, has_grammar: Column, on_grid: Column, warns: Column, infos: Column) -> Column:
    """Base plus signals minus flags, kept within 0.05 and 1."""
    raw = base + F.when(has_label, 0.10).otherwise(-0.10) + F.when(has_grammar, 0.05).otherwise(0.0) + F.when(on_grid, 0.10).otherwise(0.0) - 0.15 * warns - 0.05 * infos
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), raw))
