"""Grouped order statistics and modes that neither collect a group nor approximate."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Running sums and look-ups in order go by stretches of 2 ** STRETCH whole numbers, so that a task's share has at most so
#: many distinct ones however large a group is; what precedes a stretch is added from one row for each.
STRETCH = 12


def running_sums(rows: DataFrame, keys: Sequence[str], x: str, value: str, name: str) -> DataFrame:
    """rows with the sum of value at lower x (bigint, one row for each of a group) as name."""
    cut = rows.withColumn("_stretch", F.shiftright(x, STRETCH))
    lower = (W.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "_stretch").agg(F.sum(value).alias("_sum"))
    before = sums.select(*keys, "_stretch", F.sum("_sum").over(W.partitionBy(*keys).orderBy("_stretch").rowsBetween(*lower)).alias("_before"))
    inside = cut.withColumn("_inside", F.sum(value).over(W.partitionBy(*keys, "_stretch").orderBy(x).rowsBetween(*lower)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return inside.join(before, [*keys, "_stretch"]).withColumn(name, zero("_inside") + zero("_before")).drop("_stretch", "_inside", "_before")


def as_of(points: DataFrame, queries: DataFrame, keys: Sequence[str], x: str, value: str) -> DataFrame:
    """keys, x and value for each distinct keys and x (bigint) of queries: that of the group's last point at x or lower; left out if there is none."""
    known = points.select(*keys, x, F.struct(x, value).alias("_point"))
    asked = queries.select(*keys, x).distinct()
    every = known.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True).withColumn("_stretch", F.shiftright(x, STRETCH))
    last = every.groupBy(*keys, "_stretch").agg(F.max("_point").alias("_point"))
    before = last.select(*keys, "_stretch", F.max("_point").over(W.partitionBy(*keys).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    inside = every.withColumn("_inside", F.max("_point").over(W.partitionBy(*keys, "_stretch").orderBy(x).rangeBetween(W.unboundedPreceding, W.currentRow)))
    found = inside.where("_asked").join(before, [*keys, "_stretch"]).withColumn("_found", F.coalesce("_inside", "_before"))
    return found.where("_found is not null").select(*keys, x, F.col("_found")[value].alias(value))


def values_at_ranks(df: DataFrame, keys: Sequence[str], value: str, picks: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, n and, for each pick, the value at a rank (from 0) that is a function of n.

    Rows are first counted per distinct value, with partial aggregation, so a hot group shrinks to its distinct values
    before anything is ordered; running counts then stream. NULL values don't count.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_value")).agg(F.count("*").alias("_c"))
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("n"))
    before = F.sum("_c").over(W.partitionBy(*keys).orderBy("_value").rowsBetween(W.unboundedPreceding, -1))
    ranked = counts.withColumn("_from", F.coalesce(before, F.lit(0))).join(totals, list(keys))
    here = lambda rank: (F.col("_from") <= rank) & (rank < F.col("_from") + F.col("_c"))
    return ranked.groupBy(*keys).agg(F.first("n").alias("n"), *(F.max(F.when(here(rank(F.col("n"))), F.col("_value"))).alias(name) for name, rank in picks.items()))


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """keys, n and the exact median (mean of the middle two) as double."""
    picks = {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2)}
    out = values_at_ranks(df, keys, value, picks)
    return out.select(*keys, "n", ((F.col("_low").cast("double") + F.col("_high").cast("double")) / 2).alias(name))


def half_split(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, n, median, q1 and q3, where q1 is the median of the first n div 2 values and q3 that of the rest."""
    half = lambda n: F.floor(n / 2)
    rest = lambda n: n - F.floor(n / 2)
    picks = {
        "_m0": lambda n: F.floor((n - 1) / 2), "_m1": lambda n: F.floor(n / 2),
        "_a0": lambda n: F.floor((half(n) - 1) / 2), "_a1": lambda n: F.floor(half(n) / 2),
        "_b0": lambda n: half(n) + F.floor((rest(n) - 1) / 2), "_b1": lambda n: half(n) + F.floor(rest(n) / 2),
    }
    out = values_at_ranks(df, keys, value, picks)
    mean = lambda a, b: (F.col(a).cast("double") + F.col(b).cast("double")) / 2
    return out.select(*keys, "n", mean("_m0", "_m1").alias("median"), mean("_a0", "_a1").alias("q1"), mean("_b0", "_b1").alias("q3"))


def first_seen_mode(df: DataFrame, keys: Sequence[str], value: str, position: str) -> DataFrame:
    """keys, mode, mode_count and n: the most frequent value, of equals the one at the least position."""
    counts = df.groupBy(*keys, F.col(value).alias("_value")).agg(F.count("*").alias("_c"), F.min(position).alias("_p"))
    best = F.max_by("_value", F.struct("_c", -F.col("_p")))
    return counts.groupBy(*keys).agg(best.alias("mode"), F.max("_c").alias("mode_count"), F.sum("_c").alias("n"))


def mad_outliers(df: DataFrame, keys: Sequence[str], value: str, least: int = 3, floor: float = 0.10, factor: float = 3.0) -> DataFrame:
    """Rows farther than factor times max(MAD, floor * median) from the median of their group, with the figures.

    Groups under least rows, or with a median not over 0, have none.
    """
    own = medians(df, keys, value).where((F.col("n") >= least) & (F.col("median") > 0))
    near = df.join(own, list(keys)).withColumn("deviation", F.abs(F.col(value) - F.col("median")))
    spread = medians(near, keys, "deviation", "mad").drop("n")
    limit = factor * F.greatest("mad", F.col("median") * floor)
    out = near.join(spread, list(keys)).withColumn("threshold", limit)
    return out.where("deviation > threshold").withColumn("direction", F.when(F.col(value) > F.col("median"), "above").otherwise("below"))
