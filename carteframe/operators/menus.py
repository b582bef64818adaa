"""Version snapshots and schedules: diffs, summaries, conflicts, coverage, transitions, health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names

#: Weekdays in order; hour slots of the coverage.
DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
SLOTS = list(range(6, 24))


def diff(a: DataFrame, b: DataFrame, menu: Sequence[str]) -> DataFrame:
    """Full outer diff of two snapshots: one row per item with status added, removed, modified or unchanged and the changed fields.

    Items pair by name where it is unique on both sides, else by name and category in order of position."""
    key = names.key(F.col("name"))

    def side(df: DataFrame, s: str) -> DataFrame:
        once = F.count("*").over(W.partitionBy(*menu, "key")) == 1
        return df.withColumn("key", key).select(*menu, "key", F.col("name").alias(f"name_{s}"), F.col("category").alias(f"category_{s}"), F.col("price_cents").alias(f"price_{s}"), F.col("pos").alias(f"pos_{s}"), once.alias(f"once_{s}"))

    left, right = side(a, "a"), side(b, "b")
    on = [*menu, "key"]
    single = left.where("once_a").select(*on).join(right.where("once_b").select(*on), on).distinct()

    def keyed(df: DataFrame, s: str) -> DataFrame:
        marked = df.join(single.withColumn("_single", F.lit(True)), on, "left")
        sub = F.when(F.col("_single"), "").otherwise(names.key(F.col(f"category_{s}")))
        nth = F.row_number().over(W.partitionBy(*on, "sub").orderBy(f"pos_{s}"))
        return marked.withColumn("sub", sub).withColumn("nth", nth).drop("_single", f"once_{s}")

    both = keyed(left, "a").join(keyed(right, "b"), [*on, "sub", "nth"], "full")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    changes = F.array_compact(F.array(
        F.when(text("name_a") != text("name_b"), "name"), F.when(text("category_a") != text("category_b"), "category"),
        F.when(~F.col("price_a").eqNullSafe(F.col("price_b")), "price"), F.when(~F.col("pos_a").eqNullSafe(F.col("pos_b")), "position"),
    ))
    status = F.when(F.col("pos_a").isNull(), "added").when(F.col("pos_b").isNull(), "removed").when(F.size(changes) > 0, "modified").otherwise("unchanged")
    return both.withColumn("status", status).withColumn("fields", F.when(F.col("status") == "modified", F.array_join(changes, ",")).otherwise("")).withColumn("direction", direction(F.col("price_a"), F.col("price_b"))).drop("sub", "nth")


def direction(old: Column, new: Column) -> Column:
    return F.when(new > old, "increase").when(new < old, "decrease")


def variant_diff(a: DataFrame, b: DataFrame, item: Sequence[str], label: str) -> DataFrame:
    """Multiset diff of variants by label, equal labels paired in order of price."""
    nth = F.row_number().over(W.partitionBy(*item, "label").orderBy("price_cents"))
    side = lambda df, s: df.withColumn("label", names.key(F.col(label).cast("string"))).withColumn("nth", nth).select(*item, "label", "nth", F.col("price_cents").alias(f"price_{s}"))
    both = side(a, "a").join(side(b, "b"), [*item, "label", "nth"], "full")
    return both.withColumn("status", F.when(F.col("price_a").isNull(), "added").when(F.col("price_b").isNull(), "removed").when(F.col("price_a") != F.col("price_b"), "modified").otherwise("unchanged"))


def change_summary(diffs: DataFrame, menu: Sequence[str]) -> DataFrame:
    count = lambda c, name: F.sum(c.cast("long")).alias(name)
    s, d = F.col("status"), F.col("direction")
    return diffs.groupBy(*menu).agg(count(s == "added", "n_added"), count(s == "removed", "n_removed"), count(s == "modified", "n_modified"), F.sum(F.coalesce((d == "increase").cast("long"), F.lit(0))).alias("n_up"), F.sum(F.coalesce((d == "decrease").cast("long"), F.lit(0))).alias("n_down"))


def latest(versions: DataFrame, menu: Sequence[str], number: str) -> DataFrame:
    """The newest version of each menu: an aggregate, so a menu with very many versions isn't sorted."""
    rest = [c for c in versions.columns if c not in menu]
    return versions.groupBy(*menu).agg(F.max_by(F.struct(*rest), F.col(number)).alias("_v")).select(*menu, "_v.*")


def overlap_conflicts(schedules: DataFrame, owner: str = "owner", days: int = 32) -> DataFrame:
    """Pairs of one owner's schedules that share a day (closed ranges) and an hour (open ranges); NULL bounds are open.

    A hot owner isn't paired all with all: ranges are cut into buckets of days, open ends into one bucket of their own,
    and a pair is made in the bucket where the later of the two starts.
    """
    start = F.floor(F.datediff("date_from", F.lit("1970-01-01")) / days)
    stop = F.floor(F.datediff("date_to", F.lit("1970-01-01")) / days)
    closed = schedules.where("date_to is not null").withColumn("bucket", F.explode(F.sequence(start, stop)))
    opened = schedules.where("date_to is null")
    of = lambda df, s: df.select(F.col(owner), *([F.col("bucket")] if "bucket" in df.columns else []), *(F.col(c).alias(f"{c}_{s}") for c in ("id", "date_from", "date_to", "hour_from", "hour_to")))
    starts = schedules.withColumn("bucket", start)
    end = lambda s: F.coalesce(F.col(f"date_to_{s}"), F.lit("9999-12-31").cast("date"))
    hour = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    later = (F.col("date_from_b") > F.col("date_from_a")) | (F.col("date_from_b") == F.col("date_from_a")) & (F.col("id_b") > F.col("id_a"))
    hours = (hour("hour_from_a", 0) < hour("hour_to_b", 24)) & (hour("hour_from_b", 0) < hour("hour_to_a", 24))
    near = of(closed, "a").join(of(starts, "b"), [owner, "bucket"]).drop("bucket")
    far = of(opened, "a").join(of(schedules, "b"), owner)
    pairs = near.unionByName(far).where(later & hours & (F.col("date_from_b") <= end("a")))
    timed = F.col("hour_from_a").isNotNull() & F.col("hour_from_b").isNotNull()
    return pairs.select(owner, F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), F.when(timed, "time").otherwise("full").alias("overlap_type"))


def coverage(schedules: DataFrame, owner: str = "owner") -> DataFrame:
    """Per owner and hour slot the number of schedules active in it: one pass, each schedule once per slot."""
    slots = schedules.withColumn("slot", F.explode(F.array(*map(F.lit, SLOTS))))
    active = (F.coalesce("hour_from", F.lit(0)) <= F.col("slot")) & (F.col("slot") < F.coalesce("hour_to", F.lit(24)))
    return slots.groupBy(owner, "slot").agg(F.sum(active.cast("long")).alias("n_active"))


def specificity(season: Column, date_from: Column, date_to: Column, days: Column, time_from: Column, time_to: Column, kind: Column) -> Column:
    has = lambda c: c.isNotNull()
    pair = lambda a, b, full, part: F.when(has(a) & has(b), full).when(has(a) | has(b), part).otherwise(0)
    return F.when(has(season), 15).otherwise(0) + pair(date_from, date_to, 25, 10) + F.when(has(days), 20).otherwise(0) + pair(time_from, time_to, 30, 10) + F.when(has(kind), 10).otherwise(0)


def active_on(schedules: DataFrame, day: str, hour: int) -> DataFrame:
    """Schedules in force on a day and hour; NULL bounds are open."""
    date = F.lit(day).cast("date")
    dates = (F.col("date_from").isNull() | (F.col("date_from") <= date)) & (F.col("date_to").isNull() | (F.col("date_to") >= date))
    return schedules.where(dates & (F.coalesce("hour_from", F.lit(0)) <= hour) & (F.lit(hour) < F.coalesce("hour_to", F.lit(24))))


def next_transition(schedules: DataFrame, day: str, hour: int, owner: str = "owner") -> DataFrame:
    """Per owner the first start or end after the hour among schedules of the day; of equals the least id, starts first."""
    date = F.lit(day).cast("date")
    today = schedules.where((F.col("date_from") <= date) & (F.col("date_to").isNull() | (F.col("date_to") >= date)))
    turns = F.array(F.struct(F.col("hour_from").alias("hour"), "id", F.lit("starts").alias("type")), F.struct(F.col("hour_to").alias("hour"), "id", F.lit("ends").alias("type")))
    later = today.withColumn("t", F.explode(turns)).where(F.col("t.hour") > hour)
    order = F.struct("t.hour", "t.id", (F.col("t.type") == "ends").cast("int"))
    return later.groupBy(owner).agg(F.min_by("t", order).alias("t")).select(owner, "t.hour", "t.id", "t.type")


def health(n_versions: Column, n_items: Column, scheduled: Column, typed: Column, described: Column) -> Column:
    add = lambda c, n: F.when(c, n).otherwise(0)
    return F.least(F.lit(100), add(n_versions > 0, 25) + add(n_items > 0, 25) + add(scheduled, 25) + add(typed, 10) + add(described, 5) + add(n_versions >= 2, 10))


def health_grade(score: Column) -> Column:
    return F.when(score >= 80, "A").when(score >= 60, "B").when(score >= 40, "C").otherwise("D")
