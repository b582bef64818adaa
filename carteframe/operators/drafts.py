"""Working copies: snapshots, clones, guarded deletes, partial updates, inheritance, templates, event fan-out, expiry, pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fan-out: subscribers of a list (three lists make one run of Parquet's bit-packed values), lists gathered at once, events of a block, tasks.
LIST, GATHERED, BLOCK, TASKS = 168, 48, 128, 192
#: Subscriptions up to which lists are sent to every task; parts of the events of one type if they are, and if each part has copies of its lists.
SENT, SLICES, COPIES = 1 << 20, 1024, 64


def clone(rows: DataFrame, key: str, offset: int, links: Sequence[str] = ()) -> DataFrame:
    """A deep copy under new keys: every key and link is moved by one offset past the last key, so links stay right without a join."""
    return rows.withColumns({c: F.col(c) + offset for c in (key, *links)})


def restore(versions: DataFrame, items: DataFrame, menu: str, number: str) -> DataFrame:
    """Items of the newest version of each menu, as rows of a draft in their old order."""
    newest = versions.groupBy(menu).agg(F.max(number).alias(number))
    return items.join(newest, [menu, number]).withColumn("position", F.row_number().over(W.partitionBy(menu).orderBy("pos"))).drop(number)


def deletable(versions: DataFrame, menu: str) -> DataFrame:
    """Versions that may go: not pinned, and not the only one of their menu."""
    several = versions.groupBy(menu).agg(F.count("*").alias("_n")).where("_n > 1").select(menu)
    return versions.where("not pinned").join(several, menu, "left_semi")


def partial_update(rows: DataFrame, changes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """fields take the new value where there is one; NULL keeps the old."""
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in fields))
    return rows.join(new, key, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in fields}).drop(*(f"_new_{c}" for c in fields))


def inherit(variants: DataFrame, markers: DataFrame, menu: str) -> DataFrame:
    """Rows of a source category for the target categories that name it, as far as the target knows their size.

    markers: menu, source, target. variants: menu, category, name, size, price_cents."""
    known = variants.select(menu, F.col("category").alias("target"), "size").distinct()
    copied = variants.withColumnRenamed("category", "source").join(markers, [menu, "source"])
    return copied.join(known, [menu, "target", "size"], "left_semi").select(menu, F.col("target").alias("category"), "name", "size", "price_cents")


def template_rows(groups: DataFrame, array: str) -> DataFrame:
    """One row per element of a template's array, numbered from 1; an empty template gives none."""
    return groups.select("*", F.posexplode(array).alias("_at", "entry")).withColumn("position", F.col("_at") + 1).drop("_at", array)


def fan_out(events: DataFrame, subscribers: DataFrame, owner: str, most: int = SENT) -> DataFrame:
    """Events for each subscriber of their type: of their own restaurant or of all (NULL). Two equi-joins, so no pair is made in vain.

    Subscribers go in lists of LIST, events of a type in blocks of BLOCK, and every pair of a block and a list is written out where it
    is made: a list's subscribers repeat at short distance, so the files are small. While there are most subscriptions or fewer,
    lists are sent to every task and only events that have one are exchanged; if there are more, lists are exchanged too."""
    each = subscribers.withColumn("event_type", F.explode(F.transform(F.split("events", ","), lambda e: F.lower(F.trim(e)))))
    own = each.where(F.col(owner).isNotNull()).withColumn(owner, F.col(owner).try_cast(events.schema[owner].dataType))
    sent = each.count() <= most

    def cut(column: str, n: int) -> Column:
        return F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size(column) - 1) / n).cast("int")), lambda k: F.slice(column, k * n + 1, n)))

    def gathered(column: str) -> Column:
        """With NULL, which a list of the column itself would leave out."""
        return F.sort_array(F.collect_list(F.struct(column)))[column].alias("_all")

    def met(each: DataFrame, keys: list[str]) -> DataFrame:
        sizes = each.groupBy(*keys).agg(F.count("*").alias("_n"))
        part = F.pmod(F.xxhash64("subscriber"), F.ceil(F.col("_n") / (GATHERED * LIST)))
        lists = each.join(sizes, keys).groupBy(*keys, part.alias("_part")).agg(gathered("subscriber")).select(*keys, cut("_all", LIST).alias("_list"))
        slot = F.struct(*keys, "_slice").alias("_slot")  # one key, as of several a constant one is left out
        slices = F.pmod(F.xxhash64("event_id"), F.lit(SLICES if sent else COPIES)).cast("int")
        wanted = events.join(F.broadcast(sizes), keys, "left_semi") if sent else events.dropna(subset=keys)
        # a stated number of tasks: by its bytes adaptive execution would put all into one
        dealt = wanted.withColumn("_slice", slices).select(slot, "event_id").repartition(TASKS, "_slot")
        blocks = dealt.groupBy("_slot").agg(gathered("event_id")).select("_slot", cut("_all", BLOCK).alias("_block"))
        if sent:
            pairs = blocks.select("_slot.*", "_block").join(F.broadcast(lists), keys)
        else:
            copies = lists.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
            pairs = blocks.join(copies.select(slot, "_list").repartition(TASKS, "_slot").hint("merge"), "_slot")
        # coalesce ends the generated code of the join, which would hold the rows of all lists of a block at once
        return pairs.select("_block", "_list").coalesce(TASKS).select(F.explode("_block").alias("event_id"), "_list").select("event_id", F.explode("_list").alias("subscriber"))

    return met(own, ["event_type", owner]).unionByName(met(each.where(F.col(owner).isNull()), ["event_type"]))


def fresh(cache: DataFrame, written: str, now: Column, days: int) -> DataFrame:
    """Cache rows that haven't expired."""
    return cache.where(F.col(written) + F.make_interval(days=F.lit(days)) >= now)


def page(rows: DataFrame, conditions: Mapping[str, object], order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows that meet the conditions given (None: not asked for), one page in order."""
    for column, value in conditions.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(*order).offset(offset).limit(limit)


def relabel(variants: DataFrame, labels: Mapping[int, str], menu: Sequence[str]) -> DataFrame:
    """New labels by place inside each group; places without a new label keep theirs."""
    place = F.row_number().over(W.partitionBy(*menu).orderBy("ordinal"))
    names = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return variants.withColumn("label", F.coalesce(F.try_element_at(names, place), F.col("label")))


def grouped_modifiers(variants: DataFrame, item: str, kind: str) -> DataFrame:
    """Variants by kind as groups: sizes are required, one at most; others optional, any number."""
    rows = variants.groupBy(item, kind).agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    size = F.col(kind) == "size"
    return rows.withColumn("required", size).withColumn("min_select", F.when(size, 1).otherwise(0)).withColumn("max_select", F.when(size, F.lit(1).cast("bigint")).otherwise(F.col("n")))
