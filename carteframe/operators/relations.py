"""Look-ups, nests, logs and roll-ups over drafts, menus and their children; sequences of numbers; typed export rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Features of each account tier.
FEATURES = {
    "free": ["editor", "save_menus", "csv_json_import", "csv_json_export", "pos_export"],
    "premium": ["editor", "save_menus", "csv_json_import", "csv_json_export", "pos_export", "ai_parse", "ocr_upload", "wizard"],
}
#: Names of option groups by kind of variant; items of one batch; least averages of the grades A, B and C.
KIND_NAMES = {"size": "Size", "combo": "Combo Add-on", "flavor": "Flavor", "style": "Style", "other": "Option"}
BATCH_ITEMS = 40
GRADES = {"A": 80, "B": 60, "C": 40}


def without_listed(children: DataFrame, listed: DataFrame, key: str, parent: str, parent_id: Column) -> DataFrame:
    """children without those listed that belong to the parent; listed keys of other parents stay."""
    gone = listed.select(key).distinct().withColumn("_parent", parent_id)
    return children.join(gone, (children[key] == gone[key]) & (children[parent] == gone["_parent"]), "left_anti")


def looked_up(rows: DataFrame, asked: DataFrame, name: str, key: str) -> DataFrame:
    """Of each asked name the row with it, else the least row that holds it, without regard to case: an equality join
    first, and a search for those alone that it leaves."""
    low = lambda c: F.lower(F.trim(c))
    told = asked.select(F.col("asked"), low(F.col("asked")).alias("_asked")).distinct()
    exact = told.join(rows.select(low(F.col(name)).alias("_name"), key), F.col("_asked") == F.col("_name")).groupBy("asked").agg(F.min(key).alias(key), F.lit(0).alias("rank"))
    left = told.join(exact.select("asked"), "asked", "left_anti").where("_asked != ''")
    held = rows.select(low(F.col(name)).alias("_name"), key).join(F.broadcast(left), F.col("_name").contains(F.col("_asked"))).groupBy("asked").agg(F.min(key).alias(key), F.lit(1).alias("rank"))
    return exact.unionByName(held)


def tree(items: DataFrame, groups: DataFrame, variants: DataFrame) -> DataFrame:
    """Items with their groups, each with its modifiers, and the variants in no group; arrays by position, NULL last, empty
    and never NULL. items: item; groups: item, grp, position; variants: item, grp (NULL: in none), variant, position."""
    place = F.coalesce("position", F.lit(1_000_000_000)).alias("at")
    mods = variants.where("grp is not null").groupBy("item", "grp").agg(F.array_sort(F.collect_list(F.struct(place, "variant"))).alias("modifiers"))
    own = groups.join(mods, ["item", "grp"], "left")
    empty = lambda c, like: F.coalesce(c, F.array().cast(like.schema[c].dataType)).alias(c)
    nested = own.select("item", "grp", "position", empty("modifiers", mods)).groupBy("item").agg(F.array_sort(F.collect_list(F.struct(place, "grp", "modifiers"))).alias("groups"))
    loose = variants.where("grp is null").groupBy("item").agg(F.array_sort(F.collect_list(F.struct(place, "variant"))).alias("ungrouped"))
    return items.join(nested, "item", "left").join(loose, "item", "left").select(*items.columns, empty("groups", nested), empty("ungrouped", loose))


def changes(old: DataFrame, new: DataFrame, order: str, fields: Sequence[str]) -> DataFrame:
    """key, change, before and after: items matched by trimmed lower-case name, of equal names the last in order.

    change is removed, added, or a field's name with its two values; blank and missing text are the same."""
    key = F.lower(F.trim(F.coalesce("name", F.lit(""))))

    def last(rows: DataFrame, side: str) -> DataFrame:
        kept = F.max_by(F.struct("name", *fields), order).alias(side)
        return rows.withColumn("key", key).where("key != ''").groupBy("key").agg(kept)

    both = last(old, "o").join(last(new, "n"), "key", "full")
    text = lambda side, f: F.trim(F.coalesce(F.col(f"{side}.{f}").cast("string"), F.lit("")))
    pair = lambda f: F.when(text("o", f) != text("n", f), F.struct(F.lit(f).alias("change"), text("o", f).alias("before"), text("n", f).alias("after")))
    gone = F.struct(F.lit("removed").alias("change"), text("o", "name").alias("before"), F.lit("").alias("after"))
    come = F.struct(F.lit("added").alias("change"), F.lit("").alias("before"), text("n", "name").alias("after"))
    log = F.when(F.col("n").isNull(), F.array(gone)).when(F.col("o").isNull(), F.array(come)).otherwise(F.array_compact(F.array(pair("name"), *map(pair, fields))))
    return both.select("key", F.inline(log))


def next_numbers(parents: DataFrame, children: DataFrame, parent: str, number: str) -> DataFrame:
    """The number that each parent's next child gets: one more than the highest, 1 for the first."""
    top = children.groupBy(parent).agg(F.max(number).alias("_top"))
    return parents.join(top, parent, "left").select(parent, (F.coalesce("_top", F.lit(0)) + 1).alias("next"))


def versioned(snapshots: DataFrame, parent: str, order: Sequence[str]) -> DataFrame:
    """snapshots numbered from 1 within their parent, with the number before (NULL for the first)."""
    n = F.row_number().over(W.partitionBy(parent).orderBy(*order))
    return snapshots.withColumn("version", n).withColumn("previous", F.when(F.col("version") > 1, F.col("version") - 1))


def newest(rows: DataFrame, parent: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each parent in order; n rows of a parent are all that a task holds beyond a stream."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(parent).orderBy(*order))).where(F.col("rank") <= n)


def reordered(children: DataFrame, lists: DataFrame, parent: str, key: str) -> DataFrame:
    """children with position as their place (from 1) in their parent's list; those not listed keep theirs. lists: parent, ids."""
    places = lists.select(F.col(parent).alias("_parent"), F.posexplode("ids").alias("_at", "_key")).groupBy("_parent", "_key").agg(F.max("_at").alias("_at"))
    joined = children.join(places, (F.col(parent) == F.col("_parent")) & (F.col(key) == F.col("_key")), "left")
    return joined.withColumn("position", F.coalesce(F.col("_at") + 1, F.col("position"))).select(*children.columns)


def cascaded(children: DataFrame, deleted: DataFrame, parent: str, keep: bool = False) -> DataFrame:
    """children after parents were deleted: gone with them, or, with keep, left without a parent."""
    gone = deleted.select(F.col(parent).alias("_gone")).distinct()
    if not keep:
        return children.join(gone, F.col(parent) == F.col("_gone"), "left_anti")
    joined = children.join(gone, F.col(parent) == F.col("_gone"), "left")
    return joined.withColumn(parent, F.when(F.col("_gone").isNull(), F.col(parent))).drop("_gone")


def inserted_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old and those rows of new whose keys it doesn't have."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns))


def replaced_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """new's children in place of all that their parents had."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def base_prices(items: DataFrame, variants: DataFrame) -> DataFrame:
    """items with the least price of their variants, if any, and whether that changed it."""
    least = variants.groupBy("item").agg(F.min(F.coalesce("price_cents", F.lit(0))).alias("_least"))
    out = items.join(least, "item", "left")
    changed = F.col("_least").isNotNull() & ~F.col("_least").eqNullSafe(F.col("price_cents"))
    return out.withColumn("changed", changed).withColumn("price_cents", F.coalesce("_least", "price_cents")).drop("_least")


def batches(items: DataFrame, menu: str, category: str, order: str, size: int = BATCH_ITEMS) -> DataFrame:
    """items with their batch's number in its category: size items at a time, all in one (category NULL) for a small menu."""
    name = F.when(F.trim(F.coalesce(category, F.lit(""))) == "", "Uncategorized").otherwise(F.col(category))
    total = items.groupBy(F.col(menu).alias("_menu")).agg(F.count("*").alias("_n"))
    rows = items.withColumn("_name", name).join(total, F.col(menu) == F.col("_menu"))
    at = F.floor((F.row_number().over(W.partitionBy(menu, "_name").orderBy(order)) - 1) / size)
    small = F.col("_n") <= size
    return rows.withColumn("batch", F.when(small, F.lit(0)).otherwise(at)).withColumn("batch_of", F.when(~small, F.col("_name"))).drop("_menu", "_n", "_name")


def merged_batches(results: DataFrame, run: str, order: str) -> DataFrame:
    """Per run: all lists in one, the last context that isn't empty, the sum of seconds."""
    last = F.max_by("context", F.when(F.trim(F.coalesce("context", F.lit(""))) != "", F.col(order)))
    return results.groupBy(run).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "assessments"))), lambda r: r["assessments"])).alias("assessments"), last.alias("context"), F.sum("seconds").alias("seconds"))


def may_use(tier: Column, feature: Column) -> Column:
    """Whether an account tier has a feature; an unknown tier has none."""
    out = F.when(F.lit(False), F.lit(False))
    for name, features in FEATURES.items():
        out = out.when(tier == name, feature.isin(*features))
    return F.coalesce(out, F.lit(False))


def constraints(season: Column, date_from: Column, date_to: Column, days: Column, start: Column, end: Column) -> Column:
    """How many of season, dates, days and times a schedule sets."""
    filled = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    return sum((x.cast("int") for x in (filled(date_from) | filled(date_to), filled(days), filled(start) | filled(end))), filled(season).cast("int"))


def schedule_text(season: Column, date_from: Column, date_to: Column, days: Column, start: Column, end: Column) -> Column:
    """The constraints of a schedule in words, joined by bars; NULL without any."""
    text = lambda c: F.nullif(F.coalesce(c.cast("string"), F.lit("")), F.lit(""))
    open_ = lambda c: F.coalesce(text(c), F.lit("..."))
    span = lambda a, b, word: F.when(text(a).isNotNull() | text(b).isNotNull(), F.concat(open_(a), F.lit(word), open_(b)))
    return F.nullif(F.concat_ws(" | ", F.initcap(text(season)), span(date_from, date_to, " to "), F.upper(text(days)), span(start, end, " - ")), F.lit(""))


def version_stats(versions: DataFrame, menu: str) -> DataFrame:
    """Per menu: versions, pinned ones, price rises and falls told by their summaries, counts of items oldest first."""
    told = lambda word: F.coalesce(F.regexp_extract("summary", rf"(\d+) price {word}", 1).try_cast("bigint"), F.lit(0))
    trend = F.transform(F.array_sort(F.collect_list(F.struct("version", "n_items"))), lambda v: v["n_items"])
    return versions.groupBy(menu).agg(F.count("*").alias("n_versions"), F.count_if(F.col("pinned")).alias("n_pinned"), F.max("version").alias("latest"), F.sum(told("increase")).alias("n_up"), F.sum(told("decrease")).alias("n_down"), trend.alias("trend"))


def graded(menus: DataFrame, owner: str) -> DataFrame:
    """Per owner: menus, versions, items, pinned current versions, mean health and its grade. menus: n_versions, n_items, pinned, health."""
    out = menus.groupBy(owner).agg(F.count("*").alias("n_menus"), F.sum("n_versions").alias("n_versions"), F.sum("n_items").alias("n_items"), F.count_if("pinned").alias("n_pinned"), F.bround(F.avg("health"), 0).cast("int").alias("health"))
    grade = F.when(F.lit(False), "")
    for name, least in GRADES.items():
        grade = grade.when(F.col("health") >= least, name)
    return out.withColumn("grade", grade.otherwise("D"))


def editor_stats(items: DataFrame, draft: str) -> DataFrame:
    """Per draft: items, categories, percent of items with groups (halves to even), least and highest positive price or 0."""
    price = F.when(F.col("price_cents") > 0, F.col("price_cents"))
    category = F.nullif(F.trim(F.coalesce("category", F.lit(""))), F.lit(""))
    return items.groupBy(draft).agg(
        F.count("*").alias("n_items"), F.countDistinct(category).alias("n_categories"), F.bround(F.count_if("has_groups") * 100 / F.count("*"), 0).cast("int").alias("group_percent"),
        F.coalesce(F.min(price), F.lit(0)).alias("price_min"), F.coalesce(F.max(price), F.lit(0)).alias("price_max"),
    )


def repair_summary(recommendations: DataFrame) -> DataFrame:
    """Per category: items, items with recommendations, recommendations by priority, fixable ones; one row per item comes in
    with an array recs of (priority, type, fixable)."""
    count = lambda p: F.sum(F.size(F.filter("recs", lambda r: r["priority"] == p))).alias(p)
    fixable = F.sum(F.size(F.filter("recs", lambda r: r["fixable"])))
    return recommendations.groupBy("category").agg(F.count("*").alias("n_items"), F.count_if(F.size("recs") > 0).alias("n_items_with"), F.sum(F.size("recs")).alias("n_recs"), count("critical"), count("important"), count("suggested"), fixable.alias("n_fixable"))


def typed_rows(items: DataFrame, groups: DataFrame, variants: DataFrame) -> DataFrame:
    """Rows of one file, of type item, modifier_group, modifier and variant, to be read in order of item, place and line.

    items: item, name, category, price_cents; groups: item, grp, title, required; variants: item, grp (NULL: in none), ordinal, label, kind, price_cents."""
    long_ = lambda c: (F.col(c) if isinstance(c, str) else c).cast("bigint")
    blank, last = F.lit(""), F.lit(1 << 40)
    shape = lambda rows, type_, place, line, name, price, category, kind, label, title, required: rows.select("item", long_(place).alias("place"), long_(line).alias("line"), F.lit(type_).alias("type"), name.alias("name"), long_(price).alias("price_cents"), category.alias("category"), kind.alias("kind"), label.alias("label"), title.alias("group_name"), required.alias("required"))
    yes = F.when(F.col("required"), "Y").otherwise("N")
    head = shape(items, "item", F.lit(0), F.lit(0), F.col("name"), F.coalesce("price_cents", F.lit(0)), F.coalesce("category", blank), blank, blank, blank, blank)
    sets = shape(groups, "modifier_group", "grp", F.lit(0), blank, F.lit(None), blank, blank, blank, F.col("title"), yes)
    mods = variants.join(groups.select("item", "grp", "title"), ["item", "grp"])
    own = shape(mods, "modifier", "grp", "ordinal", blank, "price_cents", blank, F.col("kind"), F.col("label"), F.col("title"), blank)
    loose = shape(variants.where("grp is null"), "variant", last, "ordinal", blank, "price_cents", blank, F.col("kind"), F.col("label"), blank, blank)
    return head.unionByName(sets).unionByName(own).unionByName(loose)


def option_rows(items: DataFrame, groups: DataFrame, variants: DataFrame) -> DataFrame:
    """Rows of menu group, item, base price, option group, option, option price, required: a row for each item, then its
    groups' options, then variants in no group under the name of their kind. Prices are text; read in order of item, place and line."""
    from ..functions import prices

    blank, last = F.lit(""), F.lit(1 << 40)
    names = F.create_map(*(F.lit(x) for pair in KIND_NAMES.items() for x in pair))
    head = items.select("item", F.lit(0).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("line"), F.coalesce(F.nullif("category", blank), F.lit("Uncategorized")).alias("menu_group"), F.col("name").alias("menu_item"), prices.dollars(F.col("price_cents")).alias("base_price"), blank.alias("option_group"), blank.alias("option"), blank.alias("option_price"), blank.alias("required"))
    option = lambda rows, place, title, required: rows.select("item", place.cast("bigint").alias("place"), F.col("ordinal").cast("bigint").alias("line"), blank.alias("menu_group"), blank.alias("menu_item"), blank.alias("base_price"), title.alias("option_group"), F.col("label").alias("option"), prices.dollars(F.col("price_cents")).alias("option_price"), required.alias("required"))
    own = option(variants.join(groups.select("item", "grp", "title", "required"), ["item", "grp"]), F.col("grp"), F.col("title"), F.when(F.col("required"), "Y").otherwise("N"))
    loose = option(variants.where("grp is null"), last, F.coalesce(F.try_element_at(names, F.col("kind")), F.lit("Option")), blank)
    return head.unionByName(own).unionByName(loose)
