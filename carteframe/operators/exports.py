"""Export shapes: metrics, warnings, flat, wide, hierarchical and nested rows; nesting of children."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import prices, sizes
from .variants import steps


def nest(parents: DataFrame, children: DataFrame, key: str, fields: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Parents with an array of their children, ordered; empty, not NULL, without any."""
    rows = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *(f for f in fields if f not in order)))).alias(name))
    return parents.join(rows, key, "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))


def metrics(items: DataFrame, variants: DataFrame, category: str = "category") -> DataFrame:
    """Per category items, items with variants, variants, and least, highest and mean of all positive prices."""
    own = items.groupBy(category).agg(F.count("*").alias("n_items"))
    both = variants.join(items.select("item", category), "item")
    with_variants = both.groupBy(category).agg(F.countDistinct("item").alias("n_with_variants"), F.count("*").alias("n_variants"))
    every = items.select(category, "price_cents").unionByName(both.select(category, "price_cents")).where("price_cents > 0")
    prices_ = every.groupBy(category).agg(F.min("price_cents").alias("low"), F.max("price_cents").alias("high"), (F.sum("price_cents") / F.count("*")).alias("mean"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return own.join(with_variants, category, "left").join(prices_, category, "left").select(category, "n_items", zero("n_with_variants"), zero("n_variants"), "low", "high", "mean")


def draft_warnings(items: DataFrame, variants: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per item and warning, with n: the variants or groups concerned, or 1 for a field of the item.

    items have item, name, category and price_cents; variants item, grp (NULL: in no group), ordinal, label, kind and
    price_cents; groups item, grp, required, min_select and max_select (0 or NULL: no limit). A repeated label counts
    without regard to case; an inversion is a size cheaper than the one before it by place, then ordinal."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    count = lambda c: F.count(F.when(c, 1))
    label = F.when(~blank("label"), F.lower(F.trim("label")))
    counts = variants.groupBy("item").agg(F.count("*").alias("_variants"), count(none("price_cents")).alias("variant_missing_price"), count(blank("label")).alias("variant_missing_label"), (F.count(label) - F.countDistinct(label)).alias("duplicate_variant_label"))
    sized = variants.where((F.col("kind") == "size") & ~none("price_cents")).withColumn("_place", sizes.ordinal(sizes.normalized(F.col("label")))).where("_place is not null")
    falls = steps(sized.withColumn("_at", F.struct("_place", "ordinal", "price_cents")), ["item"], "_at").where("step < 0").groupBy("item").agg(F.lit(1).cast("bigint").alias("price_inversion"))
    held = variants.where("grp is not null").groupBy("item", "grp").agg(F.count("*").alias("_mods"))
    empty, least, most = none("_mods"), F.coalesce("min_select", F.lit(0)), F.coalesce("max_select", F.lit(0))
    by_group = groups.join(held, ["item", "grp"], "left").groupBy("item").agg(
        count(empty).alias("modifier_group_empty"), count(empty & F.col("required")).alias("required_group_empty"),
        count((least != 0) & (most != 0) & (least > most)).alias("group_min_exceeds_max"), count((most != 0) & ~empty & (most > F.col("_mods"))).alias("group_max_exceeds_count"),
    )
    every = items.join(counts, "item", "left").join(falls, "item", "left").join(by_group, "item", "left")
    own = {"missing_name": blank("name"), "missing_category": blank("category"), "missing_price": none("price_cents") & none("_variants")}
    names = [c for x in (counts, falls, by_group) for c in x.columns if c not in ("item", "_variants")]
    made = [F.when(c, F.lit(1).cast("bigint")).otherwise(0).alias(k) for k, c in own.items()] + [F.coalesce(k, F.lit(0)).cast("bigint").alias(k) for k in names]
    rows = F.array(*(F.struct(F.lit(k).alias("warning"), c.alias("n")) for k, c in zip([*own, *names], made, strict=True)))
    return every.select("item", F.inline(rows)).where("n > 0")


def group_lacking(links: DataFrame, category: str, item: str, group: str, share: float = 0.5, least: int = 3) -> DataFrame:
    """Per category the items with groups that lack a group which at least share of them have (n_items of least or more).

    Blank categories don't count; an item whose groups are all blank counts, and lacks every common group. A category's
    items meet its common groups only, which are at most 1 / share times its pairs of item and group."""
    filled = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    every = links.where(filled(category)).select(category, item, group).distinct()
    items, pairs = every.select(category, item).distinct(), every.where(filled(group))
    total = items.groupBy(category).agg(F.count("*").alias("n_items"))
    common = pairs.groupBy(category, group).agg(F.count("*").alias("n_have")).join(total, category).where((F.col("n_items") >= least) & (F.col("n_have") >= share * F.col("n_items")))
    return items.join(common, category).join(pairs, [category, group, item], "left_anti").select(category, group, "n_items", "n_have", item)


def publish_rows(items: DataFrame, variants: DataFrame) -> DataFrame:
    """Items without variants as they are, and one row per variant named Item (Label)."""
    plain = items.join(variants.select("item").distinct(), "item", "left_anti").select("item", F.col("name"), F.col("price_cents"))
    named = variants.join(items.select("item", "name"), "item").select("item", F.concat("name", F.lit(" ("), F.col("label"), F.lit(")")).alias("name"), "price_cents")
    return plain.unionByName(named)


def wide(items: DataFrame, variants: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One price column per label; the last value of equal labels, by ordinal, wins."""
    last = variants.groupBy("item", "label").agg(F.max_by("price_cents", "ordinal").alias("price_cents"))
    spread = last.groupBy("item").pivot("label", list(labels)).agg(F.first("price_cents"))
    return items.join(spread.select("item", *(F.col(f"`{c}`").alias(f"price_{c}") for c in labels)), "item", "left")


def labels_in_order(variants: DataFrame, most: int = 100) -> list[str]:
    """Distinct labels in first-seen order for the header of a wide export; more than most is an error, not a cut."""
    rows = variants.groupBy("label").agg(F.min(F.struct("item", "ordinal")).alias("first")).orderBy("first").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a wide export has {most} labels at most")
    return [r["label"] for r in rows]


def pos_rows(items: DataFrame, variants: DataFrame) -> DataFrame:
    """Hierarchical rows: an item row (line 0), then a row for each of its variants, prices as text."""
    head = items.select("item", F.lit(0).cast("bigint").alias("line"), F.lit("item").alias("kind"), "name", prices.dollars(F.col("price_cents")).alias("price"))
    rows = variants.select("item", F.col("ordinal").cast("bigint").alias("line"), F.lit("modifier").alias("kind"), F.col("label").alias("name"), prices.dollars(F.col("price_cents")).alias("price"))
    return head.unionByName(rows)


def nested_json(items: DataFrame, variants: DataFrame) -> DataFrame:
    """A JSON document per category: items by place with their variants."""
    full = nest(items, variants, "item", ["ordinal", "label", "price_cents"], ["ordinal"], "variants")
    return full.groupBy("category").agg(F.count("*").alias("n_items"), F.sum(F.size("variants")).cast("bigint").alias("n_variants"), F.to_json(F.array_sort(F.collect_list(F.struct("item", "name", "price_cents", "variants")))).alias("document"))


def validate(rows: DataFrame) -> DataFrame:
    """Raw rows with price_cents and errors: name required, price readable, confidence 0 to 100; no error is an empty array."""
    cents = prices.lenient_cents(F.col("price"))
    made: Column = F.array_compact(F.array(
        F.when(F.trim(F.coalesce(F.col("name"), F.lit(""))) == "", "name_required"),
        F.when((F.trim(F.coalesce(F.col("price"), F.lit(""))) != "") & cents.isNull(), "price_unreadable"),
        F.when(~F.col("confidence").between(0, 100), "confidence_range"),
    ))
    return rows.withColumn("price_cents", cents).withColumn("errors", made)


#: What an option group of variants of one kind is called.
KIND_TITLES = {"size": "Size", "combo": "Combo Add-on", "flavor": "Flavor", "style": "Style", "other": "Option"}


def option_rows(items: DataFrame, groups: DataFrame, variants: DataFrame) -> DataFrame:
    """Rows of an import by menu group, item and option. An item's row is line 0; the modifiers of its groups follow by the
    groups' position and their own ordinal, then its variants without a group, by kinds in the order of their first variant.

    items: item, name, category, price_cents; groups: item, grp, title, required, position; variants: item, grp, kind, label,
    price_cents, ordinal. A blank category is Uncategorized, a kind that is NULL a size, and an unknown one an option. Modifiers
    of a group that its item lacks are left out; groups without modifiers give no row."""
    none = F.lit("")
    shown = lambda c: prices.dollars(F.coalesce(F.col(c), F.lit(0)))
    category = F.coalesce(F.nullif(F.col("category"), none), F.lit("Uncategorized"))
    head = items.select("item", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("ordinal"), category.alias("menu_group"), F.coalesce("name", none).alias("menu_item"), shown("price_cents").alias("base_price"), none.alias("option_group"), none.alias("option"), none.alias("option_price"), none.alias("required"))
    told = ["item", "part", "place", F.col("ordinal").cast("bigint").alias("ordinal"), none.alias("menu_group"), none.alias("menu_item"), none.alias("base_price"), "option_group", F.coalesce("label", none).alias("option"), shown("price_cents").alias("option_price"), "required"]
    titled = groups.select("item", "grp", F.coalesce("title", F.lit("Option")).alias("option_group"), F.when(F.col("required"), "Y").otherwise("N").alias("required"), F.col("position").cast("bigint").alias("place"))
    grouped = variants.join(titled, ["item", "grp"]).withColumn("part", F.lit(1)).select(*told)
    kind = F.coalesce("kind", F.lit("size"))
    title = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in KIND_TITLES.items() for x in pair)), kind), F.lit("Option"))
    first = F.min("ordinal").over(W.partitionBy("item", kind)).cast("bigint")
    loose = variants.where("grp is null").withColumns({"place": first, "option_group": title, "required": none, "part": F.lit(2)}).select(*told)
    line = F.row_number().over(W.partitionBy("item").orderBy("part", "place", "ordinal", "option")) - 1
    return head.unionByName(grouped).unionByName(loose).withColumn("line", line.cast("bigint")).drop("part", "place", "ordinal")


def round_trips(items: DataFrame, variants: DataFrame) -> DataFrame:
    """One row for csv and one for json: items and variants before the rows were written as text and after they were read
    back, and whether both agree. items: item, name, category, price_cents; variants: item, label, price_cents. A row counts
    as read if its kind, key and price come back as they were."""
    rows = items.select(F.lit("item").alias("kind"), "item", "name", "category", F.col("price_cents").cast("bigint").alias("price_cents")).unionByName(
        variants.select(F.lit("variant").alias("kind"), "item", F.col("label").alias("name"), F.lit("").alias("category"), F.col("price_cents").cast("bigint").alias("price_cents"))
    )
    schema = rows.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    whole = F.struct(*rows.columns)
    signs = {"escape": '"', "emptyValue": "", "nullValue": "\\N"}
    back = {"csv": F.from_csv(F.to_csv(whole, signs), F.lit(schema), signs), "json": F.from_json(F.to_json(whole), schema, {"mode": "PERMISSIVE"})}
    read = F.explode(F.array(*(F.struct(F.lit(name).alias("format"), parsed.alias("row")) for name, parsed in back.items()))).alias("r")
    kept = (F.col("r.row.kind") == F.col("kind")) & F.col("r.row.item").eqNullSafe(F.col("item")) & F.col("r.row.price_cents").eqNullSafe(F.col("price_cents"))
    count = lambda kind, ok: F.count_if((F.col("kind") == kind) & ok)
    out = rows.select("kind", "item", "price_cents", read).withColumn("kept", F.coalesce(kept, F.lit(False))).groupBy(F.col("r.format").alias("format")).agg(
        count("item", F.lit(True)).alias("expected_items"), count("item", F.col("kept")).alias("actual_items"), count("variant", F.lit(True)).alias("expected_variants"), count("variant", F.col("kept")).alias("actual_variants")
    )
    return out.withColumn("ok", (F.col("expected_items") == F.col("actual_items")) & (F.col("expected_variants") == F.col("actual_variants")))
