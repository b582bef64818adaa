"""Set operations and writes as whole-table rewrites: deduped approval, upserts, folding, review state, corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names


def approve(existing: DataFrame, batch: DataFrame, keys: Sequence[Column], order: str) -> DataFrame:
    """Rows of batch whose keys are neither in existing nor earlier in batch."""
    columns = [f"_k{i}" for i in range(len(keys))]
    keyed = lambda df: df.select("*", *(k.alias(c) for k, c in zip(keys, columns)))
    first = keyed(batch).groupBy(*columns).agg(F.min_by(F.struct(*batch.columns), order).alias("row"))
    return first.join(keyed(existing).select(*columns), columns, "left_anti").select("row.*")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """old with the rows of new: replaced by key, added if unknown; NULL in a column of keep leaves the old value."""
    fields = [c for c in old.columns if c != key]
    both = old.select(key, F.struct(*fields).alias("o")).join(new.select(key, F.struct(*fields).alias("n")), key, "full")
    pick = lambda c: F.when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep else F.col(f"n.{c}")).alias(c)
    return both.select(key, *map(pick, fields))


def backfill_variants(items: DataFrame, menu: Sequence[str]) -> DataFrame:
    """Rows named Base (Size) of one base and category, two or more: a parent with its variants by price."""
    parts = items.withColumn("base", F.regexp_extract("name", r"^(.*?)\s*\(([^()]+)\)\s*$", 1)).withColumn("label", F.regexp_extract("name", r"^(.*?)\s*\(([^()]+)\)\s*$", 2)).where("base != ''")
    rows = parts.withColumn("key", names.key(F.col("base"))).groupBy(*menu, "key", "category").agg(F.count("*").alias("n"), F.min("pos").alias("parent"), F.array_sort(F.collect_list(F.struct("price_cents", "pos", "label"))).alias("variants"))
    return rows.where("n >= 2")


def progress(items: DataFrame, reviews: DataFrame, draft: str, pair: Sequence[str]) -> DataFrame:
    """Distinct pairs in first-seen order with their review state; a missing state is open."""
    pairs = items.groupBy(draft, *pair).agg(F.count("*").alias("n_items"), F.min("pos").alias("first_pos"))
    return pairs.join(reviews, [draft, *pair], "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))


def merge_corrections(items: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections by lower-case name: confirmed adds 5 up to 100, corrected overwrites and sets 92, anything else leaves the item."""
    fixes = corrections.withColumn("key", names.key(F.col("name"))).groupBy("key").agg(F.max_by(F.struct("status", "new_price"), "order").alias("fix"))
    rows = items.withColumn("key", names.key(F.col("name"))).join(fixes, "key", "left")
    status = F.col("fix.status")
    confidence = F.when(status == "confirmed", F.least(F.lit(100), F.col("confidence") + 5)).when(status == "corrected", 92).otherwise(F.col("confidence"))
    price = F.when((status == "corrected") & F.col("fix.new_price").isNotNull(), F.col("fix.new_price")).otherwise(F.col("price_cents"))
    return rows.withColumn("confidence", confidence).withColumn("price_cents", price).drop("key", "fix")


def flagged(items: DataFrame, top: int = 10) -> DataFrame:
    """Items of tier reject or low by tier, then confidence: the top few for a person to look at."""
    rank = F.when(F.col("score") < 0.40, 0).when(F.col("score") < 0.60, 1)
    return items.withColumn("tier_rank", rank).where("tier_rank is not null").orderBy("tier_rank", "score", "id").limit(top)


def header_map(headers: Sequence[str], aliases: dict[str, Sequence[str]]) -> dict[str, str]:
    """Canonical field of each known header; the first header of a field wins."""
    bare = lambda h: "".join(c for c in h.lower() if c.isalnum())
    out: dict[str, str] = {}
    for header in headers:
        field = next((f for f, known in aliases.items() if bare(header) in known), None)
        if field and field not in out.values():
            out[header] = field
    return out


def mapped(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Canonical columns, and a map of the filled columns that have no mapping."""
    rest = [c for c in rows.columns if c not in mapping]
    pairs = [F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in rest]
    meta = F.map_from_entries(F.filter(F.array(*pairs), lambda p: F.trim(F.coalesce(p["value"], F.lit(""))) != "")) if pairs else F.create_map().cast("map<string,string>")
    return rows.select(*(F.col(f"`{h}`").alias(f) for h, f in mapping.items()), meta.alias("meta"))
