"""Queries of set operations and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import writes
from ..sources import bindings as B
from .registry import query


@query(f"""WITH {B.ITEMS}, e AS (SELECT lower(trim(name)) AS k, price_cents AS p FROM items WHERE pos % 2 = 0)
SELECT min(pos) AS pos, lower(trim(name)) AS name, price_cents FROM items WHERE pos % 2 = 1 AND (lower(trim(name)), price_cents) NOT IN (SELECT k, p FROM e) GROUP BY 2, 3""")
def approve_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.items(spark, sf_dir).select("pos", names.key(F.col("name")).alias("name"), "price_cents")
    return writes.approve(rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1"), [F.col("name"), F.col("price_cents")], "pos")


@query(f"""WITH {B.ITEMS}, o AS (SELECT pos, name, category, price_cents FROM items WHERE pos % 3 <> 0), n AS (SELECT pos, upper(name) AS name, CASE WHEN pos % 4 = 0 THEN NULL ELSE category END AS category, price_cents + 1 AS price_cents FROM items WHERE pos % 2 = 0)
SELECT coalesce(n.pos, o.pos) AS pos, CASE WHEN n.pos IS NULL THEN o.name ELSE n.name END AS name, CASE WHEN n.pos IS NULL THEN o.category ELSE coalesce(n.category, o.category) END AS category, CASE WHEN n.pos IS NULL THEN o.price_cents ELSE n.price_cents END AS price_cents FROM o FULL JOIN n ON o.pos = n.pos""")
def upsert_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.items(spark, sf_dir).select("pos", "name", "category", "price_cents")
    new = rows.where("pos % 2 = 0").select("pos", F.upper("name").alias("name"), F.when(F.col("pos") % 4 != 0, F.col("category")).alias("category"), (F.col("price_cents") + 1).alias("price_cents"))
    return writes.upsert(rows.where("pos % 3 != 0"), new, "pos", keep=["category"])


@query(f"""WITH {B.ITEMS}, n AS (SELECT menu_id, category, name AS base, pos, price_cents FROM items WHERE pos % 3 <> 0),
g AS (SELECT menu_id, lower(base) AS key, category, count(*) AS n, min(pos) AS parent, min(price_cents) AS low FROM n GROUP BY 1, 2, 3) SELECT menu_id, key, category, n, parent, low FROM g WHERE n >= 2""")
def backfill_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = F.when(F.col("pos") % 3 != 0, F.concat("name", F.lit(" (S"), (F.col("pos") % 5).cast("string"), F.lit(")"))).otherwise(F.col("name"))
    out = writes.backfill_variants(B.items(spark, sf_dir).withColumn("name", sized), ["menu_id"])
    return out.select("menu_id", "key", "category", "n", "parent", F.element_at("variants", 1)["price_cents"].alias("low"))


@query(f"""WITH {B.ITEMS}, p AS (SELECT menu_id, category, count(*) AS n_items, min(pos) AS first_pos FROM items GROUP BY 1, 2), r AS (SELECT DISTINCT menu_id, category FROM items WHERE pos % 9 = 0)
SELECT p.*, r.category IS NOT NULL AS reviewed FROM p LEFT JOIN r USING (menu_id, category)""")
def wizard_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.items(spark, sf_dir)
    reviews = rows.where("pos % 9 = 0").select("menu_id", "category").distinct().withColumn("reviewed", F.lit(True))
    return writes.progress(rows, reviews, "menu_id", ["category"])


@query(f"""WITH {B.ITEMS}, c AS (SELECT lower(trim(name)) AS key, arg_max(status, ord) AS status, arg_max(new_price, ord) AS new_price FROM (SELECT name, pos AS ord, CASE pos % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'corrected' ELSE 'not_found' END AS status, price_cents + 7 AS new_price FROM items WHERE pos % 40 = 1 OR pos % 50 = 2) GROUP BY 1)
SELECT menu_id, pos, CASE WHEN status = 'corrected' THEN new_price ELSE price_cents END AS price_cents, CAST(CASE WHEN status = 'confirmed' THEN least(100, pos % 100 + 5) WHEN status = 'corrected' THEN 92 ELSE pos % 100 END AS BIGINT) AS confidence FROM items LEFT JOIN c ON key = lower(trim(name))""")
def reconcile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.items(spark, sf_dir)
    status = F.when(F.col("pos") % 3 == 0, "confirmed").when(F.col("pos") % 3 == 1, "corrected").otherwise("not_found")
    fixes = rows.where("pos % 40 = 1 OR pos % 50 = 2").select("name", F.col("pos").alias("order"), status.alias("status"), (F.col("price_cents") + 7).alias("new_price"))
    return writes.merge_corrections(rows.withColumn("confidence", F.col("pos") % 100), fixes).select("menu_id", "pos", "price_cents", F.col("confidence").cast("bigint").alias("confidence"))


@query("""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS id, 1 - l_discount * 9 AS score FROM lineitem), d AS (SELECT id, min(score) AS score FROM s GROUP BY 1)
SELECT id, round(score, 6) AS score, CAST(CASE WHEN score < 0.40 THEN 0 ELSE 1 END AS INT) AS tier_rank FROM d WHERE score < 0.60 ORDER BY tier_rank, d.score, id LIMIT 10""")
def flagged_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.min(1 - F.col("l_discount") * 9).alias("score"))
    return writes.flagged(rows).withColumn("score", F.round("score", 6))


@query()
def header_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = {"name": ["name", "item", "itemname", "pname"], "category": ["category", "section", "ptype"], "price": ["price", "cost", "pretailprice"], "size": ["size", "psize"]}
    rows = B.table(spark, sf_dir, "part")
    return writes.mapped(rows, writes.header_map(rows.columns, aliases))
