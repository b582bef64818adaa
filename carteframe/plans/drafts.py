"""Queries of working copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prices
from ..operators import drafts as D
from ..sources import bindings as B
from .registry import query


@query("SELECT o_orderkey + 1000000 AS id, o_custkey + 1000000 AS parent, o_orderstatus AS status FROM orders")
def clone_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent"), F.col("o_orderstatus").alias("status"))
    return D.clone(rows, "id", 1_000_000, ["parent"])


@query("""WITH n AS (SELECT o_custkey AS menu, max(o_orderkey) AS version FROM orders GROUP BY 1)
SELECT menu, l_partkey * 10 + l_linenumber AS pos, CAST(row_number() OVER (PARTITION BY menu ORDER BY l_partkey * 10 + l_linenumber) AS INT) AS position FROM n JOIN (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem) ON l_orderkey = version""")
def restore_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("menu"), F.col("o_orderkey").alias("version"))
    lines = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos")).distinct()
    return D.restore(versions, lines.join(versions, "version"), "menu", "version")


@query("SELECT o_custkey AS menu, o_orderkey AS version FROM orders WHERE o_orderstatus <> 'F' AND o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def deletable_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("menu"), F.col("o_orderkey").alias("version"), (F.col("o_orderstatus") == "F").alias("pinned"))
    return D.deletable(rows, "menu").select("menu", "version")


@query(f"""WITH {B.ITEMS} SELECT pos, CASE WHEN pos % 3 = 0 AND pos % 2 = 0 THEN 'new' ELSE name END AS name, CASE WHEN pos % 3 = 0 AND pos % 2 = 1 THEN 5 ELSE price_cents END AS price_cents FROM items""")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.items(spark, sf_dir).select("pos", "name", "price_cents")
    changes = rows.where("pos % 3 = 0").select("pos", F.when(F.col("pos") % 2 == 0, "new").alias("name"), F.when(F.col("pos") % 2 == 1, F.lit(5).cast("bigint")).alias("price_cents"))
    return D.partial_update(rows, changes, "pos", ["name", "price_cents"])


@query("""WITH v AS (SELECT p_brand AS menu, p_type AS category, p_name AS name, p_size % 9 AS size, p_partkey AS price_cents FROM part), k AS (SELECT DISTINCT menu, size FROM v WHERE category = 'LARGE')
SELECT v.menu, 'LARGE' AS category, name, v.size, price_cents FROM v JOIN k ON k.menu = v.menu AND k.size = v.size WHERE category = 'SMALL'""")
def expand_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "part").select(F.col("p_brand").alias("menu"), F.col("p_type").alias("category"), F.col("p_name").alias("name"), (F.col("p_size") % 9).alias("size"), F.col("p_partkey").alias("price_cents"))
    markers = rows.select("menu", F.lit("SMALL").alias("source"), F.lit("LARGE").alias("target")).distinct()
    return D.inherit(rows, markers, "menu")


@query("""WITH s AS (SELECT s_suppkey AS subscriber, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 50 END AS owner, CASE s_suppkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'error' END AS kind FROM supplier)
SELECT event_id, subscriber FROM events JOIN s ON kind = event_type AND (owner IS NULL OR owner = user_id) UNION ALL SELECT event_id, subscriber FROM events JOIN s ON event_type = 'purchase' AND (owner IS NULL OR owner = user_id)""")
def webhook_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    kinds = F.when(key % 3 == 0, "click, Purchase").when(key % 3 == 1, "view,purchase").otherwise("error, purchase")
    subscribers = B.table(spark, sf_dir, "supplier").select(key.alias("subscriber"), F.when(key % 4 != 0, key % 50).alias("user_id"), kinds.alias("events"))
    return D.fan_out(B.table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), subscribers, "user_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_orderdate AS TIMESTAMP) + INTERVAL 30 DAY >= TIMESTAMP '1998-06-15 00:00:00'")
def cache_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "orders").withColumn("written", F.col("o_orderdate").cast("timestamp"))
    return D.fresh(rows, "written", F.lit("1998-06-15").cast("timestamp"), 30).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def draft_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")
    return D.page(rows, {"o_orderstatus": "O", "o_custkey": None}, [F.desc("o_totalprice"), F.col("o_orderkey")], 20, 5).select("o_orderkey", "o_totalprice")


@query(f"""WITH {B.VARIANTS}, n AS (SELECT item, ordinal, row_number() OVER (PARTITION BY item ORDER BY ordinal) AS place FROM variants) SELECT item, ordinal, CASE place WHEN 1 THEN 'Small' WHEN 2 THEN 'Large' ELSE 'L' || ordinal END AS label FROM n""")
def apply_variant_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.variants(spark, sf_dir).select("item", "ordinal", F.concat(F.lit("L"), F.col("ordinal").cast("string")).alias("label"))
    return D.relabel(rows, {1: "Small", 2: "Large"}, ["item"])


@query(f"""WITH {B.VARIANTS}, k AS (SELECT item, ordinal, CASE WHEN ordinal % 3 = 0 THEN 'flavor' ELSE 'size' END AS kind FROM variants)
SELECT item, kind, count(*) AS n, min(ordinal) AS first, kind = 'size' AS required, CASE WHEN kind = 'size' THEN 1 ELSE 0 END AS min_select, CASE WHEN kind = 'size' THEN 1 ELSE count(*) END AS max_select FROM k GROUP BY 1, 2""")
def variants_to_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.variants(spark, sf_dir).withColumn("kind", F.when(F.col("ordinal") % 3 == 0, "flavor").otherwise("size"))
    return D.grouped_modifiers(rows, "item", "kind")


@query("""WITH t AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' $' || p_size || '.50' WHEN 1 THEN ' ' || (100 + p_size) WHEN 2 THEN ' ' || p_size || ' 99' ELSE '' END AS t FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_size * 100 + 50 BETWEEN 100 AND 9999 THEN CAST(p_size * 100 + 50 AS VARCHAR) ELSE '' END WHEN 1 THEN CAST(100 + p_size AS VARCHAR) WHEN 2 THEN CAST(p_size * 100 + 99 AS VARCHAR) ELSE '' END AS cents FROM t JOIN part USING (p_partkey)""")
def price_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    tail = F.when(key % 4 == 0, F.concat(F.lit(" $"), size.cast("string"), F.lit(".50"))).when(key % 4 == 1, F.concat(F.lit(" "), (100 + size).cast("string"))).when(key % 4 == 2, F.concat(F.lit(" "), size.cast("string"), F.lit(" 99"))).otherwise("")
    text = F.concat("p_name", tail)
    return B.table(spark, sf_dir, "part").select("p_partkey", F.array_join(prices.candidates(text).cast("array<string>"), ",").alias("cents"))
