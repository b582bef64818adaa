"""Queries of versions and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import menus as M
from ..sources import bindings as B
from .registry import query

_DIFF = B.VERSIONS + """,
ka AS (SELECT *, lower(trim(coalesce(name, ''))) AS key, count(*) OVER (PARTITION BY menu_id, lower(trim(coalesce(name, '')))) AS c FROM version_a),
kb AS (SELECT *, lower(trim(coalesce(name, ''))) AS key, count(*) OVER (PARTITION BY menu_id, lower(trim(coalesce(name, '')))) AS c FROM version_b),
single AS (SELECT DISTINCT ka.menu_id, ka.key FROM ka JOIN kb ON ka.menu_id = kb.menu_id AND ka.key = kb.key WHERE ka.c = 1 AND kb.c = 1),
sa AS (SELECT ka.*, CASE WHEN s.key IS NOT NULL THEN '' ELSE lower(trim(coalesce(category, ''))) END AS sub FROM ka LEFT JOIN single s ON s.menu_id = ka.menu_id AND s.key = ka.key),
sb AS (SELECT kb.*, CASE WHEN s.key IS NOT NULL THEN '' ELSE lower(trim(coalesce(category, ''))) END AS sub FROM kb LEFT JOIN single s ON s.menu_id = kb.menu_id AND s.key = kb.key),
na AS (SELECT *, row_number() OVER (PARTITION BY menu_id, key, sub ORDER BY pos) AS nth FROM sa), nb AS (SELECT *, row_number() OVER (PARTITION BY menu_id, key, sub ORDER BY pos) AS nth FROM sb),
d AS (SELECT coalesce(na.menu_id, nb.menu_id) AS menu_id, coalesce(na.key, nb.key) AS key, na.pos AS pos_a, nb.pos AS pos_b, na.price_cents AS price_a, nb.price_cents AS price_b,
  list_filter([CASE WHEN na.name <> nb.name THEN 'name' END, CASE WHEN na.category <> nb.category THEN 'category' END, CASE WHEN na.price_cents IS DISTINCT FROM nb.price_cents THEN 'price' END, CASE WHEN na.pos IS DISTINCT FROM nb.pos THEN 'position' END], lambda x: x IS NOT NULL) AS ch
  FROM na FULL JOIN nb ON na.menu_id = nb.menu_id AND na.key = nb.key AND na.sub = nb.sub AND na.nth = nb.nth),
diffs AS (SELECT *, CASE WHEN pos_a IS NULL THEN 'added' WHEN pos_b IS NULL THEN 'removed' WHEN len(ch) > 0 THEN 'modified' ELSE 'unchanged' END AS status, CASE WHEN price_b > price_a THEN 'increase' WHEN price_b < price_a THEN 'decrease' END AS direction FROM d)"""


@query(f"WITH {_DIFF} SELECT menu_id, key, pos_a, pos_b, price_a, price_b, status, CASE WHEN status = 'modified' THEN array_to_string(ch, ',') ELSE '' END AS fields, direction FROM diffs")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = B.versions(spark, sf_dir)
    return M.diff(a, b, ["menu_id"]).select("menu_id", "key", "pos_a", "pos_b", "price_a", "price_b", "status", "fields", "direction")


@query(f"WITH {_DIFF} SELECT menu_id, count(*) FILTER (WHERE status = 'added') AS n_added, count(*) FILTER (WHERE status = 'removed') AS n_removed, count(*) FILTER (WHERE status = 'modified') AS n_modified, count(*) FILTER (WHERE direction = 'increase') AS n_up, count(*) FILTER (WHERE direction = 'decrease') AS n_down FROM diffs GROUP BY 1")
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = B.versions(spark, sf_dir)
    return M.change_summary(M.diff(a, b, ["menu_id"]), ["menu_id"])


@query(f"""WITH {B.VARIANTS}, a AS (SELECT item, CAST(ordinal AS VARCHAR) AS label, price_cents, row_number() OVER (PARTITION BY item, ordinal ORDER BY price_cents) AS nth FROM variants WHERE (item + ordinal) % 7 <> 0),
b AS (SELECT item, CAST(ordinal AS VARCHAR) AS label, price_cents + CASE WHEN item % 5 = 0 THEN 100 ELSE 0 END AS price_cents, row_number() OVER (PARTITION BY item, ordinal ORDER BY price_cents) AS nth FROM variants WHERE (item + ordinal) % 11 <> 0)
SELECT coalesce(a.item, b.item) AS item, coalesce(a.label, b.label) AS label, a.price_cents AS price_a, b.price_cents AS price_b,
  CASE WHEN a.price_cents IS NULL THEN 'added' WHEN b.price_cents IS NULL THEN 'removed' WHEN a.price_cents <> b.price_cents THEN 'modified' ELSE 'unchanged' END AS status FROM a FULL JOIN b ON a.item = b.item AND a.label = b.label AND a.nth = b.nth""")
def variant_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.variants(spark, sf_dir)
    shifted = rows.withColumn("price_cents", F.col("price_cents") + F.when(F.col("item") % 5 == 0, 100).otherwise(0))
    return M.variant_diff(rows.where("(item + ordinal) % 7 != 0"), shifted.where("(item + ordinal) % 11 != 0"), ["item"], "ordinal").drop("nth")


@query("SELECT o_custkey AS menu_id, o_orderkey AS version, o_orderstatus AS label FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("menu_id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("label"))
    return M.latest(rows, ["menu_id"], "version")


@query("SELECT c_custkey, c_name, count(o_orderkey) AS n_versions, coalesce(max(o_orderkey) + 1, 1) AS next_version FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def version_count_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_versions"), (F.max("o_orderkey") + 1).alias("next_version"))
    out = B.table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(counts, "c_custkey", "left")
    return out.select("c_custkey", "c_name", F.coalesce("n_versions", F.lit(0)).cast("bigint").alias("n_versions"), F.coalesce("next_version", F.lit(1)).cast("bigint").alias("next_version"))


@query(f"""WITH {B.SCHEDULES} SELECT a.owner, a.id AS id_a, b.id AS id_b, CASE WHEN a.hour_from IS NOT NULL AND b.hour_from IS NOT NULL THEN 'time' ELSE 'full' END AS overlap_type
FROM schedules a JOIN schedules b ON a.owner = b.owner AND a.id < b.id AND a.date_from <= coalesce(b.date_to, DATE '9999-12-31') AND b.date_from <= coalesce(a.date_to, DATE '9999-12-31')
  AND coalesce(a.hour_from, 0) < coalesce(b.hour_to, 24) AND coalesce(b.hour_from, 0) < coalesce(a.hour_to, 24)""")
def schedule_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.overlap_conflicts(B.schedules(spark, sf_dir))


@query(f"WITH {B.SCHEDULES}, s AS (SELECT unnest(range(6, 24)) AS slot) SELECT owner, CAST(slot AS INT) AS slot, count(*) FILTER (WHERE coalesce(hour_from, 0) <= slot AND slot < coalesce(hour_to, 24)) AS n_active FROM schedules, s GROUP BY 1, 2")
def schedule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.coverage(B.schedules(spark, sf_dir))


@query(f"""WITH {B.SCHEDULES} SELECT owner, id, CAST(CASE WHEN date_from IS NOT NULL AND date_to IS NOT NULL THEN 25 WHEN date_from IS NOT NULL OR date_to IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN hour_from IS NOT NULL THEN 30 ELSE 0 END AS INT) AS specificity
FROM schedules WHERE date_from <= DATE '1998-06-15' AND (date_to IS NULL OR date_to >= DATE '1998-06-15') AND coalesce(hour_from, 0) <= 12 AND 12 < coalesce(hour_to, 24)""")
def active_menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    score = M.specificity(none, F.col("date_from"), F.col("date_to"), none, F.col("hour_from"), F.col("hour_to"), none)
    return M.active_on(B.schedules(spark, sf_dir), "1998-06-15", 12).select("owner", "id", score.cast("int").alias("specificity"))


@query(f"""WITH {B.SCHEDULES}, t AS (SELECT * FROM schedules WHERE date_from <= DATE '1998-06-15' AND (date_to IS NULL OR date_to >= DATE '1998-06-15')),
n AS (SELECT owner, id, hour_from AS hour, 'starts' AS type, 0 AS k FROM t WHERE hour_from > 9 UNION ALL SELECT owner, id, hour_to, 'ends', 1 FROM t WHERE hour_to > 9)
SELECT owner, hour, id, type FROM n QUALIFY row_number() OVER (PARTITION BY owner ORDER BY hour, id, k) = 1""")
def next_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.next_transition(B.schedules(spark, sf_dir), "1998-06-15", 9)


@query(f"""WITH {B.SCHEDULES} SELECT coalesce(hour_from || '-' || hour_to, 'all-day') AS slot, count(*) AS n, min(id) AS first_id FROM schedules GROUP BY 1""")
def rotation_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.coalesce(F.concat(F.col("hour_from").cast("string"), F.lit("-"), F.col("hour_to").cast("string")), F.lit("all-day"))
    return B.schedules(spark, sf_dir).groupBy(key.alias("slot")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("""WITH v AS (SELECT o_custkey AS k, count(*) AS n_versions, arg_max(o_orderkey, o_orderkey) AS latest FROM orders GROUP BY 1), i AS (SELECT l_orderkey, count(*) AS n_items FROM lineitem GROUP BY 1),
m AS (SELECT c_custkey AS menu_id, coalesce(n_versions, 0) AS n_versions, coalesce(n_items, 0) AS n_items, c_custkey % 3 <> 0 AS scheduled, c_mktsegment <> 'BUILDING' AS typed, c_custkey % 2 = 0 AS described FROM customer LEFT JOIN v ON k = c_custkey LEFT JOIN i ON l_orderkey = latest),
s AS (SELECT *, least(100, CASE WHEN n_versions > 0 THEN 25 ELSE 0 END + CASE WHEN n_items > 0 THEN 25 ELSE 0 END + CASE WHEN scheduled THEN 25 ELSE 0 END + CASE WHEN typed THEN 10 ELSE 0 END + CASE WHEN described THEN 5 ELSE 0 END + CASE WHEN n_versions >= 2 THEN 10 ELSE 0 END) AS score FROM m)
SELECT menu_id, n_versions, n_items, CAST(score AS INT) AS score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'D' END AS grade FROM s""")
def menu_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("menu_id")).agg(F.count("*").alias("n_versions"), F.max("o_orderkey").alias("latest"))
    items = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("latest")).agg(F.count("*").alias("n_items"))
    menus = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("menu_id"), "c_mktsegment").join(orders, "menu_id", "left").join(items, "latest", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    menus = menus.select("menu_id", "c_mktsegment", zero("n_versions"), zero("n_items"))
    score = M.health(F.col("n_versions"), F.col("n_items"), F.col("menu_id") % 3 != 0, F.col("c_mktsegment") != "BUILDING", F.col("menu_id") % 2 == 0)
    return menus.select("menu_id", "n_versions", "n_items", score.cast("int").alias("score")).withColumn("grade", M.health_grade(F.col("score")))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def empty_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = B.table(spark, sf_dir, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return B.table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def first_unversioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    customers = B.table(spark, sf_dir, "customer").select("c_custkey")
    return customers.join(orders, "c_custkey", "left_semi").join(orders.where("o_orderstatus = 'F'"), "c_custkey", "left_anti")
