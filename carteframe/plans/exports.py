"""Queries of exports: items are parts, variants their line numbers with the labels L1 to L7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exports as X
from ..sources import bindings as B
from .registry import query

_BOTH = B.ITEMS + ", " + B.VARIANTS + ", i AS (SELECT pos AS item, name, category, price_cents FROM items), v AS (SELECT item, ordinal, 'L' || ordinal AS label, price_cents FROM variants)"
_DOLLARS = lambda c: f"CASE WHEN coalesce({c}, 0) = 0 THEN '' ELSE ({c} // 100) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0') END"


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = B.items(spark, sf_dir).select(F.col("pos").alias("item"), "name", "category", "price_cents")
    variants = B.variants(spark, sf_dir).withColumn("label", F.concat(F.lit("L"), F.col("ordinal").cast("string")))
    return items, variants


@query(f"""WITH {_BOTH}, p AS (SELECT category, price_cents FROM i UNION ALL SELECT category, v.price_cents FROM v JOIN i USING (item)),
a AS (SELECT category, count(*) AS n_items FROM i GROUP BY 1), b AS (SELECT category, count(DISTINCT item) AS n_with_variants, count(*) AS n_variants FROM v JOIN i USING (item) GROUP BY 1),
c AS (SELECT category, min(price_cents) AS low, max(price_cents) AS high, round(sum(price_cents) / count(*), 4) AS mean FROM p WHERE price_cents > 0 GROUP BY 1)
SELECT category, n_items, coalesce(n_with_variants, 0) AS n_with_variants, coalesce(n_variants, 0) AS n_variants, low, high, mean FROM a LEFT JOIN b USING (category) LEFT JOIN c USING (category)""")
def export_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.metrics(*_both(spark, sf_dir)).withColumn("mean", F.round("mean", 4))


#: Labels by line number, and their places.
_SIZES = {"Small": 20, "medium": 35, "LG": 40, "x-large": 50, "Half": 120, "Whole": 130, "family size": 140}


@query(f"""WITH i AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_type END AS category, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 100 END AS price FROM part),
v AS (SELECT l_partkey AS item, nullif(l_suppkey % 4, 0) AS grp, l_orderkey * 8 + l_linenumber AS ordinal, CASE WHEN l_quantity < 49 THEN l_linenumber END AS label, CASE WHEN l_returnflag <> 'R' THEN list_extract({list(_SIZES.values())}, l_linenumber) END AS place, CASE WHEN l_tax = 0 THEN 0 ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END AS price FROM lineitem),
c AS (SELECT item, count(*) AS n, count(*) FILTER (WHERE price = 0) AS unpriced, count(*) - count(label) AS unlabelled, count(label) - count(DISTINCT label) AS repeated FROM v GROUP BY 1),
s AS (SELECT item, price - lag(price) OVER (PARTITION BY item ORDER BY place, ordinal, price) AS step FROM v WHERE price <> 0 AND place IS NOT NULL AND label IS NOT NULL),
g AS (SELECT p_partkey AS item, grp, p_size % 2 = 0 AS required, p_size * grp % 6 AS low, (p_partkey + grp) % 12 AS high, (SELECT count(*) FROM v WHERE v.item = p_partkey AND v.grp = t.grp) AS n FROM part, (VALUES (1), (2), (3), (4)) AS t(grp) WHERE grp < 4 OR p_partkey % 7 = 0),
w AS (SELECT item, CASE WHEN name = '' THEN 1 ELSE 0 END AS n, 'missing_name' AS warning FROM i UNION ALL SELECT item, 1, 'missing_category' FROM i WHERE category IS NULL UNION ALL SELECT item, 1, 'missing_price' FROM i WHERE price = 0 AND item NOT IN (SELECT item FROM c)
UNION ALL SELECT item, unpriced, 'variant_missing_price' FROM c UNION ALL SELECT item, unlabelled, 'variant_missing_label' FROM c UNION ALL SELECT item, repeated, 'duplicate_variant_label' FROM c UNION ALL SELECT DISTINCT item, 1, 'price_inversion' FROM s WHERE step < 0
UNION ALL SELECT item, count(*), 'modifier_group_empty' FROM g WHERE n = 0 GROUP BY 1 UNION ALL SELECT item, count(*), 'required_group_empty' FROM g WHERE n = 0 AND required GROUP BY 1
UNION ALL SELECT item, count(*), 'group_min_exceeds_max' FROM g WHERE low > 0 AND high > 0 AND low > high GROUP BY 1 UNION ALL SELECT item, count(*), 'group_max_exceeds_count' FROM g WHERE n > 0 AND high > n GROUP BY 1)
SELECT item, warning, n FROM w WHERE n > 0""")
def export_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lineitem rows as variants, blanked labels and prices in place of dropped rows, and groups of modifiers."""
    key, line = F.col("p_partkey"), F.col("l_linenumber")
    parts = B.table(spark, sf_dir, "part")
    items = parts.select(key.alias("item"), F.when(key % 17 == 0, "").otherwise(F.col("p_name")).alias("name"), F.when(key % 19 != 0, F.col("p_type")).alias("category"), F.when(key % 5 == 0, 0).otherwise(100).alias("price_cents"))
    label = F.when(F.col("l_quantity") < 49, F.try_element_at(F.array(*map(F.lit, _SIZES)), line)).otherwise(" ")
    variants = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("item"), F.nullif(F.col("l_suppkey") % 4, F.lit(0)).alias("grp"), (F.col("l_orderkey") * 8 + line).alias("ordinal"), label.alias("label"),
        F.when(F.col("l_returnflag") != "R", "size").otherwise("addon").alias("kind"), F.when(F.col("l_tax") == 0, 0).otherwise(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("price_cents"),
    )
    grp = F.explode(F.when(key % 7 == 0, F.array(*map(F.lit, (1, 2, 3, 4)))).otherwise(F.array(*map(F.lit, (1, 2, 3))))).alias("grp")
    groups = parts.select(key.alias("item"), "p_size", grp).select("item", "grp", (F.col("p_size") % 2 == 0).alias("required"), (F.col("p_size") * F.col("grp") % 6).alias("min_select"), ((F.col("item") + F.col("grp")) % 12).alias("max_select"))
    return X.draft_warnings(items, variants, groups)


@query("""WITH l AS (SELECT DISTINCT c_nationkey AS category, c_custkey AS item, o_orderpriority AS grp FROM customer JOIN orders ON o_custkey = c_custkey),
t AS (SELECT category, count(DISTINCT item) AS n_items FROM l GROUP BY 1), c AS (SELECT category, grp, max(n_items) AS n_items, count(*) AS n_have FROM l JOIN t USING (category) GROUP BY 1, 2 HAVING max(n_items) >= 3 AND count(*) >= 0.5 * max(n_items))
SELECT c.category, c.grp, n_items, n_have, i.item FROM c JOIN (SELECT DISTINCT category, item FROM l) i USING (category) WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.category = c.category AND l.grp = c.grp AND l.item = i.item)""")
def group_inconsistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tables: nations are categories, customers items, priorities of their orders groups."""
    customers = B.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("category"), F.col("c_custkey").alias("item"))
    orders = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderpriority").alias("grp"))
    return X.group_lacking(customers.join(orders, "item"), "category", "item", "grp")


@query(f"WITH {_BOTH} SELECT item, name, price_cents FROM i WHERE item NOT IN (SELECT item FROM v) UNION ALL SELECT item, name || ' (' || label || ')', v.price_cents FROM v JOIN i USING (item)")
def publish_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.publish_rows(*_both(spark, sf_dir))


@query(f"WITH {_BOTH} SELECT i.item, name, category, price_cents, " + ", ".join(f"(SELECT v.price_cents FROM v WHERE v.item = i.item AND v.label = 'L{k}') AS \"price_L{k}\"" for k in range(1, 8)) + " FROM i")
def wide_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, variants = _both(spark, sf_dir)
    return X.wide(items, variants, [f"L{k}" for k in range(1, 8)])


@query(f"WITH {_BOTH} SELECT item, 0 AS line, 'item' AS kind, name, {_DOLLARS('price_cents')} AS price FROM i UNION ALL SELECT item, ordinal, 'modifier', label, {_DOLLARS('price_cents')} FROM v")
def pos_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pos_rows(*_both(spark, sf_dir))


@query(f"WITH {_BOTH} SELECT category, count(DISTINCT i.item) AS n_items, count(v.item) AS n_variants FROM i LEFT JOIN v USING (item) GROUP BY 1")
def nested_pos_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.nested_json(*_both(spark, sf_dir)).drop("document")


@query("SELECT o_orderkey, count(l_orderkey) AS n_lines, min(l_linenumber) AS first_line FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def nest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity")
    full = X.nest(B.table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", ["l_linenumber", "l_partkey", "l_quantity"], ["l_linenumber", "l_partkey"], "lines")
    return full.select("o_orderkey", F.size("lines").cast("bigint").alias("n_lines"), F.try_element_at("lines", F.lit(1))["l_linenumber"].alias("first_line"))


@query("""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_name END AS name, CASE WHEN p_partkey % 7 = 0 THEN 'abc' WHEN p_partkey % 5 = 0 THEN '$' || p_size || '.50' WHEN p_partkey % 3 = 0 THEN CAST(p_size * 100 AS VARCHAR) WHEN p_partkey % 2 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS price, p_partkey % 120 AS confidence FROM part),
c AS (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN CAST(replace(replace(price, '$', ''), '.', '') AS BIGINT) WHEN price = '' THEN NULL WHEN CAST(price AS BIGINT) >= 1000 THEN CAST(price AS BIGINT) ELSE CAST(price AS BIGINT) * 100 END AS price_cents FROM r)
SELECT p_partkey, price_cents, array_to_string(list_filter([CASE WHEN trim(name) = '' THEN 'name_required' END, CASE WHEN price <> '' AND price_cents IS NULL THEN 'price_unreadable' END, CASE WHEN NOT confidence BETWEEN 0 AND 100 THEN 'confidence_range' END], lambda x: x IS NOT NULL), ',') AS errors FROM c""")
def structured_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    price = F.when(key % 7 == 0, "abc").when(key % 5 == 0, F.concat(F.lit("$"), size.cast("string"), F.lit(".50"))).when(key % 3 == 0, (size * 100).cast("string")).when(key % 2 == 0, "").otherwise(size.cast("string"))
    rows = B.table(spark, sf_dir, "part").select("p_partkey", F.when(key % 11 == 0, " ").otherwise(F.col("p_name")).alias("name"), price.alias("price"), (key % 120).alias("confidence"))
    return X.validate(rows).select("p_partkey", "price_cents", F.array_join("errors", ",").alias("errors"))


@query(f"""WITH {_BOTH}, w AS (SELECT *, CASE WHEN (item + ordinal) % 4 < 3 THEN (item + ordinal) % 4 END AS grp, CASE ordinal % 4 WHEN 0 THEN 'combo' WHEN 1 THEN 'size' WHEN 2 THEN 'odd' END AS kind FROM v),
g AS (SELECT item, k AS grp, 'G' || k AS title, k = 1 AS required, 5 - k AS position FROM i, (VALUES (1), (2)) t(k) WHERE item % 3 > 0),
r AS (SELECT item, 0 AS part, 0 AS place, 0 AS ordinal, CASE WHEN item % 5 = 0 THEN 'Uncategorized' ELSE category END AS menu_group, name AS menu_item, {_DOLLARS('price_cents')} AS base_price, '' AS option_group, '' AS option, '' AS option_price, '' AS required FROM i
  UNION ALL SELECT item, 1, position, ordinal, '', '', '', title, label, {_DOLLARS('price_cents')}, CASE WHEN required THEN 'Y' ELSE 'N' END FROM w JOIN g USING (item, grp)
  UNION ALL SELECT item, 2, min(ordinal) OVER (PARTITION BY item, coalesce(kind, 'size')), ordinal, '', '', '', CASE coalesce(kind, 'size') WHEN 'size' THEN 'Size' WHEN 'combo' THEN 'Combo Add-on' ELSE 'Option' END, label, {_DOLLARS('price_cents')}, '' FROM w WHERE grp IS NULL)
SELECT item, row_number() OVER (PARTITION BY item ORDER BY part, place, ordinal) - 1 AS line, menu_group, menu_item, base_price, option_group, option, option_price, required FROM r""")
def menu_option_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without a category, with and without groups; variants of both groups, of none, and of a group that no item has."""
    items, variants = _both(spark, sf_dir)
    items = items.withColumn("category", F.when(F.col("item") % 5 > 0, F.col("category")))
    place, kind = (F.col("item") + F.col("ordinal")) % 4, F.col("ordinal") % 4
    variants = variants.withColumns({"grp": F.when(place < 3, place), "kind": F.when(kind == 0, "combo").when(kind == 1, "size").when(kind == 2, "odd")})
    groups = items.where("item % 3 > 0").select("item", F.explode(F.array(F.lit(1), F.lit(2))).alias("grp"))
    groups = groups.withColumns({"title": F.concat(F.lit("G"), F.col("grp").cast("string")), "required": F.col("grp") == 1, "position": 5 - F.col("grp")})
    return X.option_rows(items, groups, variants)


@query(f"WITH {_BOTH} SELECT f AS format, (SELECT count(*) FROM i) AS expected_items, (SELECT count(*) FROM i) AS actual_items, (SELECT count(*) FROM v) AS expected_variants, (SELECT count(*) FROM v) AS actual_variants, true AS ok FROM (VALUES ('csv'), ('json')) t(f)")
def export_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with quotes, commas, line ends and backslashes."""
    items, variants = _both(spark, sf_dir)
    odd = F.concat(F.col("name"), F.when(F.col("item") % 4 == 0, ', "x"').when(F.col("item") % 4 == 1, "\nline; \\N").when(F.col("item") % 4 == 2, '"').otherwise(""))
    return X.round_trips(items.withColumn("name", odd), variants)
