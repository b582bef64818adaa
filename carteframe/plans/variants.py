"""Queries of variants: one item per part, its variants by line number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sizes
from ..operators import variants as V
from ..sources import bindings as B
from .registry import query

#: The variants with the category of their item.
_CAT = B.VARIANTS + """, v AS (SELECT p_type AS category, item, ordinal, price_cents FROM variants JOIN part ON p_partkey = item)"""


def _of(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("category"))
    return B.variants(spark, sf_dir).join(part, "item").select("category", "item", "ordinal", "price_cents")


@query("""WITH s AS (SELECT o_orderpriority AS category, o_orderkey AS item, count(*) AS n_variants FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING count(*) >= 2),
c AS (SELECT category, n_variants AS mode, count(*) AS c, min(item) AS p FROM s GROUP BY 1, 2),
m AS (SELECT category, mode, c AS mode_count, sum(c) OVER (PARTITION BY category) AS n, row_number() OVER (PARTITION BY category ORDER BY c DESC, p) AS rn FROM c)
SELECT s.category, s.item, s.n_variants, m.mode, m.mode_count, CAST(m.n AS BIGINT) AS group_items FROM s JOIN m ON m.category = s.category AND rn = 1 AND n >= 3 WHERE mode - n_variants >= 2""")
def variant_count_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items, their lines as variants, priorities as categories."""
    orders = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("category"))
    lines = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("ordinal"))
    return V.count_outliers(lines.join(orders, "item"), ["item"], ["category"], "item")


@query(f"""WITH {_CAT}, s AS (SELECT category, item, list_sort(list(DISTINCT CASE WHEN item % 9 = 0 AND ordinal % 2 = 0 THEN ordinal + 20 ELSE ordinal END)) AS labels FROM v GROUP BY 1, 2 HAVING count(DISTINCT ordinal) >= 2),
c AS (SELECT category, labels AS mode, count(*) AS c, min(item) AS p FROM s GROUP BY 1, 2),
m AS (SELECT category, mode, c AS mode_count, sum(c) OVER (PARTITION BY category) AS n, row_number() OVER (PARTITION BY category ORDER BY c DESC, p) AS rn FROM c)
SELECT s.category, s.item, array_to_string(s.labels, ',') AS labels, array_to_string(m.mode, ',') AS dominant FROM s JOIN m ON m.category = s.category AND rn = 1 AND n >= 3 AND mode_count / n >= 0.30
WHERE NOT list_has_all(mode, labels) AND NOT list_has_all(labels, mode)""")
def variant_label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.label_sets(_of(spark, sf_dir).withColumn("label", F.expr("CASE WHEN item % 9 = 0 AND ordinal % 2 = 0 THEN ordinal + 20 ELSE ordinal END")), ["item"], ["category"], "label", "item", share=0.30)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rows.select("category", "item", text("labels").alias("labels"), text("mode").alias("dominant"))


_STEPS = "st AS (SELECT *, lag(price_cents) OVER (PARTITION BY item ORDER BY ordinal) AS before FROM v WHERE price_cents > 0)"


@query(f"""WITH {_CAT}, {_STEPS}, a AS (SELECT category, item, sum(price_cents - before) / count(*) AS mean_step FROM st WHERE price_cents > before GROUP BY 1, 2),
m AS (SELECT category, median(mean_step) AS median, count(*) AS n FROM a GROUP BY 1), d AS (SELECT a.*, median, abs(mean_step - median) AS dev FROM a JOIN m USING (category) WHERE n >= 3),
k AS (SELECT category, median(dev) AS mad FROM d GROUP BY 1)
SELECT category, item, round(mean_step, 2) AS mean_step, CASE WHEN mean_step > median THEN 'above' ELSE 'below' END AS direction FROM d JOIN k USING (category) WHERE dev > 3 * greatest(mad, median * 0.15)""")
def variant_price_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.step_outliers(_of(spark, sf_dir), ["item"], ["category"], "ordinal").select("category", "item", F.round("mean_step", 2).alias("mean_step"), "direction")


@query(f"WITH {_CAT}, {_STEPS} SELECT item, ordinal, price_cents, before FROM st WHERE price_cents < before")
def variant_price_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.inversions(_of(spark, sf_dir), ["item"], "ordinal").select("item", "ordinal", "price_cents", "before")


@query(f"""WITH {_CAT}, s AS (SELECT item, min(ordinal) AS low, max(ordinal) AS high, list_sort(list(DISTINCT ordinal)) AS have FROM v GROUP BY 1),
g AS (SELECT *, list_filter(range(low, high + 1), lambda x: NOT list_contains(have, x)) AS missing FROM s WHERE high > low) SELECT item, array_to_string(missing, ',') AS missing FROM g WHERE len(missing) > 0""")
def variant_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.gaps(_of(spark, sf_dir), ["item"], "ordinal").select("item", F.array_join(F.sort_array("missing").cast("array<string>"), ",").alias("missing"))


@query("SELECT l_partkey AS item, l_linenumber AS ordinal, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def variant_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("ordinal"))
    return V.repeated_labels(rows, ["item"], "ordinal")


@query(f"""WITH {_CAT}, z AS (SELECT item, ordinal, CASE WHEN (item + ordinal) % 6 = 0 THEN 0 ELSE price_cents END AS price_cents FROM v)
SELECT item, ordinal FROM z WHERE price_cents = 0 AND item IN (SELECT item FROM z WHERE price_cents > 0)""")
def variant_zero_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _of(spark, sf_dir).withColumn("price_cents", F.when((F.col("item") + F.col("ordinal")) % 6 == 0, 0).otherwise(F.col("price_cents")))
    return V.zero_prices(rows, ["item"]).select("item", "ordinal")


@query("""SELECT l_partkey AS item, count(DISTINCT l_returnflag) AS n_kinds, CASE WHEN count(DISTINCT l_returnflag) >= 3 THEN 'warn' ELSE 'info' END AS severity FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) >= 2""")
def variant_mixed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("kind"))
    return V.kinds(rows, ["item"], "kind")


@query(f"""WITH {_CAT}, {_STEPS} SELECT item, ordinal, round(greatest(0.05, least(1.0, 0.5::DOUBLE + CASE WHEN ordinal % 2 = 0 THEN 0.10::DOUBLE ELSE -0.10::DOUBLE END + CASE WHEN ordinal % 3 = 0 THEN 0.05::DOUBLE ELSE 0.0 END + CASE WHEN item % 2 = 0 THEN 0.10::DOUBLE ELSE 0.0 END
  - 0.15::DOUBLE * CASE WHEN price_cents < before THEN 1 ELSE 0 END - 0.05::DOUBLE * CASE WHEN price_cents = before THEN 1 ELSE 0 END)), 4) AS confidence FROM st""")
def variant_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.steps(_of(spark, sf_dir).where("price_cents > 0"), ["item"], "ordinal")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    score = V.confidence(F.lit(0.5), F.col("ordinal") % 2 == 0, F.col("ordinal") % 3 == 0, F.col("item") % 2 == 0, flag(F.col("step") < 0), flag(F.col("step") == 0))
    return rows.select("item", "ordinal", F.round(score, 4).alias("confidence"))


@query("""WITH l AS (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN p_size || ' inch' WHEN 1 THEN p_size || ' pcs' WHEN 2 THEN list_extract(['Small', 'Med', 'LG', 'Family Size'], CAST(p_size % 4 AS INT) + 1) ELSE CAST(p_size AS VARCHAR) END AS label FROM part)
SELECT p_partkey, label, CASE p_partkey % 4 WHEN 0 THEN p_size || 'in' WHEN 1 THEN p_size || 'pc' WHEN 2 THEN list_extract(['S', 'M', 'L', 'Family'], CAST(p_size % 4 AS INT) + 1) ELSE CASE WHEN p_size BETWEEN 6 AND 30 THEN p_size || 'in' END END AS size,
  CAST(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 300 + p_size WHEN 2 THEN list_extract([20, 35, 40, 140], CAST(p_size % 4 AS INT) + 1) ELSE CASE WHEN p_size BETWEEN 6 AND 30 THEN p_size END END AS INT) AS ordinal,
  CASE p_partkey % 4 WHEN 0 THEN 'inch' WHEN 1 THEN 'piece' WHEN 2 THEN list_extract(['word', 'word', 'word', 'portion'], CAST(p_size % 4 AS INT) + 1) ELSE CASE WHEN p_size BETWEEN 6 AND 30 THEN 'inch' END END AS track FROM l""")
def size_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    word = F.element_at(F.array(*map(F.lit, ["Small", "Med", "LG", "Family Size"])), (F.col("p_size") % 4 + 1).cast("int"))
    label = F.when(key == 0, F.concat(size, F.lit(" inch"))).when(key == 1, F.concat(size, F.lit(" pcs"))).when(key == 2, word).otherwise(size)
    rows = B.table(spark, sf_dir, "part").select("p_partkey", label.alias("label")).withColumn("size", sizes.normalized(F.col("label")))
    return rows.withColumn("ordinal", sizes.ordinal(F.col("size")).cast("int")).withColumn("track", sizes.track(F.col("size")))


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%small%' THEN 'small' WHEN p_name LIKE '%large%' THEN 'large' ELSE CASE WHEN p_size IN (18, 20, 22, 24, 26, 28) THEN 'party' WHEN p_size = 16 THEN 'large' WHEN p_size = 14 THEN 'medium' WHEN p_size IN (8, 10, 12) THEN 'small' ELSE 'unknown' END END AS tier FROM part")
def size_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit('"'))
    return B.table(spark, sf_dir, "part").select("p_partkey", sizes.tier(text).alias("tier"))
