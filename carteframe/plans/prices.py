"""Queries of price checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prices
from ..sources import bindings as B
from .registry import query


@query("""
WITH m AS (SELECT event_type, count(value) AS n, median(value) AS median FROM events WHERE value > 0 GROUP BY 1),
d AS (SELECT e.event_id, e.event_type, e.value, m.median, abs(e.value - m.median) AS dev FROM events e JOIN m USING (event_type) WHERE m.n >= 3 AND m.median > 0 AND e.value > 0),
k AS (SELECT event_type, median(dev) AS mad FROM d GROUP BY 1)
SELECT event_id, event_type, round(value, 4) AS value, round(median, 4) AS median, round(mad, 4) AS mad,
  CASE WHEN value > median THEN 'above' ELSE 'below' END AS direction
FROM d JOIN k USING (event_type) WHERE dev > 3 * greatest(mad, median * 0.1)""")
def category_price_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prices.category_outliers(B.table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value")
    return found.select("event_id", "event_type", *(F.round(c, 4).alias(c) for c in ("value", "median", "mad")), "direction")


@query(f"""
WITH {B.ITEMS}, m AS (SELECT category, count(*) AS n, median(price_cents) AS median FROM items WHERE price_cents > 0 GROUP BY 1),
d AS (SELECT i.*, m.median, m.n, abs(i.price_cents - m.median) AS dev FROM items i JOIN m USING (category) WHERE n >= 3 AND price_cents > 0),
k AS (SELECT category, median(dev) AS mad FROM d GROUP BY 1)
SELECT menu_id, pos, category, price_cents, CAST(trunc(median) AS BIGINT) AS median_cents, CAST(trunc(mad) AS BIGINT) AS mad_cents, CASE WHEN price_cents > median THEN 'above' ELSE 'below' END AS direction
FROM d JOIN k USING (category) WHERE dev > 3 * greatest(mad, median * 0.1)""")
def item_price_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prices.category_outliers(B.items(spark, sf_dir), ["category"])
    return found.select("menu_id", "pos", "category", "price_cents", F.col("median").cast("bigint").alias("median_cents"), F.col("mad").cast("bigint").alias("mad_cents"), "direction")


_BANDS = """r AS (SELECT category, price_cents, row_number() OVER (PARTITION BY category ORDER BY price_cents) AS rn, count(*) OVER (PARTITION BY category) AS n FROM priced WHERE price_cents > 0),
bands AS (SELECT category, max(n) AS n, median(price_cents) AS median, median(price_cents) FILTER (WHERE rn <= n // 2) AS q1, median(price_cents) FILTER (WHERE rn > n // 2) AS q3 FROM r GROUP BY category HAVING max(n) >= 3)"""


@query(f"""WITH {B.ITEMS}, priced AS (SELECT * FROM items), {_BANDS}
SELECT category, n, median, q1, q3, greatest(q3 - q1, 1) AS iqr FROM bands""")
def price_band_half_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.bands(B.items(spark, sf_dir), ["category"])


@query(f"""WITH {B.ITEMS}, priced AS (SELECT menu_id, pos, category, price_cents * CASE WHEN pos % 50 = 0 THEN 100 ELSE 1 END AS price_cents FROM items), {_BANDS},
far AS (SELECT p.*, median, greatest(q3 - q1, 1) AS iqr FROM priced p JOIN bands USING (category) WHERE p.price_cents > 0 AND abs(p.price_cents - median) / greatest(q3 - q1, 1) > 4),
c AS (SELECT f.menu_id, f.pos, d.d, abs(f.price_cents / d.d - median) / median AS off FROM far f, (VALUES (10), (100), (1000)) d(d) WHERE f.price_cents % d.d = 0 AND f.price_cents / d.d > 25 AND f.price_cents / d.d < 50000),
b AS (SELECT menu_id, pos, min(off) AS off, arg_min(d, off) AS d FROM c GROUP BY 1, 2)
SELECT f.menu_id, f.pos, f.category, f.price_cents,
  CASE WHEN abs(f.price_cents - median) / median > 5 * b.off THEN b.d END AS divisor,
  CASE WHEN abs(f.price_cents - median) / median > 5 * b.off THEN f.price_cents // b.d END AS corrected_cents,
  CASE WHEN abs(f.price_cents - median) / median > 5 * b.off THEN 'auto_fix' ELSE 'warn' END AS severity
FROM far f LEFT JOIN b USING (menu_id, pos)""")
def decimal_shift_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.items(spark, sf_dir).withColumn("price_cents", F.col("price_cents") * F.when(F.col("pos") % 50 == 0, 100).otherwise(1))
    return prices.decimal_shifts(rows, ["category"]).select("menu_id", "pos", "category", "price_cents", "divisor", "corrected_cents", "severity")


_ROLE_TEXTS = [
    "{n}", "Add {n}", "{n} with Jalapeños", "Side: {n}", "Bleu cheese {n}", "{n} special", "Buy one {n}", "{n} for only {p}", "{n} + {n}", "{n} + {n} + {n} + {n} + {n} + {n} + {n} + {n}",
    "{n} and {n} and {n} and {n} and {n} and {n} and {n}", "", None, "  ", "Extra {n} {n} {n} {n} {n} {n} {n} {n} {n}", "Pick Any {n}", "Per topping", "{n}s", "Breadsticks",
]
_ROLE_CATEGORIES = ["ECONOMY", "Sides", "Sides / Appetizers", "toppings", None, "Side Orders", "Dressings"]
#: The rule as SQL, its words written out here once more.
_ROLE_SQL = """CASE WHEN t <> '' AND (length(t) <= 64 AND regexp_matches(t, 'add |extra |side of|side:|topping|toppings|each topping|per topping|extra cheese|add cheese|add bacon|add pepperoni|extra sauce|cup of sauce|ranch|blue cheese|bleu cheese|dressing|jalapeños|peppers|mushrooms|onions|olive|olives|garlic knots|breadsticks|fries|chips')
  OR lower(coalesce(category, '')) IN ('toppings', 'extras', 'sides', 'dressings') AND t <> '') THEN 'side'
  WHEN regexp_matches(t, 'coupon|special|specials|deal|family deal|family special|combo|combos|meal deal|value meal|2 for|two for|3 for|three for|buy 1|buy one|get 1|get one|bogo|any 2|any two|pick any|choose any|only|for only|just') OR length(t) > 80 AND (contains(t, ' and ') OR contains(t, ' + ')) THEN 'deal' ELSE 'primary' END"""


@query(f"""WITH x AS (SELECT p_partkey AS pos, {B.phrases_sql(_ROLE_TEXTS)} AS name, {B.phrases_sql(_ROLE_CATEGORIES)} AS category FROM part), l AS (SELECT *, lower(trim(coalesce(name, ''))) AS t FROM x)
SELECT pos, {_ROLE_SQL} AS price_role FROM l""")
def price_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), B.phrases(_ROLE_TEXTS).alias("name"), B.phrases(_ROLE_CATEGORIES).alias("category"))
    return rows.select("pos", prices.role(F.col("name"), F.col("category")).alias("price_role"))


@query(f"""WITH {B.ITEMS}, x AS (SELECT menu_id, pos, category, price_cents * CASE WHEN pos % 50 = 0 THEN 100 WHEN pos % 3 = 0 THEN 7 ELSE 1 END AS price_cents, pos % 3 <> 0 AND category <> 'PROMO' AS main FROM items),
priced AS (SELECT * FROM x WHERE main OR category NOT IN (SELECT category FROM x WHERE main)), {_BANDS}
SELECT category, n, median, q1, q3, greatest(q3 - q1, 1) AS iqr FROM bands""")
def price_band_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands from primary items; a category without any (PROMO) falls back to all."""
    rows = B.items(spark, sf_dir).withColumn("price_cents", F.col("price_cents") * F.when(F.col("pos") % 50 == 0, 100).when(F.col("pos") % 3 == 0, 7).otherwise(1))
    return prices.bands(rows.withColumn("main", (F.col("pos") % 3 != 0) & (F.col("category") != "PROMO")), ["category"], primary="main")


@query(f"""WITH {B.ITEMS}, z AS (SELECT menu_id, pos, category, CASE WHEN pos % 40 = 0 THEN 0 WHEN pos % 41 = 0 THEN NULL ELSE price_cents END AS price_cents FROM items)
SELECT menu_id, pos, category, 'zero_price_in_group' AS reason, 'warn' AS severity FROM z WHERE price_cents <= 0""")
def zero_price_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("pos") % 40 == 0, 0).when(F.col("pos") % 41 != 0, F.col("price_cents"))
    rows = B.items(spark, sf_dir).withColumn("price_cents", price).where("price_cents <= 0")
    return rows.select("menu_id", "pos", "category", F.lit("zero_price_in_group").alias("reason"), F.lit("warn").alias("severity"))


_COHERENCE_NAMES = {"ECONOMY": "Beverages", "SMALL": "Sides / Appetizers", "MEDIUM": "Desserts", "STANDARD": "Salads", "LARGE": "Pizza", "PROMO": "Pasta"}


@query(f"""WITH {B.ITEMS}, named AS (SELECT menu_id, pos, price_cents, CASE category {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _COHERENCE_NAMES.items())} END AS category FROM items),
rules(cheap, dear) AS (VALUES ('Beverages', 'Sides / Appetizers'), ('Beverages', 'Salads'), ('Beverages', 'Wings'), ('Beverages', 'Subs / Sandwiches'), ('Beverages', 'Burgers'), ('Beverages', 'Pizza'), ('Beverages', 'Pasta'), ('Beverages', 'Calzones / Stromboli'),
  ('Sides / Appetizers', 'Subs / Sandwiches'), ('Sides / Appetizers', 'Burgers'), ('Sides / Appetizers', 'Pizza'), ('Sides / Appetizers', 'Pasta'), ('Sides / Appetizers', 'Calzones / Stromboli'), ('Desserts', 'Pizza'), ('Desserts', 'Pasta'), ('Desserts', 'Calzones / Stromboli')),
m AS (SELECT menu_id, category, median(price_cents) AS med FROM named WHERE price_cents > 0 GROUP BY 1, 2 HAVING count(*) >= 2),
a AS (SELECT c.menu_id, cheap, dear, c.med AS cheap_median, d.med AS dear_median FROM rules JOIN m c ON c.category = cheap JOIN m d ON d.category = dear AND d.menu_id = c.menu_id WHERE d.med >= c.med * 1.3),
v AS (SELECT i.menu_id, pos, 'above' AS direction, category, price_cents, dear AS compared, price_cents - CAST(trunc(dear_median) AS BIGINT) AS gap FROM named i JOIN a ON a.menu_id = i.menu_id AND category = cheap AND price_cents > dear_median
  UNION ALL SELECT i.menu_id, pos, 'below', category, price_cents, cheap, CAST(trunc(cheap_median) AS BIGINT) - price_cents FROM named i JOIN a ON a.menu_id = i.menu_id AND category = dear AND price_cents < cheap_median AND price_cents > 0)
SELECT menu_id, pos, direction, category, price_cents, compared, gap FROM v QUALIFY row_number() OVER (PARTITION BY menu_id, pos, direction ORDER BY gap DESC, compared) = 1""")
def cross_category_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in _COHERENCE_NAMES.items() for x in pair))
    rules = spark.createDataFrame(prices.COHERENCE, "cheap string, dear string")
    return prices.coherence(B.items(spark, sf_dir).withColumn("category", names[F.col("category")]), ["menu_id"], rules)
