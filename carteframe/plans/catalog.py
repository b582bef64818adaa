"""Queries of names and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import catalog
from ..sources import bindings as B
from .registry import query

KEYWORDS = {"ECONOMY": ["small", "old"], "SMALL": ["small", "ring"], "MEDIUM": ["bolt", "rod"], "STANDARD": ["widget", "plate"], "LARGE": ["large", "gizmo"], "PROMO": ["hot", "red"]}
PRICE_BANDS = {"ECONOMY": (1000, 400_000), "SMALL": (2000, 800_000), "MEDIUM": (3000, 1_500_000), "STANDARD": (4000, 3_000_000), "LARGE": (5000, 5_000_000), "PROMO": (6000, 9_000_000)}

_NORM = r"regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(name)), '^((our|the|homemade|fresh|classic)\s+)+', ''), '\s+', ' ', 'g')), '[.:\- ]+$', '')"


@query(f"""WITH {B.ITEMS}, n AS (SELECT *, {_NORM} AS norm FROM items), g AS (SELECT menu_id, norm, count(*) AS group_size, count(DISTINCT price_cents) AS prices FROM n GROUP BY 1, 2 HAVING count(*) > 1)
SELECT n.menu_id, n.pos, n.norm, g.group_size, CASE WHEN g.prices <= 1 THEN 'info' ELSE 'warn' END AS severity FROM n JOIN g ON n.menu_id = g.menu_id AND n.norm = g.norm""")
def duplicate_names_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicate_names(B.items(spark, sf_dir), ["menu_id"]).select("menu_id", "pos", "norm", "group_size", "severity")


@query()
def duplicate_names_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.fuzzy_names(B.items(spark, sf_dir), ["menu_id"])


_NEAR2 = "list_filter([lag(category, 2) OVER w, lag(category, 1) OVER w, lead(category, 1) OVER w, lead(category, 2) OVER w], lambda x: x IS NOT NULL)"
_MODE = "list_sort(list_transform(list_distinct(near), lambda v: {'n': -len(list_filter(near, lambda x: x = v)), 'p': list_position(near, v), 'v': v}))[1]"


@query(f"""WITH {B.ITEMS}, n AS (SELECT *, {_NEAR2} AS near FROM items WINDOW w AS (PARTITION BY menu_id ORDER BY pos))
SELECT menu_id, pos, category, array_to_string(near, ',') AS neighbours, {_MODE}.v AS dominant_category FROM n WHERE len(near) >= 2 AND NOT list_contains(near, category)""")
def category_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.isolated(B.items(spark, sf_dir), ["menu_id"]).select("menu_id", "pos", "category", "neighbours", "dominant_category")


_NEAR3 = "list_filter([lag(category, 3) OVER w, lag(category, 2) OVER w, lag(category, 1) OVER w, lead(category, 1) OVER w, lead(category, 2) OVER w, lead(category, 3) OVER w], lambda x: x IS NOT NULL)"
_HITS = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN " + " + ".join(f"CAST(contains(norm, '{w}') AS INT)" for w in ws) for k, ws in KEYWORDS.items()) + " ELSE 0 END"
_FITS = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN price_cents BETWEEN {a} AND {b}" for k, (a, b) in PRICE_BANDS.items()) + " ELSE false END"


@query(f"""WITH {B.ITEMS}, n AS (SELECT *, {_NORM} AS norm, {_NEAR3} AS near, pos % 100 AS conf FROM items WINDOW w AS (PARTITION BY menu_id ORDER BY pos)),
m AS (SELECT *, {_MODE} AS best FROM n WHERE len(near) >= 3), b AS (SELECT *, best.v AS suggested, -best.n / len(near) AS agreement FROM m WHERE best.v <> category),
h AS (SELECT *, {_HITS("category")} AS own, {_HITS("suggested")} AS other, {_FITS("category")} AS fit_own, {_FITS("suggested")} AS fit_other FROM b WHERE agreement >= 0.6),
s AS (SELECT *, least(1.0, greatest(0.0, agreement * 0.40::DOUBLE + CASE WHEN other > own THEN 0.20::DOUBLE WHEN own > other THEN -0.20::DOUBLE ELSE 0.0 END + CASE WHEN fit_other AND NOT fit_own THEN 0.15::DOUBLE WHEN fit_own AND NOT fit_other THEN -0.15::DOUBLE ELSE 0.0 END + CASE WHEN conf < 50 THEN 0.10::DOUBLE WHEN conf >= 80 THEN -0.15::DOUBLE ELSE 0.0 END)) AS confidence FROM h WHERE own < 2)
SELECT menu_id, pos, category, suggested, round(agreement, 3) AS agreement, round(confidence, 3) AS confidence FROM s WHERE confidence >= 0.30""")
def category_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.items(spark, sf_dir).withColumn("category_confidence", F.col("pos") % 100)
    return catalog.suggestions(rows, ["menu_id"], KEYWORDS, PRICE_BANDS)


_SCORE = lambda k, i: f"{{'raw': -(4 * ({' + '.join(f'CAST(contains(low, {w!r}) AS INT)' for w in KEYWORDS[k])}) + CASE WHEN price_cents IS NULL OR price_cents <= 0 THEN 0 WHEN price_cents BETWEEN {PRICE_BANDS[k][0]} AND {PRICE_BANDS[k][1]} THEN 2 WHEN price_cents < {PRICE_BANDS[k][0] // 2} OR price_cents > {PRICE_BANDS[k][1] * 2} THEN -1 ELSE 0 END), 'o': {i}, 'c': '{k}'}}"


@query(f"""WITH {B.ITEMS}, l AS (SELECT *, lower(name) AS low FROM items), s AS (SELECT *, list_sort([{", ".join(_SCORE(k, i) for i, k in enumerate(KEYWORDS))}])[1] AS best FROM l)
SELECT menu_id, pos, CASE WHEN -best.raw <= 0 THEN CASE WHEN price_cents <= 799 THEN 'Beverages' ELSE 'Other' END ELSE best.c END AS category,
  CAST(CASE WHEN -best.raw <= 0 THEN CASE WHEN price_cents <= 799 THEN 35 ELSE 15 END ELSE 40 + least(6 * -best.raw, 55) END AS INT) AS confidence, CAST(-best.raw AS INT) AS raw FROM s""")
def category_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.items(spark, sf_dir).withColumn("_i", catalog.infer_category(F.col("name"), KEYWORDS, PRICE_BANDS, F.col("price_cents"), "Other"))
    return rows.select("menu_id", "pos", "_i.category", F.col("_i.confidence").cast("int").alias("confidence"), F.col("_i.raw").cast("int").alias("raw"))


@query(f"""WITH {B.ITEMS}, b AS (SELECT *, CASE WHEN pos % 3 = 0 THEN category END AS known FROM items)
SELECT menu_id, pos, last_value(known IGNORE NULLS) OVER (PARTITION BY menu_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inferred FROM b""")
def category_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.items(spark, sf_dir).withColumn("known", F.when(F.col("pos") % 3 == 0, F.col("category")))
    return catalog.sequential_categories(rows, ["menu_id"], "pos", "known").select("menu_id", "pos", "inferred")


#: The SQL form for names without abbreviations and plurals.
TOKENS = lambda c: f"list_filter(list_distinct(string_split_regex(lower({c}), '[^a-z0-9]+')), lambda x: length(x) > 1 AND NOT list_contains([{', '.join(repr(w) for w in names.GENERIC)}], x))"


@query(f"""WITH {B.ITEMS}, d AS (SELECT DISTINCT name FROM items), t AS (SELECT name, {TOKENS('name')} AS tk FROM d)
SELECT a.name AS a, b.name AS b, CAST(floor(100 * len(list_intersect(a.tk, b.tk)) / len(a.tk) + 0.5) AS INT) AS score FROM t a, t b WHERE a.name <> b.name AND len(list_intersect(a.tk, b.tk)) > 0""")
def name_similarity_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.items(spark, sf_dir).select("name").distinct()
    word = F.explode(names.menu_tokens(F.col("name")))
    pairs = rows.select(F.col("name").alias("a"), word.alias("w")).join(rows.select(F.col("name").alias("b"), word.alias("w")), "w").where("a != b").select("a", "b").distinct()
    return pairs.withColumn("score", catalog.token_similarity(F.col("a"), F.col("b")))


@query(f"""WITH {B.ITEMS} SELECT menu_id, category, count(*) AS n_items, min(pos) AS first_pos, count(DISTINCT name) AS n_names, trim(regexp_replace(lower(menu_id), '[^a-z0-9]+', '-', 'g'), '-') AS menu_slug FROM items GROUP BY 1, 2""")
def grouped_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.items(spark, sf_dir).groupBy("menu_id", "category").agg(F.count("*").alias("n_items"), F.min("pos").alias("first_pos"), F.countDistinct("name").alias("n_names"))
    return rows.withColumn("menu_slug", names.slug(F.col("menu_id")))
