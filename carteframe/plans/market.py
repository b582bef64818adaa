"""Queries of competitor prices: parts of even keys are own items, the others anchors at one of ten places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions import prices as P
from ..operators import market
from ..sources import bindings as B
from .catalog import TOKENS
from .registry import query

_SPLIT = B.ITEMS + ", own AS (SELECT * FROM items WHERE pos % 2 = 0), anchors AS (SELECT *, pos % 10 AS place FROM items WHERE pos % 2 = 1)"
_RANGES = _SPLIT + """,
c AS (SELECT DISTINCT category, price_cents FROM own WHERE price_cents > 0),
p AS (SELECT c.category, c.price_cents, a.price_cents AS ap, abs(a.price_cents - c.price_cents) AS off FROM c JOIN anchors a ON a.category = c.category AND a.price_cents > 0),
w AS (SELECT *, off <= greatest(CAST(floor(price_cents * 0.3::DOUBLE) AS BIGINT), 300) AS w0, off <= greatest(CAST(floor(price_cents * 0.5::DOUBLE) AS BIGINT), 500) AS w1, off <= greatest(price_cents, 800) AS w2 FROM p),
n AS (SELECT category, price_cents, count(*) FILTER (WHERE w0) AS n0, count(*) FILTER (WHERE w1) AS n1, count(*) FILTER (WHERE w2) AS n2 FROM w GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN n0 >= 3 THEN 0 WHEN n1 >= 3 THEN 1 ELSE 2 END AS band FROM n),
m AS (SELECT w.category, w.price_cents, band, count(*) AS n, min(ap) AS low, max(ap) AS high, list_sort(list(ap)) AS ps FROM w JOIN b ON b.category = w.category AND b.price_cents = w.price_cents WHERE CASE band WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END GROUP BY 1, 2, 3 HAVING count(*) >= 2),
ranges AS (SELECT category, price_cents, band, n, low, high, ps[n // 2 + 1] AS median FROM m)"""


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = B.items(spark, sf_dir)
    return rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1").withColumn("place", F.col("pos") % 10)


@query(f"WITH {_RANGES} SELECT category, price_cents, band, n, low, high, median FROM ranges")
def market_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.ranges(*_split(spark, sf_dir))


@query(f"""WITH {_RANGES} SELECT o.pos, o.price_cents, CASE WHEN o.price_cents < low THEN 'below_market' WHEN o.price_cents > high THEN 'above_market' WHEN o.price_cents < 0.9::DOUBLE * median THEN 'lower_range' WHEN o.price_cents > 1.1::DOUBLE * median THEN 'higher_range' ELSE 'fair' END AS assessment
FROM own o JOIN ranges r ON r.category = o.category AND r.price_cents = o.price_cents""")
def price_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, anchors = _split(spark, sf_dir)
    rows = market.with_ranges(own.select("pos", "category", "price_cents"), anchors)
    return rows.select("pos", "price_cents", market.assessment(F.col("price_cents"), F.col("low"), F.col("high"), F.col("median")).alias("assessment"))


@query(f"""WITH {_SPLIT}, p AS (SELECT o.pos AS item_id, a.pos AS anchor_id, a.place AS place_id, a.price_cents AS anchor_price, CAST(CASE WHEN len({TOKENS('o.name')}) = 0 THEN 0 ELSE floor(100 * len(list_intersect({TOKENS('o.name')}, {TOKENS('a.name')})) / len({TOKENS('o.name')}) + 0.5) END AS INT) AS similarity FROM own o JOIN anchors a USING (menu_id, category)),
n AS (SELECT *, row_number() OVER (PARTITION BY item_id, place_id ORDER BY similarity DESC, anchor_price, anchor_id) AS k FROM p WHERE similarity >= 50)
SELECT item_id, anchor_id, similarity, CAST(row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, anchor_price, anchor_id) AS INT) AS rank FROM n WHERE k <= 2 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, anchor_price, anchor_id) <= 8""")
def market_sources_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, anchors = _split(spark, sf_dir)
    own = own.select("menu_id", "category", F.col("pos").alias("item_id"), "name")
    anchors = anchors.select("menu_id", "category", F.col("pos").alias("anchor_id"), F.col("place").alias("place_id"), F.col("name").alias("anchor_name"), F.col("price_cents").alias("anchor_price"))
    out = market.top_sources(own, anchors, ["menu_id", "category"], names.menu_tokens(F.col("name")), names.menu_tokens(F.col("anchor_name")))
    return out.select("item_id", "anchor_id", "similarity", "rank")


@query(f"WITH {B.ITEMS} SELECT category, price_cents, count(*) AS n_items, min(pos) AS first_pos FROM items WHERE price_cents > 0 GROUP BY 1, 2 HAVING count(*) >= 2")
def category_range_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.clusters(B.items(spark, sf_dir)).where("n_items >= 2")


@query("SELECT s_nationkey, count(*) AS n_places, round(avg(CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 5 + 0.5 END), 2) AS mean_rating FROM supplier GROUP BY 1")
def market_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rating = F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey") % 5 + 0.5)
    return market.summary(B.table(spark, sf_dir, "supplier").withColumn("rating", rating), ["s_nationkey"])


@query("""WITH p AS (SELECT s_suppkey % 80 AS place_id, s_suppkey AS seen, 40 + (s_suppkey % 17) / 10.0::DOUBLE AS lat, -75 + (s_suppkey % 13) / 10.0::DOUBLE AS lng FROM supplier),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY seen) = 1),
d AS (SELECT place_id, round(2 * 3958.8 * asin(sqrt(least(1.0, pow(sin(radians(lat - 40.5) / 2), 2) + cos(radians(40.5)) * cos(radians(lat)) * pow(sin(radians(lng + 74.5) / 2), 2)))), 3) AS miles FROM f)
SELECT place_id, miles FROM d ORDER BY miles, place_id LIMIT 40""")
def nearby_dedupe_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    places = B.table(spark, sf_dir, "supplier").select((key % 80).alias("place_id"), key.alias("seen"), (40 + (key % 17) / 10.0).alias("lat"), (-75 + (key % 13) / 10.0).alias("lng"))
    first = places.groupBy("place_id").agg(F.min_by(F.struct("lat", "lng"), "seen").alias("at")).select("place_id", "at.*")
    miles = P.haversine_miles(F.lit(40.5), F.lit(-74.5), F.col("lat"), F.col("lng"))
    return first.select("place_id", F.round(miles, 3).alias("miles")).orderBy("miles", "place_id").limit(40)


@query(f"""WITH {B.ITEMS}, r AS (SELECT *, CASE pos % 5 WHEN 0 THEN 'dish' WHEN 1 THEN 'side' WHEN 2 THEN 'variant' WHEN 3 THEN 'modifier' END AS role FROM items)
SELECT menu_id, name, price_cents AS low, price_cents AS high, 1 AS n FROM r WHERE role IS NULL OR role IN ('dish', 'side', 'dessert') UNION ALL SELECT menu_id, name, min(price_cents), max(price_cents), count(*) FROM r WHERE role = 'variant' GROUP BY 1, 2""")
def collapse_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("pos") % 5 == 0, "dish").when(F.col("pos") % 5 == 1, "side").when(F.col("pos") % 5 == 2, "variant").when(F.col("pos") % 5 == 3, "modifier")
    return market.collapse_variants(B.items(spark, sf_dir).withColumn("role", role).withColumn("canonical_name", F.col("name")), ["menu_id"])
