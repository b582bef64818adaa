"""Logical catalog tables over the star-schema test tables; each has a SQL form with the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Price weight of each type.
WEIGHTS = {"ECONOMY": 1, "SMALL": 2, "MEDIUM": 3, "STANDARD": 4, "LARGE": 5}

ITEMS = """items AS (
  SELECT p_brand AS menu_id, p_partkey AS pos, p_name AS name, p_type AS category,
    CAST(round(p_retailprice * p_size * p_size * CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'MEDIUM' THEN 3
      WHEN 'STANDARD' THEN 4 WHEN 'LARGE' THEN 5 ELSE 6 END) AS BIGINT) AS price_cents
  FROM part)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """menu_id, pos, name, category, price_cents."""
    weight = F.lit(6)
    for kind, w in WEIGHTS.items():
        weight = F.when(F.col("p_type") == kind, w).otherwise(weight)
    price = F.round(F.col("p_retailprice") * F.col("p_size") * F.col("p_size") * weight).cast("bigint")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("menu_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), price.alias("price_cents"))


VARIANTS = """variants AS (
  SELECT item, ordinal, price_cents FROM (
    SELECT l_partkey AS item, l_linenumber AS ordinal, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents,
      row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey, l_extendedprice) AS rn
    FROM lineitem) WHERE rn = 1)"""


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, ordinal, price_cents: one variant per part and line number, that of the lowest order."""
    least = F.min(F.struct("l_orderkey", "l_extendedprice")).alias("v")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("ordinal")).agg(least)
    return rows.select("item", "ordinal", F.round(F.col("v.l_extendedprice") * 100).cast("bigint").alias("price_cents"))


SCHEDULES = """schedules AS (
  SELECT o_custkey AS owner, o_orderkey AS id, CAST(o_orderdate AS DATE) AS date_from,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 30 END AS date_to,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 6 + o_orderkey % 12 END AS hour_from,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 10 + o_orderkey % 12 END AS hour_to
  FROM orders)"""


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owner, id, date_from, date_to (NULL: open), hour_from, hour_to (NULL: all day)."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("owner"), key.alias("id"), day.alias("date_from"), F.when(key % 5 != 0, F.date_add(day, 30)).alias("date_to"),
        F.when(key % 3 != 0, 6 + key % 12).alias("hour_from"), F.when(key % 3 != 0, 10 + key % 12).alias("hour_to"),
    )


VERSIONS = ITEMS + """,
version_a AS (SELECT menu_id, pos, name, category, price_cents FROM items WHERE pos % 7 <> 0),
version_b AS (SELECT menu_id, pos, name, category, price_cents + CASE WHEN pos % 5 = 0 THEN 100 ELSE 0 END AS price_cents FROM items WHERE pos % 11 <> 0)"""


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the items: some rows missing on either side, some prices changed."""
    rows = items(spark, sf_dir)
    shifted = rows.withColumn("price_cents", F.col("price_cents") + F.when(F.col("pos") % 5 == 0, 100).otherwise(0))
    return rows.where("pos % 7 <> 0"), shifted.where("pos % 11 <> 0")


def phrases_sql(templates: Sequence[str | None], key: str = "p_partkey", name: str = "p_name") -> str:
    """SQL of a text of each row: the template by key, with {n} as name and {p} as a price of p_size dollars and some cents."""
    told = ", ".join("NULL" if t is None else "'" + t.replace("'", "''") + "'" for t in templates)
    return f"replace(replace(list_extract([{told}], CAST(1 + {key} % {len(templates)} AS INTEGER)), '{{n}}', {name}), '{{p}}', p_size || '.' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0'))"


def phrases(templates: Sequence[str | None], key: str = "p_partkey", name: str = "p_name") -> Column:
    """The same as an expression over part."""
    text = F.element_at(F.array(*(F.lit(t) for t in templates)), (F.col(key) % len(templates) + 1).cast("int"))
    price = F.concat(F.col("p_size").cast("string"), F.lit("."), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"))
    return F.replace(F.replace(text, F.lit("{n}"), F.col(name)), F.lit("{p}"), price)
