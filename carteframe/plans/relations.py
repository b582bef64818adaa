"""Queries of look-ups, nests, logs and roll-ups: customers stand for owners, orders for menus or drafts, parts for items,
lines for variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relations as R
from ..sources import bindings as B
from .registry import query

_LINES = "lines AS (SELECT l_orderkey AS draft, l_linenumber AS line, l_partkey AS item, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents, CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey % 4 END AS grp FROM lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    grp = F.when(F.col("l_suppkey") % 4 > 0, F.col("l_suppkey") % 4).alias("grp")
    return B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("draft"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("item"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price_cents"), grp)


@query(f"WITH {_LINES} SELECT draft, count(*) AS n, sum(item) AS items FROM lines WHERE NOT (item IN (SELECT p_partkey FROM part WHERE p_size < 10) AND draft = (SELECT min(l_orderkey) FROM lineitem)) GROUP BY 1")
def delete_listed_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed items leave one draft only, whatever other drafts hold them."""
    lines = _lines(spark, sf_dir)
    listed = B.table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("item"))
    first = lines.agg(F.min("draft")).first()[0]
    return R.without_listed(lines, listed, "item", "draft", F.lit(first)).groupBy("draft").agg(F.count("*").alias("n"), F.sum("item").alias("items"))


@query("""WITH a(asked) AS (VALUES ('nation_3'), ('ion_1'), ('  NATION_2 '), ('24'), ('xyz'), ('')), n AS (SELECT lower(n_name) AS name, n_nationkey AS k FROM nation),
e AS (SELECT asked, min(k) AS n_nationkey, 0 AS rank FROM a JOIN n ON name = lower(trim(asked)) GROUP BY 1)
SELECT asked, n_nationkey, rank FROM e UNION ALL SELECT asked, min(k), 1 FROM a JOIN n ON contains(name, lower(trim(asked))) WHERE trim(asked) <> '' AND asked NOT IN (SELECT asked FROM e) GROUP BY 1""")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(x,) for x in ("nation_3", "ion_1", "  NATION_2 ", "24", "xyz", "")], "asked string")
    return R.looked_up(B.table(spark, sf_dir, "nation"), asked, "n_name", "n_nationkey")


@query("SELECT o_custkey AS owner, o_orderkey AS id, o_orderpriority AS season FROM orders WHERE o_orderpriority = '1-URGENT' OR (o_orderpriority IS NOT NULL AND o_orderstatus = 'F')")
def seasonal_menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "orders").where((F.col("o_orderpriority") == "1-URGENT") | F.col("o_orderpriority").isNotNull() & (F.col("o_orderstatus") == "F"))
    return rows.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("season"))


_GROUPS = "groups AS (SELECT p_partkey AS item, g AS grp, CASE WHEN (p_partkey + g) % 3 > 0 THEN 10 - g END AS position FROM part, (VALUES (1), (2), (3)) t(g) WHERE p_size % 5 > 0 OR g = 1)"


@query(f"""WITH {_LINES}, {_GROUPS}, m AS (SELECT g.item, g.grp, count(l.item) AS n FROM groups g LEFT JOIN lines l ON l.item = g.item AND l.grp = g.grp GROUP BY 1, 2),
f AS (SELECT item, grp FROM groups QUALIFY row_number() OVER (PARTITION BY item ORDER BY coalesce(position, 1000000000), grp) = 1)
SELECT p_partkey AS item, (SELECT count(*) FROM m WHERE m.item = p_partkey) AS n_groups, (SELECT coalesce(CAST(sum(n) AS BIGINT), 0) FROM m WHERE m.item = p_partkey) AS n_modifiers, (SELECT count(*) FROM lines l WHERE l.item = p_partkey AND grp IS NULL) AS n_ungrouped, (SELECT grp FROM f WHERE f.item = p_partkey) AS first_group FROM part""")
def draft_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = B.table(spark, sf_dir, "part")
    g = F.explode(F.when(F.col("p_size") % 5 > 0, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1)))).alias("grp")
    groups = parts.select(F.col("p_partkey").alias("item"), g).withColumn("position", F.when((F.col("item") + F.col("grp")) % 3 > 0, 10 - F.col("grp")))
    variants = _lines(spark, sf_dir).select("item", F.col("grp").cast("int").alias("grp"), (F.col("draft") * 8 + F.col("line")).alias("variant"), F.col("line").alias("position"))
    full = R.tree(parts.select(F.col("p_partkey").alias("item")), groups, variants)
    modifiers = F.aggregate("groups", F.lit(0).cast("bigint"), lambda n, x: n + F.size(x["modifiers"]))
    return full.select("item", F.size("groups").cast("bigint").alias("n_groups"), modifiers.alias("n_modifiers"), F.size("ungrouped").cast("bigint").alias("n_ungrouped"), F.try_element_at("groups", F.lit(1))["grp"].alias("first_group"))


@query("SELECT l_partkey AS item, l_orderkey AS draft, l_linenumber AS line FROM lineitem JOIN part ON p_partkey = l_partkey WHERE nullif(l_suppkey % 4, 0) IS NULL")
def ungrouped_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"))
    return _lines(spark, sf_dir).where("grp is null").join(parts, "item").select("item", "draft", "line")


@query("SELECT c_nationkey AS owner, count(*) AS n_links, min(c_custkey) AS first_user FROM customer JOIN nation ON n_nationkey = c_nationkey AND c_acctbal > 0 GROUP BY 1")
def active_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = B.table(spark, sf_dir, "customer")
    owners = B.table(spark, sf_dir, "nation")
    return users.join(owners, (F.col("c_nationkey") == F.col("n_nationkey")) & (F.col("c_acctbal") > 0)).groupBy(F.col("c_nationkey").alias("owner")).agg(F.count("*").alias("n_links"), F.min("c_custkey").alias("first_user"))


@query("""SELECT c_custkey AS owner, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_drafts, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS n_menus, (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS n_items FROM customer""")
def owner_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = B.table(spark, sf_dir, "orders")
    drafts = orders.groupBy(F.col("o_custkey").alias("owner")).agg(F.count("*").alias("n_drafts"), F.count_if(F.col("o_orderstatus") == "O").alias("n_menus"))
    items = orders.join(B.table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("owner")).agg(F.count("*").alias("n_items"))
    every = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner")).join(drafts, "owner", "left").join(items, "owner", "left")
    return every.fillna(0, ["n_drafts", "n_menus", "n_items"])


@query("SELECT l_orderkey AS draft, l_linenumber AS line, p_type AS subcategory, n_name AS place FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 5) p ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey")
def located_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the sub-category of their item, if it is known, and the place of their owner."""
    known = B.table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("subcategory"))
    places = B.table(spark, sf_dir, "supplier").join(B.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("place"))
    rows = B.table(spark, sf_dir, "lineitem").join(known, "l_partkey", "left").join(places, "l_suppkey")
    return rows.select(F.col("l_orderkey").alias("draft"), F.col("l_linenumber").alias("line"), "subcategory", "place")


@query("""WITH o AS (SELECT lower(trim(CASE WHEN p_partkey % 9 = 0 THEN p_name || ' old' ELSE p_name END)) AS key, arg_max(struct_pack(name := CASE WHEN p_partkey % 9 = 0 THEN p_name || ' old' ELSE p_name END, price := CAST(p_size AS VARCHAR), category := p_type), p_partkey) AS o FROM part WHERE p_partkey % 7 > 0 GROUP BY 1),
n AS (SELECT lower(trim(p_name)) AS key, arg_max(struct_pack(name := CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END, price := CAST(p_size + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS VARCHAR), category := CASE WHEN p_partkey % 6 = 0 THEN ' ' ELSE p_type END), p_partkey) AS n FROM part WHERE p_partkey % 11 > 0 GROUP BY 1),
j AS (SELECT coalesce(o.key, n.key) AS key, o, n FROM o FULL JOIN n ON o.key = n.key)
SELECT key, 'removed' AS change, trim(o.name) AS before, '' AS after FROM j WHERE n IS NULL UNION ALL SELECT key, 'added', '', trim(n.name) FROM j WHERE o IS NULL
UNION ALL SELECT key, 'name', trim(o.name), trim(n.name) FROM j WHERE o IS NOT NULL AND n IS NOT NULL AND trim(o.name) <> trim(n.name) UNION ALL SELECT key, 'price', o.price, n.price FROM j WHERE o IS NOT NULL AND n IS NOT NULL AND o.price <> n.price UNION ALL SELECT key, 'category', trim(o.category), trim(n.category) FROM j WHERE o IS NOT NULL AND n IS NOT NULL AND trim(o.category) <> trim(n.category)""")
def changes_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of one list, each without some rows, with some names, prices and categories changed."""
    key, parts = F.col("p_partkey"), B.table(spark, sf_dir, "part")
    old = parts.where(key % 7 > 0).select(key, F.when(key % 9 == 0, F.concat("p_name", F.lit(" old"))).otherwise(F.col("p_name")).alias("name"), F.col("p_size").alias("price"), F.col("p_type").alias("category"))
    new = parts.where(key % 11 > 0).select(key, F.when(key % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), (F.col("p_size") + F.when(key % 4 == 0, 1).otherwise(0)).alias("price"), F.when(key % 6 == 0, " ").otherwise(F.col("p_type")).alias("category"))
    return R.changes(old, new, "p_partkey", ["price", "category"])


@query("SELECT l_orderkey AS draft, count(*) AS n_items FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def counts_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = B.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("draft"))
    return _lines(spark, sf_dir).join(listed, "draft", "left_semi").groupBy("draft").agg(F.count("*").alias("n_items"))


@query("SELECT DISTINCT l_orderkey AS draft FROM lineitem WHERE l_returnflag = 'R'")
def reviewed_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("draft")).distinct()


@query("SELECT c_custkey AS owner, coalesce(max(CAST(o_orderkey AS BIGINT)), 0) + 1 AS next FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def next_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").cast("bigint").alias("number"))
    return R.next_numbers(B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner")), children, "owner", "number")


_VERSIONS = """versions AS (SELECT o_custkey AS menu, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_items, o_orderstatus = 'F' AS pinned,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey % 5) || ' items added, ' || (o_orderkey % 7) || ' price increases' || CASE WHEN o_orderkey % 3 = 0 THEN ', ' || (o_orderkey % 11) || ' price decreases' ELSE '' END END AS summary FROM orders)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id")
    counts = _lines(spark, sf_dir).groupBy(F.col("draft").alias("id")).agg(F.count("*").alias("n_items"))
    orders = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("menu"), F.col("o_orderkey").alias("id"), "o_orderdate", (F.col("o_orderstatus") == "F").alias("pinned"))
    falls = F.when(key % 3 == 0, F.concat(F.lit(", "), (key % 11).cast("string"), F.lit(" price decreases"))).otherwise("")
    told = F.when(key % 4 != 0, F.concat((key % 5).cast("string"), F.lit(" items added, "), (key % 7).cast("string"), F.lit(" price increases"), falls))
    rows = R.versioned(orders, "menu", ["o_orderdate", "id"]).join(counts, "id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    return rows.withColumn("summary", told)


@query(f"WITH {_VERSIONS} SELECT menu, id, version, CASE WHEN version > 1 THEN version - 1 END AS previous, n_items FROM versions")
def create_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("menu", "id", F.col("version").cast("bigint").alias("version"), F.col("previous").cast("bigint").alias("previous"), "n_items")


@query(f"""WITH {_VERSIONS} SELECT menu, count(*) AS n_versions, count(*) FILTER (WHERE pinned) AS n_pinned, max(version) AS latest, CAST(sum(coalesce(TRY_CAST(regexp_extract(summary, '(\\d+) price increase', 1) AS BIGINT), 0)) AS BIGINT) AS n_up,
CAST(sum(coalesce(TRY_CAST(regexp_extract(summary, '(\\d+) price decrease', 1) AS BIGINT), 0)) AS BIGINT) AS n_down, string_agg(CAST(n_items AS VARCHAR), ',' ORDER BY version) AS trend FROM versions GROUP BY 1""")
def version_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.version_stats(_versions(spark, sf_dir), "menu")
    return out.withColumn("trend", F.array_join(F.col("trend").cast("array<string>"), ",")).withColumn("latest", F.col("latest").cast("bigint"))


@query(f"WITH {_VERSIONS} SELECT menu, id, version, row_number() OVER (PARTITION BY menu ORDER BY version DESC) AS rank, n_items - lag(n_items) OVER (PARTITION BY menu ORDER BY version) AS step FROM versions QUALIFY rank <= 2")
def newest_two_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two newest versions of each menu, with the change of items from the one before."""
    from pyspark.sql import Window as W

    rows = _versions(spark, sf_dir).withColumn("step", F.col("n_items") - F.lag("n_items").over(W.partitionBy("menu").orderBy("version")))
    return R.newest(rows, "menu", [F.desc("version")], 2).select("menu", "id", F.col("version").cast("bigint").alias("version"), F.col("rank").cast("bigint").alias("rank"), "step")


@query(f"""WITH {_VERSIONS}, m AS (SELECT menu, count(*) AS n_versions, arg_max(n_items, version) AS n_items, arg_max(pinned, version) AS pinned, menu % 101 AS health FROM versions GROUP BY 1), o AS (SELECT c_nationkey AS owner, m.* FROM m JOIN customer ON c_custkey = menu),
g AS (SELECT owner, count(*) AS n_menus, CAST(sum(n_versions) AS BIGINT) AS n_versions, CAST(sum(n_items) AS BIGINT) AS n_items, count(*) FILTER (WHERE pinned) AS n_pinned, CAST(round_even(avg(health), 0) AS INTEGER) AS health FROM o GROUP BY 1)
SELECT *, CASE WHEN health >= 80 THEN 'A' WHEN health >= 60 THEN 'B' WHEN health >= 40 THEN 'C' ELSE 'D' END AS grade FROM g""")
def owner_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    menus = _versions(spark, sf_dir).groupBy("menu").agg(F.count("*").alias("n_versions"), F.max_by("n_items", "version").alias("n_items"), F.max_by("pinned", "version").alias("pinned"))
    owners = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("menu"), F.col("c_nationkey").alias("owner"))
    return R.graded(menus.withColumn("health", F.col("menu") % 101).join(owners, "menu"), "owner")


@query(f"""WITH {B.ITEMS}, {B.VARIANTS}, v AS (SELECT item, min(price_cents) AS least FROM variants GROUP BY 1)
SELECT pos AS item, coalesce(least, price_cents) AS price_cents, least IS NOT NULL AND least <> price_cents AS changed FROM items LEFT JOIN v ON item = pos""")
def parent_base_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = B.items(spark, sf_dir).select(F.col("pos").alias("item"), "price_cents")
    return R.base_prices(items, B.variants(spark, sf_dir))


@query(f"""WITH {B.ITEMS}, x AS (SELECT menu_id, pos, CASE WHEN pos % 13 = 0 THEN ' ' WHEN pos % 17 = 0 THEN NULL ELSE category END AS category FROM items), n AS (SELECT *, CASE WHEN trim(coalesce(category, '')) = '' THEN 'Uncategorized' ELSE category END AS name, count(*) OVER (PARTITION BY menu_id) AS total FROM x)
SELECT menu_id, pos, CASE WHEN total <= 5 THEN 0 ELSE (row_number() OVER (PARTITION BY menu_id, name ORDER BY pos) - 1) // 5 END AS batch, CASE WHEN total > 5 THEN name END AS batch_of FROM n""")
def item_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.items(spark, sf_dir).withColumn("category", F.when(F.col("pos") % 13 == 0, " ").when(F.col("pos") % 17 != 0, F.col("category")))
    return R.batches(rows, "menu_id", "category", "pos", 5).select("menu_id", "pos", F.col("batch").cast("bigint").alias("batch"), "batch_of")


@query("""WITH r AS (SELECT l_orderkey AS run, l_linenumber AS place, [l_partkey, l_suppkey] AS a, CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE 'c' || l_linenumber END AS context, l_quantity AS seconds FROM lineitem)
SELECT run, array_to_string(flatten(list(a ORDER BY place, a)), ',') AS assessments, arg_max(context, place) FILTER (WHERE trim(context) <> '') AS context, sum(seconds) AS seconds FROM r GROUP BY 1""")
def merged_batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("place"), F.array("l_partkey", "l_suppkey").alias("assessments"), F.when(F.col("l_linenumber") % 3 == 0, " ").otherwise(F.concat(F.lit("c"), F.col("l_linenumber").cast("string"))).alias("context"), F.col("l_quantity").alias("seconds"))
    return R.merged_batches(rows, "run", "place").withColumn("assessments", F.array_join(F.col("assessments").cast("array<string>"), ","))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        one = B.table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH l AS (SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'O')
SELECT o_custkey AS owner, o_orderkey AS id, coalesce(place, 100 + o_orderkey) AS position FROM orders LEFT JOIN l ON l.id = o_orderkey""")
def reordered_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children take their place in a list of some of their parent's."""
    orders = B.table(spark, sf_dir, "orders")
    ids = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("minus"), "o_orderkey"))), lambda x: x["o_orderkey"])
    lists = orders.where("o_orderstatus != 'O'").groupBy(F.col("o_custkey").alias("owner")).agg(ids.alias("ids"))
    children = orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), (100 + F.col("o_orderkey")).cast("bigint").alias("position"))
    return R.reordered(children, lists, "owner", "id")


@query("""SELECT o_custkey AS owner, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END DESC NULLS LAST, o_orderkey) AS by_rating, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END ASC NULLS FIRST, o_orderkey) AS by_start,
row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 100 END, 1000000000), o_orderkey) AS by_position FROM orders""")
def null_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by rating (none last), by start (none first) and by position (none last)."""
    from pyspark.sql import Window as W

    key, of = F.col("o_orderkey"), W.partitionBy("o_custkey")
    place = lambda *order: F.row_number().over(of.orderBy(*order, "o_orderkey")).cast("bigint")
    rating, start, position = F.when(key % 4 > 0, F.col("o_totalprice")), F.when(key % 3 > 0, F.col("o_orderdate")), F.when(key % 5 > 0, key % 100)
    return B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), key.alias("id"), place(rating.desc_nulls_last()).alias("by_rating"), place(start.asc_nulls_first()).alias("by_start"), place(F.coalesce(position, F.lit(1_000_000_000))).alias("by_position"))


_SCHEDULED = "s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'summer menu' WHEN o_orderkey % 5 = 0 THEN '' END AS season, CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS d1, CASE WHEN o_orderkey % 4 = 0 THEN '2030-01-01' END AS d2, CASE WHEN o_orderkey % 7 = 0 THEN 'mon,tue' END AS days, CASE WHEN o_orderkey % 6 = 0 THEN '11:00' END AS t1, CASE WHEN o_orderkey % 9 = 0 THEN '14:30' END AS t2 FROM orders)"


@query(f"""WITH {_SCHEDULED} SELECT id, CAST(coalesce(season, '') <> '' AS INTEGER) + CAST(d1 IS NOT NULL OR d2 IS NOT NULL AS INTEGER) + CAST(days IS NOT NULL AS INTEGER) + CAST(t1 IS NOT NULL OR t2 IS NOT NULL AS INTEGER) AS n_fields,
nullif(concat_ws(' | ', CASE WHEN season <> '' THEN 'Summer Menu' END, CASE WHEN d1 IS NOT NULL OR d2 IS NOT NULL THEN coalesce(d1, '...') || ' to ' || coalesce(d2, '...') END, upper(days), CASE WHEN t1 IS NOT NULL OR t2 IS NOT NULL THEN coalesce(t1, '...') || ' - ' || coalesce(t2, '...') END), '') AS told FROM s""")
def schedule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    fields = [F.when(key % 2 == 0, "summer menu").when(key % 5 == 0, ""), F.when(key % 3 == 0, F.to_date("o_orderdate").cast("string")), F.when(key % 4 == 0, "2030-01-01"), F.when(key % 7 == 0, "mon,tue"), F.when(key % 6 == 0, "11:00"), F.when(key % 9 == 0, "14:30")]
    return B.table(spark, sf_dir, "orders").select(key.alias("id"), R.constraints(*fields).alias("n_fields"), R.schedule_text(*fields).alias("told"))


@query("SELECT o_custkey AS owner, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders QUALIFY rank <= 3")
def newest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest rows of each owner: a list for people to look at."""
    rows = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), "o_orderdate")
    return R.newest(rows, "owner", [F.desc("o_orderdate"), F.desc("id")], 3).select("owner", "id", F.col("rank").cast("bigint").alias("rank"))


@query("""SELECT 'gone' AS part, l_orderkey AS draft, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 2
UNION ALL SELECT 'kept', CASE WHEN l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') THEN l_orderkey END, count(*) FROM lineitem GROUP BY 2""")
def cascades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of deleted drafts: gone with them, or kept without a draft."""
    lines = _lines(spark, sf_dir).select("draft", "line")
    deleted = B.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("draft"))
    count = lambda rows, name: rows.groupBy("draft").agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "draft", "n")
    return count(R.cascaded(lines, deleted, "draft"), "gone").unionByName(count(R.cascaded(lines, deleted, "draft", keep=True), "kept"))


@query("""SELECT l_orderkey AS draft, l_linenumber AS line, 'old' AS source FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT l_orderkey, l_linenumber, 'new' FROM lineitem n WHERE l_linenumber <= 3 AND NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_returnflag = 'N' AND o.l_orderkey = n.l_orderkey AND o.l_linenumber = n.l_linenumber)""")
def insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("draft"), F.col("l_linenumber").alias("line"), "l_returnflag")
    old, new = rows.where("l_returnflag = 'N'").select("draft", "line", F.lit("old").alias("source")), rows.where("line <= 3").select("draft", "line", F.lit("new").alias("source"))
    return R.inserted_missing(old, new, ["draft", "line"])


@query("""SELECT l_orderkey AS draft, l_linenumber AS line, 'old' AS source FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT l_orderkey, l_linenumber, 'new' FROM lineitem WHERE l_returnflag = 'R'""")
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("draft"), F.col("l_linenumber").alias("line"), "l_returnflag")
    return R.replaced_children(rows.select("draft", "line", F.lit("old").alias("source")), rows.where("l_returnflag = 'R'").select("draft", "line", F.lit("new").alias("source")), "draft")


@query("""WITH u AS (SELECT c_custkey AS account, CASE c_custkey % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'premium' WHEN 2 THEN 'gold' END AS tier, f AS feature FROM customer, (VALUES ('editor'), ('pos_export'), ('wizard'), ('ai_parse'), ('other')) t(f))
SELECT account, feature, coalesce(tier = 'free' AND feature IN ('editor', 'save_menus', 'csv_json_import', 'csv_json_export', 'pos_export') OR tier = 'premium' AND feature IN ('editor', 'save_menus', 'csv_json_import', 'csv_json_export', 'pos_export', 'ai_parse', 'ocr_upload', 'wizard'), false) AS allowed FROM u""")
def feature_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    feature = F.explode(F.array(*map(F.lit, ("editor", "pos_export", "wizard", "ai_parse", "other")))).alias("feature")
    rows = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account"), feature)
    tier = F.when(F.col("account") % 4 == 0, "free").when(F.col("account") % 4 == 1, "premium").when(F.col("account") % 4 == 2, "gold")
    return rows.withColumn("allowed", R.may_use(tier, F.col("feature")))


@query(f"""WITH {B.ITEMS}, x AS (SELECT menu_id, CASE WHEN pos % 8 = 0 THEN ' ' ELSE category END AS category, CASE WHEN pos % 6 = 0 THEN 0 ELSE price_cents END AS price, pos IN (SELECT l_partkey FROM lineitem WHERE l_suppkey % 4 = 1) AS g FROM items)
SELECT menu_id, count(*) AS n_items, count(DISTINCT nullif(trim(category), '')) AS n_categories, CAST(round_even(count(*) FILTER (WHERE g) * 100 / count(*), 0) AS INTEGER) AS group_percent, coalesce(min(price) FILTER (WHERE price > 0), 0) AS price_min, coalesce(max(price) FILTER (WHERE price > 0), 0) AS price_max FROM x GROUP BY 1""")
def editor_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _lines(spark, sf_dir).where("grp = 1").select(F.col("item").alias("pos"), F.lit(True).alias("has_groups")).distinct()
    items = B.items(spark, sf_dir).withColumn("category", F.when(F.col("pos") % 8 == 0, " ").otherwise(F.col("category"))).withColumn("price_cents", F.when(F.col("pos") % 6 == 0, 0).otherwise(F.col("price_cents")))
    return R.editor_stats(items.join(grouped, "pos", "left").withColumn("has_groups", F.coalesce("has_groups", F.lit(False))), "menu_id")


@query("""WITH r AS (SELECT l_partkey AS item, CASE l_linenumber % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'important' ELSE 'suggested' END AS priority, l_tax = 0 AS fixable FROM lineitem WHERE l_returnflag = 'R')
SELECT p_type AS category, count(DISTINCT p_partkey) AS n_items, count(DISTINCT item) AS n_items_with, count(item) AS n_recs, count(*) FILTER (WHERE priority = 'critical') AS critical, count(*) FILTER (WHERE priority = 'important') AS important, count(*) FILTER (WHERE priority = 'suggested') AS suggested, count(*) FILTER (WHERE fixable) AS n_fixable FROM part LEFT JOIN r ON item = p_partkey GROUP BY 1""")
def repair_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 3
    rec = F.struct(F.when(n == 0, "critical").when(n == 1, "important").otherwise("suggested").alias("priority"), (F.col("l_tax") == 0).alias("fixable"))
    recs = B.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_list(rec).alias("recs"))
    rows = B.table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("category")).join(recs, "p_partkey", "left")
    return R.repair_summary(rows.withColumn("recs", F.coalesce("recs", F.array().cast(recs.schema["recs"].dataType))))


_EXPORT = f"""{B.ITEMS}, i AS (SELECT pos AS item, name, CASE WHEN pos % 9 = 0 THEN NULL ELSE category END AS category, price_cents FROM items), g AS (SELECT p_partkey AS item, t.g AS grp, 'Set ' || t.g AS title, (p_partkey + t.g) % 2 = 0 AS required FROM part, (VALUES (1), (2), (3)) t(g)),
v AS (SELECT l_partkey AS item, CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey % 4 END AS grp, l_orderkey * 8 + l_linenumber AS ordinal, l_returnflag AS label, CASE l_linenumber % 4 WHEN 0 THEN 'size' WHEN 1 THEN 'combo' WHEN 2 THEN 'style' ELSE 'odd' END AS kind, CASE WHEN l_tax = 0 THEN 0 ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END AS price FROM lineitem)"""
_TEXT = lambda c: f"CASE WHEN coalesce({c}, 0) = 0 THEN '' ELSE ({c} // 100) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0') END"


def _export(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = B.items(spark, sf_dir).select(F.col("pos").alias("item"), "name", F.when(F.col("pos") % 9 != 0, F.col("category")).alias("category"), "price_cents")
    groups = items.select("item", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("grp")).select("item", "grp", F.concat(F.lit("Set "), F.col("grp").cast("string")).alias("title"), ((F.col("item") + F.col("grp")) % 2 == 0).alias("required"))
    n = F.col("l_linenumber") % 4
    variants = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("item"), F.when(F.col("l_suppkey") % 4 > 0, F.col("l_suppkey") % 4).alias("grp"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"), F.col("l_returnflag").alias("label"),
        F.when(n == 0, "size").when(n == 1, "combo").when(n == 2, "style").otherwise("odd").alias("kind"), F.when(F.col("l_tax") == 0, 0).otherwise(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("price_cents"),
    )
    return items, groups, variants


@query(f"""WITH {_EXPORT} SELECT item, 0 AS place, 0 AS line, 'item' AS type, name, price_cents, coalesce(category, '') AS category, '' AS kind, '' AS label, '' AS group_name, '' AS required FROM i
UNION ALL SELECT item, grp, 0, 'modifier_group', '', NULL, '', '', '', title, CASE WHEN required THEN 'Y' ELSE 'N' END FROM g UNION ALL SELECT v.item, v.grp, ordinal, 'modifier', '', price, '', kind, label, title, '' FROM v JOIN g ON g.item = v.item AND g.grp = v.grp UNION ALL SELECT item, 1099511627776, ordinal, 'variant', '', price, '', kind, label, '', '' FROM v WHERE grp IS NULL""")
def typed_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.typed_rows(*_export(spark, sf_dir))


@query(f"""WITH {_EXPORT} SELECT item, 0 AS place, 0 AS line, coalesce(nullif(category, ''), 'Uncategorized') AS menu_group, name AS menu_item, {_TEXT('price_cents')} AS base_price, '' AS option_group, '' AS option, '' AS option_price, '' AS required FROM i
UNION ALL SELECT v.item, v.grp, ordinal, '', '', '', title, label, {_TEXT('price')}, CASE WHEN required THEN 'Y' ELSE 'N' END FROM v JOIN g ON g.item = v.item AND g.grp = v.grp
UNION ALL SELECT item, 1099511627776, ordinal, '', '', '', CASE kind WHEN 'size' THEN 'Size' WHEN 'combo' THEN 'Combo Add-on' WHEN 'flavor' THEN 'Flavor' WHEN 'style' THEN 'Style' ELSE 'Option' END, label, {_TEXT('price')}, '' FROM v WHERE grp IS NULL""")
def option_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.option_rows(*_export(spark, sf_dir))
