"""Boundary cases with results worked out by hand."""

import collections
import difflib
import itertools
import json
import math
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from carteframe.functions import cleanup, geometry, names, price_texts, prices, sizes, stats
from carteframe.operators import catalog, drafts, exports, market, menus, quality, rates, text, variants, writes
from carteframe.operators import prices as P
from carteframe.sources import readers


def items(spark, values, category="Pizza"):
    return spark.createDataFrame([("m", i, f"item {i}", category, v) for i, v in enumerate(values)], "menu_id string, pos int, name string, category string, price_cents bigint")


@pytest.mark.parametrize(("values", "flagged"), [([1000, 1100, 1200, 5000], [5000]), ([1000, 9000], []), ([1000] * 4, []), ([None, 1000, 1000, 1000, 2000], [2000])])
def test_category_outliers(spark, values, flagged):
    assert [r.price_cents for r in P.category_outliers(items(spark, values), ["category"]).collect()] == flagged


def test_half_split_band(spark):
    r = P.bands(items(spark, [1600, 1700, 1800, 16000]), ["category"]).first()
    assert (r.n, r.median, r.q1, r.q3, r.iqr) == (4, 1750, 1650, 8900, 7250)
    assert P.decimal_shifts(items(spark, [1600, 1700, 1800, 16000]), ["category"]).count() == 0


def test_decimal_shift(spark):
    r = P.decimal_shifts(items(spark, [1500, 1600, 1600, 1700, 1700, 1800, 1800, 16000]), ["category"]).collect()
    assert [(x.price_cents, x.corrected_cents, x.divisor, x.severity) for x in r] == [(16000, 1600, 10, "auto_fix")]


def test_order_statistics_with_ties_and_partitions(spark):
    df = spark.createDataFrame([("a", v) for v in [5, 1, 1, 3, 9, 9, 9]] + [("b", None)], "g string, v int").repartition(5)
    assert [(r.g, r.n, r.median) for r in stats.medians(df, ["g"], "v").collect()] == [("a", 7, 5)]


def test_first_seen_mode(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, "x")], "p int, v string")
    r = stats.first_seen_mode(df.withColumn("g", F.lit(1)), ["g"], "v", "p").first()
    assert (r["mode"], r.mode_count, r.n) == ("x", 2, 4)


def test_names(spark):
    df = spark.createDataFrame([("Our Classic  Cheese Pizza.",), ("cheese pizza",), ("  ",), (None,)], "n string")
    assert [r[0] for r in df.select(names.normalized(F.col("n"))).collect()] == ["cheese pizza", "cheese pizza", "", None]


def test_duplicates(spark):
    df = spark.createDataFrame([("m", 0, "Our Classic  Cheese Pizza.", 1000), ("m", 1, "cheese pizza", 1200), ("m", 2, "x", 1)], "menu_id string, pos int, name string, price_cents int")
    assert {(r.pos, r.severity) for r in catalog.duplicate_names(df, ["menu_id"]).collect()} == {(0, "warn"), (1, "warn")}


def test_fuzzy_names_equal_brute_force(spark):
    texts = ["margherita pizza", "margarita pizza", "pepperoni pizza", "pepperoni piza", "garlic bread", "garlic breads", "tide", "diet", "caesar salad", "a very long name of a dish indeed"]
    df = spark.createDataFrame([("m", i, t) for i, t in enumerate(texts)], "menu_id string, pos int, name string").repartition(3)
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and len(a) >= 4 and len(b) >= 4 and difflib.SequenceMatcher(None, a, b).ratio() >= catalog.FUZZY}
    assert {(r.a_pos, r.b_pos) for r in catalog.fuzzy_names(df, ["menu_id"]).collect()} == want


@pytest.mark.parametrize(("order", "flagged"), [("AABAA", [2]), ("BA", []), ("ABAB", [])])
def test_isolation(spark, order, flagged):
    df = spark.createDataFrame([("m", i, c) for i, c in enumerate(order)], "menu_id string, pos int, category string").repartition(3)
    assert [r.pos for r in catalog.isolated(df, ["menu_id"]).collect()] == flagged


def variant_rows(spark, sets):
    return spark.createDataFrame([("c", i, lab) for i, labs in enumerate(sets) for lab in labs], "category string, item int, label string")


def test_label_sets(spark):
    few = [["S", "M", "L"]] * 3 + [["M", "L"], ["S", "M", "L", "XL"], ["Mini", "Party"]]
    most = [["S", "M", "L"]] * 4 + [["M", "L"], ["Mini", "Party"]]
    assert variants.label_sets(variant_rows(spark, few), ["item"], ["category"], "label", "item").count() == 0
    assert [r.item for r in variants.label_sets(variant_rows(spark, most), ["item"], ["category"], "label", "item").collect()] == [5]


def test_inversions_and_gaps(spark):
    df = spark.createDataFrame([(1, 0, 1000), (1, 1, 900), (1, 3, 900)], "item int, ordinal int, price_cents int")
    assert [(r.ordinal, r.before) for r in variants.inversions(df, ["item"], "ordinal").collect()] == [(1, 1000)]
    assert [r.missing for r in variants.gaps(df, ["item"], "ordinal").collect()] == [[2]]


def test_sizes(spark):
    df = spark.createDataFrame([('12"',), ("10 pcs",), ("Lg",), ("14",), ("99",), (None,)], "s string")
    size = sizes.normalized(F.col("s"))
    assert [tuple(r) for r in df.select(size, sizes.ordinal(size), sizes.track(size)).collect()] == [("12in", 12, "inch"), ("10pc", 310, "piece"), ("L", 40, "word"), ("14in", 14, "inch"), (None, None, None), (None, None, None)]
    tiers = spark.createDataFrame([('12" Sml',), ('16" Hawaiian',), ("Extra-Large",), ("Soup",), (None,)], "s string")
    assert [r[0] for r in tiers.select(sizes.tier(F.col("s"))).collect()] == ["small", "large", "party", "unknown", "unknown"]
    pieces = spark.createDataFrame([("20 Pcs Wings",), ("10 spicy hot Wings",), ("Wings",)], "s string")
    assert [r[0] for r in pieces.select(sizes.piece_count(F.col("s"))).collect()] == [20, 10, None]


@pytest.mark.parametrize(("a", "b", "score"), [("Combination", "COMBO PIZZA", 100), ("Steak & Cheese Melt", "STEAK & CHEESE SANDWICH", 67), ("Cheeseburger Melt", "Cheeseburger", 50), ("Cheese Pizza", "TRADITIONAL CHEESE PIZZA", 100), ("Pizza", "Pizza", 0)])
def test_token_similarity(spark, a, b, score):
    assert spark.range(1).select(catalog.token_similarity(F.lit(a), F.lit(b)).alias("s")).first().s == score


def test_garbled_names(spark):
    df = spark.createDataFrame([("eeesssnnn",), ("Cheese Pizza",), ("eee",)], "n string")
    assert [r[0] for r in df.select(quality.is_garbled(F.col("n"))).collect()] == [True, False, False]


def test_geometry(spark):
    a, b, c = (geometry.box(*map(F.lit, v)) for v in ((0, 0, 10, 10), (15, 5, 5, 15), (30, 0, 40, 10)))
    r = spark.range(1).select(F.round(geometry.iou(a, b), 4), geometry.iou(a, c), geometry.gap(a, c, "x"), geometry.overlap(a, b, "y")).first()
    assert tuple(r) == (0.1429, 0.0, 20, 5)


@pytest.mark.parametrize(
    ("f", "raw", "clean"),
    [(cleanup.runs, "Soooo good", "Soo good"), (cleanup.punctuation, "Garlic Knots .... 5.99 || x", "Garlic Knots 5.99 x"), (cleanup.smart_title, "BBQ chicken NY style", "BBQ Chicken NY Style"), (cleanup.token_soup, "&, A, Eb, cheese 12 BBQ oz", "&, cheese 12 BBQ oz"), (cleanup.token_soup, "Jr w/ md, lb pc of ny NYC in on", "Jr w/ md, ny NYC"), (cleanup.with_slash, "ham w/ cheese", "ham with cheese"), (cleanup.tier_url, " HTTP://A.com/x/?q=1#f", "http://a.com/x")],
)
def test_cleanup(spark, f, raw, clean):
    assert spark.createDataFrame([(raw,)], "t string").select(f(F.col("t")).alias("t")).first().t == clean


def test_descriptions(spark):
    df = spark.createDataFrame([("Pie", "Pie - with apples , warm"), ("Tea", ""), ("Soup - hot and red", None)], "n string, d string")
    got = df.select(cleanup.description(F.col("n"), F.col("d")).alias("d"), cleanup.split_name(F.col("n"), F.col("d")).alias("s")).collect()
    assert [r.d for r in got] == ["with apples, warm", None, None]
    assert tuple(got[2].s) == ("Soup", "hot and red") and got[0].s.name == "Pie"


def test_semantic_score_without_signals(spark):
    none = F.lit(None).cast("double")
    df = spark.range(1).select(quality.semantic(none, F.lit(None).cast("string"), none, none, quality.flag_penalty(F.lit(0), F.lit(0), F.lit(0))).alias("s"))
    assert df.first().s == 0.455


def test_tiers(spark):
    df = spark.createDataFrame([(s,) for s in (0.80, 0.7999, 0.60, 0.40, 0.3999)], "s double")
    assert [r[0] for r in df.select(quality.tier(F.col("s"))).collect()] == ["high", "medium", "medium", "low", "reject"]


@pytest.mark.parametrize(("row", "score", "passed"), [((0.95, 12, None, None), 0.955, True), ((0.95, 12, 0.8, None), 0.9175, True), ((None, 0, None, None), 0.0, False)])
def test_gate(spark, row, score, passed):
    r = quality.gate(spark.createDataFrame([row], "mean double, n long, call2 double, call3 double")).first()
    assert (r.score, r.passed) == (score, passed)


def snapshot(spark, rows):
    return spark.createDataFrame([("m", p, n, c, v) for p, n, c, v in rows], "menu_id string, pos int, name string, category string, price_cents int")


def test_diff(spark):
    a = snapshot(spark, [(1, "soup", "Hot", 5), (2, "soup", "Cold", 6), (3, "Pie", "Hot", 7), (4, "tea", "Hot", 1)])
    b = snapshot(spark, [(2, "soup", "Cold", 6), (3, "pie", "Hot", 7), (4, "tea", "Drinks", 1), (5, "new", "Hot", 1)])
    got = {(r.key, r.pos_a, r.pos_b, r.status, r.fields) for r in menus.diff(a, b, ["menu_id"]).collect()}
    assert got == {("soup", 1, None, "removed", ""), ("soup", 2, 2, "unchanged", ""), ("pie", 3, 3, "modified", "name"), ("tea", 4, 4, "modified", "category"), ("new", None, 5, "added", "")}
    assert menus.diff(a, a, ["menu_id"]).where("status != 'unchanged'").count() == 0


def test_diff_mirrors(spark):
    a = snapshot(spark, [(1, "x", "H", 5), (2, "y", "H", 6)])
    b = snapshot(spark, [(2, "y", "H", 7), (3, "z", "H", 6)])
    swap = {"added": "removed", "removed": "added"}
    there = {(r.key, swap.get(r.status, r.status)) for r in menus.diff(a, b, ["menu_id"]).collect()}
    assert there == {(r.key, r.status) for r in menus.diff(b, a, ["menu_id"]).collect()}


def test_schedule_overlap_is_closed_in_days_and_open_in_hours(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 1, date'2026-01-01', date'2026-03-31', 11, 14), (1, 2, date'2026-03-31', NULL, 14, 17), (1, 3, date'2026-03-31', date'2026-04-01', 13, 15),
      (2, 4, date'2026-01-01', NULL, NULL, NULL), (2, 5, date'2027-01-01', date'2027-02-01', 5, 6) AS t(owner, id, date_from, date_to, hour_from, hour_to)""")
    assert {(r.id_a, r.id_b, r.overlap_type) for r in menus.overlap_conflicts(df).collect()} == {(1, 3, "time"), (2, 3, "time"), (4, 5, "full")}


@pytest.mark.parametrize(("price", "kind"), [(999, "below_market"), (1000, "lower_range"), (1350, "fair"), (1500, "fair"), (1650, "fair"), (1651, "higher_range"), (2001, "above_market")])
def test_assessment(spark, price, kind):
    df = spark.range(1).select(market.assessment(F.lit(price), F.lit(1000), F.lit(2000), F.lit(1500)).alias("a"))
    assert df.first().a == kind


def test_market_ranges_take_the_upper_median(spark):
    own = spark.createDataFrame([("c", 1300)], "category string, price_cents bigint")
    anchors = spark.createDataFrame([("c", v) for v in (1000, 1200, 1400, 1600, 99999)], "category string, price_cents bigint")
    r = market.ranges(own, anchors).first()
    assert (r.band, r.n, r.low, r.high, r["median"]) == (0, 4, 1000, 1600, 1400)


@pytest.mark.parametrize(("raw", "cents"), [("1599", 1599), ("15", 1500), ("999", 99900), ("$15.99", 1599), ("", None), ("abc", None)])
def test_lenient_price(spark, raw, cents):
    assert spark.createDataFrame([(raw,)], "p string").select(prices.lenient_cents(F.col("p")).alias("c")).first().c == cents


@pytest.mark.parametrize(("raw", "cents"), [("MP", None), ("15.999", 1600), ("$5", 500)])
def test_strict_price(spark, raw, cents):
    assert spark.createDataFrame([(raw,)], "p string").select(prices.strict_cents(F.col("p")).alias("c")).first().c == cents


def test_backfill(spark):
    df = spark.createDataFrame([("m", 0, "Fries (L)", "Sides", 500), ("m", 1, "fries (S)", "Sides", 300), ("m", 2, "Pie", "Sides", 1)], "menu_id string, pos int, name string, category string, price_cents int")
    r = writes.backfill_variants(df, ["menu_id"]).first()
    assert (r.n, [(v.label, v.price_cents) for v in r.variants]) == (2, [("S", 300), ("L", 500)])


def test_publish_rows_and_wide(spark):
    its = spark.createDataFrame([(1, "a", "c", 5), (2, "b", "c", 6)], "item int, name string, category string, price_cents int")
    vs = spark.createDataFrame([(1, 1, "L", 7), (1, 2, "S", 8)], "item int, ordinal int, label string, price_cents int")
    assert {(r.name, r.price_cents) for r in exports.publish_rows(its, vs).collect()} == {("a (L)", 7), ("a (S)", 8), ("b", 6)}
    assert exports.labels_in_order(vs) == ["L", "S"]
    assert exports.wide(its, vs, ["L", "S"]).columns[-2:] == ["price_L", "price_S"]
    nested = exports.nest(its, vs, "item", ["ordinal", "label"], ["ordinal"], "v").orderBy("item").collect()
    assert [len(r.v) for r in nested] == [2, 0]
    assert json.loads(exports.nested_json(its, vs).first().document)[0]["variants"][1]["label"] == "S"


def test_group_lacking(spark):
    rows = [("E", 1, "Size"), ("E", 2, "Size"), ("E", 2, "Size"), ("E", 3, "Toppings"), ("E", 4, " "), ("S", 5, "Temp"), ("S", 6, "Size"), (" ", 7, "Size"), (None, 8, "Size"), *(("T", k, "All") for k in (9, 10, 11))]
    got = exports.group_lacking(spark.createDataFrame(rows, "category string, item int, grp string"), "category", "item", "grp").collect()
    assert sorted(map(tuple, got)) == [("E", "Size", 4, 2, 3), ("E", "Size", 4, 2, 4)]


def test_group_inconsistency_all_reads_every_customer(spark, small):
    from carteframe.plans import registry

    rows = registry.QUERIES["group_inconsistency"](spark, small).collect()
    orders = spark.read.parquet(f"{small}/orders.parquet").select("o_custkey").distinct()
    per = {r.c_nationkey: r["count"] for r in spark.read.parquet(f"{small}/customer.parquet").join(orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").count().collect()}
    assert rows and all(r.n_items == per[r.category] for r in rows)


def test_draft_warnings(spark):
    its = spark.createDataFrame([(1, "a", "c", 0), (2, " ", None, 0), (3, "b", "c", 5)], "item int, name string, category string, price_cents int")
    vs = [(1, 1, 1, "Small", "size", 9), (1, 1, 2, "LARGE", "size", 7), (1, None, 3, "large ", "addon", 8), (1, None, 4, " ", "addon", 0), (3, 2, 1, "small", "size", 5), (3, 2, 2, "medium", "size", 5), (3, 2, 3, "odd", "size", 1)]
    gs = [(1, 1, True, 3, 2), (1, 2, True, 0, 0), (1, 3, False, None, 4), (3, 2, True, 1, 4)]
    got = exports.draft_warnings(its, spark.createDataFrame(vs, "item int, grp int, ordinal int, label string, kind string, price_cents int"), spark.createDataFrame(gs, "item int, grp int, required boolean, min_select int, max_select int"))
    assert {tuple(r) for r in got.collect()} == {
        (2, "missing_name", 1), (2, "missing_category", 1), (2, "missing_price", 1), (1, "variant_missing_price", 1), (1, "variant_missing_label", 1), (1, "duplicate_variant_label", 1), (1, "price_inversion", 1),
        (1, "modifier_group_empty", 2), (1, "required_group_empty", 1), (1, "group_min_exceeds_max", 1), (3, "group_max_exceeds_count", 1),
    }


def test_whole_exports_keep_every_variant(spark, small):
    from carteframe.plans import registry

    n = spark.read.parquet(f"{small}/lineitem.parquet").select("l_partkey", "l_linenumber").distinct().count()
    assert registry.QUERIES["export_metrics"](spark, small).agg(F.sum("n_variants")).first()[0] == n
    assert registry.QUERIES["pos_rows"](spark, small).where("line > 0").count() == n


def test_call_success_ratio_all_counts_every_event(spark, small):
    from carteframe.plans import registry

    assert registry.QUERIES["call_success_ratio"](spark, small).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{small}/events.parquet").count()


def test_category_classifier_predicts_every_document_as_plain_bayes_does(spark, small):
    from carteframe.plans import registry

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    split = {r.doc_id: [w for w in re.split("[^a-z]+", (r.text or "").lower()) if len(w) > 1] for r in rows}
    every = sorted({w for ws in split.values() for w in ws})
    size = text.Classifier.BUCKETS
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(size)).alias("b")).collect()}
    counts, n_docs = collections.defaultdict(collections.Counter), collections.Counter()
    for r in rows:
        if r.doc_id % 3 != 1 and r.lang is not None:
            counts[r.lang].update(bucket[w] for w in split[r.doc_id])
            n_docs[r.lang] += 1
    total = {k: sum(counts[k].values()) + size for k in n_docs}

    def scores(words):
        return {k: math.log(n_docs[k] / sum(n_docs.values())) + sum(math.log((counts[k][bucket[w]] + 1) / total[k]) for w in words) for k in sorted(n_docs)}

    got = registry.QUERIES["category_classifier"](spark, small).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == set(split)
    for r in got:
        own = scores(split[r.doc_id])
        assert own[r.predicted] >= max(own.values()) - 1e-6 and r.held_out == (r.doc_id % 3 == 1 or r.lang is None)


def test_merge_corrections(spark):
    its = spark.createDataFrame([(1, "A", 98, 5), (2, "b", 50, 5), (3, "c", 50, 5)], "pos int, name string, confidence int, price_cents int")
    fixes = spark.createDataFrame([("a", "confirmed", None, 1), ("B", "corrected", 9, 1), ("c", "not_found", 7, 1)], "name string, status string, new_price int, order int")
    assert [(r.confidence, r.price_cents) for r in writes.merge_corrections(its, fixes).orderBy("pos").collect()] == [(100, 5), (92, 9), (50, 5)]


def test_rate_limit(spark):
    df = spark.sql("SELECT 1 AS k, id, timestamp_seconds(t) AS ts FROM VALUES (1, 0), (2, 10), (3, 20), (4, 61) AS t(id, t)")
    assert [r.admitted for r in rates.admitted(df, "k", "ts", "id", 2).orderBy("id").collect()] == [True, True, False, True]


def test_line_types(spark):
    cases = {"PIZZA": "heading", "$12.99": "price_only", "Small Medium Large": "size_header", "Cheese Pizza 12.99": "menu_item", "": "empty", "tomato, basil, cheese": "description_only", "Add bacon for more": "info_line"}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert [r[0] for r in df.select(text.line_type(F.col("l"))).collect()] == list(cases.values())


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Name,Price,Color\nPie,5,red\nTea,,\n", encoding="utf-8")
    rows = readers.csv_items(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.name, r.price, r.meta) for r in rows] == [("Pie", "5", {"Color": "red"}), ("Tea", None, {})]
    (tmp_path / "b.json").write_text(json.dumps({"items": [{"name": "Pie", "price": "5"}]}))
    (tmp_path / "c.json").write_text(json.dumps([{"name": "Tea"}]))
    assert {r.name for r in readers.json_items(spark, str(tmp_path / "*.json")).collect()} == {"Pie", "Tea"}
    ld = {"@graph": [{"hasMenu": {"hasMenuSection": [{"name": "S", "hasMenuItem": [{"name": "Pie", "offers": {"price": "5.999"}}, {"name": "Free", "offers": {"price": "0"}}]}]}}]}
    pages = spark.createDataFrame([(1, f'<script type="application/ld+json">{json.dumps(ld)}</script>')], "id int, html string")
    assert [(r.section, r.name, r.price_cents) for r in readers.jsonld_items(pages, "id", "html").collect()] == [("S", "Pie", 599)]
    table = spark.createDataFrame([(1, "Hot | Soup | $4.50\nnothing\n")], "id int, t string")
    assert [(r.category, r.name, r.price_cents) for r in readers.pipe_table(table, "id", "t").collect()] == [("Hot", "Soup", 450)]


def test_flattened(spark):
    tree = spark.sql("SELECT 1 AS id, array(named_struct('name', 'C', 'items', array(named_struct('name', 'Pie', 'price_cents', 5, 'sizes', array(named_struct('name', 'S', 'price_cents', 3))), named_struct('name', 'Tea', 'price_cents', 1, 'sizes', array())))) AS cats")
    assert [(r.name, r.price_cents) for r in readers.flattened(tree, "id", "cats").orderBy("item_pos").collect()] == [("Pie (S)", 3), ("Tea", 1)]


def test_workbook(spark, tmp_path):
    path = tmp_path / "a.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="x"><si><t>Name</t></si><si><t>Pie</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="x"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2"/></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>5</v></c></row></sheetData></worksheet>')
    spark.dataSource.register(readers.WorkbookSource)
    got = spark.read.format("workbook").load(str(path)).collect()
    assert [(r.row, r.cells) for r in got] == [(1, ["Name"]), (3, ["Pie", None, "5"])]


def test_empty_tables(spark):
    none = items(spark, [1]).where("false")
    assert P.category_outliers(none, ["category"]).count() == 0
    assert P.decimal_shifts(none, ["category"]).count() == 0
    assert catalog.duplicate_names(none, ["menu_id"]).count() == 0
    assert menus.diff(none, none, ["menu_id"]).count() == 0
    assert market.ranges(none, none).count() == 0


def test_price_tokens(spark):
    cases = {"$12.99": [1299], "12,50 or 599": [1250, 599], "9 99": [999], "$7": [700], "soup": [], "0.50": []}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(prices.candidates(F.col("t"))).collect()] == list(cases.values())


def test_drafts(spark):
    versions = spark.createDataFrame([("m", 1, False), ("m", 2, True), ("n", 1, False)], "menu string, version int, pinned boolean")
    assert [(r.menu, r.version) for r in drafts.deletable(versions, "menu").collect()] == [("m", 1)]
    events = spark.createDataFrame([(1, "view", 7), (2, "view", 8), (3, "click", 7)], "event_id int, event_type string, owner int")
    subs = spark.createDataFrame([("a", 7, "view, click"), ("b", None, "View")], "subscriber string, owner int, events string")
    assert {(r.event_id, r.subscriber) for r in drafts.fan_out(events, subs, "owner").collect()} == {(1, "a"), (3, "a"), (1, "b"), (2, "b")}
    template = spark.createDataFrame([(1, ["x", "y"]), (2, [])], "id int, entries array<string>")
    assert [(r.id, r.position, r.entry) for r in drafts.template_rows(template, "entries").collect()] == [(1, 1, "x"), (1, 2, "y")]


@pytest.mark.parametrize(("ms", "told"), [(1250, "1.2s"), (1350, "1.4s"), (1450, "1.4s"), (59960, "60.0s"), (61250, "1m 1.2s"), (125.75 * 1000, "2m 5.8s"), (999.7, "1000ms"), (2.5, "2ms"), (None, None)])
def test_durations_round_the_exact_value(spark, ms, told):
    assert spark.createDataFrame([(ms and float(ms),)], "ms double").select(price_texts.duration(F.col("ms")).alias("t")).first().t == told


def test_one_place_is_that_of_printf(spark):
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 9.95, 12.45, -0.25, -0.35, 59.95, 1e13 + 0.25, *(k / 20 for k in range(400)), *(k / 100 for k in range(1000))]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", price_texts.one_place(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [f"{r.v:.1f}" for r in got]


def test_market_ranges_match_all_pairs(spark):
    """Against every pair, prices over several stretches, bands that end below 0, NULL and prices not over 0 on both sides."""
    left, right = [*range(-5, 3000, 97), *range(3000, 60_000, 1009), None], [*range(0, 2000, 131), *range(4000, 80_000, 977), 4096, 4096, 8192, None]
    own = spark.createDataFrame([(k, v) for k in ("a", "b", None) for v in left], "category string, price_cents bigint")
    anchors = spark.createDataFrame([(k, v) for k, most in (("a", 10**9), ("b", 900), (None, 10**9)) for v in right if v is None or v < most], "category string, price_cents bigint")
    expected = set()
    for k, most in (("a", 10**9), ("b", 900)):
        for p in (p for p in left if p and p > 0):
            near = [sorted(v for v in right if v and 0 < v < most and abs(v - p) <= max(math.floor(p * share), cents)) for share, cents in market.BANDS]
            band = 0 if len(near[0]) >= 3 else 1 if len(near[1]) >= 3 else 2
            if len(found := near[band]) >= 2:
                expected.add((k, p, band, len(found), found[0], found[-1], found[len(found) // 2]))
    got = market.ranges(own, anchors).select("category", "price_cents", "band", "n", "low", "high", "median").collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


@pytest.mark.parametrize("most", [0, market.SENT])
def test_rows_get_their_range_by_either_path(spark, most):
    """Against every pair: two keys, NULL and prices not over 0 on both sides, prices that repeat, keys without anchors."""
    pairs = [("a", 1), ("a", 2), ("b", 1), ("c", 1), (None, 1), ("a", None)]
    left, right = [*range(-5, 3000, 97), *range(3000, 60_000, 3011), 900, 900, None], [*range(0, 2000, 131), *range(4000, 80_000, 1977), 4096, 4096, 4096, 8192, None]
    own = spark.createDataFrame([(i, *k, v) for i, (k, v) in enumerate(itertools.product(pairs, left))], "pos bigint, category string, menu int, price_cents bigint")
    known = [(*k, v) for k, most_ in ((("a", 1), 10**9), (("a", 2), 900), (("b", 1), 140), ((None, 1), 10**9), (("a", None), 10**9)) for v in right if v is None or v < most_]
    anchors = spark.createDataFrame(known, "category string, menu int, price_cents bigint").repartition(3)
    expected = set()
    for i, (k, p) in enumerate(itertools.product(pairs, left)):
        if None not in k and p and p > 0:
            near = [sorted(v for *a, v in known if tuple(a) == k and v and v > 0 and abs(v - p) <= max(math.floor(p * share), cents)) for share, cents in market.BANDS]
            band = 0 if len(near[0]) >= 3 else 1 if len(near[1]) >= 3 else 2
            if len(found := near[band]) >= 2:
                expected.add((i, *k, p, band, len(found), found[0], found[-1], found[len(found) // 2]))
    got = market.with_ranges(own, anchors, ["category", "menu"], most).collect()
    assert {r[4] for r in expected} == {0, 1, 2}
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected
    assert got[0].__fields__ == ["pos", "category", "menu", "price_cents", "band", "n", "low", "high", "median"]
    assert not market.with_ranges(own, anchors.where("false"), ["category", "menu"], most).collect()


def test_prices_of_many_keys_are_joined(spark):
    """5,000 prices of one category are sent, one price in each of 5,000 categories isn't: tasks would hold an entry for each."""
    plan = lambda rows_: market.with_ranges(rows_, rows_)._jdf.queryExecution().toString()
    price = spark.range(5000).select((10_000 + F.col("id")).alias("price_cents"), F.col("id").cast("string").alias("category"))
    assert "MapInArrow" in plan(price.withColumn("category", F.lit("c"))) and "MapInArrow" not in plan(price)


def test_ranges_of_the_largest_prices(spark):
    top = 2**63 - 1
    rows_ = spark.createDataFrame([(top,), (top - 5,), (top - 9,)], "price_cents bigint").withColumn("category", F.lit("a"))
    got = market.with_ranges(rows_, rows_).select("price_cents", "band", "n", "low", "high", "median").collect()
    assert {tuple(r) for r in got} == {(top - k, 0, 3, top - 9, top, top - 5) for k in (0, 5, 9)}


def shuffled(spark, df) -> int:
    """Bytes that running df writes for exchanges."""
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(e.totalShuffleWrite() for e in (found.apply(i) for found in [store.executorList(False)] for i in range(found.size())))
    before = written()
    df.collect()
    return written() - before


def test_market_ranges_shuffle_no_pairs(spark):
    prices_ = spark.range(2000).select(F.lit("c").alias("category"), (10_000 + F.col("id")).alias("price_cents"))
    assert shuffled(spark, market.ranges(prices_, prices_)) < 2_000_000


def test_top_sources_compare_sets_once(spark):
    """Every pair in plain Python, and the number of times that names are compared: 40,000 anchors and items with 9 names make no 400 million pairs."""
    words = ["ham", "pie", "soup", "kale"]
    tokens = lambda c: F.split(c, " ")
    menu = [" ".join(w) for n in (1, 2, 3) for w in itertools.combinations(words, n)]
    own = [(k, 1000 * k + i, menu[i % len(menu)]) for k in (1, 2) for i in range(20)]
    anchors = [(k, 5000 * k + i, i % 3, menu[(i * 7) % len(menu)], None if i % 11 == 0 else 100 + i * 37 % 50) for k in (1, 2) for i in range(60 * k)]
    expected = set()
    for k, item, name in own:
        mine = set(name.split())
        score = lambda n, mine=mine: math.floor(100 * len(mine & set(n.split())) / len(mine) + 0.5)
        order = sorted((-score(n), price is None, price, a, place) if price else (-score(n), True, 0, a, place) for key, a, place, n, price in anchors if key == k and score(n) >= 50)
        seen, kept = collections.Counter(), []
        for s, _, _, a, place in order:
            seen[place] += 1
            if seen[place] <= 2:
                kept.append((item, a, -s))
        expected |= {(*row, rank) for rank, row in enumerate(kept[:8], 1)}
    left = spark.createDataFrame(own, "menu int, item_id int, name string")
    right = spark.createDataFrame(anchors, "menu int, anchor_id int, place_id int, anchor_name string, anchor_price int")
    got = market.top_sources(left, right, ["menu"], tokens(F.col("name")), tokens(F.col("anchor_name"))).select("item_id", "anchor_id", "similarity", "rank").collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected
    many = spark.range(20_000).withColumn("menu", F.lit(1)).withColumn("name", F.element_at(F.array(*map(F.lit, menu)), (F.col("id") % len(menu) + 1).cast("int")))
    right = many.select("menu", F.col("id").alias("anchor_id"), (F.col("id") % 10).alias("place_id"), F.col("name").alias("anchor_name"), F.lit(1).alias("anchor_price"))
    out = market.top_sources(many.withColumnRenamed("id", "item_id"), right, ["menu"], tokens(F.col("name")), tokens(F.col("anchor_name")))
    assert out.count() == 160_000


def test_fan_out_deals_one_type_to_many_tasks(spark):
    """All events of one type and 2,500 subscribers to all restaurants, one without a name: the pairs of no task are many more than a share."""
    events = spark.range(600).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"), (F.col("id") % 2).alias("owner"))
    subs = spark.range(2500).select(F.when(F.col("id") > 0, F.col("id")).alias("subscriber"), F.when(F.col("id") % 5 == 0, F.lit(1)).alias("owner"), F.lit("click, View").alias("events"))
    out = drafts.fan_out(events, subs, "owner")
    shares = out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.count("subscriber").alias("named")).collect()
    assert sum(r.n for r in shares) == 600 * 2000 + 300 * 500
    assert sum(r.ids for r in shares) == sum(range(600)) * 2000 + sum(range(1, 600, 2)) * 500
    assert sum(r.n - r.named for r in shares) == 300
    assert max(r.n for r in shares) < 0.2 * sum(r.n for r in shares)


@pytest.mark.parametrize("most", [0, drafts.SENT])
def test_fan_out_makes_every_pair_by_either_path(spark, most):
    """Against every pair: more than a list and a block of a key, NULL in each column, owners and types that only one side has, twins."""
    kinds, owners = ["view", "click", "signup", None], [1, 2, 3, None]
    events = [(i if i % 50 else None, kinds[i % 4 if i > 300 else 0], owners[i // 4 % 4 if i > 300 else 0]) for i in range(500)]
    subs = [(f"s{i // 2}" if i % 40 else None, [1, 2, 4, None][i % 4 if i > 400 else 3], ["view", "View , click", "other", None, ""][i % 5 if i > 400 else 0]) for i in range(600)]
    types = [{k.strip().lower() for k in (s[2] or "").split(",")} for s in subs]
    expected = collections.Counter((e, s) for e, kind, at in events for (s, of, _), known in zip(subs, types, strict=True) if kind in known and (of is None or of == at))
    left = spark.createDataFrame(events, "event_id bigint, event_type string, owner bigint").repartition(3)
    got = drafts.fan_out(left, spark.createDataFrame(subs, "subscriber string, owner bigint, events string"), "owner", most)
    assert got.columns == ["event_id", "subscriber"] and collections.Counter(map(tuple, got.collect())) == expected


def test_fan_out_exchanges_no_events_in_vain(spark):
    """100 of 40,000 events have subscribers; lists aren't exchanged in copies."""
    events = spark.range(40_000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 400 == 0, "view").otherwise("signup").alias("event_type"), F.lit(1).alias("owner"))
    subs = spark.range(2000).select(F.col("id").alias("subscriber"), F.when(F.col("id") % 4 > 0, F.col("id") % 50).alias("owner"), F.lit("view").alias("events"))
    assert shuffled(spark, drafts.fan_out(events, subs, "owner")) < 150_000


def test_fan_out_files_are_small(spark, tmp_path, monkeypatch):
    """Every pair is written, in few bytes: a list's subscribers repeat at short distance."""
    monkeypatch.setattr(drafts, "SLICES", 4)
    events = spark.range(512).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"), F.lit(1).alias("owner"))
    subs = spark.range(4999).select(F.col("id").alias("subscriber"), F.lit(None).cast("int").alias("owner"), F.lit("view").alias("events"))
    drafts.fan_out(events, subs, "owner").write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 512 * 4999
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * 512 * 4999
