"""Line rules with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from carteframe.functions import grammar as G
from carteframe.functions import rescue
from carteframe.operators import cleaning


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first().r


def test_noise(spark):
    assert one(spark, G.without_garble, "CHEESE PIZZA coseeee 9.95") == "CHEESE PIZZA 9.95"
    assert one(spark, G.without_garble, "Soup......4.50") == "Soup 4.50"
    assert one(spark, G.without_garble, None) == ""
    assert one(spark, G.without_noise, "eee Ham F590 00 7 & x $5 9.95,") == "Ham 7 & $5 9.95,"
    assert one(spark, G.without_noise, "  ") == ""


def test_words(spark):
    assert one(spark, G.without_misreadings, "[a1] 88q Smt Basi!") == "BBQ Sml Basil"
    assert [one(spark, G.spelled_with, t) for t in ("W/ FRIES", "Wi CHEESE", "WIFRIES", "Wi onions", "WI/soup")] == ["with FRIES", "with CHEESE", "with FRIES", "Wi onions", "with soup"]


@pytest.mark.parametrize(
    ("line", "want"),
    [("MEAT LOVERS Pepperoni, Sausage, Bacon", ("MEAT LOVERS", "Pepperoni, Sausage, Bacon")), ("BBQ Chicken Pizza", None), ("BLT bacon", ("BLT", "bacon")), ("MAC & CHEESE creamy", ("MAC & CHEESE", "creamy")), ("ALL CAPS", None), ("SUPER ab", None), ("& Bacon bits", None), (None, None)],
)
def test_capital_name(spark, line, want):
    got = one(spark, G.capital_name, line)
    assert (tuple(got) if got else None) == want


def test_components(spark):
    told = lambda t: tuple(cleaning.components(spark.createDataFrame([(t,)], "t string"), "t").first().components)[1:]
    assert told("grilled chicken, ranch dressing and Mayo, Peppers") == (["chicken", "Mayo", "Peppers"], "ranch", "grilled", [])
    assert told("hot, mild or BBQ") == ([], None, None, ["hot", "mild", "bbq"])
    assert told("Chicken w/ Alfredo Sauce") == (["Chicken"], "alfredo", None, [])
    assert told(None) == ([], None, None, [])


def test_columns(spark):
    assert one(spark, G.column_segments, "Soup ... of day      $4.50     x     Salad") == ["Soup of day", "$4.50", "Salad"]
    assert one(spark, G.column_segments, "Soup   4.50") is None
    assert one(spark, G.size_columns, '10"Mini 12" Sml 16"lrg Family Size') == ['10" Mini', '12" S', '16" L', "Family"]
    assert one(spark, G.size_columns, "Regular Deluxe 8 slices 6 pcs") == ["Regular", "Deluxe", "6pc"]


@pytest.mark.parametrize(("cents", "want"), [([900, 1200, 1500], [("S", 900, 0.85), ("M", 1200, 0.85), ("L", 1500, 0.85)]), ([0, 900, 1200], [("M", 900, 0.75), ("L", 1200, 0.75)]), ([900], []), ([1, 2, 3, 4], []), (None, [])])
def test_grid_variants(spark, cents, want):
    df = spark.createDataFrame([(["S", "M", "L"], cents)], "c array<string>, p array<int>")
    assert [tuple(v) for v in df.select(G.grid_variants(F.col("c"), F.col("p")).alias("v")).first().v] == want


def test_rescue(spark):
    rows = [
        ("Hawaiian (ham, pineapple, mozzarella)", None, ("Hawaiian", "ham, pineapple, mozzarella")),
        ("Hawaiian (ham, pineapple, mozzarella)", "long enough", ("Hawaiian (ham, pineapple, mozzarella)", "")),
        ("Calzones Stuffed With: ricotta, mozzarella and sauce and many other things that make this a long name", "", ("Calzones Stuffed", "With ricotta, mozzarella and sauce and many other things that make this a long name")),
        ("Big Pizza without any of the cheese that most other people would like so very much on it at all", "", ("Big Pizza without any of the", "cheese that most other people would like so very much on it at all")),
        ("Plain", "", ("Plain", "")),
        (None, None, ("", "")),
    ]
    df = spark.createDataFrame([(i, n, d) for i, (n, d, _) in enumerate(rows)], "i int, n string, d string")
    got = {r.i: tuple(r.r) for r in df.select("i", rescue.rescued(F.col("n"), F.col("d")).alias("r")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(rows)}


def test_cleaned_items_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "Garlic Knots....", "a, b ham w/ cheese & and olives, x with", 599), (2, "Plain", "*** ~~ ]] a b", None), (3, None, None, 5), (3, None, None, 5)], "id int, name string, description string, price_cents int")
    got = sorted(map(tuple, cleaning.cleaned_items(df).collect()))
    assert got == [(1, "Garlic Knots", "ham with cheese and olives,", 599), (2, "Plain", "[AI Cleaned]", None), (3, "", "", 5), (3, "", "", 5)]
    assert cleaning.cleaned_items(df.limit(0)).count() == 0
