"""Queries of the rules on names, quotes, labels and price texts. Texts are templates filled with part names and prices;
each SQL form spells the rule and its words out on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import price_texts as P
from ..functions import quotes as Q
from ..sources import bindings as B
from .registry import query


def _part(spark: SparkSession, sf_dir: str, **texts: list) -> DataFrame:
    return B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), *(B.phrases(t).alias(k) for k, t in texts.items()), "p_size")


def _sql(**texts: list) -> str:
    return "x AS (SELECT p_partkey AS pos, p_size, " + ", ".join(f"{B.phrases_sql(t)} AS {k}" for k, t in texts.items()) + " FROM part)"


_NAMES = [
    "{n}", "Toast Bistro", "Roastoria {n}", "Toasted {n}", "Slice Life", "slice.com", "Uber Eats {n}", "ubereats", "Google Maps", "Best {n}", "The Top {n}", "12 {n}", "120 {n}", "Bestia {n}", "{n} | Menu", "{n} · City", "{n} near me",
    "Top Pizzas in {n}", "our top pizzas in {n}", "Where to Eat in {n}", "{n}...", None, "", "  ", "{n} {n} {n} {n} {n} {n} {n} {n}", "Square Space", "Squared", "Trip Advisor {n}", "Six Flags {n}", "Small {n}", "Cedar Point", "Zomato",
]
_PLACES = ["Main St", None, "Terminal B", "Westfield Mall", "", "12 Riverside Dr", "Hotel Row"]
_CODES = [None, "X2 Airport", "", "Q4 Town", "arena 7"]


@query(f"""WITH {_sql(name=_NAMES, vicinity=_PLACES, code=_CODES)}, t AS (SELECT *, lower(trim(coalesce(name, ''))) AS low, coalesce(name, '') AS whole FROM x)
SELECT pos, low = '' OR regexp_matches(low, '\\b(doordash|grubhub|uber eats|ubereats|uber-eats|postmates|seamless|caviar|toast|toasttab|toast tab|slice|slicelife|slice life|slice\\.com|chownow|chow now|square|square space|yelp|tripadvisor|trip advisor|zomato|google maps|google\\.com)\\b') AS platform,
  whole = '' OR length(trim(whole)) > 80 OR regexp_matches(low, ' \\| | · |\\.\\.\\.| near (me|you|here)|best pizzas? in |best pizza of |best restaurants (in|of) |top (restaurants|pizzas) in |places to eat in |where to eat in ') OR regexp_matches(low, '^(best|top|the best|the top|10|5|7|12|15|20|25) ') AS article,
  whole = '' OR length(trim(whole)) > 80 OR regexp_matches(low, ' \\| | · |\\.\\.\\.| near (me|you|here)|best pizzas? in |best pizza of |best restaurants (in|of) |top restaurants in |places to eat in |where to eat in ') OR regexp_matches(low, '^(best|top|the best|the top|10|5|7|12|15|20|25) ') AS article_web,
  regexp_matches(lower(whole || ' ' || coalesce(vicinity, '') || '#' || coalesce(code, '')), 'six flags|riverside|amusement park|theme park|disney|universal studios|busch gardens|cedar point|funtown|mall|food court|airport|terminal|stadium|arena|hospital|medical center|casino|hotel') AS inside
FROM t""")
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    rows = _part(spark, sf_dir, name=_NAMES, vicinity=_PLACES, code=_CODES)
    return rows.select("pos", Q.is_platform(name).alias("platform"), Q.is_article(name).alias("article"), Q.is_article(name, Q.WEB_MARKS).alias("article_web"), Q.is_inside_venue(name, F.col("vicinity"), F.col("code")).alias("inside"))


_QUOTED = ["{n}", "30 Pcs {n}", "10 Wings", "24ct {n}", "Cheese Slice", "{n} (8 Slices)", "Two {n} Slices", "Cheese Pizza", "Meat Lovers Pizza", "The Sub", "Hamburger", "Fries", "Mini Pizza", "A b", None, "0 pcs", "Wings"]
_QUOTES = [
    "{n} ${p}", "{n} {p} and more", "10 pieces {n} ${p}", "30 Pcs Wings ${p}", "Small/Med {n} ${p}", "Med / Large ${p}", "plain pie ${p}", "Cheese Pizza $1.99 / {n} ${p}", "hoagie ${p}", "burger {p}", "french basket ${p}", "mini ${p}", "${p} {n}",
    "", None, "Buffalo Wings 12 ct ${p}", "meat lovers here, a very long line about other things that goes on and on and on for a while: ${p}", "{p}", "reg/family {n}",
]
_SUBS = ["Toppings", "Sauce Options", "Pizza", None, "Add-Ons", "Bread Option", "Tortilla", "Wings", "Modifier"]
_TOKENS = "list_filter(regexp_extract_all(lower(coalesce(name, '')), '[a-z]+'), lambda w: length(w) > 3 AND w NOT IN ('the', 'and', 'with', 'for', 'size', 'small', 'large', 'medium', 'regular', 'personal', 'mini', 'pizza'))"
_SHORTER = "list_filter(regexp_extract_all(lower(coalesce(name, '')), '[a-z]+'), lambda w: length(w) > 2)"
_OTHERS = "CASE w WHEN 'cheese' THEN ['plain', 'mozzarella'] WHEN 'hamburger' THEN ['burger'] WHEN 'cheeseburger' THEN ['cheese burger'] WHEN 'wings' THEN ['buffalo', 'chicken', 'wing'] WHEN 'buffalo' THEN ['wings', 'wing'] WHEN 'fries' THEN ['french', 'side', 'basket'] WHEN 'calzone' THEN ['calz'] WHEN 'sub' THEN ['hoagie', 'grinder', 'hero'] WHEN 'hoagie' THEN ['sub', 'grinder', 'hero'] WHEN 'grinder' THEN ['sub', 'hoagie', 'hero'] ELSE [] END"
_QTY = lambda c: f"TRY_CAST(regexp_extract(coalesce({c}, ''), '(?i)\\b(\\d{{1,3}})\\s*(pcs?|pieces?|wings?|count|ct)\\b', 1) AS INTEGER)"


@query(f"""WITH {_sql(name=_QUOTED, quote=_QUOTES, sub=_SUBS)}, c AS (SELECT *, lower(coalesce(quote, '')) AS q, CASE WHEN pos % 4 = 0 THEN p_size * 100 ELSE p_size * 100 + pos % 100 END AS cents, {_QTY('name')} AS own, {_QTY('quote')} AS other, {_TOKENS} AS t1, {_SHORTER} AS t2 FROM x),
d AS (SELECT *, CASE WHEN len(t1) > 0 THEN t1 ELSE t2 END AS tokens, (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS exact, CAST(cents // 100 AS VARCHAR) AS whole FROM c),
e AS (SELECT *, flatten(list_transform(tokens, lambda w: list_concat([w], {_OTHERS}))) AS words, coalesce(nullif(strpos(q, '$' || exact), 0), nullif(strpos(q, exact), 0), CASE WHEN cents % 100 = 0 THEN coalesce(nullif(strpos(q, '$' || whole), 0), nullif(strpos(q, ' ' || whole || ' '), 0)) END, 0) AS spot FROM d),
w AS (SELECT *, CASE WHEN spot > 1 THEN substr(q, greatest(1, spot - 60), spot - greatest(1, spot - 60)) ELSE q END AS near FROM e)
SELECT pos, regexp_matches(coalesce(quote, ''), '(?i)\\b(sm|small|md|med|medium|reg|regular|lg|large|xl|x-large)\\s*/\\s*(sm|small|md|med|medium|reg|regular|lg|large|xl|x-large|family|party)\\b') AS compound, own, other,
  own IS NOT NULL AND other IS NOT NULL AND own > 0 AND abs(other - own) / own > 0.5 AS mismatch, q <> '' AND spot > 0 AND (len(tokens) = 0 OR len(list_filter(words, lambda v: contains(q, v))) > 0 AND len(list_filter(words, lambda v: contains(near, v))) > 0) AS backed,
  regexp_matches(lower(regexp_replace(coalesce(name, ''), '\\([^)]*\\)', '', 'g')), '\\bslices?\\b') AS by_slice, regexp_matches(lower(coalesce(sub, '')), 'topping|sauce|preparation|add-on|addon|add on|modifier|options|tortilla|bread option') AS modifier FROM w""")
def quote_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.when(F.col("pos") % 4 == 0, F.col("p_size") * 100).otherwise(F.col("p_size") * 100 + F.col("pos") % 100)
    rows = _part(spark, sf_dir, name=_QUOTED, quote=_QUOTES, sub=_SUBS).withColumn("cents", cents)
    name, quote = F.col("name"), F.col("quote")
    return rows.select(
        "pos", Q.has_compound_size(quote).alias("compound"), Q.quantity(name).alias("own"), Q.quantity(quote).alias("other"), Q.quantity_mismatch(name, quote).alias("mismatch"),
        Q.backs_price(quote, F.col("cents"), name).alias("backed"), Q.by_the_slice(name).alias("by_slice"), Q.is_modifier(F.col("sub")).alias("modifier"),
    )


_PRICES = ["{p}", "${p}", " {p} ", "$ {p}", "12 50", "12 5", "1,200.50", "abc", "", None, "-3.50", "$7", "about {p} each", "MP", "9.999", "{p}.1", "7.5", ".75", "2500", "+$4", "12.345", "1e2"]
_FLOAT = "CASE WHEN regexp_matches({0}, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN TRY_CAST({0} AS DOUBLE) END"


@query(f"""WITH {_sql(raw=_PRICES)}, a AS (SELECT pos, raw, trim(replace(replace(raw, '$', ''), ',', ' ')) AS form, trim(replace(trim(raw), '$', '')) AS loose, replace(trim(raw), '$', '') AS scan, regexp_replace(replace(replace(trim(raw), ',', ''), ' ', ''), '^\\$', '') AS page FROM x),
b AS (SELECT *, CASE WHEN regexp_matches(form, '^\\S+\\s+\\d{{1,2}}$') THEN regexp_extract(form, '^(\\S+)', 1) || '.' || lpad(regexp_extract(form, '(\\d+)$', 1), 2, '0') ELSE form END AS joined,
  CASE WHEN regexp_matches(page, '^\\d+(\\.\\d*)?$') THEN CAST(regexp_extract(page, '^(\\d+)', 1) AS BIGINT) * 100 + CAST(left(regexp_extract(page, '\\.(.*)$', 1) || '00', 2) AS INTEGER) END AS paged FROM a)
SELECT pos, coalesce(CAST(round_even({_FLOAT.format('joined')} * 100, 0) AS BIGINT), 0) AS form_cents, greatest(coalesce(CAST(round_even({_FLOAT.format('loose')} * 100, 0) AS BIGINT), 0), 0) AS loose_cents,
  CASE WHEN scan <> '' THEN coalesce(CAST(nullif(regexp_replace(regexp_extract(scan, '^([^.]*)', 1), '\\D', '', 'g'), '') AS BIGINT), 0) * 100 + coalesce(CAST(nullif(left(regexp_replace(CASE WHEN contains(scan, '.') THEN substr(scan, strpos(scan, '.') + 1) ELSE '' END, '\\D', '', 'g'), 2), '') AS BIGINT), 0) END AS scanned_cents,
  coalesce(CAST(round_even(TRY_CAST(regexp_extract(raw, '[-+]?\\$?\\s*(\\d+(\\.\\d{{1,2}})?)', 1) AS DOUBLE) * 100, 0) AS BIGINT), 0) AS found_cents, CASE WHEN paged BETWEEN 50 AND 100000 THEN paged END AS page_cents FROM b""")
def price_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    readings = {"form_cents": P.form_cents, "loose_cents": P.loose_cents, "scanned_cents": P.scanned_cents, "found_cents": P.found_cents, "page_cents": P.page_cents}
    return _part(spark, sf_dir, raw=_PRICES).select("pos", *(f(raw).alias(k) for k, f in readings.items()))


_LINES = ["{n}...{p}...{p}", "{n} ${p}", "{n} +1.50 extra", "{n} 8.00 - 9.50", "2 for $10 {n}", "{n}", "", None, "3 FOR 9.99", "12 {p}", "$8", "{p}"]


@query(f"""WITH {_sql(line=_LINES)}, l AS (SELECT pos, coalesce(line, '') AS line FROM x), k AS (SELECT *, regexp_extract_all(line, '\\$?\\b(\\d{{1,3}}\\.\\d{{2}})\\b', 1) AS two FROM l)
SELECT pos, len(two) AS n_prices, coalesce(CAST(two[1] AS DOUBLE), 0) AS first_price, array_to_string(list_concat(list_transform(regexp_extract_all(line, '\\$?\\d{{1,3}}(\\.\\d{{2}})?'), lambda h: 'base:' || replace(h, '$', '')), list_transform(regexp_extract_all(line, '\\+\\$?\\d+(\\.\\d{{2}})?'), lambda h: 'delta:' || regexp_replace(h, '[+$]', '', 'g')),
  list_transform(regexp_extract_all(line, '\\d{{1,3}}\\.\\d{{2}}\\s*[-–]\\s*\\d{{1,3}}\\.\\d{{2}}'), lambda h: 'range:' || regexp_replace(h, '\\s', '', 'g')), list_transform(regexp_extract_all(line, '(?i)\\b\\d+\\s*for\\s*\\$?\\d+(\\.\\d{{2}})?\\b'), lambda h: 'deal:' || h)), '|') AS kinds FROM k""")
def line_price_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir, line=_LINES).withColumn("two", P.line_prices(F.col("line")))
    return rows.select("pos", F.size("two").cast("bigint").alias("n_prices"), F.coalesce(F.try_element_at("two", F.lit(1)), F.lit(0.0)).alias("first_price"), F.array_join(P.line_price_kinds(F.col("line")), "|").alias("kinds"))


_BLOCKS = ["{p}", "${p} {n}", "{n} {p}", "8", "1234567", "ab 12", "12 ab {p}", "{n}", "", None, "....", "bcdfg", "a$b", "é.", "#@!x", "x" * 30, "-----------------------------ab", "7up", "..", "{p} {p}", "rhythm"]


@query(f"""WITH {_sql(text=_BLOCKS)}, t AS (SELECT pos, coalesce(text, '') AS raw, trim(coalesce(text, '')) AS t FROM x), c AS (SELECT *, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(t, '\\P{{L}}', '', 'g')) AS letters, greatest(length(raw), 1) AS size, length(regexp_replace(raw, '\\P{{L}}', '', 'g')) AS alphas, length(regexp_replace(raw, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) AS symbols FROM t)
SELECT pos, digits > 0 AND (contains(t, '$') OR regexp_matches(t, '\\b\\d{{1,3}}(\\.\\d{{2}})?\\b') AND letters <= 4 OR letters = 0 AND digits <= 6 OR letters <= 2 AND digits >= 2 AND length(t) <= 10) AS pricey,
  raw = '' OR alphas / size < 0.45 AND NOT regexp_matches(raw, '[0-9]') OR regexp_matches(raw, '(?i)\\b[b-df-hj-np-tv-z]{{4,}}\\b') OR length(raw) > 28 AND alphas / size < 0.6 OR length(raw) <= 2 AND NOT regexp_matches(raw, '[\\p{{L}}\\p{{N}}]') OR symbols / size > 0.35 AS garbage FROM c""")
def token_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, text=_BLOCKS).select("pos", P.is_price_text(F.col("text")).alias("pricey"), P.is_garbage_token(F.col("text")).alias("garbage"))


_LABELS = ['10"', "14 inch", "6pc", "12 Pieces", "Small", "lg.", "Extra Large Pie", "X-Large", "18", "5", "W/Fries", "with Cheese", "w/ {n}", "Fries", "Thin Crust", "Honey BBQ", "Hot", "Bone-In", "naked", "{n}", "", None, "Half; 12", "Plain medium", "31", "8 in", "with onion rings", "Side Salad"]
_FOODS = ["sweet potato fries", "macaroni and cheese", "fried mushrooms", "mixed vegetables", "seasoned fries", "mashed potatoes", "mashed potato", "mac and cheese", "fountain drink", "fried pickles", "caesar salad", "potato chips", "potato salad", "french fries", "waffle fries", "garden salad", "baked potato", "extra cheese", "garlic bread", "breadsticks", "curly fries", "steak fries", "onion rings", "cup of soup", "house salad", "onion ring", "tater tots", "side salad", "fried rice", "white rice", "brown rice", "vegetables", "cole slaw", "side soup", "coleslaw", "beverage", "veggies", "cheese", "fries", "chips", "salad", "drink", "bread", "frie", "tots", "chip", "slaw", "rice", "soda", "soup"]
_IN_FOODS = ", ".join(f"'{f}'" for f in _FOODS)
_SIZE_SQL = "CASE WHEN w IN ('xs', 'x-small', 'extra small') THEN 'XS' WHEN w IN ('small', 'sm', 'sml', 's') THEN 'S' WHEN w IN ('medium', 'med', 'md', 'm') THEN 'M' WHEN w IN ('large', 'lg', 'lrg', 'l') THEN 'L' WHEN w IN ('x-large', 'xlarge', 'xl', 'extra large') THEN 'XL' WHEN w = 'xxl' THEN 'XXL' WHEN w = 'individual' THEN 'Personal' WHEN w IN ('half', 'whole', 'slice', 'personal', 'family', 'party', 'single', 'double', 'triple', 'regular', 'deluxe', 'mini') THEN upper(w[1]) || w[2:] END"


@query(f"""WITH {_sql(label=_LABELS)}, l AS (SELECT pos, coalesce(label, '') AS label, lower(trim(coalesce(label, ''))) AS low FROM x),
s AS (SELECT *, coalesce(CAST(TRY_CAST(regexp_extract(low, '(\\d{{1,2}})\\s*("|in(ch(es)?)?)\\b', 1) AS INTEGER) AS VARCHAR) || 'in', CAST(TRY_CAST(regexp_extract(low, '(\\d{{1,2}})\\s*(pc|pcs|piece|pieces|ct)\\b', 1) AS INTEGER) AS VARCHAR) || 'pc',
  list_filter(list_transform(string_split_regex(low, '\\s+'), lambda t: (SELECT {_SIZE_SQL} FROM (SELECT trim(t, '.,;:-') AS w))), lambda v: v IS NOT NULL)[1], CAST(list_filter(list_transform(regexp_extract_all(low, '\\b(\\d{{1,2}})\\b', 1), lambda n: CAST(n AS INTEGER)), lambda n: n BETWEEN 6 AND 30)[1] AS VARCHAR) || 'in') AS size FROM l),
k AS (SELECT *, CASE WHEN low = '' THEN NULL WHEN size IS NOT NULL THEN 'size' WHEN trim(regexp_replace(low, '^(w/\\s*|with\\s+)', '')) IN ({_IN_FOODS}) OR low IN ({_IN_FOODS}) THEN 'combo'
  WHEN regexp_matches(low, 'bone-in|bone in|boneless|thin|thick|deep dish|stuffed crust|white|red|alfredo|pesto|pan|hand tossed|hand-tossed|brooklyn|sicilian|neapolitan|detroit|new york|ny style|flatbread|gluten free|gluten-free|cauliflower crust|crispy|fried|grilled|baked|breaded|naked|dry rub|tossed') THEN 'style'
  WHEN regexp_matches(low, 'hot|mild|medium|honey|bbq|barbecue|garlic|parm|teriyaki|buffalo|spicy|sweet|sour|lemon|pepper|mango habanero|carolina gold|thai chili|old bay|cajun|ranch|blue cheese|asian zing|sriracha|plain|naked|original') THEN 'flavor' ELSE 'other' END AS kind FROM s)
SELECT pos, size, kind, CASE WHEN kind = 'size' THEN 'size:' || size WHEN kind IN ('flavor', 'style', 'combo') THEN kind || ':' || low END AS group_key, array_to_string(list_transform(regexp_extract_all(label, '(?i)\\b(w/|with)\\s+({"|".join(_FOODS)})\\b', 2), lambda f: lower(f)), ',') AS combos FROM k""".replace("lambda t: (SELECT " + _SIZE_SQL + " FROM (SELECT trim(t, '.,;:-') AS w))", "lambda t: " + _SIZE_SQL.replace("upper(w[1]) || w[2:]", "upper(left(w, 1)) || substr(w, 2)").replace("WHEN w ", "WHEN trim(t, '.,;:-') ").replace("(left(w, 1)) || substr(w, 2)", "(left(trim(t, '.,;:-'), 1)) || substr(trim(t, '.,;:-'), 2)")))
def variant_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label")
    return _part(spark, sf_dir, label=_LABELS).select("pos", Q.label_size(label).alias("size"), Q.label_kind(label).alias("kind"), Q.group_key(label).alias("group_key"), F.array_join(Q.combo_hints(label), ",").alias("combos"))


_HEADINGS = ["Pizzas", "Pizza's", "Sandwiches", "Sandwich", "Calzones", "Salad & Soup", "Fries", "Dishes", "Boxes", "Glasses", "Pies", "", None, "GOURMET PIZZA PIES", "SOFT DRINKS", "Italian Dinners", "PARTY TRAYS (for 10)", "s", "Bone-In Wings", "hot subs", "{n}", "ab", "kids' MENU", "ies"]
_WANTED = ["{n} Pizza", "Casa Di Lisa", "The Bar & Grill", None, "Salty Flame Restaurant", "{n}"]


@query(f"""WITH {_sql(heading=_HEADINGS, want=_WANTED)}, k AS (SELECT *, trim(replace(replace(replace(lower(trim(coalesce(heading, ''))), '''', ''), '"', ''), '&', 'and')) AS c, trim(coalesce(heading, '')) AS raw FROM x)
SELECT pos, CASE WHEN c LIKE '%ies' AND length(c) > 4 THEN left(c, length(c) - 3) || 'y' WHEN regexp_matches(c, '(ches|shes|xes|zes|sses)$') AND length(c) > 4 THEN left(c, length(c) - 2) WHEN c LIKE '%s' AND length(c) > 2 THEN left(c, length(c) - 1) ELSE c END AS key,
  CASE WHEN raw = '' THEN 'Uncategorized' WHEN regexp_matches(lower(raw), 'pizza') THEN 'Pizza' WHEN regexp_matches(lower(raw), 'calzone|stromboli') THEN 'Calzones & Strombolis' WHEN regexp_matches(lower(raw), 'wings') THEN 'Wings' WHEN regexp_matches(lower(raw), 'burger|sandwich|panini|wrap|sub|grinder|hoagie|philly') THEN 'Burgers & Sandwiches' WHEN regexp_matches(lower(raw), 'salad') THEN 'Salads'
    WHEN regexp_matches(lower(raw), 'pasta|dinners') THEN 'Pastas' WHEN regexp_matches(lower(raw), 'appetizer|starters|sides|side orders|finger foods') THEN 'Appetizers & Sides' WHEN regexp_matches(lower(raw), 'beverage|drink|soda') THEN 'Beverages' WHEN regexp_matches(lower(raw), 'dessert|sweet treats') THEN 'Desserts'
    WHEN length(raw) > 2 THEN array_to_string(list_transform(regexp_extract_all(raw, '[a-zA-Z]+|[^a-zA-Z]+'), lambda p: upper(left(p, 1)) || lower(substr(p, 2))), '') ELSE 'Uncategorized' END AS collapsed,
  len(list_intersect(list_filter(string_split_regex(replace(replace(lower(coalesce(heading, '')), '&', ' '), ',', ' '), '\\s+'), lambda w: w NOT IN ('', 'restaurant', 'pizza', 'pizzeria', 'bar', 'grill', 'cafe', 'kitchen', 'the', 'and', 'of', 'la', 'el', 'di', 'da')), string_split_regex(replace(replace(lower(coalesce(want, '')), '&', ' '), ',', ' '), '\\s+'))) > 0 AS same
FROM k""")
def category_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.col("heading")
    return _part(spark, sf_dir, heading=_HEADINGS, want=_WANTED).select("pos", Q.category_key(heading).alias("key"), Q.collapsed_category(heading).alias("collapsed"), Q.roughly_same(heading, F.col("want")).alias("same"))


@query("""WITH e AS (SELECT event_id, abs(value) * 1000 * CASE WHEN event_id % 3 = 0 THEN 60 WHEN event_id % 3 = 1 THEN 1 ELSE 0.01 END + 3 AS ms FROM events), s AS (SELECT *, ms / 1000 AS s FROM e)
SELECT event_id, CASE WHEN ms < 1000 THEN CAST(round_even(ms, 0) AS BIGINT) || 'ms' WHEN s < 60 THEN printf('%.1fs', s) ELSE CAST(floor(s / 60) AS BIGINT) || 'm ' || printf('%.1fs', s - floor(s / 60) * 60) END AS told FROM s""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = F.when(F.col("event_id") % 3 == 0, 60.0).when(F.col("event_id") % 3 == 1, 1.0).otherwise(0.01)
    return B.table(spark, sf_dir, "events").select("event_id", P.duration(F.abs("value") * 1000 * factor + 3).alias("told"))


@query("""WITH v AS (SELECT l_partkey AS item, list(CAST(round(l_extendedprice) AS BIGINT) - 20000) AS own, list(CAST(l_quantity AS BIGINT) - 25 ORDER BY l_orderkey, l_linenumber) AS seen FROM lineitem GROUP BY 1)
SELECT p_partkey AS pos, CAST(coalesce(list_min(list_filter(CASE WHEN p_partkey % 3 = 0 THEN own END, lambda x: x > 0)), list_filter(CASE WHEN p_partkey % 3 <> 1 THEN seen END, lambda x: x > 0)[1], CASE WHEN p_size - 10 > 0 THEN p_size - 10 END, 0) AS BIGINT) AS cents FROM part LEFT JOIN v ON item = p_partkey""")
def primary_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least positive variant, else the first positive candidate, else the item's own price."""
    rows = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("pos")).agg(F.collect_list(F.round("l_extendedprice").cast("bigint") - 20000).alias("own"), F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("bigint") - 25).alias("q")))).alias("seen"))
    parts = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), "p_size").join(rows, "pos", "left")
    key = F.col("pos") % 3
    return parts.select("pos", P.lowest_variant(F.when(key == 0, F.col("own")), F.when(key != 1, F.transform("seen", lambda s: s["q"])), F.col("p_size").cast("bigint") - 10).alias("cents"))
