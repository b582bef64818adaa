"""Queries of the line rules. Lines are templates filled with part names and prices; each SQL form spells its rule out on
its own and shares only the fixed word lists."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar as G
from ..functions import price_texts as P
from ..functions import quotes as Q
from ..functions import rescue as R
from ..operators import cleaning
from ..sources import bindings as B
from .registry import query


def _part(spark: SparkSession, sf_dir: str, **texts: list) -> DataFrame:
    return B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), *(B.phrases(t).alias(k) for k, t in texts.items()), "p_size")


def _sql(**texts: list) -> str:
    return "x AS (SELECT p_partkey AS pos, p_size, " + ", ".join(f"{B.phrases_sql(t)} AS {k}" for k, t in texts.items()) + " FROM part)"


def _list(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_LINES = [
    "CHEESE PIZZA coseeee {p}", "{n} ....... {p}", "{n} ssssvvssseecsscssssssssescstvsesneneeosees {p}", "Pepperoni & Sausage", "eee {n} F590 s0s00 00 7", "88q Chicken W/ FRIES {p}", "Wi CHEESE {n}", "WIFRIES {p}", "[a1] {n} Basi!", "Wi onions",
    "piZzA Smt {p}", "WI/SALAD {n}", None, "", "  a  x  1, 2b (no) $5 {p}, pc:", "sessions rotten wonton covers", "neerseet oosse {n}", "Cheeeese Balloon", "hot w/ fries and wi/ chips", "880 B8Q 8BQ", "a1b2c3d4 99999x 12345678ab w",
]
_TRIPLES = "|".join(c * 3 for c in string.ascii_lowercase)
_SINGLE = "|".join(sorted((f for f in Q.COMBO_FOODS if " " not in f), key=len, reverse=True))


@query(rf"""WITH {_sql(line=_LINES)}, l AS (SELECT pos, coalesce(line, '') AS line FROM x)
SELECT pos, trim(regexp_replace(array_to_string(list_transform(regexp_extract_all(regexp_replace(line, '\.{{2,}}', ' ', 'g'), '[a-zA-Z]+|[^a-zA-Z]+'), lambda w: CASE WHEN regexp_full_match(w, '[a-zA-Z]{{5,}}')
    AND CAST(regexp_matches(lower(w), '{_TRIPLES}') AS INT) + CAST(length(regexp_replace(lower(w), '[^secrnotvw]', '', 'g')) / length(w) >= 0.55 AS INT) + CAST(len(list_distinct(string_split(lower(w), ''))) / length(w) <= 0.45 AS INT) + CAST(length(w) >= 12 AS INT) >= 2 THEN ' ' ELSE w END), ''), '\s+', ' ', 'g')) AS ungarbled,
  array_to_string(list_transform(list_filter(list_transform(list_filter(string_split_regex(line, '\s+'), lambda w: w <> ''), lambda w: struct_pack(w := w, b := trim(w, '.,;:!?)'), l := lower(rtrim(w, '.,;:!?)')), a := lower(regexp_replace(w, '[^\p{{L}}]', '', 'g')))),
    lambda s: regexp_matches(s.b, '^\$?\s*\d{{1,3}}[.,]\d{{2}}') OR starts_with(s.w, '$') OR CASE
      WHEN length(s.b) < 4 THEN s.l IN ('&', 'w/', 'or', 'of', 'on', 'in', 'to', 'a', 'no', 'pc') OR (regexp_full_match(s.b, '\d+') AND s.b NOT IN ('00', '000')) OR NOT (s.a = '' OR (length(s.a) <= 1 AND length(s.b) <= 2) OR (length(s.a) = length(s.b) AND len(list_distinct(string_split(s.a, ''))) = 1))
      WHEN length(s.b) <= 11 THEN NOT ((s.a <> '' AND length(s.a) < length(s.b) * 0.4) OR (length(s.a) >= 3 AND length(regexp_replace(s.a, '[^secrnotvw]', '', 'g')) / length(s.a) >= 0.85 AND len(list_distinct(string_split(s.a, ''))) / length(s.a) < 0.65))
      ELSE true END), lambda s: s.w), ' ') AS quiet,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '88q|88Q|8BQ|880|B8Q', 'BBQ', 'g'), '(B|b)asi!', '\1asil', 'g'), '\bpiZzA\b', 'PIZZA', 'g'), '\bSmt\b', 'Sml', 'g'), '^\[a?\d*\]?\s*', ''), '\bWI/', 'W/', 'g') AS reread,
  regexp_replace(regexp_replace(regexp_replace(line, '(?i)\bwi?/\s*', 'with ', 'g'), '\bWi\s+([b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])', 'with \1', 'g'), '(?i)\bwi({_SINGLE})\b', 'with \1', 'g') AS spelled FROM l""")
def line_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    return _part(spark, sf_dir, line=_LINES).select("pos", G.without_garble(line).alias("ungarbled"), G.without_noise(line).alias("quiet"), G.without_misreadings(line).alias("reread"), G.spelled_with(line).alias("spelled"))


_HEADS = [
    "MEAT LOVERS Pepperoni, Sausage, Bacon", "BBQ Chicken Pizza", "BLT bacon lettuce", "BBQ Pulled Pork, onions", "MAC & CHEESE 12 creamy", "ALL CAPS ONLY", "{n} Mixed Case", "12 WINGS & FRIES Served hot", "& THE WORKS with it", None, "", "ONE", "A Big lunch",
    "SUPER ab", "GRECO {p} Feta And Olives", "HOT Very long description that goes on without any comma until here, late",
]


@query(rf"""WITH {_sql(line=_HEADS)}, w AS (SELECT pos, list_filter(string_split_regex(coalesce(line, ''), '\s+'), lambda w: w <> '') AS words FROM x),
f AS (SELECT *, list_transform(words, lambda w: regexp_replace(w, '[^A-Za-z]', '', 'g')) AS plain FROM w),
g AS (SELECT *, coalesce(list_min(list_filter(list_transform(range(1, len(words) + 1), lambda i: CASE WHEN plain[i] <> '' AND NOT (length(plain[i]) >= 2 AND plain[i] = upper(plain[i])) THEN i END), lambda i: i IS NOT NULL)), 0) AS cut FROM f),
h AS (SELECT *, array_to_string(words[1:cut - 1], ' ') AS name, array_to_string(words[cut:], ' ') AS rest FROM g WHERE cut > 1 AND array_to_string(plain[1:cut - 1], '') <> '')
SELECT pos, name, rest AS description FROM h WHERE length(regexp_replace(rest, '[^\p{{L}}]', '', 'g')) >= 3 AND NOT (cut = 2 AND regexp_matches(rest, '^[^\p{{L}}]*\p{{Lu}}') AND NOT contains(rest[1:40], ','))""")
def capital_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = G.capital_name(F.col("line")).alias("s")
    return _part(spark, sf_dir, line=_HEADS).select("pos", split).where("s is not null").select("pos", "s.name", "s.description")


_TOLD = [
    "Pepperoni, Sausage & Bacon", "Chicken w/ Alfredo Sauce", "grilled chicken, ranch and bbq sauce", "hot, mild, BBQ", "hot, mild or pickles", "with lettuce; tomato.", "sliced steak and fried onions", "homemade marinara, pesto sauce, {n}", None, "", "plain", "1000 Island base, turkey",
    "w/ sweet chili & crispy bacon, smoked", "oven baked ham or honey mustard", "{n}", ".., & ,", "caesar dressing and blue cheese", "fresh shaved parmesan, diced",
]
_KNOWN = ", ".join(f"('{w}', '{k}', {i})" for i, (k, w) in enumerate((k, w) for k, words in (("sauce", G.SAUCES), ("preparation", G.PREPARATIONS), ("flavor", G.TASTES), ("topping", G.TOPPINGS)) for w in words))


@query(rf"""WITH {_sql(line=_TOLD)}, known(word, kind, place) AS (VALUES {_KNOWN}),
s AS (SELECT pos, unnest(string_split_regex(regexp_replace(coalesce(line, ''), '(?i)\s+w/\s*', ', ', 'g'), '(?i),\s*|\s+&\s+|\s+and\s+|;\s*|\s+or\s+')) AS part, generate_subscripts(string_split_regex(regexp_replace(coalesce(line, ''), '(?i)\s+w/\s*', ', ', 'g'), '(?i),\s*|\s+&\s+|\s+and\s+|;\s*|\s+or\s+'), 1) AS i FROM x),
t AS (SELECT pos, i, trim(regexp_replace(trim(trim(part), '.'), '(?i)^(w/\s*|with\s+)', '')) AS part FROM s), u AS (SELECT *, lower(part) AS low FROM t WHERE part <> ''),
k AS (SELECT u.pos, u.i, u.part, u.low, (SELECT arg_min(struct_pack(word := word, kind := kind), -length(word) * 1000 + place) FROM known WHERE contains(u.low, word)) AS k, CASE WHEN string_split(low, ' ')[1] IN {_list(G.PREPARATIONS)} THEN string_split(low, ' ')[1] END AS way,
  count(*) OVER (PARTITION BY u.pos) >= 2 AND bool_and(low IN {_list(G.TASTES)}) OVER (PARTITION BY u.pos) AS only_tastes FROM u),
a AS (SELECT *, min(CASE WHEN k.kind = 'sauce' AND NOT only_tastes THEN i END) OVER (PARTITION BY pos) AS sauce_at FROM k),
b AS (SELECT *, min(CASE WHEN NOT only_tastes AND i IS DISTINCT FROM sauce_at AND (way IS NOT NULL OR k.kind = 'preparation') THEN i END) OVER (PARTITION BY pos) AS made_at FROM a),
c AS (SELECT *, CASE WHEN i = sauce_at THEN 'sauce' WHEN i = made_at THEN 'made' WHEN only_tastes OR k.kind = 'flavor' THEN 'flavor' ELSE 'topping' END AS role, coalesce(way, k.word) AS by_way FROM b),
d AS (SELECT *, CASE role WHEN 'topping' THEN part WHEN 'made' THEN nullif(trim(substr(low, 1, strpos(low, by_way) - 1) || substr(low, strpos(low, by_way) + length(by_way))), '') END AS topping FROM c)
SELECT x.pos, count(d.i) AS n_parts, coalesce(string_agg(topping, '|' ORDER BY i), '') AS toppings, max(CASE WHEN role = 'sauce' THEN trim(regexp_replace(k.word, ' (base|sauce|dressing)$', '')) END) AS sauce, max(CASE WHEN role = 'made' THEN by_way END) AS preparation,
  coalesce(string_agg(CASE WHEN role = 'flavor' THEN low END, '|' ORDER BY i), '') AS flavors FROM x LEFT JOIN d ON d.pos = x.pos GROUP BY 1""")
def description_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = cleaning.components(_part(spark, sf_dir, line=_TOLD), "line", "c")
    joined = lambda c: F.array_join(c, "|").alias(c.split(".")[1])
    return told.select("pos", F.size("c.parts").cast("bigint").alias("n_parts"), joined("c.toppings"), "c.sauce", "c.preparation", joined("c.flavors"))


_WIDE = ["{n}      {p}     Large", "CHEESEBURGER......     {n}  with  fries      ", "a     b", "{n}", None, "", "     ", "Soup ... of day     $ {p}     x     Salad..greens", "{n}\t \t  two", "12     34"]


@query(rf"""WITH {_sql(line=_WIDE)}, s AS (SELECT pos, list_filter(list_transform(string_split_regex(trim(coalesce(line, '')), '\s{{5,}}'), lambda s: trim(regexp_replace(regexp_replace(trim(trim(s), '.'), '\.{{2,}}', ' ', 'g'), '\s+', ' ', 'g'))),
  lambda s: length(regexp_replace(s, '[^\p{{L}}]', '', 'g')) >= 2 OR regexp_matches(s, '\$?\s*\d{{1,3}}[.,]\d{{2}}')) AS parts FROM x) SELECT pos, len(parts) AS n_columns, array_to_string(parts, '|') AS columns FROM s WHERE len(parts) >= 2""")
def column_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir, line=_WIDE).select("pos", G.column_segments(F.col("line")).alias("parts")).where("parts is not null")
    return rows.select("pos", F.size("parts").cast("bigint").alias("n_columns"), F.array_join("parts", "|").alias("columns"))


_GRIDS = [
    '10"Mini 12" Sml 16"lrg Family Size', "Regular Deluxe", '12" Sml   16"lrg  Family Size', '10" 14" 18"', "Small Medium Large {n}", "6 pcs 12 pieces 24pc", '12" (8 slices) 16” (12 cuts)', "{n}", None, "", '8"Pizza party', "personal 10° med"
]
_PRICED = ["{n} {p} {p} {p}", "{n} {p} {p}", "{n} {p}", "{n} 9.95 {p} 12.50 14.00 16.25", "{n}", None, "{n} 0.00 {p} 3.25"]
_SIZE = lambda w: f"CASE lower({w}) WHEN 'small' THEN 'S' WHEN 'sm' THEN 'S' WHEN 'sml' THEN 'S' WHEN 'medium' THEN 'M' WHEN 'med' THEN 'M' WHEN 'large' THEN 'L' WHEN 'lrg' THEN 'L' WHEN 'lg' THEN 'L' WHEN 'mini' THEN 'Mini' WHEN 'family' THEN 'Family' WHEN 'party' THEN 'Party' WHEN 'personal' THEN 'Personal' WHEN 'regular' THEN 'Regular' WHEN 'deluxe' THEN 'Deluxe' ELSE {w} END"


@query(rf"""WITH {_sql(header=_GRIDS, line=_PRICED)}, h AS (SELECT pos, list_filter(regexp_extract_all(coalesce(header, ''), '(?i)\d{{1,2}}\s*["”°](?:[a-zA-Z]+|\s+(?:mini|sml|small|sm|medium|med|large|lrg|lg)\b)?|\b(?:mini|small|sml|sm|medium|med|large|lrg|lg|family|party|personal|regular|deluxe)\b|\b\d+\s*(?:slices?|pieces?|pcs?|cuts?)\b'),
  lambda t: regexp_matches(t, '["”°]') OR NOT regexp_matches(lower(t), 'slice|cut')) AS found, list_filter(list_transform(regexp_extract_all(coalesce(line, ''), '\$?\b(\d{{1,3}}\.\d{{2}})\b', 1), lambda p: CAST(round(CAST(p AS DOUBLE) * 100) AS BIGINT)), lambda c: c > 0) AS cents FROM x),
c AS (SELECT pos, cents, list_transform(found, lambda t: CASE WHEN regexp_matches(t, '["”°]') THEN regexp_extract(t, '^\d+') || '"' || CASE WHEN regexp_matches(t, '[a-zA-Z]$') THEN ' ' || {_SIZE("regexp_extract(t, '[a-zA-Z]+$')")} ELSE '' END WHEN regexp_matches(t, '^\d') THEN regexp_extract(t, '^\d+') || 'pc' ELSE {_SIZE('t')} END) AS cols FROM h)
SELECT pos, len(cols) AS n_columns, array_to_string(cols, '|') AS columns, CASE WHEN len(cents) < 2 OR len(cents) > len(cols) THEN '' ELSE array_to_string(list_transform(range(1, len(cents) + 1), lambda i: cols[i + len(cols) - len(cents)] || '=' || cents[i]), '|') END AS variants,
  CASE WHEN len(cents) >= 2 AND len(cents) = len(cols) THEN 'high' WHEN len(cents) >= 2 AND len(cents) < len(cols) THEN 'medium' ELSE 'unknown' END AS tier FROM c""")
def size_header_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.transform(P.line_prices(F.col("line")), lambda p: F.round(p * 100).cast("bigint"))
    rows = _part(spark, sf_dir, header=_GRIDS, line=_PRICED).select("pos", G.size_columns(F.col("header")).alias("cols"), cents.alias("cents"))
    rows = rows.select("pos", "cols", G.grid_variants(F.col("cols"), F.col("cents")).alias("placed"))
    told = F.array_join(F.transform("placed", lambda v: F.concat(v["label"], F.lit("="), v["price_cents"].cast("string"))), "|")
    sure = F.coalesce(F.try_element_at("placed", F.lit(1))["confidence"], F.lit(0.0))
    return rows.select("pos", F.size("cols").cast("bigint").alias("n_columns"), F.array_join("cols", "|").alias("columns"), told.alias("variants"), G.tier(sure).alias("tier"))


_TITLES = [
    "{n} Soooo good....", "Calzones Stuffed With ricotta, mozzarella and sauce, plus many other long things to make this name really long", "{n} (ham, pineapple, mozzarella)", "MEAT LOVERS PIZZA WITH PEPPERONI SAUSAGE BACON HAM AND A LOT OF THINGS MORE {n}",
    "House Pizza - a long list of toppings that goes on and on and on for everyone who likes {n}", "one two three four five six and seven nine ten eleven twelve {n}", "Big Pizza topped with ham and much more ham and yet more ham on every day of the week {n}", None, "", "Bob's NY BBQ ## {n}!!", "x (ab)",
    "Two Piece Dinner: the best there is of all the things that we have ever made for you {n}", "Garlic Knots .... {p} || x",
]
_TEXTS = ["a, b ham w/ cheese & and olives, x with", "SERVED WITH FRIES AND COLESLAW", "fries on the side and", None, "", "*** ~~ ]] a b", "short", "ham ,, cheese and/or bacon, or or onion with and", "{n} w, sauce , {p} for the", "Eb Ss Qq aa bb ham", "AMPLE BBQ NY 12 lg x y"]


def _marks(c: str) -> str:
    burst = lambda t: f"regexp_replace({t}, '([\\p{{L}}\\p{{N}}_])[^\\p{{L}}\\p{{N}}_\\s]+([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
    return f"trim(regexp_replace({burst(burst(f"""regexp_replace(regexp_replace(regexp_replace({c}, '\\.{{2,}}\\s*', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s$.,&()/+''-]{{2,}}', ' ', 'g'), '\\|{{2,}}', ' ', 'g')"""))}, '\\s+', ' ', 'g'))"


def _runs(c: str) -> str:
    return f"array_to_string(list_transform(range(1, length({c}) + 1), lambda i: CASE WHEN i > 2 AND {c}[i] = {c}[i - 1] AND {c}[i] = {c}[i - 2] THEN '' ELSE {c}[i] END), '')"


def _count(c: str) -> str:
    return f"len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"


_ENOUGH = f"{_count('head')} >= 2 AND {_count('tail')} >= 3"
_MARKS = " UNION ALL ".join(f"SELECT pos, {i} AS step, trim(n[1:strpos(n, '{s}') - 1], ' -–—:·•') AS head, trim(substr(n, strpos(n, '{s}') + {len(s)})) AS tail, true AS turn, strpos(n, '{s}') > 1 AS ok FROM c" for i, s in enumerate([" - ", " — ", " – ", ":", " • ", " · "]))


@query(rf"""WITH {_sql(name=_TITLES, line=_TEXTS)}, a AS (SELECT pos, trim(coalesce(name, '')) AS raw_name, trim(coalesce(line, '')) AS raw FROM x), r AS (SELECT *, {_runs('raw_name')} AS ran FROM a),
b AS (SELECT *, trim(regexp_replace({_marks('ran')}, '[^\p{{L}}\p{{N}}_)\]]+$', '')) AS bare FROM r),
c AS (SELECT *, array_to_string(list_transform(string_split(bare, ' '), lambda t: CASE WHEN length(t) <= 2 OR (t = upper(t) AND t <> lower(t)) THEN t ELSE upper(t[1]) || lower(t[2:]) END), ' ') AS n FROM b),
o AS ({_MARKS}
  UNION ALL SELECT pos, 6, trim(regexp_extract(n, '(?i)^(.*?)\b(topped with|served with|comes with|made with|includes|featuring)\b', 1)), trim(substr(n, length(regexp_extract(n, '(?i)^(.*?)\b(topped with|served with|comes with|made with|includes|featuring)\b', 1)) + 1)), false, regexp_matches(n, '(?i)\b(topped with|served with|comes with|made with|includes|featuring)\b') FROM c
  UNION ALL SELECT pos, 7, trim(regexp_extract(n, '(?i)^(.*?)\bwith\b', 1)), trim(substr(n, length(regexp_extract(n, '(?i)^(.*?)\bwith\b', 1)) + 1)), false, regexp_matches(n, '(?i)\bwith\b') FROM c
  UNION ALL SELECT pos, 8, trim(n[1:strpos(n, ', ') - 1], ', '), trim(substr(n, strpos(n, ', ') + 2)), true, strpos(n, ', ') > 11 AND strpos(n, ', ') - 1 < length(n) - 10 FROM c),
p AS (SELECT pos, step, head, tail, turn FROM o WHERE ok AND {_ENOUGH} UNION ALL SELECT pos, 9, array_to_string(w[1:least(6, len(w) - 3)], ' '), array_to_string(w[least(6, len(w) - 3) + 1:], ' '), true FROM (SELECT pos, string_split(n, ' ') AS w FROM c) WHERE len(w) >= 8),
q AS (SELECT pos, arg_min(struct_pack(head := CASE WHEN turn THEN regexp_replace(head, '(?i)\s(with|and|or|on|in)$', '') ELSE head END, tail := CASE WHEN turn AND regexp_matches(head, '(?i)\s(with|and|or|on|in)$') THEN regexp_extract(head, '\S+$') || ' ' ELSE '' END || tail), step) AS best FROM p GROUP BY 1),
s AS (SELECT c.*, best, regexp_extract(n, '\s*\(([^)]{{5,}})\)\s*') AS whole_bracket, trim(regexp_extract(n, '\s*\(([^)]{{5,}})\)\s*', 1)) AS inside FROM c LEFT JOIN q ON q.pos = c.pos),
t AS (SELECT *, trim(replace(n, whole_bracket, ' ')) AS outside FROM s),
u AS (SELECT *, CASE WHEN length(raw) >= 10 THEN struct_pack(head := n, tail := '') WHEN whole_bracket <> '' AND outside <> '' AND {_count('inside')} >= 2 THEN struct_pack(head := outside, tail := inside) WHEN (length(n) >= 80 OR {_count('n')} >= 12) AND best IS NOT NULL THEN best ELSE struct_pack(head := n, tail := '') END AS split FROM t),
v AS (SELECT pos, raw_name, n, split.head AS head, split.tail AS tail, trim(raw || ' ' || split.tail) AS whole FROM u), v2 AS (SELECT *, {_runs('whole')} AS ran FROM v),
d1 AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace({_marks('ran')}, '\s*,\s*', ', ', 'g'), ',\s*,+', ', ', 'g'), '\s+', ' ', 'g')) AS d FROM v2),
d2 AS (SELECT * REPLACE (regexp_replace(regexp_replace(d, '(?i)\s(with|and|or|on|in)$', ''), '((^| )\p{{L}})+$', '') AS d) FROM d1),
d3 AS (SELECT * REPLACE (array_to_string(list_filter(string_split_regex(d, '\s+'), lambda w: trim(w, ',.;:/!?)(') <> '' AND (lower(trim(w, ',.;:/!?)(')) IN ('bbq', 'blt', 'ny', 'nyc', 'sm', 'lg', 'xl', 'oz', 'jr', 'md', 'w/', 'w', '&', 'and', 'or') OR regexp_full_match(trim(w, ',.;:/!?)('), '\d+') OR length(trim(w, ',.;:/!?)(')) > 2)), ' ') AS d) FROM d2),
d4 AS (SELECT * REPLACE (trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(d, '(?i)\bw/\s*', 'with ', 'g'), '(?i)\bw[.,]\s+', 'with ', 'g'), '(?i)\bw\b', 'with', 'g'), '\s+', ' ', 'g')) AS d) FROM d3),
d5 AS (SELECT * REPLACE (array_to_string(list_filter(string_split(d, ' '), lambda w: regexp_matches(w, '[A-Za-z0-9]')), ' ') AS d) FROM d4),
d6 AS (SELECT * REPLACE (CASE WHEN length(regexp_replace(d, '[^\p{{L}}]', '', 'g')) >= 10 AND length(regexp_replace(d, '[^\p{{Lu}}]', '', 'g')) / length(regexp_replace(d, '[^\p{{L}}]', '', 'g')) > 0.8 THEN upper(d[1]) || lower(d[2:]) ELSE d END AS d) FROM d5),
d7 AS (SELECT * REPLACE (CASE WHEN regexp_matches(lower(d), '\b(on\s+side|the\s+side|the\s+sid\b)') THEN d ELSE trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(d, '(?i)\band\s*/\s*or\b|\bor\s*/\s*and\b', 'or', 'g'), '(?i)\b(and|or|&)\s+(and|or|&)\b', '\1', 'g'), '(?i),\s+(and|or|&)\b', ' \1', 'g'), '(?i)\b(with|and|or|&|on the|for the)\b[\s.,;:!]*$', ''), '\s+', ' ', 'g')) END AS d) FROM d6),
e AS (SELECT *, CASE WHEN whole = '' THEN 0.0 ELSE len(list_filter(string_split_regex(d, '\s+'), lambda w: w <> '' AND contains(lower(whole), lower(w)))) / greatest({_count('whole')}, 1) END AS saved FROM d7)
SELECT pos, n AS title, CASE WHEN head <> '' THEN head ELSE raw_name END AS name, CASE WHEN whole = '' AND d = '' THEN '' WHEN saved < 0.2 AND {_count('d')} <= 3 THEN '[AI Cleaned]' WHEN saved < 0.5 AND NOT starts_with(d, '[AI Cleaned]') THEN trim('[AI Cleaned] ' || d) ELSE d END AS description FROM e""")
def item_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir, name=_TITLES, line=_TEXTS).withColumn("title", R.item_name(F.trim(F.coalesce("name", F.lit("")))))
    return cleaning.cleaned_items(rows, "name", "line").select("pos", "title", "name", F.col("line").alias("description"))
