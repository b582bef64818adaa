"""Queries of text, layout, pages and event rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import rates
from ..operators import text as X
from ..sources import bindings as B
from .registry import query


@query("""SELECT doc_id, length(text) AS chars, len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '')) AS tokens, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[A-Za-z0-9 ]', '', 'g')) / length(text) ELSE 0 END, 4) AS symbol_ratio,
round(CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0 THEN length(regexp_replace(text, '[^A-Z]', '', 'g')) / length(regexp_replace(text, '[^A-Za-z]', '', 'g')) ELSE 0 END, 4) AS upper_ratio FROM documents""")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents")
    made = X.quality(F.col("text"))
    return docs.select("doc_id", "text").withColumns(made).select("doc_id", "chars", "tokens", F.round("symbol_ratio", 4).alias("symbol_ratio"), F.round("upper_ratio", 4).alias("upper_ratio"))


_MENU_WORD = " OR ".join(f"contains(lower(t), '{w}')" for w in X.MENU_WORDS)
_RUN = lambda n: f"regexp_matches(lower(t), '[bcdfghjklmnpqrstvwxz]{{{n + 1}}}')"


@query(rf"""WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM documents),
r AS (SELECT *, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(t, '[\p{{L}}\p{{N}} ]', '', 'g')) / greatest(length(t), 1) AS sr, regexp_matches(t, '\$?\d{{1,3}}(?:\.\d{{2}})') AS priced FROM l),
v AS (SELECT *, CASE WHEN letters > 0 THEN length(regexp_replace(lower(t), '[^aeiouy]', '', 'g')) / letters ELSE 0 END AS vr FROM r),
g AS (SELECT doc_id, CASE WHEN length(t) < 2 THEN true WHEN {_MENU_WORD} OR (priced AND letters > 0 AND length(t) >= 8) OR (letters > 0 AND contains(t, ' ') AND length(t) >= 15) THEN (sr > 0.85 AND vr < 0.10) OR {_RUN(10)}
  WHEN priced THEN vr < 0.12 OR {_RUN(8)} OR sr > 0.625 ELSE vr < 0.20 OR {_RUN(6)} OR sr > 0.50 END AS bad FROM v)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_garbage FROM g GROUP BY 1""")
def garbage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.lines(B.table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(X.is_garbage(F.col("line")).cast("long")).alias("n_garbage"))


@query()
def line_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.lines(B.table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("line_type", X.line_type(F.col("line")))
    return rows.groupBy("doc_id", "line_type").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM events)
SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM r GROUP BY user_id, event_type, island HAVING count(*) >= 2""")
def heading_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.runs(B.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id", "event_type")


@query("""WITH h AS (SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER w AS head, max(CASE WHEN turn % 4 = 3 THEN turn END) OVER w AS stop FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, CASE WHEN stop IS NULL OR head > stop THEN head END AS header_at FROM h""")
def size_grid_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return X.carried_header(rows, ["conv_id"], "turn", F.col("role") == "user", F.col("turn") % 4 == 3).select("conv_id", "turn", "header_at")


@query("""WITH e AS (SELECT user_id, event_id, event_type, event_type = 'view' AS header FROM events), s AS (SELECT *, last_value(CASE WHEN header THEN event_id END IGNORE NULLS) OVER w AS section, count(*) FILTER (WHERE header) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, section, row_number() OVER (PARTITION BY user_id, n ORDER BY event_id) AS in_section FROM s WHERE NOT header""")
def section_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return X.sections(rows, ["user_id"], "event_id", F.col("event_type") == "view", "event_id").select("user_id", "event_id", "section", F.col("in_section").cast("bigint").alias("in_section"))


@query("""WITH b AS (SELECT p_brand AS page, p_partkey AS box, p_size * 7 % 200 AS x, p_partkey % 300 * 3 AS y, 40 AS w, p_partkey % 4 = 0 AS price FROM part),
n AS (SELECT t.page, p.box AS price_box, t.box AS text_box, abs(p.y - t.y) AS off, abs(p.x - t.x - t.w) AS s FROM b t JOIN b p ON p.page = t.page AND p.price AND NOT t.price AND abs(p.y - t.y) <= 12 AND p.x - t.x - t.w BETWEEN -10 AND 150)
SELECT page, price_box, text_box, off FROM n QUALIFY row_number() OVER (PARTITION BY page, price_box ORDER BY off, s, text_box) = 1""")
def row_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    boxes = B.table(spark, sf_dir, "part").select(F.col("p_brand").alias("page"), key.alias("box"), (F.col("p_size") * 7 % 200).alias("x"), (key % 300 * 3).alias("y"), F.lit(40).alias("w"), (key % 4 == 0).alias("price"))
    return X.paired_prices(boxes.where("not price"), boxes.where("price"), ["page"])


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "pages").select("page_id", names.html_text(F.col("html")).alias("text"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value >= 5) AS n_ok, round(count(*) FILTER (WHERE value >= 5) / count(*), 6) AS ratio, count(*) FILTER (WHERE value >= 5) / count(*) >= 0.60 AS healthy FROM events GROUP BY 1")
def call_success_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.success_ratio(B.table(spark, sf_dir, "events"), ["event_type"], "value >= 5").withColumn("ratio", F.round("ratio", 6))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS n_window FROM events")
def sliding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.sliding_counts(B.table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 3600).drop("ts")


@query()
def rate_limit_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.admitted(B.table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", limit=2, seconds=36_000)


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    return rates.tumbling(rows, ["event_type"], "ts", "1 hour").withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return rates.sessions(rows, "user_id", "ts", "2 hours")


@query()
def category_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language; held_out marks the third that the model was not fitted on."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False)).alias("held_out"))
    model = X.Classifier.fit(docs.where("not held_out and lang is not null"), "text", "lang")
    return model.predict(docs, "text").select("doc_id", "lang", "predicted", (F.col("held_out") | F.col("lang").isNull()).alias("held_out"))


@query()
def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    words = B.table(spark, sf_dir, "part").select(F.col("p_brand").alias("page"), key.alias("word"), (F.col("p_size") * 7).alias("x"), (key % 300 * 3).alias("y"), F.lit(10).alias("h"))
    return X.group_words(words, ["page"], "page string, word long, x int, y long, h int, line int")
