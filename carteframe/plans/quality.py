"""Queries of scores, tiers, the gate and its calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources import bindings as B
from .registry import query

_TIER = lambda s: f"CASE WHEN {s} >= 0.80 THEN 'high' WHEN {s} >= 0.60 THEN 'medium' WHEN {s} >= 0.40 THEN 'low' ELSE 'reject' END"
_GRADE = lambda s: f"CASE WHEN {s} >= 0.80 THEN 'A' WHEN {s} >= 0.60 THEN 'B' WHEN {s} >= 0.40 THEN 'C' ELSE 'D' END"

#: Items with drawn signals: missing names and prices, flags, grammar and variant confidence.
_SIGNALS = B.ITEMS + """, g AS (SELECT menu_id, pos, category, CASE WHEN pos % 23 = 0 THEN '' WHEN pos % 29 = 0 THEN 'XY' WHEN pos % 31 = 0 THEN upper(name) ELSE name END AS name,
  CASE WHEN pos % 13 = 0 THEN 0 ELSE price_cents END AS price_cents, CASE WHEN pos % 5 <> 0 THEN (pos % 100) / 100.0::DOUBLE END AS grammar, CASE WHEN pos % 3 <> 0 THEN (pos % 50) / 50.0::DOUBLE END AS vconf,
  pos % 4 AS warns, pos % 3 AS infos, pos % 2 AS fixes FROM items),
c AS (SELECT *, length(trim(name)) AS len, lower(regexp_replace(name, '[^A-Za-z]', '', 'g')) AS letters FROM g),
q AS (SELECT *, CASE WHEN len = 0 THEN 0.1::DOUBLE ELSE least(CASE WHEN len < 3 THEN 0.3::DOUBLE WHEN len < 6 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END,
  CASE WHEN length(letters) >= 4 AND CAST(length(regexp_replace(letters, '[^secrnotvw]', '', 'g')) / length(letters) >= 0.60 AS INT) + CAST(len(list_distinct(string_split(letters, ''))) / length(letters) <= 0.40 AS INT) >= 2 THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END,
  CASE WHEN name = upper(name) AND len > 2 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END) END AS nscore, greatest(0.0::DOUBLE, 1.0::DOUBLE - (0.15::DOUBLE * warns + 0.05::DOUBLE * infos + 0.02::DOUBLE * fixes)) AS fscore FROM c),
scored AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, round(0.30::DOUBLE * coalesce(grammar, 0.5::DOUBLE) + 0.20::DOUBLE * nscore + 0.20::DOUBLE * CASE WHEN price_cents > 0 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END + 0.15::DOUBLE * coalesce(vconf, 0.5::DOUBLE) + 0.15::DOUBLE * fscore, 4))) AS score FROM q)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("pos")
    rows = B.items(spark, sf_dir).select(
        "menu_id", "pos", "category", F.when(pos % 23 == 0, "").when(pos % 29 == 0, "XY").when(pos % 31 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"), F.when(pos % 13 == 0, 0).otherwise(F.col("price_cents")).alias("price_cents"),
        F.when(pos % 5 != 0, (pos % 100) / 100.0).alias("grammar"), F.when(pos % 3 != 0, (pos % 50) / 50.0).alias("vconf"), (pos % 4).alias("warns"), (pos % 3).alias("infos"), (pos % 2).alias("fixes"),
    )
    return rows.withColumn("score", Q.semantic(F.col("grammar"), F.col("name"), F.col("price_cents"), F.col("vconf"), Q.flag_penalty(F.col("warns"), F.col("infos"), F.col("fixes"))))


@query(f"WITH {_SIGNALS} SELECT menu_id, pos, score, {_TIER('score')} AS tier, score < 0.60 AS needs_review FROM scored")
def semantic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("menu_id", "pos", "score", Q.tier(F.col("score")).alias("tier"), (F.col("score") < 0.60).alias("needs_review"))


@query("""WITH s AS (SELECT l_returnflag, 1 - l_discount * 8 AS score FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(stddev_samp(score), 6) AS stdev, count(*) FILTER (WHERE score >= 0.80) AS n_high, count(*) FILTER (WHERE score >= 0.60 AND score < 0.80) AS n_medium,
  count(*) FILTER (WHERE score >= 0.40 AND score < 0.60) AS n_low, count(*) FILTER (WHERE score < 0.40) AS n_reject, count(*) FILTER (WHERE score < 0.60) AS needs_review,
  CASE WHEN count(*) FILTER (WHERE score >= 0.80) / count(*) >= 0.80 THEN 'A' WHEN count(*) FILTER (WHERE score >= 0.80) / count(*) >= 0.60 THEN 'B' WHEN count(*) FILTER (WHERE score >= 0.80) / count(*) >= 0.40 THEN 'C' ELSE 'D' END AS grade FROM s GROUP BY 1""")
def confidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "lineitem").select("l_returnflag", (1 - F.col("l_discount") * 8).alias("score"))
    out = Q.summary(rows, ["l_returnflag"])
    return out.select("l_returnflag", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "stdev")), "n_high", "n_medium", "n_low", "n_reject", "needs_review", "grade")


@query("""WITH f AS (SELECT event_type AS reason, event_id FROM events), c AS (SELECT reason, count(*) AS n, min(event_id) AS first FROM f GROUP BY 1) SELECT reason, n, round(n / (SELECT sum(n) FROM c), 6) AS share FROM c ORDER BY n DESC, first LIMIT 4""")
def issue_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = B.table(spark, sf_dir, "events").select(F.col("event_type").alias("reason"), "event_id")
    return Q.digest(flags, "reason", "event_id", 4).withColumn("share", F.round("share", 6))


@query(f"WITH {_SIGNALS} SELECT menu_id, category, count(*) AS n, round(avg(score), 6) AS mean, round(count(*) FILTER (WHERE score < 0.60) / count(*), 6) AS review_share, {_GRADE('avg(score)')} AS grade FROM scored GROUP BY 1, 2")
def category_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.category_health(_scored(spark, sf_dir), ["menu_id", "category"]).select("menu_id", "category", "n", F.round("mean", 6).alias("mean"), F.round("review_share", 6).alias("review_share"), "grade")


@query(f"""WITH {_SIGNALS}, p AS (SELECT *, CASE WHEN score < 0.40 THEN 1 WHEN score < 0.60 THEN 2 WHEN score < 0.80 THEN 3 END AS priority FROM scored)
SELECT menu_id, pos, priority, type, auto FROM (SELECT menu_id, pos, priority, 'name_missing' AS type, false AS auto FROM p WHERE len = 0 UNION ALL SELECT menu_id, pos, priority, 'name_short', false FROM p WHERE len BETWEEN 1 AND 2
UNION ALL SELECT menu_id, pos, priority, 'name_all_caps', true FROM p WHERE len > 2 AND name = upper(name) UNION ALL SELECT menu_id, pos, priority, 'price_missing', false FROM p WHERE price_cents <= 0 UNION ALL SELECT menu_id, pos, priority, 'review_flags', false FROM p WHERE warns > 0) WHERE priority IS NOT NULL""")
def repair_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.repairs(_scored(spark, sf_dir)).select("menu_id", "pos", "priority", "type", "auto")


@query(f"""WITH {_SIGNALS} SELECT menu_id, count(*) AS n, round(count(grammar) / count(*), 6) AS grammar_share, round(count(*) FILTER (WHERE price_cents > 0) / count(*), 6) AS price_share, round(count(vconf) / count(*), 6) AS variant_share FROM scored GROUP BY 1""")
def pipeline_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c, name: F.round(F.count(c) / F.count("*"), 6).alias(name)
    return _scored(spark, sf_dir).groupBy("menu_id").agg(F.count("*").alias("n"), share("grammar", "grammar_share"), share(F.when(F.col("price_cents") > 0, 1), "price_share"), share("vconf", "variant_share"))


_RUNS = """runs AS (SELECT l_orderkey AS run, avg(1 - l_discount) AS mean, count(*) AS n, CASE WHEN l_orderkey % 3 <> 0 THEN 1 - max(l_tax) END AS call2, CASE WHEN l_orderkey % 4 = 0 THEN 1 - min(l_tax) END AS call3 FROM lineitem GROUP BY l_orderkey),
gated AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, round(mean * (0.50::DOUBLE + CASE WHEN call2 IS NULL THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN call3 IS NULL THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) + CASE WHEN call2 IS NULL THEN 0.0::DOUBLE ELSE call2 * 0.25::DOUBLE END + CASE WHEN call3 IS NULL THEN 0.0::DOUBLE ELSE call3 * 0.15::DOUBLE END
  + CASE WHEN n >= 10 THEN 1.0::DOUBLE WHEN n >= 5 THEN 0.8::DOUBLE WHEN n >= 3 THEN 0.6::DOUBLE WHEN n >= 1 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END * 0.10::DOUBLE, 4))) AS score FROM runs)"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey")
    rows = B.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg(1 - F.col("l_discount")).alias("mean"), F.count("*").alias("n"), (1 - F.max("l_tax")).alias("_c2"), (1 - F.min("l_tax")).alias("_c3"))
    runs = rows.select(key.alias("run"), "mean", "n", F.when(key % 3 != 0, F.col("_c2")).alias("call2"), F.when(key % 4 == 0, F.col("_c3")).alias("call3"))
    return Q.gate(runs)


@query(f"WITH {_RUNS} SELECT run, n, round(score, 2) AS score FROM gated")
def gate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("run", "n", F.round("score", 2).alias("score"))


@query(f"WITH {_RUNS}, t AS (SELECT unnest(range(50, 100, 5)) AS threshold), b AS (SELECT floor(round(round(score, 2) * 10000) / 100) AS bin FROM gated) SELECT CAST(threshold AS INT) AS threshold, count(*) FILTER (WHERE bin >= threshold) AS n_pass, count(*) FILTER (WHERE bin < threshold) AS n_fail FROM t, b GROUP BY 1")
def gate_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.sweep(_gated(spark, sf_dir).withColumn("score", F.round("score", 2)))


@query(f"""WITH {_RUNS}, s AS (SELECT 'mean' AS signal, mean AS raw FROM runs UNION ALL SELECT 'call2', call2 FROM runs UNION ALL SELECT 'call3', call3 FROM runs)
SELECT signal, count(raw) AS n, round(avg(raw), 6) AS mean, round(min(raw), 6) AS low, round(max(raw), 6) AS high FROM s WHERE raw IS NOT NULL GROUP BY 1""")
def signal_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.signal_contribution(_gated(spark, sf_dir), ["mean", "call2", "call3"])
    return out.select("signal", "n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@query(f"WITH {_RUNS}, r AS (SELECT round(score, 2) AS score FROM gated) SELECT count(*) AS n, count(*) FILTER (WHERE score >= 0.90) AS n_pass, count(*) FILTER (WHERE round(abs(score - 0.90), 6) <= 0.05) AS n_marginal, round(avg(score), 6) AS mean, min(score) AS low, max(score) AS high FROM r")
def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.calibration(_gated(spark, sf_dir).withColumn("score", F.round("score", 2))).withColumn("mean", F.round("mean", 6))


@query("""WITH s AS (SELECT user_id AS run, event_type AS step, event_id AS ord, CAST(round(value * 100) AS BIGINT) AS ms, CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'success' END AS status FROM events)
SELECT run, count(*) AS n_steps, count(*) FILTER (WHERE status <> 'success') AS n_failed, CAST(sum(ms) AS BIGINT) AS total_ms, arg_max(CASE WHEN status = 'success' THEN step END, CASE WHEN status = 'success' THEN ms * 100000000 - ord END) AS bottleneck FROM s GROUP BY 1""")
def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    steps = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("step"), key.alias("order"), F.round(F.col("value") * 100).cast("bigint").alias("ms"), F.when(key % 7 == 0, "failed").otherwise("success").alias("status"))
    return Q.step_metrics(steps, ["run"])
