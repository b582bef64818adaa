"""Semantic scores, tiers, roll-ups, repairs, the gate and its calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats

#: Weights of grammar, name, price, variants and flags.
WEIGHTS = (0.30, 0.20, 0.20, 0.15, 0.15)
#: Least score of each tier; shares of high items for grades.
TIERS = (("high", 0.80), ("medium", 0.60), ("low", 0.40))
GRADES = (("A", 0.80), ("B", 0.60), ("C", 0.40))
#: Penalties of a flag by severity.
PENALTIES = {"warn": 0.15, "info": 0.05, "auto_fix": 0.02}
#: Gate weights of items' mean, two calls and item count; threshold.
GATE_WEIGHTS, GATE = (0.50, 0.25, 0.15, 0.10), 0.90


#: Letters that garbled readings favour.
GARBLE_LETTERS = "secrnotvw"


def is_garbled(name: Column) -> Column:
    """Two of: a character three times in a row, mostly garble letters, few different letters; names under four letters aren't."""
    letters = F.lower(F.regexp_replace(name, "[^A-Za-z]", ""))
    n = F.length(letters)
    likely = F.length(F.regexp_replace(letters, f"[^{GARBLE_LETTERS}]", ""))
    distinct = F.size(F.array_distinct(F.filter(F.split(letters, ""), lambda c: c != "")))
    signals = name.rlike(r"(.)\1{2}").cast("int") + (likely / F.greatest(n, F.lit(1)) >= 0.60).cast("int") + (distinct / F.greatest(n, F.lit(1)) <= 0.40).cast("int")
    return (n >= 4) & (signals >= 2)


def name_score(name: Column) -> Column:
    """The lowest of length, garble and capitals scores."""
    length = F.length(F.trim(F.coalesce(name, F.lit(""))))
    caps = (name == F.upper(name)) & (length > 2)
    return F.when(length == 0, 0.1).otherwise(F.least(F.when(length < 3, 0.3).when(length < 6, 0.6).otherwise(1.0), F.when(is_garbled(name), 0.2).otherwise(1.0), F.when(caps, 0.9).otherwise(1.0)))


def flag_penalty(warns: Column, infos: Column, fixes: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - (PENALTIES["warn"] * warns + PENALTIES["info"] * infos + PENALTIES["auto_fix"] * fixes))


def semantic(grammar: Column, name: Column, price: Column, variants: Column, flags: Column) -> Column:
    """Weighted sum of five signals, rounded to 4 places, within 0 and 1; missing grammar and variants count 0.5."""
    parts = (F.coalesce(grammar, F.lit(0.5)), name_score(name), F.when(F.coalesce(price, F.lit(0)) > 0, 1.0).otherwise(0.3), F.coalesce(variants, F.lit(0.5)), flags)
    total = sum((w * p for w, p in zip(WEIGHTS[1:], parts[1:])), WEIGHTS[0] * parts[0])
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(total, 4)))


def tier(score: Column) -> Column:
    out = F.when(score >= TIERS[0][1], TIERS[0][0])
    for name, least in TIERS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("reject")


def grade(share: Column) -> Column:
    out = F.when(share >= GRADES[0][1], GRADES[0][0])
    for name, least in GRADES[1:]:
        out = out.when(share >= least, name)
    return out.otherwise("D")


def summary(scored: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Per group: n, mean, median, sample deviation (0 under two), tier counts, items to review, grade by share of high ones."""
    kind = tier(F.col(score))
    count = lambda c: F.sum(c.cast("long"))
    base = scored.groupBy(*keys).agg(
        F.avg(score).alias("mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("stdev"),
        count(kind == "high").alias("n_high"), count(kind == "medium").alias("n_medium"), count(kind == "low").alias("n_low"), count(kind == "reject").alias("n_reject"),
    )
    middle = stats.medians(scored, keys, score)
    out = base.join(middle, list(keys)) if keys else base.crossJoin(middle)
    return out.withColumn("needs_review", F.col("n_low") + F.col("n_reject")).withColumn("grade", grade(F.col("n_high") / F.col("n")))


def category_health(scored: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Per category n, mean, share to review, grade of the mean, worst first by rank."""
    low = (F.col(score) < TIERS[1][1]).cast("long")
    out = scored.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), (F.sum(low) / F.count("*")).alias("review_share"))
    return out.withColumn("grade", grade(F.col("mean")))


def digest(flags: DataFrame, reason: str, position: str, top: int = 8) -> DataFrame:
    """The most frequent reasons with their shares, of equals the first seen first."""
    counts = flags.groupBy(reason).agg(F.count("*").alias("n"), F.min(position).alias("_first"))
    total = counts.agg(F.sum("n").alias("_total"))
    best = counts.orderBy(F.desc("n"), "_first").limit(top)
    return best.join(F.broadcast(total)).select(reason, "n", (F.col("n") / F.col("_total")).alias("share"))


def repairs(scored: DataFrame, score: str = "score") -> DataFrame:
    """One row per recommendation: type and priority (1 reject, 2 low, 3 medium), whether it can be applied by itself."""
    kind = tier(F.col(score))
    priority = F.when(kind == "reject", 1).when(kind == "low", 2).when(kind == "medium", 3)
    name, trimmed = F.col("name"), F.trim(F.coalesce(F.col("name"), F.lit("")))
    made = F.array(
        F.when(trimmed == "", F.struct(F.lit("name_missing").alias("type"), F.lit(False).alias("auto"))),
        F.when((trimmed != "") & (F.length(trimmed) < 3), F.struct(F.lit("name_short").alias("type"), F.lit(False).alias("auto"))),
        F.when((F.length(trimmed) > 2) & (name == F.upper(name)), F.struct(F.lit("name_all_caps").alias("type"), F.lit(True).alias("auto"))),
        F.when(F.coalesce(F.col("price_cents"), F.lit(0)) <= 0, F.struct(F.lit("price_missing").alias("type"), F.lit(False).alias("auto"))),
        F.when(F.col("warns") > 0, F.struct(F.lit("review_flags").alias("type"), F.lit(False).alias("auto"))),
    )
    out = scored.withColumn("priority", priority).where("priority is not null")
    return out.withColumn("_r", F.explode(F.filter(made, lambda r: r.isNotNull()))).withColumn("type", F.col("_r.type")).withColumn("auto", F.col("_r.auto")).drop("_r")


def count_score(n: Column) -> Column:
    """1.0 from 10 items, 0.8 from 5, 0.6 from 3, 0.3 from 1, else 0."""
    return F.when(n >= 10, 1.0).when(n >= 5, 0.8).when(n >= 3, 0.6).when(n >= 1, 0.3).otherwise(0.0)


def gate(runs: DataFrame, mean: str = "mean", n: str = "n", call2: str = "call2", call3: str = "call3", threshold: float = GATE) -> DataFrame:
    """score and passed of each run; the weight of a call that is NULL goes to the items' mean."""
    base, w2, w3, wn = GATE_WEIGHTS
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    has2, has3 = F.col(call2).isNotNull(), F.col(call3).isNotNull()
    weight = F.lit(base) + F.when(has2, 0.0).otherwise(w2) + F.when(has3, 0.0).otherwise(w3)
    score = F.coalesce(F.col(mean), F.lit(0.0)) * weight + F.when(has2, clip(F.col(call2)) * w2).otherwise(0.0) + F.when(has3, clip(F.col(call3)) * w3).otherwise(0.0) + count_score(F.col(n)) * wn
    return runs.withColumn("score", clip(F.round(score, 4))).withColumn("passed", F.col("score") >= threshold)


def sweep(scores: DataFrame, low: int = 50, high: int = 99, step: int = 5) -> DataFrame:
    """Passes and fails at thresholds of low to high hundredths: one histogram, whose few bins meet each threshold."""
    bins = scores.groupBy(F.floor(F.round(F.col("score") * 10000) / 100).cast("int").alias("bin")).agg(F.count("*").alias("c"))
    joined = bins.withColumn("threshold", F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step))))
    return joined.groupBy("threshold").agg(F.sum(F.when(F.col("bin") >= F.col("threshold"), F.col("c")).otherwise(0)).alias("n_pass"), F.sum(F.when(F.col("bin") < F.col("threshold"), F.col("c")).otherwise(0)).alias("n_fail"))


def signal_contribution(runs: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Per signal: runs that have it, mean, least and highest."""
    stacked = runs.select(F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("raw")) for s in signals))).alias("s")).select("s.*").where("raw is not null")
    return stacked.groupBy("signal").agg(F.count("*").alias("n"), F.avg("raw").alias("mean"), F.min("raw").alias("low"), F.max("raw").alias("high"))


def calibration(scores: DataFrame, threshold: float = GATE, margin: float = 0.05) -> DataFrame:
    """One row: runs, passes, marginal ones (within margin, ends included), mean, least, highest score."""
    s = F.col("score")
    return scores.agg(
        F.count("*").alias("n"), F.sum((s >= threshold).cast("long")).alias("n_pass"), F.sum((F.round(F.abs(s - threshold), 6) <= margin).cast("long")).alias("n_marginal"),
        F.avg("score").alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"),
    )


def step_metrics(steps: DataFrame, run: Sequence[str]) -> DataFrame:
    """Per run: steps, failures, total time and the slowest successful step (the first of equals)."""
    good = F.col("status") == "success"
    return steps.groupBy(*run).agg(F.count("*").alias("n_steps"), F.sum((~good).cast("long")).alias("n_failed"), F.sum("ms").alias("total_ms"), F.max_by("step", F.when(good, F.struct("ms", -F.col("order")))).alias("bottleneck"))
