"""The registered queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html, langid, minhash, pii, quality, sharding, substring, warc
from .common import materialize, shared_dir, table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.components_of(table(spark, sf_dir, "documents"), similarity=85)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    filters = langid.fit(docs.where("not held_out and doc_id is not null"))
    return langid.predict(docs, filters, ["doc_id", "held_out"])


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = pii.ordered(F.concat("pii.base", "pii.added"))
    return found.select("doc_id", *(count(k) for k in pii.KINDS), F.sha2(pii.digest(pii.ordered(F.col("pii.base"))), 256).alias("base_sha256"), pii.digest(every).alias("spans"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(quality.statistics(table(spark, sf_dir, "documents")), "quality")
    return quality.judge(stats, quality.fit(stats, table(spark, sf_dir, "labels"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_archives(spark, path, payloads=False))
    size = F.coalesce("response.payload_bytes", "metadata.payload_bytes")
    digest = F.when(F.coalesce("response.verified", F.lit(True)), F.col("response.digest")).otherwise(F.raise_error(F.lit("a payload doesn't have its record's digest")).cast("string"))
    return captures.select("metadata.page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), F.col("response.type").alias("record_type"), "metadata.refers_to")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracles() -> dict[str, str]:
    from .oracle import ORACLES

    return dict(ORACLES)
