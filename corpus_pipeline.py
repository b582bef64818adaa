"""A training corpus from ``documents``: language, near-duplicates, benchmark leaks, personal data, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and reread as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carteframe.llm import bpe, decontaminate, langid, minhash, pii
from carteframe.llm.common import shared_dir, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language; texts that are null or have no letter go, and so do those whose score is 0
    because none of their n-grams is known. A text shorter than one n-gram can't be judged and stays if it has a letter."""
    learned_from = docs.where((F.crc32(F.col("doc_id").cast("string")) % 3 != 1) & F.col("lang").isNotNull())
    judged = langid.predict(docs, langid.fit(learned_from), docs.columns, pred_col="_lang_pred", score_col="_lang_score")
    known = (F.col("_lang_score") > 0) | (F.octet_length("text") < langid.GRAM)
    return judged.where((F.col("_lang_pred") != langid.UNKNOWN) & known).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of near-duplicates."""
    return minhash.deduplicate(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether the ids decode to the text."""
    coded = bpe.round_trip(docs.select("doc_id", "text"), TOKENIZER)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("exact"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("personal_data", personal_data), ("tokens", tokens)]

#: No stage but the windows of the third has a form in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
