"""Sharding by rendezvous hashing over weighted shards, in built-in functions only.

A record goes to the shard with the highest -weight / ln(u), u a hash of its key and the shard. One more shard can only
win records over, so nothing moves between old shards.

Defined cases: a null key has one shard like any other; rows with equal keys share a shard; a null text has size 1 and
checksum 0; an empty table stays empty; other columns are ignored by ``assign`` and kept by ``write_shards``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Rows whose slots one window counts, about.
RUN_ROWS = 20_000
#: Runs of each shard, at least.
LEAST_RUNS = 64


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard of a key; weights: one for each shard, over 0."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight over 0")

    def score(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(shard).alias("shard"))

    return F.array_max(F.array(*(score(i, w) for i, w in enumerate(weights))))["shard"]


def assign(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, more: float = 1.0, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key_col, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (with a shard of weight more added)."""
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.col(key_col)
    rows = docs.select(key.alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), shard_of(key, weights).alias("shard"), shard_of(key, [*weights, more]).alias("grown_shard"), F.monotonically_increasing_id().alias("row"))
    # written once, so that counts and slots see the same row numbers even if tasks are run again
    rows = materialize(rows, "shards")
    runs = max(LEAST_RUNS, -(-rows.count() // (RUN_ROWS * len(weights))))
    rows = rows.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(runs)))
    counts = rows.groupBy("shard", "run").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    offsets = materialize(counts.select(F.col("shard").alias("_shard"), F.col("run").alias("_run"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset")), "offsets")
    inside = F.row_number().over(W.partitionBy("shard", "run").orderBy("row")) - 1
    numbered = rows.withColumn("inside", inside).join(offsets, (F.col("shard") == F.col("_shard")) & (F.col("run") == F.col("_run")))
    return numbered.select(F.col("key").alias(key_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("inside")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * 8, key_col: str = "doc_id", file_rows: int = 100_000) -> None:
    """All columns of docs as Parquet, one folder for each shard; large shards get several files."""
    shard = next(n for n in ("shard", *(f"shard_{i}" for i in range(1000))) if n not in docs.columns)
    placed = docs.withColumn(shard, shard_of(F.col(key_col), weights))
    placed.write.option("maxRecordsPerFile", file_rows).partitionBy(shard).parquet(path)
