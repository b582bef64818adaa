"""Event rates: success ratios, sliding counts, admission under a rate limit, tumbling and session windows."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def success_ratio(events: DataFrame, keys: Sequence[str], ok: str) -> DataFrame:
    out = events.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.expr(ok).cast("long")).alias("n_ok"))
    return out.withColumn("ratio", F.col("n_ok") / F.col("n")).withColumn("healthy", F.col("ratio") >= 0.60)


def sliding_counts(events: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """Each event with the number of its key's events in the seconds up to it, itself included."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("n_window", F.count("*").over(w))


def admitted(events: DataFrame, key: str, ts: str, order: str, limit: int, seconds: int = 60) -> DataFrame:
    """Each event with whether a limit per sliding window admits it; only admitted ones count.

    The state is a key's last limit admissions. A key's events come in Arrow batches in order, so a hot key streams
    through one task with that small state instead of being gathered."""
    schema = events.select(key, order).schema.add("admitted", "boolean")
    rows = events.select(key, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t")).repartition(key).sortWithinPartitions(key, "_t", order)

    def run(batches):
        now, recent = None, []
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch["_t"]):
                if k != now:
                    now, recent = k, []
                recent = [x for x in recent if x > t - seconds * 1_000_000]
                out.append(len(recent) < limit)
                if out[-1]:
                    recent.append(t)
            yield pd.DataFrame({key: batch[key], order: batch[order], "admitted": out})

    return rows.mapInPandas(run, schema)


def tumbling(events: DataFrame, keys: Sequence[str], ts: str, width: str) -> DataFrame:
    w = F.window(ts, width)
    return events.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*keys, F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    w = F.session_window(ts, gap)
    return events.groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
