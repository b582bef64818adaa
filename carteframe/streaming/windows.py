"""Streams of events: watermarked windows, duplicates, and admission under a rate limit with kept state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, keys: Sequence[str], ts: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and totals per window; rows later than the watermark are left out."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = events.withWatermark(ts, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total")


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def once(events: DataFrame, id_col: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """The first of each id within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_col])


def admitted(events: DataFrame, key: str, ts: str, order: str, limit: int, seconds: int = 60) -> DataFrame:
    """Each event with whether the sliding limit admits it; a key's state is its last admissions, limit at most."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values([ts, order])
        out = []
        for at in rows[ts].astype("datetime64[us]").astype("int64"):
            recent = [x for x in recent if x > at - seconds * 1_000_000]
            out.append(len(recent) < limit)
            if out[-1]:
                recent.append(at)
        state.update((recent,))
        yield pd.DataFrame({key: keys[0], order: rows[order].to_numpy(), "admitted": out})

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, admitted boolean"
    return events.groupBy(key).applyInPandasWithState(run, schema, "recent array<bigint>", "append", GroupStateTimeout.NoTimeout)
