"""Competitor prices: matching anchors, ranges, assessments, summaries, nearby places."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats

#: Share and least cents of the price bands, tried in order until enough anchors match; most sources shown.
BANDS, ENOUGH, LEAST, SOURCES = ((0.30, 300), (0.50, 500), (1.00, 800)), 3, 2, 8
#: Distinct anchor prices, about, up to which all of them are sent to every task, some two bytes each as sent and 16 in a task; a key counts as KEY prices.
SENT, KEY = 1 << 20, 1 << 10


def clusters(items: DataFrame, keys: Sequence[str] = ("category", "price_cents")) -> DataFrame:
    """Items of one category and price share a range; one row per cluster of any size."""
    return items.where("price_cents > 0 and category is not null").groupBy(*keys).agg(F.count("*").alias("n_items"), F.min("pos").alias("first_pos"))


def price_tiers(anchors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Anchors counted per distinct price, so that a cluster meets each price once however many places charge it."""
    return anchors.where("price_cents > 0").groupBy(*keys, F.col("price_cents").alias("anchor_price")).agg(F.count("*").alias("c"))


def ranges(own: DataFrame, anchors: DataFrame, keys: Sequence[str] = ("category",)) -> DataFrame:
    """Per cluster (keys and price_cents over 0): band used, matches, low, high and upper median of the matching anchors.

    Anchors match in the narrowest band that holds three; under two in the widest there is no range. A cluster meets no
    anchors: running counts of the anchors' prices are looked up at the ends of its bands, then prices at three ranks."""
    price, cluster = F.col("price_cents"), [*keys, "price_cents"]
    tiers = stats.running_sums(price_tiers(anchors, keys), keys, "anchor_price", "c", "before")
    reach = [F.greatest(F.floor(price * share), F.lit(cents)) for share, cents in BANDS]
    ends = F.array(*(F.struct(F.lit(name).alias("end"), at.alias("anchor_price")) for k, r in enumerate(reach) for name, at in ((f"from{k}", price - r - 1), (f"to{k}", price + r))))
    asked = own.where(price > 0).select(*cluster).distinct().select(*cluster, F.inline(ends))
    counts = stats.as_of(tiers.withColumn("n", F.col("before") + F.col("c")), asked.where("anchor_price > 0"), keys, "anchor_price", "n")
    at = lambda name: F.coalesce(F.max(F.when(F.col("end") == name, F.col("n"))), F.lit(0)).alias(name)
    counted = asked.join(counts, [*keys, "anchor_price"]).groupBy(*cluster).agg(*(at(f"{side}{k}") for k in range(len(BANDS)) for side in ("from", "to")))
    within = [F.col(f"to{k}") - F.col(f"from{k}") for k in range(len(BANDS))]
    band = F.when(within[0] >= ENOUGH, 0).when(within[1] >= ENOUGH, 1).otherwise(2)
    pick = lambda found: F.when(F.col("band") == 0, found[0]).when(F.col("band") == 1, found[1]).otherwise(found[2])
    chosen = counted.withColumn("band", band).select(*cluster, "band", pick(within).alias("n"), pick([F.col(f"from{k}") for k in range(len(BANDS))]).alias("first")).where(F.col("n") >= LEAST)
    # the upper median is at n div 2 of the matches, the first of which has as many anchors before it as the band's start
    ranks = {"low": F.col("first"), "high": F.col("first") + F.col("n") - 1, "median": F.col("first") + F.floor(F.col("n") / 2)}
    wanted = chosen.select(*cluster, "band", "n", F.inline(F.array(*(F.struct(F.lit(name).alias("pick"), rank.alias("before")) for name, rank in ranks.items()))))
    prices = stats.as_of(tiers, wanted, keys, "before", "anchor_price")
    return wanted.join(prices, [*keys, "before"]).groupBy(*cluster, "band", "n").agg(*(F.max(F.when(F.col("pick") == name, F.col("anchor_price"))).alias(name) for name in ranks))


def with_ranges(own: DataFrame, anchors: DataFrame, keys: Sequence[str] = ("category",), most: int = SENT) -> DataFrame:
    """Own rows (price_cents bigint) that have a range, with its band, n, low, high and median as in ranges.

    While the anchors have some most distinct prices (estimated) or fewer in few keys, every task gets them with their counts and looks
    its own rows up, so that no own row is exchanged; if they have more, own rows are joined to the ranges. The rows are the same."""
    told = [F.col(name) for name in ("band", "n", "low", "high", "median")]
    priced = anchors.where("price_cents > 0")
    n_prices, n_keys = priced.agg(*(F.approx_count_distinct(F.struct(*keys, *more)) for more in (["price_cents"], []))).first()
    if n_prices + KEY * n_keys > most:
        return own.join(ranges(own, anchors, keys), [*keys, "price_cents"]).select(*own.columns, *told)
    tiers = price_tiers(priced.dropna(subset=list(keys)), keys).toArrow().sort_by([("anchor_price", "ascending")])
    schema = T.StructType([*own.schema.fields, T.StructField("band", T.IntegerType()), *(T.StructField(name, T.LongType()) for name in ("n", "low", "high", "median"))])
    return own.where("price_cents > 0").mapInArrow(_looked_up(_packed(tiers, keys), keys), schema)


def _by_key(columns: Sequence[pa.Array], n: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """The values of the columns that occur in n rows, and the numbers of their rows in order."""
    code = np.zeros(n, np.int64)
    for column in columns:
        kinds = column.dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(kinds.dictionary) + kinds.indices.to_numpy(), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if n else ():
        yield tuple(column[int(at[0])].as_py() for column in columns), at


def _packed(tiers: pa.Table, keys: Sequence[str]) -> dict[tuple, tuple[bytes, bytes]]:
    """Of each key the steps from one anchor price to the next and the counts, compressed; tiers are in order of price."""
    price, c = (tiers.column(name).to_numpy() for name in ("anchor_price", "c"))
    pack = lambda values: zlib.compress(values.astype("<i8").tobytes())
    return {key: (pack(np.diff(price[at], prepend=0)), pack(c[at])) for key, at in _by_key([tiers.column(k).combine_chunks() for k in keys], tiers.num_rows)}


def _looked_up(packed: dict[tuple, tuple[bytes, bytes]], keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(p: np.ndarray, prices: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """Which of the own prices p have a range, and band, n, low, high and median of those; before: anchors under each price."""
        reach = [np.maximum(np.floor(p * share).astype(np.int64) if share < 1 else p, cents) for share, cents in BANDS]
        start = np.stack([np.searchsorted(prices, p - r) for r in reach])
        end = np.stack([np.searchsorted(prices, p + np.minimum(r, np.iinfo(np.int64).max - p), "right") for r in reach])
        n = before[end] - before[start]
        band = np.where(n[0] >= ENOUGH, 0, np.where(n[1] >= ENOUGH, 1, 2))
        start, end, n = (np.take_along_axis(x, band[None], 0)[0] for x in (start, end, n))
        kept = np.flatnonzero(n >= LEAST)
        start, end, n = start[kept], end[kept], n[kept]
        median = prices[np.searchsorted(before, before[start] + n // 2, "right") - 1]
        return kept, band[kept], n, prices[start], prices[end - 1], median

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda data: np.cumsum(np.frombuffer(zlib.decompress(data), "<i8"))
        index = {key: (read(steps), np.concatenate([[0], read(counts)])) for key, (steps, counts) in packed.items()}
        for batch in batches:
            price = batch.column("price_cents").to_numpy().astype(np.int64)
            parts = []
            for key, at in _by_key([batch.column(k) for k in keys], batch.num_rows):
                if key in index:
                    kept, *told = found(price[at], *index[key])
                    parts.append((at[kept], *told))
            if parts:
                at, band, *told = (np.concatenate(x) for x in zip(*parts, strict=True))
                out = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(band, pa.int32()), *(pa.array(x, pa.int64()) for x in told)], [*out.schema.names, "band", "n", "low", "high", "median"])

    return run


def top_sources(own: DataFrame, anchors: DataFrame, keys: Sequence[str], own_tokens: Column, anchor_tokens: Column, least: int = 50, per_place: int = 2, top: int = SOURCES) -> DataFrame:
    """Per own item its anchors by token similarity (at least 1): per_place of a place and top in all at most. Ties go to the least price and id.

    Own rows have keys and a unique item_id, anchors keys, anchor_id, place_id and anchor_price. Similarity depends on the
    sets of tokens only, so sets are compared, each once for its keys: an anchor behind per_place others of its set and place
    is behind them for every item, and items of one set have the same sources. A set that is similar enough shares one of
    any (size - least shared + 1) own tokens, so sets meet by that many of the own tokens rarest among the anchors' sets."""
    from pyspark.sql import Window as W

    share = lambda k, n: F.floor(100 * k / n + 0.5).cast("int")
    mine = own.withColumn("_own", F.array_sort(own_tokens)).where(F.size("_own") > 0)
    theirs = anchors.select(*keys, "anchor_id", "place_id", "anchor_price", F.array_sort(anchor_tokens).alias("_theirs"))
    cheap = [F.col("anchor_price").asc_nulls_last(), F.col("anchor_id")]
    first = theirs.withColumn("_p", F.row_number().over(W.partitionBy(*keys, "_theirs", "place_id").orderBy(*cheap))).where(F.col("_p") <= per_place).drop("_p")
    words = theirs.select(*keys, "_theirs").distinct().withColumn("_w", F.explode("_theirs"))
    counts = words.groupBy(*keys, "_w").agg(F.count("*").alias("_c"))
    sets = mine.select(*keys, "_own").distinct()
    # of n tokens the fewest that may be shared, and so how many of the rarest must be looked up; those no anchor has count as rarest
    needed = F.array_min(F.filter(F.sequence(F.lit(1), F.size("_own")), lambda k: share(k, F.size("_own")) >= least))
    ranked = sets.where(needed.isNotNull()).withColumn("_w", F.explode("_own")).join(counts, [*keys, "_w"], "left").groupBy(*keys, "_own").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_c", F.lit(0)).alias("c"), "_w"))).alias("_rare"))
    looked = ranked.select(*keys, "_own", F.explode(F.transform(F.slice("_rare", F.lit(1), F.size("_own") - needed + 1), lambda r: r["_w"])).alias("_w"))
    met = looked.join(words, [*keys, "_w"]).select(*keys, "_own", "_theirs").distinct()
    similar = met.withColumn("similarity", share(F.size(F.array_intersect("_own", "_theirs")), F.size("_own"))).where(F.col("similarity") >= least)
    order = [F.desc("similarity"), *cheap]
    near = similar.join(first, [*keys, "_theirs"]).withColumn("_p", F.row_number().over(W.partitionBy(*keys, "_own", "place_id").orderBy(*order))).where(F.col("_p") <= per_place)
    best = near.withColumn("rank", F.row_number().over(W.partitionBy(*keys, "_own").orderBy(*order))).where(F.col("rank") <= top).drop("_p", "_theirs")
    return mine.join(best, [*keys, "_own"]).drop("_own")


def assessment(price: Column, low: Column, high: Column, median: Column) -> Column:
    return F.when(price < low, "below_market").when(price > high, "above_market").when(price < 0.9 * median, "lower_range").when(price > 1.1 * median, "higher_range").otherwise("fair")


def summary(places: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: places, mean rating (NULL left out, two digits)."""
    return places.groupBy(*keys).agg(F.count("*").alias("n_places"), F.round(F.avg("rating"), 2).alias("mean_rating"))


def collapse_variants(items: DataFrame, menu: Sequence[str], roles: Sequence[str] = ("dish", "side", "dessert")) -> DataFrame:
    """Dishes, sides, desserts and rows without role as they are; variant rows as one per canonical name with least, highest price and count."""
    kept = items.where(F.col("role").isNull() | F.col("role").isin(*roles)).select(*menu, "name", F.col("price_cents").alias("low"), F.col("price_cents").alias("high"), F.lit(1).cast("bigint").alias("n"))
    rest = items.where("role = 'variant'").groupBy(*menu, F.col("canonical_name").alias("name")).agg(F.min("price_cents").alias("low"), F.max("price_cents").alias("high"), F.count("*").alias("n"))
    return kept.unionByName(rest)
