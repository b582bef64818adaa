"""Benchmark decontamination with training suffix arrays.

Each task builds suffix arrays over its shards of the training texts and binary-searches every suffix of the test
items in them; suffixes that begin with the same window are searched together. Nothing of the corpus is shuffled; the
test items are the only thing sent out, a block of bounded size at a time. Work and memory grow with the words at hand,
not with the product of equal passages: a window's occurrences are one range of the array, longest matches come from the
neighbours in a joint order of hit words and test suffixes.

Words are named by hash, and every word that is found is compared byte by byte with the word of the item.

Defined cases: a null or empty text, or one without words, has no hits; an item without words matches nothing; an item
shorter than the window is one window as a whole; items without an id are searched like any other, and they have a null
item_id, which op10 counts as one item and leaves out of items_sha256; ids of any type are given back as text; repeated
rows are each judged alone; other columns, whatever their names, are ignored by ``find_matches`` and kept by
``decontaminate``; empty tables have no matches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import map_arrow, materialize, slices

#: Bytes of test text in one block; each block is one pass over the documents.
BLOCK_BYTES = 8_000_000
#: Bytes of training text under one suffix array.
SHARD_BYTES = 8_000_000
#: Items that are listed at once, test suffixes that are searched at once.
LISTED, SEARCHED = 2_000_000, 100_000
STEP = 16


class TestItems:
    """One block of test items, as ranks of a vocabulary; texts end with rank 0."""

    def __init__(self, rows: list[tuple[str, str]], size: int) -> None:
        self.ids, self.size = np.array([i for i, _ in rows] or [None], object), size
        self.data, offsets = K.buffers(pa.array([t for _, t in rows], pa.string()))
        starts, ends, first = K.words(self.data, offsets, K.ALNUM)
        self.seed = 0
        while True:  # a seed under which no two words of the items share a hash
            self.seed += 1
            hashes = K.word_hashes(self.data, starts, ends, lower=True, seed=self.seed)
            self.vocabulary, lead, ranks = np.unique(hashes, return_index=True, return_inverse=True)
            self.from_, self.to = starts[lead], ends[lead]
            if K.same_strings(self.data, starts, ends, self.data, self.from_[ranks], self.to[ranks], lower=True).all():
                break
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self.vocabulary & K.U(0xFFFF)] = True
        item, counts = K.owner(first), np.diff(first)
        window = np.minimum(size, counts)
        self.least = int(window[counts > 0].min(initial=size))
        self.ranks = np.zeros(len(ranks) + len(rows) + STEP, np.int64)
        place = np.arange(len(ranks)) + item
        self.ranks[place] = ranks + 1
        #: suffixes with room for a window of their item
        keep = first[1:][item] - np.arange(len(ranks)) >= window[item]
        suffix, item = place[keep], item[keep]
        width = window[item]
        #: groups of suffixes with the same window: one suffix, its width, and the number of its set of items
        keys = np.zeros(len(suffix), K.U)
        for w in np.unique(width).tolist():
            own = width == w
            keys[own] = K.window_hashes(self.ranks.astype(K.U), suffix[own], int(w))
        _, lead, group = np.unique(keys, return_index=True, return_inverse=True)
        alike = width == width[lead][group] if len(group) else np.zeros(0, bool)
        for k in range(size):
            alike &= (width <= k) | (self.ranks[np.minimum(suffix + k, len(self.ranks) - 1)] == self.ranks[np.minimum(suffix[lead][group] + k, len(self.ranks) - 1)])
        if not alike.all():  # two windows share a hash: every suffix is a group of its own
            lead = group = np.arange(len(suffix))
        self.suffix, self.width, self.group = suffix[lead], width[lead], group
        self.every, self.every_item = suffix, item
        pairs = np.unique(group * len(self.ids) + item)
        of, item = pairs // len(self.ids), pairs % len(self.ids)
        bounds = np.searchsorted(of, np.arange(len(lead) + 1))
        total = np.concatenate((np.zeros(1, K.U), np.cumsum(K.mix(item.astype(K.U) + K.U(1)))))
        print_ = total[bounds[1:]] - total[bounds[:-1]]
        _, lead, self.set_of = np.unique(print_, return_index=True, return_inverse=True)
        self.items = [item[bounds[k] : bounds[k + 1]] for k in lead.tolist()]
        # sets that share a print, though they differ, are sets of their own
        size, whole = np.diff(bounds), lead[self.set_of]
        unlike = size != size[whole]
        spot = np.repeat(bounds[whole] - bounds[:-1], size) + np.arange(len(item))
        unlike[of[item != item[np.minimum(spot, max(0, len(item) - 1))]]] = True
        for k in np.flatnonzero(unlike).tolist():
            self.set_of[k] = len(self.items)
            self.items.append(item[bounds[k] : bounds[k + 1]])

    def rank(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """1 and up for words of the vocabulary, else 0."""
        hashes = K.word_hashes(data, starts, ends, lower=True, seed=self.seed)
        out = np.zeros(len(hashes), np.int64)
        if not len(self.vocabulary):
            return out
        maybe = np.flatnonzero(self.seen[hashes & K.U(0xFFFF)])
        place = np.searchsorted(self.vocabulary, hashes[maybe])
        place[place == len(self.vocabulary)] = 0
        same = self.vocabulary[place] == hashes[maybe]
        maybe, place = maybe[same], place[same]
        same = K.same_strings(data, starts[maybe], ends[maybe], self.data, self.from_[place], self.to[place], lower=True)
        out[maybe[same]] = place[same] + 1
        return out


def suffix_array(text: np.ndarray, longest: int) -> np.ndarray:
    """Order of all suffixes by their first longest ranks, by prefix doubling; text ends with a 0."""
    rank, done = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while done < longest:
        ahead = np.zeros_like(rank)
        ahead[:-done] = rank[done:] + 1
        names, rank = np.unique(rank * (rank.max() + 2) + ahead, return_inverse=True)
        done *= 2
        if len(names) == len(text) or done >= len(text):
            break
    return np.argsort(rank, kind="stable")


def common_prefix(text: np.ndarray, a: np.ndarray, tests: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words shared by text[a:] and tests[b:], most at most; a block of STEP words at a time, for those still equal."""
    out, open_, done = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    lane = np.arange(STEP)
    while len(open_):
        x = text[np.minimum(a[open_, None] + done + lane, len(text) - 1)]
        y = tests[np.minimum(b[open_, None] + done + lane, len(tests) - 1)]
        differ = (x != y) | (x == 0)
        some = differ.any(1)
        out[open_] = done + np.where(some, differ.argmax(1), STEP)
        done += STEP
        open_ = open_[~some & (done < most[open_])]
    return np.minimum(out, most)


def bound(text: np.ndarray, order: np.ndarray, tests: np.ndarray, at: np.ndarray, most: np.ndarray, above: bool) -> np.ndarray:
    """Binary search: for each test suffix, how many training suffixes sort before it (above: or share most words)."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order))
    while (todo := np.flatnonzero(low < high)).size:
        middle = (low[todo] + high[todo]) // 2
        a, b = order[middle], at[todo]
        shared = common_prefix(text, a, tests, b, most[todo])
        equal = shared == most[todo]
        x, y = text[np.minimum(a + shared, len(text) - 1)], tests[np.minimum(b + shared, len(tests) - 1)]
        right = np.where(equal, above, x < y)
        low[todo] = np.where(right, middle + 1, low[todo])
        high[todo] = np.where(right, high[todo], middle)
    return low


class Found(NamedTuple):
    hit: np.ndarray  #: whether each word is inside an occurrence of a window
    doc: np.ndarray  #: documents and the sets of items with a window in them, each pair once
    set_: np.ndarray
    at: np.ndarray  #: first words, items and lengths of longest verbatim matches
    item: np.ndarray
    length: np.ndarray


def search(tests: TestItems, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, longest: bool = True) -> Found:
    """All occurrences of windows in the words of a shard of texts; longest: matches, too."""
    n, none = len(starts), np.zeros(0, np.int64)
    nothing = Found(np.zeros(n, bool), none, none, none, none, none)
    ranks = tests.rank(data, starts, ends)
    known = ranks > 0
    # runs of known words, cut at text ends
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    heads = first[:-1][first[:-1] < n]
    begins[heads] = known[heads]
    places = np.flatnonzero(known)
    if not len(places) or not len(tests.suffix):
        return nothing
    run = np.cumsum(begins)[places] - 1
    sizes = np.bincount(run)
    places = places[sizes[run] >= tests.least]
    if not len(places):
        return nothing
    gap = np.cumsum(begins[places]) - 1
    text = np.zeros(len(places) + gap[-1] + 2, np.int64)
    spot = np.arange(len(places)) + gap
    text[spot] = ranks[places]
    origin = np.full(len(text), -1, np.int64)
    origin[spot] = places
    present = np.zeros(len(tests.vocabulary) + 1, bool)
    present[text] = True
    order = suffix_array(text, tests.size + 1)
    some = np.flatnonzero(present[tests.ranks[tests.suffix]])
    low = high = np.zeros(0, np.int64)
    for part in np.array_split(some, max(1, -(-len(some) // SEARCHED))):
        at, width = tests.suffix[part], tests.width[part]
        under = bound(text, order, tests.ranks, at, width, above=False)
        over = under.copy()
        there = np.flatnonzero(under < len(order))
        there = there[common_prefix(text, order[under[there]], tests.ranks, at[there], width[there]) == width[there]]
        over[there] = bound(text, order, tests.ranks, at[there], width[there], above=True)
        low, high = np.concatenate((low, under)), np.concatenate((high, over))
    found = np.flatnonzero(high > low)
    if not len(found):
        return nothing
    # windows of one width share no occurrence, so each width's come to the shard's words at most
    hit, pairs, short = np.zeros(n, bool), [], []
    for width in np.unique(tests.width[some[found]]).tolist():
        own = found[tests.width[some[found]] == width]
        count = high[own] - low[own]
        head = np.cumsum(count) - count
        word = origin[order[np.arange(int(count.sum())) + np.repeat(low[own] - head, count)]]
        hit |= K.covered(word, word + width, n)
        group = np.repeat(some[own], count)
        doc = np.searchsorted(first, word, "right") - 1
        pairs.append(np.unique(doc * len(tests.items) + tests.set_of[group]))
        if width < tests.size and longest:  # whole items: the first occurrence in each document
            order_ = np.lexsort((word, group, doc))
            lead = np.append(True, (doc[order_][1:] != doc[order_][:-1]) | (group[order_][1:] != group[order_][:-1]))
            short += [(int(word[k]), item, width) for k in order_[lead].tolist() for item in tests.items[tests.set_of[group[k]]].tolist()]
    pairs = np.unique(np.concatenate(pairs))
    at = item = length = none
    if longest:
        wide = np.zeros(len(tests.suffix), bool)
        wide[some[found]] = tests.width[some[found]] == tests.size
        at, item, length = matches(tests, wide[tests.group], ranks, hit, first)
        if short:
            more = np.array(short, np.int64).T
            at, item, length = (np.concatenate(x) for x in zip((at, item, length), more, strict=True))
    return Found(hit, pairs // len(tests.items), pairs % len(tests.items), at, item, length)


def matches(tests: TestItems, used: np.ndarray, ranks: np.ndarray, hit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, items and lengths of longest verbatim matches of a full window or more, those that go on to the left left out.

    A joint order of the suffixes of hit words and of test words under used windows; the longest match of a suffix is
    with its nearest test suffix before or after it, its length the least common prefix on the way there."""
    none = np.zeros(0, np.int64)
    if not used.any():
        return none, none, none
    inside = np.zeros(len(tests.ranks) + 1, np.int64)
    np.add.at(inside, tests.every[used], 1)
    np.add.at(inside, np.minimum(tests.every[used] + tests.size, len(tests.ranks)), -1)
    item_of = np.zeros(len(tests.ranks), np.int64)
    item_of[tests.every] = tests.every_item
    theirs = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    mine = np.flatnonzero(hit)
    doc = np.searchsorted(first, mine, "right") - 1
    cut = lambda where, group: np.append(True, (np.diff(where) > 1) | (np.diff(group) != 0))
    tail = np.zeros(len(theirs), np.int64)  # a rank of 0 stands between two items already, so no run crosses them
    joint, back, is_test = [], [], []
    for where, values, heads, flag in ((mine, ranks[mine], cut(mine, doc), False), (theirs, tests.ranks[theirs], cut(theirs, tail), True)):
        spot = np.arange(len(where)) + np.cumsum(heads) - 1
        text, source = np.zeros(int(spot[-1]) + 2, np.int64), np.full(int(spot[-1]) + 2, -1, np.int64)
        text[spot], source[spot] = values, where
        joint.append(text), back.append(source), is_test.append(np.full(len(text), flag))
    text, source, test = np.concatenate(joint), np.concatenate(back), np.concatenate(is_test)
    m = len(text)
    ends = np.append(np.flatnonzero(text == 0), m)
    room = ends[np.searchsorted(ends, np.arange(m))] - np.arange(m)  # words up to the end of the run
    most = int(room[test].max())
    levels, rank, done = [], np.unique(text, return_inverse=True)[1].astype(np.int32), 1
    while True:  # ranks by the first 1, 2, 4, ... words
        levels.append(rank)
        if done >= most:
            break
        ahead = np.zeros(m, np.int64)
        ahead[:-done] = rank[done:].astype(np.int64) + 1
        rank = np.unique(rank.astype(np.int64) * (m + 2) + ahead, return_inverse=True)[1].astype(np.int32)
        done *= 2
    order = np.argsort(rank, kind="stable")
    a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(m - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        fits = (a < m) & (b < m)
        same = np.zeros(m - 1, bool)
        same[fits] = levels[k][a[fits]] == levels[k][b[fits]]
        shared[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    shared = np.minimum(shared, np.minimum(room[order[:-1]], room[order[1:]]))

    def nearest(gap: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place in the order: the least gap since the last test suffix, and that suffix's place."""
        part, far = np.cumsum(flags), m + 1
        value = np.append(0, gap)
        value[flags] = far
        least = np.minimum.accumulate(value - part * (far + 1)) + part * (far + 1)
        last = np.maximum.accumulate(np.where(flags, np.arange(m), -1))
        return np.where(last >= 0, least, 0), np.maximum(last, 0)

    flags = test[order]
    before, left = nearest(shared, flags)
    after, right = (x[::-1] for x in nearest(shared[::-1], flags[::-1]))
    best, with_ = np.maximum(before, after), np.where(before >= after, left, m - 1 - right)
    length, partner = np.zeros(m, np.int64), np.zeros(m, np.int64)
    length[order] = np.where(flags, 0, np.minimum(best, room[order]))
    partner[order] = order[with_]
    start = length >= tests.size
    start[1:] &= length[:-1] != length[1:] + 1
    start &= source >= 0
    # a partner starts a window, as size words or more from it are under windows of one item
    return source[start], item_of[source[partner[start]]], length[start]


_HELD: dict[str, TestItems] = {}


def _items(key: str, tests_of: Broadcast, size: int) -> TestItems:
    """The block of test items, built once in a worker."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = TestItems(tests_of.value, size)
    return _HELD[key]


def _listed(tests: TestItems, doc: np.ndarray, set_: np.ndarray, n: int) -> pa.ListArray:
    """Of each of n documents, the ids of the items in its sets, each once."""
    size = np.array([len(x) for x in tests.items] or [0])[set_] if len(set_) else np.zeros(0, np.int64)
    counts, out, at = np.zeros(n, np.int64), [], 0
    edge = np.flatnonzero(np.diff(doc, prepend=-1))
    while at < len(edge):  # some documents at a time
        end = at + 1
        while end < len(edge) and size[edge[at] : edge[end]].sum() < LISTED // 4 and end - at < 1000:
            end += 1
        part = slice(edge[at], edge[end] if end < len(edge) else len(doc))
        if end == at + 1:
            held = np.zeros(len(tests.ids), bool)
            for k in set_[part].tolist():
                held[tests.items[k]] = True
            pairs = np.flatnonzero(held) + doc[part.start] * len(tests.ids)
        else:
            pairs = np.unique(np.concatenate([tests.items[k] + d * len(tests.ids) for d, k in zip(doc[part].tolist(), set_[part].tolist(), strict=True)]))
        counts += np.bincount(pairs // len(tests.ids), minlength=n)
        out.append(pa.array(tests.ids[pairs % len(tests.ids)], pa.string()))
        at = end
    return K.lists(np.concatenate((np.zeros(1, np.int64), np.cumsum(counts))), pa.concat_arrays(out) if out else pa.array([], pa.string()))


_STATE = "matches array<struct<item_id:string,word:bigint,length:bigint>>, items array<string>, spans array<struct<start:bigint,end:bigint>>, n_words bigint"


def _pass(key: str, tests_of: Broadcast, size: int):
    """Rows (id, text): id, matches, items, spans of hit words, n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = _items(key, tests_of, size)
        for batch in slices(batches, "text", SHARD_BYTES):
            data, offsets = K.buffers(batch.column(1))
            starts, ends, first = K.words(data, offsets, K.ALNUM)
            got, n = search(tests, data, starts, ends, first), batch.num_rows
            order = np.lexsort((got.item, got.at))
            doc = np.searchsorted(first, got.at[order], "right") - 1
            found = pa.StructArray.from_arrays([pa.array(tests.ids[got.item[order]], pa.string()), pa.array(got.at[order] - first[doc]), pa.array(got.length[order])], ["item_id", "word", "length"])
            # of each document: the merged spans of words inside any window
            hit, owner = got.hit, K.owner(first)
            opens, closes = hit.copy(), hit.copy()
            opens[1:] &= ~hit[:-1] | (owner[1:] != owner[:-1])
            closes[:-1] &= ~hit[1:] | (owner[1:] != owner[:-1])
            begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            spans = pa.StructArray.from_arrays([pa.array(begin - first[owner[begin]]), pa.array(end - first[owner[begin]])], ["start", "end"])
            rows = np.arange(n + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), K.lists(np.searchsorted(doc, rows), found), _listed(tests, got.doc, got.set_, n), K.lists(np.searchsorted(owner[begin], rows), spans), pa.array(np.diff(first))], ["id", "matches", "items", "spans", "n_words"])

    return run


def _blocks(spark: SparkSession, items: DataFrame, item_col: str, item_text: str) -> Iterator[tuple[int, str, Broadcast]]:
    """The number of blocks, and the test items in broadcasts of BLOCK_BYTES of text, about; one at least."""
    tests = items.select(F.col(f"`{item_col}`").cast("string").alias("id"), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("text"))
    total = tests.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    for k in range(blocks):
        yield blocks, uuid.uuid4().hex, spark.sparkContext.broadcast([(r[0], r[1]) for r in tests.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()])


def find_matches(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, items (ids of those with a window in it), matches (longest verbatim
    matches where they begin: item_id, word, length).

    A word is hit if it is inside any occurrence of a window: size consecutive words of an item, or all of a shorter one.
    Beyond one block, each block's hits are written before the next block is sent out, and joined by row at the end."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    state = T.StructType.fromDDL(_STATE)
    schema = lambda rows: T.StructType([rows.schema["id"], *state])
    columns = [F.col("id").alias(id_col), "n_words", "n_hit", "items", "matches"]
    width = lambda s: s["end"] - s["start"]
    parts, base = [], None
    for blocks, key, tests in _blocks(docs.sparkSession, items, item_col, item_text):
        if blocks == 1:
            out = map_arrow(source, _pass(key, tests, size), schema(source))
            return out.withColumn("n_hit", F.aggregate(F.transform("spans", width), F.lit(0).cast("long"), lambda a, b: a + b)).select(*columns)
        if base is None:
            base = materialize(source.withColumn("row", F.monotonically_increasing_id()), "searched")
        rows = base.select(F.col("row").alias("id"), "text")
        found = map_arrow(rows, _pass(key, tests, size), schema(rows))
        parts.append(materialize(found.where(F.size("spans") > 0) if parts else found, "block-hits"))
        tests.destroy()
    counts = parts[0].select(F.col("id").alias("_id"), "n_words")
    every = parts[0].where(F.size("spans") > 0)
    for part in parts[1:]:
        every = every.unionByName(part)
    joined = every.groupBy("id").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("matches", "items", "spans")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    add = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end"))
    joined = joined.select(F.col("id").alias("_row"), F.aggregate(F.array_sort("spans"), start, add)["n"].alias("n_hit"), "items", "matches")
    rows = base.select("id", "row").join(counts, F.col("row") == F.col("_id")).join(joined, F.col("row") == F.col("_row"), "left")
    empty = lambda name: F.coalesce(name, F.array().cast(state[name].dataType)).alias(name)
    return rows.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), empty("items"), empty("matches")).select(*columns)


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without any hit word, all columns kept; a pass for each block of items, each row judged alone."""
    column = docs.columns.index(text_col)

    def clean(key: str, tests_of: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = _items(key, tests_of, size)
            for batch in slices(batches, text_col, SHARD_BYTES):
                data, offsets = K.buffers(batch.column(column))
                starts, ends, first = K.words(data, offsets, K.ALNUM)
                got = search(tests, data, starts, ends, first, longest=False)
                good = np.ones(batch.num_rows, bool)
                good[got.doc] = False
                yield batch.filter(pa.array(good))

        return run

    out = docs
    for blocks, key, tests in _blocks(docs.sparkSession, items, item_col, item_text):
        out = map_arrow(out, clean(key, tests), docs.schema)
        if blocks > 1:
            out = materialize(out, "cleaned")
            tests.destroy()
    return out
