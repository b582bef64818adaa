"""Substring dedup by recompression.

Words are named by hash; runs of one word and then, round after round, pairs of neighbours get a new name that is a
hash of the names they replace. Names are thus global without an exchange, and equal passages get equal symbols except
near their ends. Every symbol carries the span of words that its name depends on, so it is known which symbols any
other copy of a window must have too. Rounds in Spark:

1. each document's distinct symbols, and those in two documents or more; documents that copy a smaller one whole are
   known by now and go no further;
2. documents with such symbols: their windows in which no dependable symbol is unshared are candidates;
3. candidates are verified by 96-bit hashes of all their words: the least document of each;
4. words under windows that start in a smaller document go.

Defined cases: ids are integers, others are refused; null is as empty; texts under one window lose nothing; a row without id loses nothing and is no source;
rows with the same id are one document, whose windows aren't repeats of each other; other columns are kept by
``remove_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import fresh, integer_ids, map_arrow, materialize, slices

#: Consecutive words of a repeat.
WINDOW = 50
#: Rounds of pairing; a symbol then stands for 8 words on average.
ROUNDS = 7


def symbols(hashes: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all last-round symbols and the spans of words [left, right) on which each depends.

    A symbol that depends on where its text begins or ends reaches beyond it, so that no window can hold it."""
    n = len(hashes)
    doc = K.owner(first)
    # runs of one word
    head = np.ones(n, bool)
    head[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, n))
    names = np.where(size > 1, K.mix(hashes[at] * K.U(0x9FB21C651E98DF25) + size.astype(K.U)), hashes[at])
    left, right, doc = at - 1, at + size + 1, doc[at]
    for k in range(rounds):
        m = len(names)
        if not m:
            break
        second = (K.mix(names + K.U(k)) >> K.U(63)).astype(bool)
        joined = np.zeros(m, bool)  # with the next one
        alike = doc[1:] == doc[:-1]
        joined[:-1] = ~second[:-1] & second[1:] & alike
        taken = np.zeros(m, bool)
        taken[1:] = joined[:-1]
        # what stays alone depends on the neighbour that it wasn't joined with
        nearer, farther = left.copy(), right.copy()
        ahead = np.flatnonzero(~second & ~joined)
        inside = ahead[ahead + 1 < m]
        inside = inside[alike[inside]]
        nearer[inside] = np.minimum(left[inside], left[inside + 1])
        farther[inside] = np.maximum(right[inside], right[inside + 1])
        behind = np.flatnonzero(second & ~taken)
        inner = behind[behind > 0]
        inner = inner[alike[inner - 1]]
        nearer[inner] = np.minimum(left[inner], left[inner - 1])
        farther[inner] = np.maximum(right[inner], right[inner - 1])
        last, begin = np.ones(m, bool), np.ones(m, bool)
        last[:-1], begin[1:] = ~alike, ~alike
        edge = ahead[last[ahead]]
        farther[edge] = first[doc[edge] + 1] + 1
        edge = behind[begin[behind]]
        nearer[edge] = first[doc[edge]] - 1
        pairs = np.flatnonzero(joined)
        names = names.copy()
        names[pairs] = K.mix(names[pairs] * K.U(0xE7037ED1A0B428DB) + K.mix(names[pairs + 1] ^ K.U(0x8EBC6AF09C88C6E3)))
        nearer[pairs] = np.minimum(left[pairs], left[pairs + 1])
        farther[pairs] = np.maximum(right[pairs], right[pairs + 1])
        keep = ~taken
        names, left, right, doc = names[keep], nearer[keep], farther[keep], doc[keep]
    return names, left, right


class Texts:
    """Words and dependable symbols of a slice of texts."""

    def __init__(self, array: pa.Array, window: int) -> None:
        self.data, self.offsets = K.buffers(array)
        self.starts, self.ends, self.first = K.words(self.data, self.offsets, K.SPACED)
        self.hashes = K.word_hashes(self.data, self.starts, self.ends, lower=False)
        self.window = window
        self.at, self.by_text = K.windows(self.first, window)

    def dependable(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Names, texts and spans of the symbols that fit into a window of their text."""
        names, left, right = symbols(self.hashes, self.first)
        doc = np.searchsorted(self.first, np.clip((left + right) // 2, 0, max(0, len(self.hashes) - 1)), "right") - 1
        fits = (right - left <= self.window) & (left >= self.first[doc]) & (right <= self.first[doc + 1])
        fits &= self.first[doc + 1] - self.first[doc] >= self.window
        return names[fits], doc[fits], left[fits], right[fits]

    def under(self, left: np.ndarray, right: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Of each window in self.at, whether it holds any of the spans whole."""
        count = np.diff(self.first)
        spot = self.by_text[doc] - self.first[doc]  # from a word to the window that starts there
        low = np.maximum(right - self.window, self.first[doc]) + spot
        high = np.minimum(left, self.first[doc] + count[doc] - self.window) + spot + 1
        some = high > low
        return K.covered(low[some], high[some], len(self.at))

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes, of 64 and 32 bits, of the windows at some words; the second is made from other names of the words."""
        return K.window_hashes(self.hashes, at, self.window), (K.window_hashes(self.others(), at, self.window) >> K.U(32)).astype(np.uint32)

    def wholes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of all words of each text."""
        return tuple(K.span_hashes(names, self.first[:-1], self.first[1:]) for names in (self.hashes, self.others()))

    def others(self) -> np.ndarray:
        """Second names of the words, which don't depend on the first."""
        return K.word_hashes(self.data, self.starts, self.ends, lower=False, seed=2)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64 if x.itemsize == 8 else np.int32))


def _among(values: np.ndarray, rows: np.ndarray, known: pa.ListArray) -> np.ndarray:
    """Whether each value is in the list of its row; a null list is empty."""
    owners = np.repeat(np.arange(len(known)), pc.fill_null(known.value_lengths(), 0).to_numpy(zero_copy_only=False))
    held = K.mix(known.flatten().to_numpy(zero_copy_only=False).view(K.U) + K.mix(owners.astype(K.U)))
    return np.isin(K.mix(values + K.mix(rows.astype(K.U))), held)


def lost_passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document that loses words: id; hashes, the windows that start in a smaller one too; wholes, its texts that are whole in a smaller one."""
    integer_ids(docs, id_col)
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(symbol, id) once each, kind 0; kind 1: a document with a window without any dependable symbol; kind 2: a whole text and its second hash."""
        for batch in slices(batches, "text"):
            ids = batch.column(0).to_numpy()
            texts = Texts(batch.column(1), window)
            names, doc, left, right = texts.dependable()
            bare = np.unique(K.owner(texts.by_text)[~texts.under(left, right, doc)])
            order = np.lexsort((ids[doc], names))
            names, of = names[order], ids[doc][order]
            lead = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (of[1:] != of[:-1]))[: len(names)])
            long_ = np.flatnonzero(np.diff(texts.first) >= window)
            x, y = (h[long_] for h in texts.wholes())
            sizes = (len(lead), len(bare), len(long_))
            symbol = np.concatenate((names[lead], ids[bare].astype(K.U), x))
            second = pa.concat_arrays([pa.nulls(sizes[0] + sizes[1], pa.int64()), _signed(y)])
            yield pa.RecordBatch.from_arrays([_signed(symbol), pa.array(np.concatenate((of[lead], ids[bare], ids[long_]))), pa.array(np.repeat(np.array([0, 1, 2], np.int32), sizes)), second], ["symbol", "id", "kind", "second"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids = batch.column(0).to_numpy()
            texts = Texts(batch.column(1), window)
            names, doc, left, right = texts.dependable()
            alone = ~_among(names, doc, batch.column(2))
            copy = _among(texts.wholes()[0], np.arange(batch.num_rows), batch.column(3))
            owner = K.owner(texts.by_text)
            open_ = ~texts.under(left[alone], right[alone], doc[alone]) & ~copy[owner]
            a, b = texts.keys(texts.at[open_])
            of = ids[owner[open_]]
            order = np.lexsort((of, a))
            a, b, of = a[order], b[order], of[order]
            lead = np.append(True, (a[1:] != a[:-1]) | (of[1:] != of[:-1]))[: len(a)]
            yield pa.RecordBatch.from_arrays([_signed(a[lead]), _signed(b[lead]), pa.array(of[lead])], ["a", "b", "id"])

    found = materialize(map_arrow(rows, name, "symbol long, id long, kind int, second long"), "symbols")
    # tables on both sides of each join, so plain exchanges, whose hot keys adaptive execution splits
    symbols = found.where("kind = 0").select("symbol", "id")
    shared = symbols.groupBy("symbol").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select(F.col("symbol").alias("shared"))
    shared = materialize(shared, "shared-symbols")
    texts = found.where("kind = 2").select(F.col("symbol").alias("x"), F.col("second").alias("y"), "id")
    first = texts.groupBy(F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").drop("high")
    copies = texts.join(materialize(first, "first-copies"), (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")) & (F.col("id") > F.col("low")))
    copies = materialize(copies.groupBy(F.col("id").alias("copy")).agg(F.collect_set("x").alias("wholes")), "copies")
    marked = symbols.join(shared, F.col("symbol") == F.col("shared"), "left_semi").unionByName(found.where("kind = 1").select(F.lit(None).cast("long").alias("symbol"), "id"))
    marked = materialize(marked.groupBy("id").agg(F.collect_list("symbol").alias("symbols")), "marked")
    marked = marked.join(copies, F.col("id") == F.col("copy"), "left").drop("copy")
    windows = materialize(map_arrow(rows.join(marked, "id").select("id", "text", "symbols", "wholes"), candidates, "a long, b int, id long"), "windows")
    least = windows.groupBy("a", "b").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "low")
    least = materialize(least, "repeated-windows")
    lost = windows.join(least, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("id") > F.col("low")))
    lost = lost.groupBy("id").agg(F.collect_list("a").alias("hashes")).join(copies, F.col("id") == F.col("copy"), "full")
    return materialize(lost.select(F.coalesce("id", "copy").alias("id"), "hashes", "wholes"), "lost-passages")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and n_words, n_removed, kept_text (kept words joined by one space); columns already so named are replaced."""
    docs = docs.drop("n_words", "n_removed", "kept_text")
    key, held, whole = (fresh(docs, n) for n in ("_lost_id", "_hashes", "_wholes"))
    lost = lost_passages(docs, window, id_col, text_col).select(F.col("id").alias(key), F.col("hashes").alias(held), F.col("wholes").alias(whole))
    joined = docs.join(lost, F.col(id_col) == F.col(key), "left").drop(key)
    names = docs.columns
    schema = docs.select("*").schema
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("kept_text", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = Texts(batch.column(names.index(text_col)), window)
            hashes, wholes = batch.column(len(names)), batch.column(len(names) + 1)
            gone = np.zeros(len(texts.starts), bool)
            if hashes.null_count < batch.num_rows:
                hit = texts.at[_among(texts.keys(texts.at)[0], K.owner(texts.by_text), hashes)]
                gone = K.covered(hit, hit + window, len(texts.starts))
            if wholes.null_count < batch.num_rows:
                gone |= _among(texts.wholes()[0], np.arange(batch.num_rows), wholes)[K.owner(texts.first)]
            kept = np.flatnonzero(~gone)
            by_text = np.searchsorted(kept, texts.first)
            offsets, data = _joined_words(texts, kept, by_text)
            text = pa.Array.from_buffers(pa.string(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            total = np.diff(texts.first)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(total), pa.array(total - np.diff(by_text)), text], schema.names)

    return map_arrow(joined, run, schema)


def _joined_words(texts: Texts, kept: np.ndarray, by_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of each text's kept words joined by one space."""
    starts, size = texts.starts[kept], (texts.ends - texts.starts)[kept]
    head = np.zeros(len(kept), bool)
    some = by_text[:-1][np.diff(by_text) > 0]
    head[some] = True
    room = size + ~head
    ends = np.concatenate(([0], np.cumsum(room)))
    out = np.full(ends[-1], 0x20, np.uint8)
    to = ends[1:] - size
    spread = np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
    place = np.repeat(to - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
    out[place] = texts.data[spread]
    return ends[by_text].astype(np.int32), out
