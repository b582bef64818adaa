"""Byte-level BPE with forced-boundary splitting.

A byte pair that stands inside no vocabulary token can never be inside a merge, so it marks a certain cut. Each
pre-token is cut there; the fragments are encoded independently and their ids concatenated, which equals encoding
the pre-token whole.

Defined cases: null is as empty; an empty text has no ids; strings of special tokens become their ids, as in the
tokenizers library's default; repeated rows are each encoded; other columns are kept by ``encode``.
"""

from __future__ import annotations

import array
import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, slices

#: Fixed value: the pre-token pattern of this kind of vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts without characters from U+0250 on, with their letters, numbers and spaces spelled
#: out, so that the faster standard module can match it.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Pre-tokens whose ids a worker remembers; beyond that it starts afresh.
REMEMBERED = 300_000
#: Ids that are decoded at once, about.
DECODED = 500_000


def _printable() -> dict[str, int]:
    """The byte that each character of a vocabulary file stands for: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], _printable()
        raw = lambda token: bytes(to_byte[c] for c in token)
        self.id_of = {raw(t): i for t, i in model["vocab"].items()}
        #: rank of each mergeable pair of ids, at first * 2**20 + second, and the id that each rank makes
        self.rank_of: dict[int, int] = {}
        self.made: list[int] = []
        for pair in model["merges"]:
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            self.rank_of.setdefault((self.id_of[a] << 20) + self.id_of[b], len(self.made))
            self.made.append(self.id_of[a + b])
        self.byte_ids = [self.id_of.get(bytes([b]), -1) for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: t for t, i in self.id_of.items()} | {i: t.encode() for t, i in self.special.items()}
        #: joined[a, b]: some token has the byte a just before the byte b
        self.joined = np.zeros((256, 256), bool)
        for token in self.id_of:
            for a, b in zip(token, token[1:]):
                self.joined[a, b] = True
        self.joined_after = [frozenset(np.flatnonzero(row).tolist()) for row in self.joined]
        self.pretoken = regex.compile(PRETOKEN)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.latin, self.beyond_latin = re.compile(LATIN), re.compile("[\u0250-\U0010ffff]")
        self.memory = Memory(self)
        self._tables()
        self.parts: dict[bytes, bytes] = {}

    def fragments(self, piece: bytes) -> list[bytes]:
        """The piece cut at every byte pair that no token has inside."""
        after = self.joined_after
        cuts = [i for i, (a, b) in enumerate(zip(piece, piece[1:]), 1) if b not in after[a]]
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)])] if cuts else [piece]

    def merged(self, fragment: bytes) -> list[int]:
        """Ids of one fragment: the lowest-ranked pair is merged first, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in fragment]
        if len(ids) > 60:
            return self._merged_long(ids)
        rank_of, none = self.rank_of.get, 1 << 60
        ranks = [rank_of((a << 20) + b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != none:
            i = ranks.index(least)
            ids[i] = made = self.made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1] << 20) + made, none)
            if i < len(ranks):
                ranks[i] = rank_of((made << 20) + ids[i + 1], none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same by a heap and links: n log n steps for very long fragments."""
        n, rank_of = len(ids), self.rank_of.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank_of((ids[i] << 20) + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank_of((ids[i] << 20) + ids[j]) != rank:
                continue
            ids[i], ids[j], after[i] = self.made[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := rank_of((ids[left] << 20) + ids[right])) is not None:
                    heapq.heappush(heap, (r, left))
        return [x for x in ids if x >= 0]

    def ids_of(self, pretoken: str) -> bytes:
        """The ids of a pre-token, as 32-bit integers."""
        out = []
        for fragment in self.fragments(pretoken.encode()):
            if (ids := self.parts.get(fragment)) is None:
                ids = array.array("i", self.merged(fragment)).tobytes()
                if len(fragment) <= 64:
                    if len(self.parts) >= REMEMBERED:
                        self.parts.clear()
                    self.parts[fragment] = ids
            out.append(ids)
        return b"".join(out)

    def _ordinary(self, text: str) -> bytes:
        find = self.pretoken if self.beyond_latin.search(text) else self.latin
        if len(self.memory) >= REMEMBERED:
            self.memory.clear()
        return b"".join(map(self.memory.__getitem__, find.findall(text)))

    def encode(self, text: str) -> bytes:
        if self.specials is None or not self.specials.search(text):
            return self._ordinary(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._ordinary(text[at : m.start()]), array.array("i", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._ordinary(text[at:])])

    def forget(self) -> None:
        """Drops what was remembered; an idle worker needs no memory."""
        self.memory.clear()
        self.parts.clear()

    def _tables(self) -> None:
        """Bytes of all ids in one row, and where each begins."""
        size = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, token in self.bytes_of.items():
            size[i] = len(token)
        self.size, self.begin = size, np.cumsum(size) - size
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(size))), np.uint8)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """Texts of rows of ids, each from first[i] to first[i + 1]. Broken UTF-8 becomes U+FFFD."""
        size = self.size[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        data = self.flat[np.repeat(self.begin[ids] - ends[:-1], size) + np.arange(ends[-1])]
        offsets = ends[first].astype(np.int32)
        out = pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        try:
            out.validate(full=True)
            return out
        except pa.ArrowInvalid:
            raw = data.tobytes()
            return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])], pa.string())


class Memory(dict):
    """Ids of pre-tokens seen before; others are encoded, and kept if short."""

    def __init__(self, encoder: Vocabulary) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, pretoken: str) -> bytes:
        ids = self.encoder.ids_of(pretoken)
        if len(pretoken) <= 64:
            self[pretoken] = ids
        return ids


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns and ids_col, array<int>: the ids of the whole text. A column already named ids_col is replaced."""
    kept = [f for f in docs.schema.fields if f.name != ids_col]
    schema = T.StructType([*kept, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary(path)
        for batch in slices(batches, text_col):
            got = [encoder.encode(t) if t else b"" for t in batch.column(names.index(text_col)).to_pylist()]
            ends = np.cumsum([0, *map(len, got)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(got), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*names, ids_col])
        encoder.forget()

    return map_arrow(docs.select(*(F.col(f"`{n}`") for n in names)), run, schema)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns and text_col: the text of the ids (null: empty). Broken UTF-8 becomes U+FFFD."""
    kept = [f for f in tokens.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, T.StructField(text_col, T.StringType(), False)])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = vocabulary(path)
        for batch in batches:
            lengths = pc.fill_null(batch.column(names.index(ids_col)).value_lengths(), 0).to_numpy(zero_copy_only=False)
            begin, group = 0, np.cumsum(lengths) // DECODED
            for end in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]:
                part = batch.slice(begin, end - begin)
                ids = part.column(names.index(ids_col)).flatten().to_numpy()
                texts = decoder.decode(ids, np.concatenate(([0], np.cumsum(lengths[begin:end]))))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*names, text_col])
                begin = end

    return map_arrow(tokens.select(*(F.col(f"`{n}`") for n in names)), run, schema)


def round_trip(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """decode(encode(docs)) in one pass over the rows, so that a task has one Python worker with one vocabulary."""
    kept = [f for f in docs.schema.fields if f.name not in (ids_col, decoded_col)]
    schema = T.StructType([*kept, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded_col, T.StringType(), False)])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(path)
        for batch in slices(batches, text_col):
            got = [coder.encode(t) if t else b"" for t in batch.column(names.index(text_col)).to_pylist()]
            ends, ids = np.cumsum([0, *map(len, got)]) // 4, np.frombuffer(b"".join(got), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, coder.decode(ids, ends)], schema.names)
        coder.forget()

    return map_arrow(docs.select(*(F.col(f"`{n}`") for n in names)), run, schema)
