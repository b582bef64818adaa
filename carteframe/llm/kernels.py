"""Vectorised text kernels over Arrow string buffers: words, hashes, windows. No per-word Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U(31))
    x *= U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for the pair of two names. Both have been scrambled before, so no structure of the text survives in them."""
    return mix(a * U(0x9E6C63D0876A3F35) + b)


def fold(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One name for each row of values[first[i] : first[i + 1]]: neighbours are joined, level by level; an empty row has 0."""
    counts = np.diff(first)
    out = np.zeros(len(counts), U)
    rows = np.flatnonzero(counts)
    counts, begin = counts[rows], first[:-1][rows]
    while len(rows):
        done = counts == 1
        out[rows[done]] = values[begin[done]]
        rows, counts, begin = rows[~done], counts[~done], begin[~done]
        half = (counts + 1) >> 1
        ahead = np.cumsum(half) - half
        place = np.arange(int(half.sum())) - np.repeat(ahead, half)
        left = np.repeat(begin, half) + 2 * place
        two = np.flatnonzero(2 * place + 1 < np.repeat(counts, half))
        level = values[left]
        level[two] = joined(level[two], values[left[two] + 1])
        values, begin, counts = level, ahead, half
    return out


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of values[start:end], by all their members in order; equal spans have equal names wherever they stand."""
    size = ends - starts
    first = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    at = np.arange(first[-1]) + np.repeat(starts - first[:-1], size)
    return mix(fold(mix(values[at]), first) + size.astype(U))


def window_hashes(values: np.ndarray, at: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Names of values[i : i + size] for each i in at, made from names of runs of 1, 2, 4, ... members."""
    if not len(at):
        return np.zeros(0, U)
    run, width, out, done = mix(values + U(seed)), 1, None, 0
    while True:
        if size & width:
            part = run[at + done]
            out = part if out is None else joined(out, part)
            done += width
        if done == size:
            return mix(out + U(size))
        run = joined(run[:-width], run[width:])
        width *= 2


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings together and the n + 1 offsets; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


#: Byte classes of the word rules. A word of SPACED is [^\x20\x09-\x0D]+, of ALNUM [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 indexes of each text's first word."""
    inside = kind[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    if len(data):
        before[0] = after[-1] = False
        edges = offsets[1:-1]
        before[edges[edges < len(data)]] = False
        after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes as they are, and with A-Z as a-z.
_AS_IS = np.arange(256, dtype=np.uint8)
_LOWER = _AS_IS.copy()
_LOWER[65:91] += 32
_KEPT = np.append((U(1) << np.arange(0, 64, 8, dtype=U)) - U(1), U(0xFFFFFFFFFFFFFFFF))


def lanes(data: np.ndarray, lower: bool) -> np.ndarray:
    """For each place of data the 8 bytes from there, as a number; zeros follow the end."""
    room = np.zeros(len(data) + 8, np.uint8)
    room[: len(data)] = _LOWER[data] if lower else data
    return np.ndarray(len(data) + 1, "<u8", room, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, seed: int = 1) -> np.ndarray:
    """Names of the byte strings data[start:end]; with lower, A-Z count as a-z. 8 bytes are scrambled at a time."""
    eight, size = lanes(data, lower), ends - starts
    out = mix((eight[starts] & _KEPT[np.minimum(size, 8)]) + U(seed * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF))
    long_ = np.flatnonzero(size > 8)
    if len(long_):
        count = (size[long_] + 7) >> 3
        first = np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))
        at = np.repeat(starts[long_] - 8 * first[:-1], count) + 8 * np.arange(first[-1])
        left = np.repeat(ends[long_], count) - at
        out[long_] = fold(mix((eight[at] & _KEPT[np.minimum(left, 8)]) + U(seed * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF)), first)
    return mix(out + size.astype(U))


def same_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, from_: np.ndarray, to: np.ndarray, lower: bool) -> np.ndarray:
    """Whether data[starts:ends] equals other[from_:to], byte by byte, for each pair."""
    out = (ends - starts) == (to - from_)
    a, b, at, open_ = lanes(data, lower), lanes(other, lower), 0, np.flatnonzero(out)
    while len(open_):  # 8 bytes at first, then ever longer stretches
        left = np.minimum(ends[open_] - starts[open_] - at, 8)
        keep = _KEPT[left]
        unlike = (a[starts[open_] + at] & keep) != (b[from_[open_] + at] & keep)
        out[open_[unlike]] = False
        at += 8
        open_ = open_[~unlike & (ends[open_] - starts[open_] > at)]
        if at >= 512:  # what is left is few and long
            for k in open_.tolist():
                x, y = data[starts[k] + at : ends[k]], other[from_[k] + at : to[k]]
                out[k] = np.array_equal(_LOWER[x], _LOWER[y]) if lower else np.array_equal(x, y)
            break
    return out


def owner(first: np.ndarray) -> np.ndarray:
    """For each element, the row that has it, from the n + 1 first indexes."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start elements of all windows of size elements inside one row, and the n + 1 indexes of each row's first window."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    ahead = np.concatenate(([0], np.cumsum(counts)))
    starts = np.arange(ahead[-1]) + np.repeat(first[:-1] - ahead[:-1], counts)
    return starts, ahead


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n elements is inside any of the spans."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth)[:n] > 0


def lists(first: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)
