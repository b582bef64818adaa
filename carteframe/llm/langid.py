"""Language ID with bit-sliced Bloom filters of byte n-grams.

One filter per language, stored by position: a word of bits per position, a bit per language; the number of positions
follows from the largest language's count of n-grams. A look-up ANDs the words at an n-gram's positions and so returns
all languages that contain it. A document's counts per language, corrected for
each filter's false positives, decide.

Defined cases: null texts and texts without a letter are ``und`` with score 0; a text with letters but no known n-gram
gets the first learned language with score 0; with nothing to learn from, all rows are ``und``; repeated rows are
each judged; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import map_arrow, slices

GRAM = 4
UNKNOWN = "und"
#: Labelled texts of each language that the filters learn from, at most.
SAMPLE_TEXTS = 300
#: An n-gram belongs to a language if its rate there is at least this share of its highest rate in any language.
SHARE = 0.2
#: Positions of a filter for each n-gram of its language, at least; looked at for each n-gram.
ROOM, PROBES = 8, 3

#: Bytes as n-grams see them: letters lower-cased, everything else in ASCII a space.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams inside each text, with one that is only spaces left out, and the n + 1 indexes of each text's first."""
    folded = FOLD[data].astype(np.uint32)
    n = max(0, len(folded) - GRAM + 1)
    codes = folded[:n].copy()
    for k in range(1, GRAM):
        codes |= folded[k : k + n] << np.uint32(8 * k)
    keep = codes != np.uint32(0x20202020)
    for k in range(1, GRAM):  # none across two texts
        edge = offsets[1:-1] - k
        keep[edge[(edge >= 0) & (edge < n)]] = False
    places = np.flatnonzero(keep)
    return codes[places], np.searchsorted(places, offsets)


def probes(codes: np.ndarray, positions: int) -> list[np.ndarray]:
    """Places of n-grams in a filter of positions, a power of two."""
    mixed = [K.mix(codes.astype(K.U) + K.U(0x51ED27 + k)) for k in range(PROBES)]
    return [(m & K.U(positions - 1)).astype(np.int64) for m in mixed]


class Filters:
    def __init__(self, languages: list[str], codes: dict[str, np.ndarray]) -> None:
        self.languages = languages
        self.positions = 1 << max(10, int(ROOM * max(map(len, codes.values()), default=1) - 1).bit_length())
        self.slices = np.zeros((-(-len(languages) // 64), self.positions), K.U)
        self.false = np.zeros(len(languages))
        for i, language in enumerate(languages):
            filled = np.zeros(self.positions, bool)
            for p in probes(codes[language], self.positions):
                filled[p] = True
            self.slices[i // 64] |= filled.astype(K.U) << K.U(i % 64)
            self.false[i] = filled.mean() ** PROBES

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Corrected counts, a row for each text and a column for each language."""
        codes, first = grams(data, offsets)
        at = probes(codes, self.positions)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        total = np.diff(first)
        for word, bits in enumerate(self.slices):
            hit = bits[at[0]]
            for p in at[1:]:
                hit &= bits[p]
            some = np.flatnonzero(hit)
            by_text, hit = np.searchsorted(some, first), hit[some]
            for i in range(64 * word, min(64 * word + 64, len(self.languages))):
                running = np.concatenate(([0], np.cumsum((hit >> K.U(i % 64)) & K.U(1), dtype=np.int64)))
                out[:, i] = running[by_text[1:]] - running[by_text[:-1]]
        return np.maximum(0, (out - self.false * total[:, None]) / (1 - self.false))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams of each language in one task's texts, given out once at its end."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in slices(batches, "text"):
        codes, first = grams(*K.buffers(batch.column(1)))
        names = np.array(batch.column(0).to_pylist(), object)
        by_text = names[K.owner(first)]
        for name in sorted(set(names)):
            held[name] = [_merged([*held.get(name, []), np.unique(codes[by_text == name], return_counts=True)])]
    for name, [(codes, n)] in sorted(held.items()):
        for at in range(0, len(codes), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes[part]), pa.string()), pa.array(codes[part].astype(np.int64)), pa.array(n[part])], ["lang", "gram", "n"])


def _merged(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = (np.concatenate(x) for x in zip(*counts, strict=True))
    out, place = np.unique(codes, return_inverse=True)
    return out, np.bincount(place, n, len(out)).astype(np.int64)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS) -> Filters:
    """Learns from a bounded sample of the labelled rows: of each language the text with the least hash in each of
    sample_texts buckets of hashes. All n-grams of the sample count; a language's texts are counted in one task."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    picked = rows.groupBy("lang", F.pmod("h", F.lit(sample_texts)).alias("bucket")).agg(F.min("h").alias("h")).select("lang", "h")
    texts = rows.join(F.broadcast(picked), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])
    counted = map_arrow(texts.select("lang", "text").repartition("lang"), _counter, "lang string, gram long, n long").toArrow()
    names, codes, n = counted["lang"].to_pylist(), counted["gram"].to_numpy().astype(np.uint32), counted["n"].to_numpy()
    languages = sorted(set(names))
    lang = np.searchsorted(np.array(languages, object), np.array(names, object)) if languages else np.zeros(0, np.int64)
    rate = n / np.bincount(lang, n, len(languages))[lang] if len(n) else np.zeros(0)
    gram = np.unique(codes, return_inverse=True)[1]
    most = np.zeros(gram.max(initial=-1) + 1)
    np.maximum.at(most, gram, rate)
    kept = rate >= SHARE * most[gram]
    return Filters(languages, {k: codes[kept & (lang == i)] for i, k in enumerate(languages)})


def predict(docs: DataFrame, filters: Filters, id_cols: list[str], text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """id_cols, pred_col and score_col for every row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(filters)
    kept = [F.col(f"`{c}`") for c in id_cols]
    own = [] if text_col in id_cols else [F.col(text_col).alias("_text")]
    rows = docs.select(*kept, *own, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    width, at, name = len(id_cols) + len(own), len(id_cols) if own else id_cols.index(text_col), "_text" if own else text_col
    schema = docs.select(*kept).schema.add(pred_col, "string").add(score_col, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = sent.value
        names = np.array([*filters.languages, UNKNOWN], object)
        for batch in slices(batches, name):
            letters = batch.column(width).to_numpy(zero_copy_only=False)
            best, score = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            if len(names) > 1:
                counts = filters.counts(*K.buffers(batch.column(at)))
                best[letters] = counts.argmax(1)[letters]
                score[letters] = (counts.max(1) / np.maximum(counts.sum(1), 1e-9))[letters]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(id_cols)], pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], schema.names)

    return map_arrow(rows, run, schema)
