"""Quality rules with isolation forests on rule statistics.

``statistics`` counts for every whole text; ``fit`` deals the statistics of all rows to random split trees, a forest for
each group of rules (one over all would spend its splits on columns that tell nothing), and sets each threshold by the
scores of all labelled rows; ``judge`` turns path lengths into verdicts.

Defined cases: a null or empty text has zero counts and fails the base rules; repeated rows are each judged; with no
row labelled good only base failures are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import map_arrow, slices

#: Words of the windows whose repetition is counted.
WINDOW = 8
#: Trees of a forest, rows that each gets at least (if there are as many), steps of a score from 0 to 1 that thresholds tell apart.
TREES, TREE_ROWS, STEPS = 100, 256, 1 << 16
#: Share of the rows labelled good that one threshold may reject; how much likelier it must reject those labelled bad.
GOOD_LOST, GAIN = 0.001, 5
#: Columns of ``features`` that each forest sees.
GROUPS = ((1,), (2, 3), (4, 5), (0,), (0, 1, 2, 3, 4, 5))
#: The base rules.
LEAST_WORDS, MOST_REPEATED = 20, 30

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]
_SYMBOLS, _UPPER, _MARKS, _HEADS = (np.zeros(256, bool) for _ in range(4))
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_MARKS[list(b"!?=_~^\\/{}[]")] = True
_HEADS[:] = (np.arange(256) & 0xC0) != 0x80


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key stands twice or more among all."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def count_texts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, first = K.words(data, offsets, K.SPACED)
    within = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])
    out = {"n_words": np.diff(first), "word_chars": within(_HEADS[data] & K.SPACED[data])}
    out |= {"n_symbols": within(_SYMBOLS[data]), "n_upper": within(_UPPER[data]), "n_marks": within(_MARKS[data])}
    # lines with a word
    breaks = np.flatnonzero(data == 0x0A)
    begins = np.sort(np.concatenate((breaks + 1, offsets[:-1])))
    begins = np.unique(begins[begins < len(data)])
    stops = np.concatenate((begins[1:], [len(data)])) if len(begins) else begins
    line_text = np.searchsorted(offsets, begins, "right") - 1
    stops = stops - (data[np.maximum(stops - 1, 0)] == 0x0A)
    full = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
    begins, stops, line_text = begins[full], stops[full], line_text[full]
    salt = K.mix(np.arange(1, n + 1, dtype=K.U))
    keys = K.word_hashes(data, begins, stops, lower=False, seed=3) + salt[line_text]
    _, kept = np.unique(keys, return_index=True)
    out["n_lines"] = np.bincount(line_text, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_text[kept], minlength=n)
    # words in repeated windows
    hashes = K.word_hashes(data, starts, ends, lower=False)
    at, by_text = K.windows(first, WINDOW)
    keys = K.window_hashes(hashes, at, WINDOW) + salt[K.owner(by_text)]
    again = at[repeated(keys)]
    hit = K.covered(again, again + WINDOW, len(starts))
    out["n_repeat_words"] = np.diff(np.concatenate(([0], np.cumsum(hit)))[first])
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and COUNTS, long, for every whole text."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = rows.drop("_text").schema
    for name in COUNTS:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = count_texts(*K.buffers(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], schema.names)

    return map_arrow(rows, run, schema)


def features(table: dict[str, np.ndarray]) -> np.ndarray:
    n = np.maximum(1, table["n_words"]).astype(float)
    chars = np.maximum(1, table["word_chars"]).astype(float)
    lines = np.maximum(1, table["n_lines"]).astype(float)
    return np.column_stack([chars / n, table["n_symbols"] / n, table["n_dup_lines"] / lines, table["n_repeat_words"] / n, table["n_upper"] / chars, table["n_marks"] / n])


class Forest:
    """Isolation trees as arrays: column, split, children; leaves have column -1 and the path length in split."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, size: int = TREE_ROWS, seed: int = 7) -> None:
        """Grown on random rows of these, size for each tree."""
        rng = np.random.default_rng(seed)
        self._hold([self.grow(rows[rng.permutation(len(rows))[:size]], seed * 1000 + k) for k in range(trees)], min(size, len(rows)))

    def _hold(self, trees: list[tuple[np.ndarray, ...]], size: float) -> None:
        self.trees, self.size, self.threshold = trees, size, np.inf

    @classmethod
    def of(cls, trees: list[tuple[np.ndarray, ...]], size: float) -> Forest:
        """Of trees by grow(); size is the mean number of their rows."""
        self = cls.__new__(cls)
        self._hold(trees, size)
        return self

    @classmethod
    def grow(cls, rows: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
        """A tree of all rows, as deep as one of TREE_ROWS may be; their order has no effect."""
        return cls._grow(rows, int(np.ceil(np.log2(max(2, min(TREE_ROWS, len(rows)))))), np.random.default_rng(seed))

    @staticmethod
    def usual(n: float) -> float:
        """Mean path length of an unsuccessful search among n rows."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    @classmethod
    def _grow(cls, rows: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        column, split, left, right = [], [], [], []

        def node(part: np.ndarray, at: int) -> int:
            me = len(column)
            column.append(-1), split.append(at + cls.usual(len(part))), left.append(me), right.append(me)
            if at < depth and len(part) > 1:
                low, high = part.min(0), part.max(0)
                if (some := np.flatnonzero(high > low)).size:
                    c = int(rng.choice(some))
                    cut = rng.uniform(low[c], high[c])
                    under = part[:, c] < cut
                    column[me], split[me] = c, cut
                    left[me], right[me] = node(part[under], at + 1), node(part[~under], at + 1)
            return me

        node(rows, 0)
        return np.array(column), np.array(split), np.array(left), np.array(right)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; anomalous rows have short paths and so high scores."""
        total = np.zeros(len(rows))
        for column, split, left, right in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (todo := np.flatnonzero(column[at] >= 0)).size:
                here = at[todo]
                at[todo] = np.where(rows[todo, column[here]] < split[here], left[here], right[here])
            total += split[at]
        return 2 ** -(total / max(1, len(self.trees)) / max(1e-9, self.usual(self.size)))


class Judge:
    """Forests over groups of columns, each with its threshold."""

    def __init__(self, forests: list[tuple[list[int], Forest]]) -> None:
        self.forests = forests

    def steps(self, rows: np.ndarray) -> np.ndarray:
        """The scores of each forest in whole STEPS."""
        return np.array([np.floor(forest.scores(rows[:, columns]) * STEPS) for columns, forest in self.forests], dtype=np.int64).reshape(len(self.forests), len(rows))

    def calibrate(self, good: np.ndarray, bad: np.ndarray) -> None:
        """Thresholds at the share of good rows that may go; a forest that doesn't find bad rows much likelier has no say.

        good and bad: for each forest, the number of labelled rows at each step."""
        for (_, forest), fine, poor in zip(self.forests, good, bad):
            n, most = int(fine.sum()), int(poor.sum())
            # the lowest step over which no more good rows are than may go
            forest.threshold = float(np.searchsorted(np.cumsum(fine), n - int(GOOD_LOST * n))) if n else np.inf
            if most and n and poor[int(forest.threshold) + 1 :].sum() / most < GAIN * GOOD_LOST:
                forest.threshold = np.inf

    def verdicts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest score of each row, and whether any forest rejects it."""
        steps = self.steps(rows)
        limits = np.array([forest.threshold for _, forest in self.forests])
        return steps.max(0) / STEPS, (steps > limits[:, None]).any(0)


def _table(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return features({c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in COUNTS})


def _grown(part: pa.Table) -> pa.Table:
    """The trees of one number, a row for each group of columns."""
    number, rows = part.column("_tree")[0].as_py(), _table(part)
    found = [(k, number, len(rows), *(x.tolist() for x in Forest.grow(rows[:, list(g)], 1000 * k + number))) for k, g in enumerate(GROUPS)]
    return pa.table(dict(zip(("forest", "tree", "n", "column", "split", "left", "right"), map(pa.array, zip(*found)))))


def grow(usable: DataFrame, id_col: str) -> Judge | None:
    """Forests of which each row is in a tree, in more while a tree has under TREE_ROWS; None with under two rows.

    A forest's trees are dealt the same rows, once for all forests; a task holds the rows of one tree."""
    n = usable.count()
    if n < 2:
        return None
    copies = min(TREES, -(-TREES * TREE_ROWS // n))
    first = F.pmod(F.xxhash64(id_col, *COUNTS), F.lit(TREES))
    dealt = usable.select(*COUNTS, F.explode(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda k: ((first + k) % TREES).cast("int"))).alias("_tree"))
    schema = "forest long, tree long, n long, column array<long>, split array<double>, left array<long>, right array<long>"
    trees = sorted(dealt.groupBy("_tree").applyInArrow(_grown, schema).collect(), key=lambda r: (r["forest"], r["tree"]))
    of = lambda k: [r for r in trees if r["forest"] == k]
    arrays = lambda r: tuple(np.array(r[c]) for c in ("column", "split", "left", "right"))
    return Judge([(list(g), Forest.of([arrays(r) for r in of(k)], float(np.mean([r["n"] for r in of(k)])))) for k, g in enumerate(GROUPS)])


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Judge | None:
    """Forests grown on all rows with LEAST_WORDS, thresholds from all labelled ones that pass the base rules; None without rows.

    Only counts of rows for each step of a score come to the driver, at most STEPS for each forest and label."""
    usable = stats.where(F.col("n_words") >= LEAST_WORDS)
    judge_ = grow(usable, id_col)
    if judge_ is None:
        return None
    known = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg((F.min(label_col) > 0).alias("_good"))
    fair = usable.where(100 * F.col("n_repeat_words") <= MOST_REPEATED * F.col("n_words")).join(known, id_col).select("_good", *COUNTS)
    sent = stats.sparkSession.sparkContext.broadcast(judge_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps, fine = sent.value.steps(_table(batch)), batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            key, n = np.unique((np.arange(len(steps))[:, None] * 2 + fine) * (STEPS + 1) + steps, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    counts = np.zeros((len(GROUPS), 2, STEPS + 1), np.int64)
    for key, n in map_arrow(fair, run, "key long, n long").groupBy("key").agg(F.sum("n")).collect():
        counts.reshape(-1)[key] = n
    judge_.calibrate(counts[:, 1], counts[:, 0])
    return judge_


def judge(stats: DataFrame, judge_: Judge | None) -> DataFrame:
    """stats with score, base_failed and kept."""
    schema = T.StructType(list(stats.schema)).add("score", "double").add("base_failed", "boolean").add("kept", "boolean")
    sent = stats.sparkSession.sparkContext.broadcast(judge_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            found = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in COUNTS}
            failed = (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * found["n_words"])
            score, rejected = held.verdicts(features(found)) if held else (np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool))
            kept = ~failed & ~rejected
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(failed), pa.array(kept)], schema.names)

    return map_arrow(stats, run, schema)
