"""MinHash near-dedup with sequential Bayesian verification.

1. A pass over the texts makes shingle sets, set fingerprints and signatures; equal sets form a class at once.
2. Bands of class representatives' signatures make buckets. Each bucket's least member is its leader; pairs of a leader
   and a member are pruned on signatures alone, batch by batch: a pair goes as soon as the posterior probability of a
   similarity over the threshold falls under the miss probability.
3. Survivors are confirmed on their full shingle sets: first each representative with its likeliest leader, then with
   those of other components. A leader's text travels once for many members, and only texts of survivors travel at all.
4. Members of buckets that still hold several components are compared with each other in blocks, on signatures; only
   members of surviving pairs then come with their texts, and only links leave a block.
5. Components by contraction: every node points to its least neighbour, pointers are doubled, the graph shrinks; what is
   small enough is solved in one task.

Shingles are named by 64-bit hashes. Wherever full sets are compared, the names in hand are checked against the words
themselves, and texts with a collision are compared on words. Sizes count names; sets with equal 128-bit fingerprints
count as equal.

Defined cases: ids are integers of any width, others are refused; a text with fewer words than a shingle has one shingle,
its words; without words, or null, it has none and is linked with nothing; rows with one id are one document, linked if
any of its texts is; a row without id stands alone, with component null; other columns, whatever their names, are
ignored by ``components_of`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import fresh, integer_ids, map_arrow, materialize, slices

SHINGLE = 5
#: Default similarity in hundredths; a link has 100 * intersection >= SIMILARITY * union.
SIMILARITY = 80
#: Most hashes of a signature, hashes of a batch.
HASHES, BATCH = 192, 30
#: Probability with which banding, and again pruning, may miss a pair just at the threshold.
MISS = 1e-6
#: Representatives, and shingles of their texts, of a block when members of one bucket are compared with each other.
BLOCK, BLOCK_SHINGLES = 512, 500_000
#: Members, and bytes of their texts, that one copy of a leader serves, about.
SERVED, SERVED_BYTES = 512, 4_000_000
#: Links that one task may solve.
FEW_LINKS = 500_000


@functools.cache
def plan(similarity: int, most: int = HASHES, miss: float = MISS) -> tuple[int, int]:
    """Rows and bands: the longest bands whose miss probability at the threshold is in bounds."""
    for rows in range(most, 0, -1):
        bands = math.ceil(math.log(miss) / math.log1p(-((similarity / 100) ** rows)))
        if rows * bands <= most:
            return rows, bands
    return 1, most


@functools.cache
def least_matches(similarity: int, hashes: int, miss: float = MISS) -> tuple[int, ...]:
    """For each n: the fewest matches of n at which P(similarity >= threshold | matches) >= miss, with a uniform prior.

    The posterior is Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m)."""
    t, out = similarity / 100, [0]
    for n in range(1, hashes + 1):
        below, m = 0.0, -1
        while below < miss and m < n:
            m += 1
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def shingle_sets(array: pa.Array, size: int = SHINGLE, checked: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, as numbers, and the n + 1 indexes of each text's first.

    checked: different shingles of the given texts surely have different numbers. Equal ones have equal numbers in other
    calls, too, unless a collision was found here."""
    data, offsets = K.buffers(array)
    starts, ends, first = K.words(data, offsets, K.SPACED)
    hashes, counts = K.word_hashes(data, starts, ends, lower=True), np.diff(first)
    at, by_text = K.windows(first, size)
    whole = np.flatnonzero((counts > 0) & (counts < size))
    doc = np.concatenate((K.owner(by_text), whole))
    values = np.concatenate((K.window_hashes(hashes, at, size), K.span_hashes(hashes, first[whole], first[whole + 1])))
    head, length = np.concatenate((at, first[whole])), np.concatenate((np.full(len(at), size), counts[whole]))
    if checked and not _injective(data, starts, ends, hashes, values, head, length, size):
        values = _numbered(data, starts, ends, head, length)
    keys = values + K.mix(doc.astype(K.U))
    order = np.argsort(keys)
    fresh_ = np.ones(len(keys), bool)
    fresh_[1:] = keys[order][1:] != keys[order][:-1]
    kept = order[fresh_]
    kept = kept[np.argsort(doc[kept], kind="stable")]
    return values[kept], np.searchsorted(doc[kept], np.arange(len(counts) + 1))


def _leads(values: np.ndarray) -> np.ndarray:
    """For each value the place of one that equals it, the same for all."""
    order = np.argsort(values)
    ranked = values[order]
    head = np.ones(len(values), bool)
    head[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(values), np.int64)
    out[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(values) else order
    return out


def _injective(data, starts, ends, hashes, values, head, length, size: int) -> bool:
    """Whether no two different words share a hash and no two different shingles a name, looked up in the texts."""
    lead = _leads(hashes)
    if not K.same_strings(data, starts, ends, data, starts[lead], ends[lead], lower=True).all():
        return False
    like = _leads(values)
    if (length[like] != length).any():
        return False
    for k in range(size):
        some = length > k
        if (lead[head[some] + k] != lead[head[like[some]] + k]).any():
            return False
    return True


def _numbered(data, starts, ends, head, length) -> np.ndarray:
    """Numbers of shingles by their words, in plain Python; taken only where hashes collide."""
    raw, seen = data.tobytes(), {}
    words = [raw[a:b].lower() for a, b in zip(starts.tolist(), ends.tolist())]  # of bytes, lower() changes A-Z alone
    return np.array([seen.setdefault(tuple(words[a : a + n]), len(seen)) for a, n in zip(head.tolist(), length.tolist())], K.U)


@functools.cache
def _permutations(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = K.mix(np.arange(1, 2 * hashes + 1, dtype=K.U) * K.U(0x9E3779B97F4A7C15))
    return seeds[:hashes], seeds[hashes:] | K.U(1)


def signatures(values: np.ndarray, first: np.ndarray, hashes: int) -> np.ndarray:
    """Of each set the least value under each permutation, upper 32 bits; sets without members have zeros."""
    out = np.zeros((len(first) - 1, hashes), np.uint32)
    full = np.flatnonzero(np.diff(first) > 0)
    flips, factors = _permutations(hashes)
    begin = 0
    while begin < len(full):  # some sets at a time, so that their values stay in the cache
        end = max(begin + 1, int(np.searchsorted(first[full], first[full[begin]] + 16_384)))
        rows = full[begin:end]
        base, heads = first[rows[0]], first[rows] - first[rows[0]]
        part = values[base : first[rows[-1] + 1]]
        room = np.empty_like(part)
        for k in range(hashes):
            np.bitwise_xor(part, flips[k], out=room)
            np.multiply(room, factors[k], out=room)
            out[rows, k] = np.minimum.reduceat(room, heads) >> K.U(32)
        begin = end
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = len(rows), rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(array: pa.Array, hashes: int) -> np.ndarray:
    data, _ = K.buffers(array)
    return data.view(np.uint32).reshape(-1, hashes) if len(data) else np.zeros((0, hashes), np.uint32)


def likely(a: np.ndarray, b: np.ndarray, similarity: int) -> np.ndarray:
    """Which rows of two signature matrices stay after all batches."""
    hashes = a.shape[1]
    least, open_, same = least_matches(similarity, hashes), np.arange(len(a)), np.zeros(len(a), np.int64)
    for begin in range(0, hashes, BATCH):
        end = min(begin + BATCH, hashes)
        same[open_] += (a[open_, begin:end] == b[open_, begin:end]).sum(1)
        open_ = open_[same[open_] >= least[end]]
    out = np.zeros(len(a), bool)
    out[open_] = True
    return out


def sketch(docs: DataFrame, similarity: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), x and y (set fingerprint; null without members), signature."""
    rows, bands = plan(similarity)
    hashes = rows * bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, first = shingle_sets(batch.column(1), checked=False)
            n = np.diff(first)
            prints = []
            for seed in (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D):
                total = np.concatenate((np.zeros(1, K.U), np.cumsum(K.mix(values ^ K.U(seed)))))
                prints.append(pa.array((total[first[1:]] - total[first[:-1]]).view(np.int64), mask=n == 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *prints, _binary(signatures(values, first, hashes))], ["id", "n", "x", "y", "signature"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_arrow(source, run, "id long, n long, x long, y long, signature binary")


def _bucket_hashes(sign: np.ndarray, similarity: int) -> np.ndarray:
    """A row of bucket numbers, one for each band, of every signature."""
    rows, bands = plan(similarity)
    table = sign.reshape(-1, bands, rows).astype(K.U)
    out = np.broadcast_to(K.mix(np.arange(1, bands + 1, dtype=K.U)), table.shape[:2]).copy()
    for k in range(rows):
        out = K.mix(out * K.U(0x9FB21C651E98DF25) + table[:, :, k])
    return out


def _buckets(similarity: int):
    rows, bands = plan(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = _bucket_hashes(_matrix(batch.column(1), rows * bands), similarity)
            ids = np.repeat(batch.column(0).to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel().view(np.int64)), pa.array(ids)], ["bucket", "rep"])

    return run


def _by_leader(column: str, compare) -> Callable:
    """Reads rows (a, salt, member, id, ...) sorted by (a, salt, member): a leader's rows, then its members'.

    compare(leaders, members) gets them as batches and tells which members stay; a slice of rows is all that is held,
    and the leaders of the last key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaders = None, None
        for batch in slices(batches, column):
            a, salt, member = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
            edge = np.flatnonzero((a[1:] != a[:-1]) | (salt[1:] != salt[:-1])) + 1
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for begin, end in itertools.pairwise([0, *edge.tolist(), len(a)]):
                if begin == end:
                    continue
                part, here = batch.slice(begin, end - begin), int(end - begin - member[begin:end].sum())
                if (a[begin], salt[begin]) != key:
                    key, leaders = (a[begin], salt[begin]), None
                if here:
                    leaders = part.slice(0, here) if leaders is None else pa.concat_batches([leaders, part.slice(0, here)])
                part = part.slice(here)
                if part.num_rows and leaders is not None:
                    ids = part.column(3).to_numpy()[compare(leaders, part)]
                    found.append((np.full(len(ids), a[begin]), ids))
            pairs = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["a", "b"])

    return run


def _likely_members(similarity: int):
    rows, bands = plan(similarity)

    def compare(leaders: pa.RecordBatch, members: pa.RecordBatch) -> np.ndarray:
        n, sign = members.column(4).to_numpy(), _matrix(members.column(5), rows * bands)
        out = np.zeros(len(n), bool)
        for m, own in zip(leaders.column(4).to_numpy().tolist(), _matrix(leaders.column(5), rows * bands), strict=True):
            able = np.flatnonzero(100 * np.minimum(n, m) >= similarity * np.maximum(n, m))  # sizes bound the similarity, too
            out[able[likely(sign[able], np.broadcast_to(own, (len(able), rows * bands)), similarity)]] = True
        return out

    return compare


def _linked_members(similarity: int):
    def compare(leaders: pa.RecordBatch, members: pa.RecordBatch) -> np.ndarray:
        heads = leaders.num_rows
        values, first = shingle_sets(pa.concat_arrays([leaders.column(4), members.column(4)]))
        owner, n = K.owner(first), np.diff(first)
        out = np.zeros(members.num_rows, bool)
        rest = values[first[heads] :]
        for k in range(heads):
            own = np.sort(values[first[k] : first[k + 1]])
            if len(own):
                spot = np.minimum(np.searchsorted(own, rest), len(own) - 1)
                both = np.bincount(owner[first[heads] :] - heads, own[spot] == rest, minlength=members.num_rows).astype(np.int64)
                out |= (n[heads:] > 0) & (100 * both >= similarity * (len(own) + n[heads:] - both))
        return out

    return compare


def _beside(pairs: DataFrame, rows: DataFrame, column: str, compare) -> DataFrame:
    """Those of the pairs (a, b) that compare lets stay. rows: id, n and column, all ids that can be in a pair.

    Every leader a goes out once for some SERVED of its members, so no key is large; nothing is held but a stream."""
    size = pairs.groupBy("a").agg(F.count("*").alias("m"))
    parts = F.ceil(F.col("m") / SERVED)
    if column == "text":  # members are about as long as their leader
        own = rows.groupBy(F.col("id").alias("_id")).agg(F.max(F.octet_length("text")).alias("bytes"))
        size = size.join(own, F.col("a") == F.col("_id"))
        parts = F.ceil(F.greatest(F.col("m") / SERVED, F.col("m") * F.col("bytes") / SERVED_BYTES))
    size = materialize(size.select("a", parts.cast("long").alias("parts")), "leader-parts")
    payload = ["id", column] if column == "text" else ["id", "n", column]
    content = rows.select(*payload)
    salt = F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt")
    members = pairs.join(size.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a")).select("a", salt, F.lit(True).alias("member"), "b")
    members = members.join(content, F.col("b") == F.col("id")).select("a", "salt", "member", *payload)
    leaders = size.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.lit(False).alias("member"))
    leaders = leaders.join(content, F.col("a") == F.col("id")).select("a", "salt", "member", *payload)
    sent = members.unionByName(leaders).repartition("a", "salt").sortWithinPartitions("a", "salt", "member")
    return map_arrow(sent, _by_leader(column, compare), "a long, b long").distinct()


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least labels of a few links, all of them in one task."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    high, low = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, place = np.unique(np.concatenate((high, low)), return_inverse=True)
    x, y = place[: len(high)], place[len(high) :]
    label = np.arange(len(nodes))
    while (open_ := label[x] != label[y]).any():
        x, y = x[open_], y[open_]
        a, b = label[x], label[y]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["node", "label"])


def components(links: DataFrame) -> DataFrame:
    """node and label, the least node of its component, for every node with a smaller one; links: a, b, any order."""
    edges = links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).where("high > low").distinct()
    edges, labels = materialize(edges, "edges"), None
    while (left := edges.count()) > 0:
        if left <= FEW_LINKS:
            tree = materialize(map_arrow(edges.select("high", "low").coalesce(1), _solved, "node long, label long"), "tree")
            return tree if labels is None else relabelled(labels, tree)
        tree = materialize(edges.groupBy("high").agg(F.min("low").alias("low")).select(F.col("high").alias("node"), F.col("low").alias("label")), "tree")
        while True:  # pointers are doubled until they reach roots
            up = tree.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
            if tree.join(up, F.col("label") == F.col("_node"), "left_semi").isEmpty():
                break
            for _ in range(2):
                up = tree.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
                tree = tree.join(up, F.col("label") == F.col("_node"), "left").select("node", F.coalesce("_label", "label").alias("label"))
            tree = materialize(tree, "tree")
        labels = tree if labels is None else relabelled(labels, tree)
        edges = materialize(_between(edges, tree, "high", "low"), "edges")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("label")).where("false")


def _between(links: DataFrame, labels: DataFrame, a: str, b: str) -> DataFrame:
    """The links between different components, each once, as pairs of their labels; names are kept."""
    named = _labelled(_labelled(links, labels, a, "_a"), labels, b, "_b").where("_a != _b")
    return named.select(F.greatest("_a", "_b").alias(a), F.least("_a", "_b").alias(b)).distinct()


def relabelled(labels: DataFrame, further: DataFrame) -> DataFrame:
    """labels after their components were joined as further says; nodes new in further are added."""
    more = further.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    old = labels.join(more, F.col("label") == F.col("_node"), "left").select("node", F.coalesce("_label", "label").alias("label"))
    return materialize(old.unionByName(further.join(labels.select("node"), "node", "left_anti")), "labels")


def _labelled(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    own = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return rows.join(own, F.col(column) == F.col("_node"), "left").withColumn(name, F.coalesce("_label", column)).drop("_node", "_label")


def _pairs_of_block(table: pa.Table, similarity: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each away member of a block, the home members of other components that may be linked with it.

    A pair is compared in the first bucket that it shares only."""
    rows, bands = plan(similarity)
    label, home, n = (table[c].to_numpy() for c in ("label", "home", "n"))
    sign = _matrix(table["signature"].combine_chunks(), rows * bands)
    bucket = _bucket_hashes(sign, similarity)
    band = int(np.flatnonzero(bucket[0].view(np.int64) == table["bucket"][0].as_py())[0])
    here = np.flatnonzero(home)
    for i in np.flatnonzero(~home).tolist():
        other = here[(label[here] != label[i]) & (100 * np.minimum(n[here], n[i]) >= similarity * np.maximum(n[here], n[i]))]
        other = other[~(bucket[other, :band] == bucket[i, :band]).any(1)]
        yield i, other[likely(sign[other], np.broadcast_to(sign[i], (len(other), rows * bands)), similarity)]


def _suspects(similarity: int):
    """Of one block, without texts: the members of any pair that signatures let stay, each once."""

    def run(table: pa.Table) -> pa.Table:
        kept = np.zeros(table.num_rows, bool)
        for i, other in _pairs_of_block(table, similarity):
            kept[other] = True
            kept[i] |= len(other) > 0
        return table.filter(pa.array(kept))

    return run


def _across(similarity: int):
    """Of one block's suspects, with texts: links between components. A pair that links found here connect is not
    compared any more, so that no more links leave than members came."""

    def run(table: pa.Table) -> pa.Table:
        ids, label = (table[c].to_numpy() for c in ("rep", "label"))
        values, first = shingle_sets(table["text"].combine_chunks())
        sets: dict[int, frozenset] = {}
        set_of = lambda i: sets.get(i) or sets.setdefault(i, frozenset(values[first[i] : first[i + 1]].tolist()))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        links = []
        for i, other in _pairs_of_block(table, similarity):
            for k in other.tolist():
                if find(int(label[i])) != find(int(label[k])):
                    both = len(set_of(i) & set_of(k))
                    if 100 * both >= similarity * (len(set_of(i)) + len(set_of(k)) - both):
                        root[find(int(label[i]))] = find(int(label[k]))
                        links.append((ids[i], ids[k]))
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _rest(members: DataFrame, labels: DataFrame, signs: DataFrame, docs: DataFrame, similarity: int) -> DataFrame | None:
    """Links between different components that share a bucket, those with its leader left out; None if there is no such bucket."""
    rows = materialize(_labelled(_labelled(members, labels, "rep", "label"), labels, "leader", "lead"), "members-labelled")
    mixed = rows.groupBy("bucket").agg(F.count("*").alias("m"), F.sum((F.col("label") != F.col("lead")).cast("long")).alias("v"))
    mixed = materialize(mixed.where("v > 0 and m > 2").select(F.col("bucket").alias("_bucket")), "buckets-mixed")
    if mixed.isEmpty():
        return None
    rows = rows.where("rep != leader").join(mixed, F.col("bucket") == F.col("_bucket"), "left_semi")
    rows = materialize(rows.join(signs, F.col("rep") == F.col("id")).drop("id"), "members-mixed")
    # blocks are bounded in rows and in shingles
    blocks = lambda which: F.ceil(F.greatest(F.sum(which.cast("long")) / BLOCK, F.sum(F.when(which, F.col("n"))) / BLOCK_SHINGLES)).alias
    strange = F.col("label") != F.col("lead")
    sizes = materialize(rows.groupBy(F.col("bucket").alias("_bucket")).agg(blocks(F.lit(True))("homes"), blocks(strange)("aways")).where("aways > 0"), "blocks")
    rows = rows.join(sizes, F.col("bucket") == F.col("_bucket")).drop("_bucket")
    at = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    kept = ["rep", "label", "n", "signature"]
    home = rows.select("bucket", at("homes", 1).alias("i"), every("aways").alias("j"), *kept, F.lit(True).alias("home"))
    away = rows.where(strange).select("bucket", every("homes").alias("i"), at("aways", 2).alias("j"), *kept, F.lit(False).alias("home"))
    both = home.unionByName(away)
    suspects = materialize(both.groupBy("bucket", "i", "j").applyInArrow(_suspects(similarity), both.schema), "suspects")
    texts = _texts(docs, suspects.select(F.col("rep").alias("_id")))
    asked = suspects.join(texts.select(F.col("id").alias("_id"), "text"), F.col("rep") == F.col("_id")).drop("_id")
    return asked.groupBy("bucket", "i", "j").applyInArrow(_across(similarity), "a long, b long")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of the documents in ids (_id)."""
    ids = materialize(ids.distinct(), "asked")
    return materialize(docs.join(ids, F.col("id") == F.col("_id"), "left_semi").select("id", "text"), "texts")


def components_of(docs: DataFrame, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the least id reachable over links)."""
    integer_ids(docs, id_col)
    sketches = materialize(sketch(docs, similarity, id_col, text_col), "sketches")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    # equal sets are one class, of which the least id stands for all
    usable = sketches.where("id is not null and x is not null")
    classes = materialize(usable.groupBy("x", "y").agg(F.min("id").alias("rep"), F.min_by("signature", "id").alias("signature"), F.min("n").alias("n")), "classes")
    buckets = map_arrow(classes.select("rep", "signature"), _buckets(similarity), "bucket long, rep long")
    leaders = materialize(buckets.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count("*").alias("m")).where("m > 1").select(F.col("bucket").alias("_bucket"), "leader"), "leaders")
    members = materialize(buckets.join(leaders, F.col("bucket") == F.col("_bucket")).drop("_bucket"), "members")
    signs = classes.select(F.col("rep").alias("id"), "n", "signature")
    # every representative with every leader of its buckets, pruned on signatures
    stars = materialize(members.where("rep != leader").groupBy(F.col("leader").alias("a"), F.col("rep").alias("b")).count(), "stars")
    open_ = materialize(_beside(stars.select("a", "b"), signs, "signature", _likely_members(similarity)), "stars-open")
    open_ = materialize(stars.join(open_, ["a", "b"], "left_semi"), "stars-counted")
    texts = _texts(source, open_.select(F.explode(F.array("a", "b")).alias("_id")))
    # the likeliest leader first
    first = open_.groupBy("b").agg(F.max(F.struct(F.col("count"), (-F.col("a")).alias("minus"))).alias("best")).select((-F.col("best.minus")).alias("a"), "b")
    first = materialize(first, "stars-first")
    links = materialize(_beside(first, texts, "text", _linked_members(similarity)), "links")
    labels = components(links)
    # then the leaders of other components
    second = _labelled(_labelled(open_, labels, "a", "_a"), labels, "b", "_b").where("_a != _b").select("a", "b").join(first, ["a", "b"], "left_anti")
    links = materialize(_beside(materialize(second, "stars-second"), texts, "text", _linked_members(similarity)), "links")
    labels = _joined(labels, links)
    # then other members of mixed buckets
    third = _rest(members, labels, signs, source, similarity)
    if third is not None:
        labels = _joined(labels, materialize(third, "links"))
    of_class = materialize(_labelled(classes.select(F.col("x").alias("_x"), F.col("y").alias("_y"), "rep"), labels, "rep", "component_id").select("_x", "_y", "component_id"), "components")
    out = sketches.select("id", "n", "x", "y").join(of_class, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels with more links between their components."""
    if links.isEmpty():
        return labels
    return relabelled(labels, components(_between(links, labels, "a", "b")))


def deduplicate(docs: DataFrame, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those whose component has a smaller id; all columns kept, rows without id or text too."""
    name = fresh(docs, "_lost")
    found = components_of(docs, similarity, id_col, text_col)
    lost = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(materialize(lost, "lost"), F.col(f"`{id_col}`") == F.col(name), "left_anti")
