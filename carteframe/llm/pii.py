"""PII with candidate gradient boosting, in built-in functions only.

Fixed patterns and checks give the base spans. Beside them, wide generators propose overlapping spans of the same kinds;
small boosted trees score each from its format and context, and those over a calibrated threshold that overlap no base
span are added. The trees learn from the corpus itself: a proposal that holds a base span is an example of its kind, any
other is a counterexample. The marks by which base patterns know their kind (a plus, a plain @, undivided dots) are no
features, so that other spellings of the same thing score alike. Trees become CASE expressions; training sees a sample
of bounded size; no Python runs on executors.

Every step over the spans of one text is linear or n log n, so that a text may hold any number: places are sums of gaps,
taken in chunks; overlaps are found by binary search among the sorted, disjoint spans of each kind.

Defined cases: null and empty texts have no spans; positions are code points, ends exclusive; repeated rows are each
judged; without examples or counterexamples of a kind nothing is added to it; an empty table stays empty; other columns
are kept by ``redact`` and ``spans``, which replaces a column that is named like its result.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, spread_sample

#: Kinds in the order of their spans.
KINDS = ("email", "ip", "card", "phone")
#: Texts and proposals that training may see, at most.
SAMPLE_TEXTS, SAMPLE_ROWS = 4000, 20_000
#: Precision on held-out proposals at which a kind's threshold is set, rounds, rate.
PRECISION, ROUNDS, RATE = 0.99, 20, 0.3

#: The base patterns, with possessive repeats and left edges that keep each search linear. A card's run is
#: taken only where it has 13 digits or more: shorter ones fail its check and take nothing from their neighbours.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must have for its kind to be looked for at all.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
#: The generators and their hints.
WIDE = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?+(?:@|\(at\)|\[at\]) ?+[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*+", r"@|\(at\)|\[at\]"),
    "ip": (r"(?<![0-9.])[0-9]++(?:(?: ?\. ?|\[\.\]|\(\.\))[0-9]++){2,}+", r"[0-9] ?[\[(]?\."),
    "card": (r"(?<![0-9])[0-9](?:[ .-]{0,2}+[0-9]){10,}+", r"[0-9](?:[ .-]{0,2}[0-9]){10}"),
    "phone": (r"(?<![0-9])(?:\([0-9]++\) ?+)?+[0-9](?:[ ().-]{0,2}+[0-9]){6,}+", r"[0-9][0-9 ().-]{5,}[0-9]"),
}
FEATURES = ("chars", "digits", "groups", "longest", "brackets", "hyphens", "dots", "letters", "luhn", "high_parts", "glued_before", "glued_after", "last_letters", "contact_cue", "record_cue")
#: Characters before a proposal in which cues are looked for; fixed values: words near contact data, and near other numbers.
NEAR = 30
CONTACT = r"(?i)\b(?:tel|phone|call|ring|fax|mobile|cell|contact|mail|e-?mail|card|visa|mastercard|host|server|address|reach|whatsapp|sms)\b"
RECORD = r"(?i)\b(?:order|invoice|ref|reference|no|nr|number|id|isbn|sku|version|build|page|item|code|total|ticket|case|date|serial)\b"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum of up to 19 digits is a multiple of 10."""
    back = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _small_parts(hit: Column) -> Column:
    """Whether all runs of digits are numbers up to 255."""
    bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.regexp_extract_all(hit, F.lit("([0-9]+)"), F.lit(1)), lambda p: (F.length(bare(p)) <= 3) & (bare(p).try_cast("int") <= 255))


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return _small_parts(hit)
    if kind == "card":
        return F.when(F.length(_digits(hit)).between(13, 19), _luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


SPAN = "array<struct<start:bigint,end:bigint,hit:string,before:string,after:string>>"


def _let(value: Column, body) -> Column:
    """body(value), value computed once."""
    return F.transform(F.array(value), body)[0]


def found(text: Column, pattern: str, hint: str) -> Column:
    """Leftmost non-overlapping matches with their places and what stands around; an array of SPAN, empty for null.

    Places are running sums of gaps and hits: within chunks of about sqrt(n) matches, then over the chunks."""

    def inside(acc: Column, i: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gaps"][i])
        end = start + F.length(x["hits"][i])
        span = F.struct(start.alias("start"), end.alias("end"), i.alias("i"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def chunk(x: Column, size: Column, k: Column) -> Column:
        places = F.sequence(k * size, F.least((k + 1) * size, F.size(x["hits"])) - 1)
        nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,i:int>>").alias("out"))
        return F.aggregate(places, nothing, lambda acc, i: inside(acc, i, x))

    def onward(acc: Column, c: Column) -> Column:
        return F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("base"), c["out"].alias("part")))).alias("out"))

    def placed(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x["hits"]).cast("double"))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x["hits"]) / size).cast("int") - 1), lambda k: chunk(x, size, k))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<base:bigint,part:array<struct<start:bigint,end:bigint,i:int>>>>").alias("out"))
        based = F.aggregate(chunks, start, onward)["out"]

        def span(base: Column, s: Column) -> Column:
            before, i = x["gaps"][s["i"]], s["i"]
            glued = F.when((F.length(before) == 0) & (i > 0), F.right(x["hits"][F.greatest(i - 1, F.lit(0))], F.lit(1))).otherwise(F.right(before, F.lit(NEAR)))
            after = x["gaps"][i + 1]
            # the next match may follow at once
            after = F.when((F.length(after) == 0) & (i + 1 < F.size(x["hits"])), F.left(x["hits"][F.least(i + 1, F.size(x["hits"]) - 1)], F.lit(1))).otherwise(F.left(after, F.lit(1)))
            return F.struct((base + s["start"]).alias("start"), (base + s["end"]).alias("end"), x["hits"][i].alias("hit"), glued.alias("before"), after.alias("after"))

        every = F.flatten(F.transform(based, lambda c: F.transform(c["part"], lambda s: span(c["base"], s))))
        return F.when(F.size(x["hits"]) > 0, every).otherwise(F.array().cast(SPAN))

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(hint), _let(parts, placed)).otherwise(F.array().cast(SPAN))


def _last(array: Column, test) -> Column:
    """How many spans of array stand before the first that test refuses; test holds for a first part of array only."""
    start = F.struct(F.lit(0).alias("low"), F.size(array).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        at = F.least(middle, F.size(array) - 1)
        right, open_ = test(array[at]), acc["low"] < acc["high"]
        return F.struct(F.when(open_ & right, middle + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~right, middle).otherwise(acc["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(array) + F.lit(1))).cast("int"))
    return F.when(F.size(array) > 0, F.aggregate(steps, start, halve)["low"]).otherwise(0)


def _overlapped(array: Column, p: Column) -> Column:
    """Whether a span of the sorted, disjoint array overlaps p."""
    return _let(_last(array, lambda s: s["start"] < p["end"]), lambda n: F.when(n > 0, array[F.greatest(n - 1, F.lit(0))]["end"] > p["start"]).otherwise(False))


def base_spans(text: Column) -> dict[str, Column]:
    of = lambda kind: F.filter(found(text, BASE[kind], HINT[kind]), lambda s: _valid(kind, s["hit"]))
    return {k: of(k) for k in KINDS}


def _features(span: Column) -> dict[str, Column]:
    hit = span["hit"]
    count = lambda what: (F.length(hit) - F.length(F.regexp_replace(hit, what, ""))).cast("double")
    runs = F.regexp_extract_all(hit, F.lit("([0-9]+)"), F.lit(1))
    digits = _digits(hit)
    before, after = F.right(span["before"], F.lit(1)), span["after"]
    glued = lambda c: c.rlike("[A-Za-z0-9]").cast("double")
    return {
        "chars": F.length(hit).cast("double"), "digits": F.length(digits).cast("double"), "groups": F.size(runs).cast("double"),
        "longest": F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("double"), "brackets": count("[()\\[\\]]"), "hyphens": count("-"), "dots": count("\\."), "letters": count("[A-Za-z]"),
        "luhn": F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False).cast("double"), "high_parts": (~_small_parts(hit)).cast("double"),
        "glued_before": F.when(span["start"] > 0, glued(before)).otherwise(0.0), "glued_after": glued(after), "last_letters": F.length(F.regexp_extract(hit, "([A-Za-z]*)$", 1)).cast("double"),
        "contact_cue": span["before"].rlike(CONTACT).cast("double"), "record_cue": span["before"].rlike(RECORD).cast("double"),
    }


def proposals(text: Column, kind: str) -> Column:
    pattern, hint = WIDE[kind]
    return F.transform(found(text, pattern, hint), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), *(v.alias(k) for k, v in _features(s).items())))


@dataclass
class Trees:
    """Depth-2 trees for one kind: (column, split, (column, split, low, high) on either side)."""

    start: float
    trees: list[tuple]
    threshold: float

    def score(self, get) -> Column:
        """Probability as an expression; get(name) is a feature."""
        total = F.lit(self.start)
        for column, split, left, right in self.trees:
            leaf = lambda side: F.when(get(FEATURES[side[0]]) < side[1], side[2]).otherwise(side[3])
            total = total + F.when(get(FEATURES[column]) < split, leaf(left)).otherwise(leaf(right))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _stump(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float, float, float]:
    """The best single split for gradients g and weights h: gain, column, split, values below and above."""
    total_g, total_h = g.sum(), h.sum()
    value = lambda a, b: RATE * a / (b + 1.0)
    best = (0.0, 0, -math.inf, 0.0, value(total_g, total_h))
    for c in range(x.shape[1]):
        levels = np.unique(x[:, c])
        if len(levels) > 17:
            levels = np.unique(np.quantile(levels, np.linspace(0, 1, 17)))
        for split in (levels[1:] + levels[:-1]) / 2:
            low = x[:, c] < split
            a, b = g[low].sum(), h[low].sum()
            gain = a * a / (b + 1) + (total_g - a) ** 2 / (total_h - b + 1) - total_g**2 / (total_h + 1)
            if gain > best[0] + 1e-9:
                best = (gain, c, float(split), value(a, b), value(total_g - a, total_h - b))
    return best


def boosted(x: np.ndarray, y: np.ndarray) -> Trees | None:
    """Gradient boosting of logistic loss on every row but each fourth, the threshold from those."""
    held = np.arange(len(y)) % 4 == 3
    if min(y[~held].sum(), (1 - y[~held]).sum(), y[held].sum(), (1 - y[held]).sum()) < 5:
        return None
    rate = np.clip(y[~held].mean(), 0.01, 0.99)
    start, trees, score = float(np.log(rate / (1 - rate))), [], np.full(len(y), np.log(rate / (1 - rate)))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = np.where(held, 0, y - p), np.where(held, 0, p * (1 - p))
        _, column, split, *_rest = _stump(x, g, h)
        low = x[:, column] < split
        sides = []
        for part in (low, ~low):
            _, c, s, a, b = _stump(x[part], g[part], h[part]) if part.any() else (0, 0, -math.inf, 0.0, 0.0)
            sides.append((c, s, a, b))
            score[part] += np.where(x[part, c] < s, a, b)
        trees.append((column, split, *sides))
    p, truth = 1 / (1 + np.exp(-score[held])), y[held]
    order = np.argsort(-p, kind="stable")
    good = np.cumsum(truth[order]) / np.arange(1, len(order) + 1) >= PRECISION
    if not good.any():
        return None
    return Trees(start, trees, max(0.5, float(p[order[np.flatnonzero(good)[-1]]])))


def fit(docs: DataFrame, text_col: str = "text", sample_texts: int = SAMPLE_TEXTS, sample_rows: int = SAMPLE_ROWS) -> dict[str, Trees]:
    """Trees of each kind from the proposals of a bounded sample of sample_texts texts, sample_rows at most."""
    texts = docs.where(F.col(text_col).rlike(r"[0-9@]|\(at\)|\[at\]")).select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    # the sample is small but its texts are dear: dealt to all cores, and read for proposals once
    texts = spread_sample(texts, "h", sample_texts).repartition(max(8, docs.sparkSession.sparkContext.defaultParallelism), "h")
    base = texts.select("text", "h", *(v.alias(f"_{k}") for k, v in base_spans(F.col("text")).items()))

    def example(b: Column, p: Column) -> Column:
        """Whether a base span lies in p and is more than half of it; such a one is the last or last but one to begin before p's middle."""
        fits = lambda s: (s["start"] >= p["start"] - 2) & (s["end"] <= p["end"]) & (2 * (s["end"] - s["start"]) > p["end"] - p["start"])
        one = lambda k: F.when(k >= 0, fits(b[F.greatest(k, F.lit(0))])).otherwise(False)
        return _let(_last(b, lambda s: 2 * s["start"] <= p["start"] + p["end"]), lambda n: one(n - 1) | one(n - 2))

    holds = lambda kind: F.transform(proposals(F.col("text"), kind), lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("p"), example(F.col(f"_{kind}"), p).alias("y")))
    rows = base.select(F.explode(F.concat(*(holds(k) for k in KINDS))).alias("c"), "h").select("c.kind", "c.y", "c.p", "h", F.xxhash64("h", "c.p.start", "c.kind").alias("order"))
    rows = materialize(rows, "proposals")
    sample = spread_sample(rows, "order", sample_rows).select("order", "kind", F.col("y").cast("int").alias("y"), *(F.col(f"p.{f}").alias(f) for f in FEATURES)).collect()
    sample.sort(key=lambda r: r["order"])
    out = {}
    for kind in KINDS:
        own = [r for r in sample if r["kind"] == kind]
        if own and (trees := boosted(np.array([[r[f] for f in FEATURES] for r in own], float), np.array([r["y"] for r in own], float))):
            out[kind] = trees
    return out


def spans(docs: DataFrame, models: dict[str, Trees] | None = None, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """docs with out_col: struct of base and added, arrays of (kind, start, end) by kind and start.

    What is added overlaps no base span and nothing added of a kind before its own."""
    models = fit(docs, text_col) if models is None else models
    kept = [F.col(f"`{c}`") for c in docs.columns if c != out_col]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    place = lambda array: F.transform(array, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    names = {k: fresh(docs, f"_base_{k}") for k in KINDS}
    added = {k: fresh(docs, f"_added_{k}") for k in models}
    staged = docs.select(*kept, *(place(v).alias(names[k]) for k, v in base_spans(text).items()))
    chosen = lambda kind, trees: F.filter(proposals(text, kind), lambda p: trees.score(lambda f: p[f]) >= trees.threshold)
    staged = staged.select("*", *(place(chosen(k, m)).alias(added[k]) for k, m in models.items()))
    before = [F.col(n) for n in names.values()]
    for kind in models:
        clear = F.filter(F.col(added[kind]), lambda p: ~functools.reduce(lambda a, b: a | b, (_overlapped(array, p) for array in before)))  # noqa: B023
        staged = staged.withColumn(added[kind], clear)
        before.append(F.col(added[kind]))
    tagged = lambda kind, array: F.transform(array, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    both = F.struct(F.concat(*(tagged(k, F.col(names[k])) for k in KINDS)).alias("base"), F.concat(none, *(tagged(k, F.col(n)) for k, n in added.items())).alias("added"))
    return staged.withColumn(out_col, both).drop(*names.values(), *added.values())


def ordered(array: Column) -> Column:
    """Spans by kind as in KINDS, then start."""
    of = lambda kind: F.array_sort(F.filter(array, lambda s: s["kind"] == kind))
    return F.flatten(F.array(*(of(k) for k in KINDS)))


def digest(array: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Characters of a stretch of text that is cut at once.
STRETCH = 1000


def redact(docs: DataFrame, models: dict[str, Trees] | None = None, text_col: str = "text") -> DataFrame:
    """docs with every span of text_col replaced by [KIND]; null stays null. Of spans that overlap, the first is named."""
    name = fresh(docs, "_pii")
    marked = spans(docs, models, text_col, name)
    # each kind's spans, base and added, are disjoint: the last to begin has the furthest end
    of = {k: fresh(marked, f"_of_{k}") for k in KINDS}
    place = lambda kind: F.array_sort(F.transform(F.filter(F.concat(F.col(name)["base"], F.col(name)["added"]), lambda s: s["kind"] == kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    marked = marked.select("*", *(place(k).alias(c) for k, c in of.items()))
    rank = {k: i for i, k in enumerate(KINDS)}
    every = F.array_sort(F.concat(*(F.transform(F.col(c), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(rank[k]).alias("rank"))) for k, c in of.items())))

    def reach(s: Column) -> Column:
        """The furthest end of spans that sort before s."""
        ends = []
        for k, c in of.items():
            array = F.col(c)
            less = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(rank[k]).alias("rank")) < s  # noqa: E731, B023
            ends.append(_let(_last(array, less), lambda n: F.when(n > 0, array[F.greatest(n - 1, F.lit(0))]["end"]).otherwise(F.lit(0).cast("long"))))  # noqa: B023
        return F.greatest(*ends)

    heads = fresh(marked, "_heads")
    marked = marked.withColumn(heads, F.filter(F.transform(every, lambda s: F.struct(reach(s).alias("at"), s["start"].alias("start"), s["rank"].alias("rank"))), lambda h: h["start"] >= h["at"]))
    text, size = F.col(f"`{text_col}`"), F.lit(STRETCH).cast("long")

    def piece(stretches: Column, begin: Column, end: Column) -> Column:
        def cut(k: Column) -> Column:
            low = F.greatest(begin - k * size, F.lit(0).cast("long"))
            return F.substring(stretches[k.cast("int")], (low + 1).cast("int"), (F.least(end - k * size, size) - low).cast("int"))

        whole = F.array_join(F.transform(F.sequence(F.floor(begin / size), F.floor((end - 1) / size)), cut), "")
        return F.when(begin < end, whole).otherwise("")

    mark = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    furthest = F.greatest(*(F.coalesce(F.element_at(F.when(F.size(c) > 0, F.col(c)), -1)["end"], F.lit(0).cast("long")) for c in of.values()))
    cut = lambda x: F.concat(F.array_join(F.transform(F.col(heads), lambda h: F.concat(piece(x, h["at"], h["start"]), mark[h["rank"]])), ""), piece(x, furthest, F.length(text).cast("long")))
    whole = _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)), cut)
    return marked.withColumn(text_col, F.when(F.size(heads) > 0, whole).otherwise(text)).select(*(F.col(f"`{c}`") for c in docs.columns))
