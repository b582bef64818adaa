"""Text lines and blocks: quality, line types, headings, carried headers, sections, layout, and a text classifier."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names

#: Limits of a garbage line; words that speak for a menu.
LEAST_VOWELS, MOST_SYMBOLS, MOST_CONSONANTS = 0.20, 0.50, 6
MENU_WORDS = ["pizza", "calzone", "sub", "sandwich", "wrap", "salad", "wing", "burger", "fries", "pasta", "spaghetti", "lasagna", "garlic", "bread", "sticks", "cheese", "cheesy", "tenders", "nuggets", "combo", "special", "appetizer", "side", "dessert"]
PRICE = r"\$?\d{1,3}(?:\.\d{2})"


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, line_no (from 0) and line of every text."""
    return docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line_no", "line"))


def quality(text: Column) -> dict[str, Column]:
    """Characters, tokens, ratio of symbols, ratio of capitals by letters, and whether the text is junk."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    upper = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    symbols = names.symbol_ratio(text)
    return {"chars": F.length(text).cast("bigint"), "tokens": F.size(F.filter(F.split(text, r"\s+"), lambda t: t != "")).cast("bigint"), "symbol_ratio": symbols, "upper_ratio": F.when(letters > 0, upper / letters).otherwise(0.0), "junk": (symbols > 0.5) | (F.length(text) == 0)}


def is_garbage(line: Column) -> Column:
    """Too few vowels, too many symbols or too long a run of consonants; a price or a menu word allows more.

    What several rules need is computed once for a line, and a rule's words and runs are one pattern each."""
    blank = r"[ \t\n\x0B\f\r]{2,}|[\t\n\x0B\f\r]"  # a single space is one already

    def facts(t: Column) -> Column:
        low = F.lower(t)
        count = lambda kept: F.length(F.regexp_replace(t, kept, "")).alias
        run = F.array_max(F.transform(F.regexp_extract_all(low, F.lit(f"([bcdfghjklmnpqrstvwxz]{{{MOST_CONSONANTS + 1},}})"), F.lit(1)), F.length))
        return F.struct(
            F.length(t).alias("size"), count(r"[^\p{L}]+")("letters"), F.length(F.regexp_replace(low, "[^aeiouy]+", "")).alias("vowels"), count(r"[\p{L}\p{N} ]+")("symbols"),
            F.coalesce(run, F.lit(0)).alias("run"), t.rlike(PRICE).alias("priced"), low.rlike("|".join(MENU_WORDS)).alias("word"), t.contains(" ").alias("spaced"),
        )

    def judged(x: Column) -> Column:
        size, run, priced, alpha = x["size"], x["run"], x["priced"], x["letters"] > 0
        vowels, symbols = F.when(alpha, x["vowels"] / x["letters"]).otherwise(0.0), x["symbols"] / F.greatest(size, F.lit(1))
        menu = x["word"] | priced & alpha & (size >= 8) | alpha & x["spaced"] & (size >= 15)
        loose = (symbols > 0.85) & (vowels < 0.10) | (run > MOST_CONSONANTS + 4)
        middle = (vowels < 0.6 * LEAST_VOWELS) | (run > MOST_CONSONANTS + 2) | (symbols > 1.25 * MOST_SYMBOLS)
        strict = (vowels < LEAST_VOWELS) | (run > MOST_CONSONANTS) | (symbols > MOST_SYMBOLS)
        return F.when(size < 2, True).when(menu, loose).when(priced, middle).otherwise(strict)

    trimmed = F.transform(F.array(F.trim(F.regexp_replace(line, blank, " "))), facts)
    return F.transform(trimmed, judged)[0]


def line_type(line: Column) -> Column:
    """An ordered decision list: empty, price_only, size_header, heading, info_line, menu_item, description_only."""
    text = F.trim(line)
    words = F.size(F.filter(F.split(text, r"\s+"), lambda t: t != ""))
    priced = text.rlike(PRICE)
    sizes = F.size(F.regexp_extract_all(F.lower(text), F.lit(r"\b(small|medium|large|sm|med|lg|mini|family|\d{1,2}\s?(?:\"|in|inch))"), F.lit(1)))
    return (
        F.when(text == "", "empty").when(text.rlike(rf"^[\s.$]*{PRICE}\s*$"), "price_only").when(~priced & (sizes >= 2) & (words <= 12), "size_header")
        .when(~priced & (words <= 5) & (text == F.upper(text)) & text.rlike("[A-Z]"), "heading").when(text.rlike(r"(?i)^(add|extra|all .* (served|come)|choice of|served with)\b"), "info_line")
        .when(priced, "menu_item").when(text.rlike("^[a-z(]") | text.contains(","), "description_only").when(words <= 6, "menu_item").otherwise("description_only")
    )


def runs(rows: DataFrame, keys: Sequence[str], order: str, kind: str, least: int = 2) -> DataFrame:
    """Islands of least or more consecutive rows of one kind: keys, kind, first and last place, length."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    same = F.row_number().over(W.partitionBy(*keys, kind).orderBy(order))
    grouped = rows.withColumn("_island", place - same).groupBy(*keys, kind, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))
    return grouped.where(F.col("length") >= least).drop("_island")


def carried_header(rows: DataFrame, keys: Sequence[str], order: str, header: Column, reset: Column) -> DataFrame:
    """Each row with the place of the last header before it, unless a reset row stands between."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    head = F.max(F.when(header, F.col(order))).over(w)
    stop = F.max(F.when(reset, F.col(order))).over(w)
    return rows.withColumn("_head", head).withColumn("_stop", stop).withColumn("header_at", F.when(F.col("_stop").isNull() | (F.col("_head") > F.col("_stop")), F.col("_head"))).drop("_head", "_stop")


def sections(elements: DataFrame, keys: Sequence[str], order: str, is_header: Column, name: str) -> DataFrame:
    """As-of join in reading order: every element with the name of the nearest header above it and its number in that section."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = elements.withColumn("section", F.last(F.when(is_header, F.col(name)), ignorenulls=True).over(w)).withColumn("_n", F.count(F.when(is_header, 1)).over(w))
    return out.where(~is_header).withColumn("in_section", F.row_number().over(W.partitionBy(*keys, "_n").orderBy(order))).drop("_n")


def paired_prices(texts: DataFrame, prices: DataFrame, keys: Sequence[str], dy: int = 12, gap: tuple[int, int] = (-10, 150)) -> DataFrame:
    """Each price box with the nearest text box left of it: rows are cut into bands of height dy, so only neighbours meet."""
    band = F.floor(F.col("y") / dy)
    left = texts.withColumn("_band", F.explode(F.array(band - 1, band, band + 1))).select(*keys, "_band", F.col("box").alias("text_box"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("w").alias("tw"))
    right = prices.withColumn("_band", band).select(*keys, "_band", F.col("box").alias("price_box"), F.col("x").alias("px"), F.col("y").alias("py"))
    off, space = F.abs(F.col("py") - F.col("ty")), F.col("px") - F.col("tx") - F.col("tw")
    near = left.join(right, [*keys, "_band"]).withColumn("off", off).withColumn("space", space).where((F.col("off") <= dy) & F.col("space").between(*gap))
    best = near.groupBy(*keys, "price_box").agg(F.min(F.struct("off", F.abs("space").alias("s"), "text_box")).alias("best"))
    return best.select(*keys, "price_box", F.col("best.text_box").alias("text_box"), F.col("best.off").alias("off"))


def group_words(words: DataFrame, keys: Sequence[str], schema: str) -> DataFrame:
    """Words of a page to lines: by centre, with a line centre that drifts (0.85 old, 0.15 new). The state depends on every
    word before, so each page is one group; a page is small."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y", "x"], kind="stable").reset_index(drop=True)
        centre, limit = page["y"] + page["h"] / 2, 0.6 * page["h"].median()
        line, at, out = -1, None, []
        for c in centre:
            if at is None or abs(c - at) > limit:
                line, at = line + 1, c
            else:
                at = 0.85 * at + 0.15 * c
            out.append(line)
        page["line"] = out
        return page

    return words.groupBy(*keys).applyInPandas(run, schema)


class Classifier:
    """Multinomial naive Bayes over hashed words; counts are aggregated in Spark, only the table of counts is collected."""

    BUCKETS = 4096

    def __init__(self, labels: list[str], counts: np.ndarray, docs: np.ndarray) -> None:
        self.labels = labels
        self.weights = np.log((counts + 1) / (counts + 1).sum(1, keepdims=True))
        self.prior = np.log(docs / docs.sum())

    @staticmethod
    def words(text: Column) -> Column:
        return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.length(w) > 1)

    @classmethod
    def fit(cls, rows: DataFrame, text: str, label: str) -> Classifier:
        bucket = F.pmod(F.xxhash64("w"), F.lit(cls.BUCKETS)).alias("b")
        counts = rows.select(F.col(label).cast("string").alias("label"), F.explode(cls.words(F.col(text))).alias("w")).groupBy("label", bucket).count().collect()
        docs = {r["label"]: r["count"] for r in rows.groupBy(F.col(label).cast("string").alias("label")).count().collect()}
        labels = sorted(docs)
        table = np.zeros((len(labels), cls.BUCKETS))
        for r in counts:
            table[labels.index(r["label"]), r["b"]] = r["count"]
        return cls(labels, table, np.array([docs[k] for k in labels], float))

    def predict(self, rows: DataFrame, text: str) -> DataFrame:
        """rows with predicted; buckets are made in the engine, the sum of weights in Arrow batches."""
        buckets = F.transform(self.words(F.coalesce(text, F.lit(""))), lambda w: F.pmod(F.xxhash64(w), F.lit(self.BUCKETS)).cast("int"))
        sent = rows.sparkSession.sparkContext.broadcast((self.labels, self.weights, self.prior))

        @F.pandas_udf("string")
        def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            labels, weights, prior = sent.value
            for batch in batches:
                yield pd.Series([labels[int((prior + weights[:, np.asarray(b, int)].sum(1)).argmax())] for b in batch])

        return rows.withColumn("predicted", label(buckets))
