"""HTML extraction with a recurrent block labeller.

A page is cut into blocks (leaf texts under block-level elements). Each block is a vector: learned embeddings of the
hashed names on its tag path and of its hashed words, and a few shape numbers. A bidirectional LSTM in numpy reads the
whole sequence and labels every block as main text or not. It is trained here, on pages drawn from a seeded grammar of
page parts with known labels; no page of the corpus is used.

Reading takes time and memory in proportion to the page, whatever its nesting: a block holds the set of names on its path,
which children share with their parent where they add nothing, and closing tags are looked up, not searched for.

Defined cases: null and empty pages, and pages without main blocks, give an empty text; broken and unclosed markup is
read as far as it goes; only scripts, styles, templates and form controls (SILENT) are dropped unseen, everything else
is the labeller's to judge, formulas and fall-backs of embedded media among it; repeated rows are each read; an empty
table stays empty; other columns are kept by ``extract``.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import map_arrow, slices

#: Elements that don't end a block, that have no content, and whose content is never text.
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big br canvas cite code data dfn em font i iframe img ins del kbd label mark noscript object picture q rp rt ruby s samp small span strike strong sub sup time tt u var video wbr"
    " math semantics annotation mi mn mo ms mspace mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mmultiscripts mpadded mphantom mfenced menclose".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template textarea select datalist".split())
#: An opening one of these ends an open p; of the others, an open one of the same kind.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = ("ul", "ol", "dl", "table", "select")
#: Inside a tag any character but its end will do, and quotes bind only after =, so that no match is ever tried again.
_INSIDE = r"(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(script|style|template|textarea)\b{_INSIDE}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_INSIDE})(?:>|\Z)|[^<]+|<", re.S | re.I)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_PARTS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

BUCKETS, EMBEDDING, HIDDEN, SHAPES = 512, 12, 12, 5
#: Steps whose inputs are computed at once; steps of all pages that run together, padding counted.
STRETCH, CELLS = 4096, 50_000


@functools.lru_cache(100_000)
def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


def path(names: list[str], above: frozenset = frozenset()) -> frozenset:
    """The buckets of names and of those above; above itself if nothing is new."""
    more = {_bucket(n) for n in names}
    return above if more <= above else above | more


Block = tuple[str, frozenset, int]


def blocks(page: str) -> list[Block]:
    """(text, buckets of the names on the tag path, characters inside links) of all blocks with text, in page order."""
    out: list[Block] = []
    tags: list[str] = []
    paths: list[frozenset] = [frozenset()]
    places: dict[str, list[int]] = {}  # where each tag is open
    outer: list[int] = []  # where elements that end blocks are open
    parts: list[str] = []
    linked, silent, here = 0, 0, frozenset()

    def close() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = _SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip()
            if text:
                out.append((text, here, linked))
            parts.clear()
        linked = 0

    def last(tag: str) -> int:
        return at[-1] if (at := places.get(tag)) else -1

    def pop(to: int) -> None:
        nonlocal silent
        while len(tags) > to:
            tag = tags.pop()
            paths.pop()
            places[tag].pop()
            silent -= tag in SILENT
        while outer and outer[-1] >= to:
            outer.pop()

    for m in _TOKEN.finditer(page):
        raw, tag = m[0], m[3]
        if tag is None:
            if raw[0] != "<" or raw == "<":
                if not silent:
                    if not parts:
                        here = paths[-1]
                    parts.append(raw)
                    linked += len(raw) if places.get("a") else 0
            continue
        tag = tag.lower()
        if tag not in INLINE:
            close()
        elif tag == "br":
            parts.append(" ")
        if m[2]:
            if (k := last(tag)) >= 0:
                pop(k)
            continue
        if tag in ENDS_P and outer and tags[outer[-1]] == "p":
            pop(outer[-1])
        if (same := ENDS_SELF.get(tag)) is not None and (k := max(map(last, same))) > max(map(last, HOLDERS)):
            pop(k)
        if tag in VOID or m[4].endswith("/"):
            continue
        names = [tag]
        if m[4]:
            for value in _NAMES.findall(m[4]):
                names += [f".{w}" for w in _PARTS.findall(value.lower())]
        silent += tag in SILENT
        places.setdefault(tag, []).append(len(tags))
        if tag not in INLINE:
            outer.append(len(tags))
        tags.append(tag)
        paths.append(path(names, paths[-1]))
    close()
    return out


@functools.lru_cache(10_000)
def _sorted(buckets: frozenset) -> tuple[int, ...]:
    return tuple(sorted(buckets))


def inputs(found: list[Block]) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray]:
    """Path buckets; word buckets with the index of each block's first; shape numbers."""
    texts = pa.array([t for t, _, _ in found], pa.large_string())
    data, offsets = K.buffers(texts)
    starts, ends, first = K.words(data, offsets, K.ALNUM)
    words = (K.word_hashes(data, starts, ends, lower=True) % K.U(BUCKETS)).astype(np.int64)
    n = np.array([len(t) for t, _, _ in found], float)
    links = np.array([min(1.0, k / max(1, len(t))) for t, _, k in found])
    shapes = np.column_stack([np.log1p(n) / 5, np.log1p(np.diff(first)) / 4, links, n > 120, np.array([t[-1] in ".!?:\"'" for t, _, _ in found], float)])
    return [_sorted(p) for _, p, _ in found], words, first, shapes


class Labeller:
    """The network; parameters are a dict of arrays."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        d = 2 * EMBEDDING + SHAPES
        self.p = {"path": rng.normal(0, 0.3, (BUCKETS, EMBEDDING)), "word": rng.normal(0, 0.1, (BUCKETS, EMBEDDING)), "out": rng.normal(0, 0.3, (2 * HIDDEN + d, 1)), "bias": np.zeros(1)}
        for side in ("f", "b"):
            self.p |= {f"x{side}": rng.normal(0, d**-0.5, (d, 4 * HIDDEN)), f"h{side}": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"c{side}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}

    def vectors(self, found: list[Block]) -> tuple[np.ndarray, tuple]:
        paths, words, first, shapes = inputs(found)
        size = np.array([len(p) for p in paths])
        flat = np.array([b for p in paths for b in p], np.int64)
        owner = np.repeat(np.arange(len(paths)), size)
        path = np.zeros((len(paths), EMBEDDING))
        np.add.at(path, owner, self.p["path"][flat])
        count = np.maximum(1, np.diff(first))
        running = np.concatenate((np.zeros((1, EMBEDDING)), np.cumsum(self.p["word"][words], axis=0)))
        word = (running[first[1:]] - running[first[:-1]]) / count[:, None]
        return np.column_stack([path, word, shapes]), (flat, owner, words, K.owner(first), count)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, taped: bool = True) -> tuple[np.ndarray, list]:
        """x: pages by steps by inputs. Hidden states of all steps; steps outside a page keep the state at zero."""
        n, steps, _ = x.shape
        h, c, out, tape, held = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.zeros((n, steps, HIDDEN)), [], -1
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            if t // STRETCH != held:  # inputs of a stretch of steps at a time
                held = t // STRETCH
                ahead = x[:, held * STRETCH : (held + 1) * STRETCH] @ self.p[f"x{side}"] + self.p[f"c{side}"]
            z = ahead[:, t - held * STRETCH] + h @ self.p[f"h{side}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g, m = np.tanh(z[:, 3 * HIDDEN :]), mask[:, t, None]
            before, c = c, (f * c + i * g) * m
            last, bent = h, np.tanh(c)
            h = o * bent * m
            out[:, t] = h
            if taped:
                tape.append((t, i, f, o, g, before, last, bent, m))
        return out, tape

    def _back(self, x: np.ndarray, grad: np.ndarray, tape: list, side: str, total: dict) -> np.ndarray:
        dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
        dx = np.zeros_like(x)
        for t, i, f, o, g, before, last, bent, m in reversed(tape):
            d = (grad[:, t] + dh) * m
            dc = dc + d * o * (1 - bent**2)
            dc = dc * m
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), d * bent * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            total[f"x{side}"] += x[:, t].T @ dz
            total[f"h{side}"] += last.T @ dz
            total[f"c{side}"] += dz.sum(0)
            dx[:, t] = dz @ self.p[f"x{side}"].T
            dh, dc = dz @ self.p[f"h{side}"].T, dc * f
        return dx

    @staticmethod
    def _padded(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.arange(sizes.max(initial=1))[None, :] < sizes[:, None]
        out = np.zeros((*mask.shape, x.shape[1]))
        out[mask] = x
        return out, mask

    def scores(self, pages: list[list[Block]]) -> np.ndarray:
        """Probability of main text for all blocks of all pages, in one row. Pages of like length run together."""
        sizes = np.array([len(p) for p in pages])
        out = np.zeros(sizes.sum())
        if not len(out):
            return out
        x, _ = self.vectors([b for p in pages for b in p])
        first = np.concatenate(([0], np.cumsum(sizes)))
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        begin = 0
        while begin < len(order):  # as many as come to CELLS steps with their padding, one at least
            end = begin + 1
            while end < len(order) and end - begin < 128 and (end + 1 - begin) * sizes[order[end]] <= CELLS:
                end += 1
            some, begin = order[begin:end], end
            rows = np.concatenate([np.arange(first[k], first[k + 1]) for k in some])
            padded, mask = self._padded(x[rows], sizes[some])
            states = [self._run(padded, mask, side, taped=False)[0][mask] for side in ("f", "b")]
            out[rows] = 1 / (1 + np.exp(-(np.column_stack([*states, x[rows]]) @ self.p["out"] + self.p["bias"])[:, 0]))
        return out

    def train(self, pages: list[tuple[list[Block], list[int]]], epochs: int, rate: float = 0.01, batch: int = 32, seed: int = 11, decay: float = 0.02) -> None:
        """Adam on the mean cross-entropy of all blocks, its rate falling to a tenth."""
        rng = np.random.default_rng(seed)
        mean, square, step = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2)), None, 0
        first, second = mean
        for epoch in range(epochs):
            pace = rate * 0.1 ** (epoch / max(1, epochs - 1))
            order = rng.permutation(len(pages))
            for begin in range(0, len(order), batch):
                some = [pages[k] for k in order[begin : begin + batch]]
                sizes = np.array([len(b) for b, _ in some])
                x, (flat, owner, words, word_owner, count) = self.vectors([b for blocks_, _ in some for b in blocks_])
                truth = np.concatenate([np.array(y, float) for _, y in some])
                padded, mask = self._padded(x, sizes)
                runs = {side: self._run(padded, mask, side) for side in ("f", "b")}
                top = np.column_stack([runs["f"][0][mask], runs["b"][0][mask], x])
                guess = 1 / (1 + np.exp(-(top @ self.p["out"] + self.p["bias"])[:, 0]))
                error = ((guess - truth) / len(truth))[:, None]
                total = {k: np.zeros_like(v) for k, v in self.p.items()}
                total["out"], total["bias"] = top.T @ error, error.sum(0)
                back = error @ self.p["out"].T
                dx = back[:, 2 * HIDDEN :].copy()
                for k, side in enumerate(("f", "b")):
                    grad = np.zeros((*mask.shape, HIDDEN))
                    grad[mask] = back[:, k * HIDDEN : (k + 1) * HIDDEN]
                    dx += self._back(padded, grad, runs[side][1], side, total)[mask]
                np.add.at(total["path"], flat, dx[owner, :EMBEDDING])
                # pages have words that the grammar doesn't draw: word vectors are pulled to zero
                total["word"] += decay * self.p["word"] / len(truth)
                np.add.at(total["word"], words, (dx[:, EMBEDDING : 2 * EMBEDDING] / count[:, None])[word_owner])
                step += 1
                for k, g in total.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


class PageGrammar:
    """Draws pages with known labels: main text in one container, everything else around and inside it."""

    #: Names that page parts usually have.
    MENU = "nav menu navbar navigation breadcrumb breadcrumbs toc tabs".split()
    SIDE = "sidebar aside widget related rail recommended trending".split()
    NOTICE = "cookie consent notice banner popup modal alert newsletter subscribe gdpr paywall".split()
    ADVERT = "ad ads advert advertisement sponsor sponsored promo promotion".split()
    COMMENT = "comment comments reply replies discussion responses respond".split()
    SHARE = "share social follow tags meta byline pagination pager".split()
    MAIN = "content post entry story body text main article page".split()

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.syllables = ["".join(self.rng.choice(list("bcdfghlmnprstv")) + self.rng.choice(list("aeiou")) for _ in range(2)) for _ in range(80)]

    def one(self, options: list):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def prose(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        words = ["".join(self.one(self.syllables) for _ in range(int(self.rng.integers(1, 3)))) for _ in range(n)]
        text = " ".join(words).capitalize()
        return text + self.one([".", ".", ".", "", "!", "?", ":"])

    def wrap(self, tags: list[str], names: list[str], inner: str, named: float = 0.8) -> str:
        tag = self.one(tags)
        name = f' {self.one(["class", "id"])}="{self.one(names)}{self.one(["", "", "-box", "-list", " wrap", "_1"])}"' if self.chance(named) else ""
        return f"<{tag}{name}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{self.prose(1, 3)}</a></li>' for _ in range(int(self.rng.integers(low, high)))) + "</ul>"

    def off(self, text: str) -> str:
        """Marks text as not main; the mark is taken out again when blocks are read."""
        return text.replace(">", ">\x01")

    def heading(self) -> str:
        return f"<{(h := self.one(['h2', 'h3', 'h4', 'b']))}>{self.prose(1, 4)}</{h}>" if self.chance(0.4) else ""

    def boilerplate(self) -> str:
        kind = int(self.rng.integers(9))
        if kind == 0:
            return self.wrap(["nav", "div"], self.MENU, self.links(2, 8)) if self.chance(0.5) else f"<nav>{self.links(2, 8)}</nav>"
        if kind == 1:
            return self.wrap(["aside"], self.SIDE, f"<h3>{self.prose(1, 4)}</h3>" + self.links(1, 5) + f"<p>{self.prose(4, 30)}</p>", 0.6)
        if kind == 2:
            return self.wrap(["div", "section", "aside"], self.NOTICE, self.heading() + f"<p>{self.prose(5, 30)}</p><button>{self.prose(1, 2)}</button>", 1)
        if kind == 3:
            return self.wrap(["div", "section", "aside", "ins"], self.ADVERT, self.one([self.prose(2, 25), f"<p>{self.prose(3, 25)}</p>"]), 1)
        if kind == 4:
            return f'<form action="/s"><label>{self.prose(1, 3)}</label><input><p>{self.prose(2, 12)}</p><button>{self.prose(1, 2)}</button></form>'
        if kind == 5:
            return self.wrap(["div", "section", "ol", "ul"], self.COMMENT, self.heading() + "".join(self.one(["<div><p>{}</p></div>", "<p>{}</p>", "<li>{}</li>", "<div>{}</div>"]).format(self.prose(1, 40)) for _ in range(int(self.rng.integers(1, 5)))), 1)
        if kind == 6:
            return self.wrap(["div", "p", "ul"], self.SHARE, self.prose(1, 5), 1)
        if kind == 7:
            return f"<header>{self.prose(1, 6)}{self.links(0, 3)}</header>"
        return self.wrap(["div"], ["sidebar", "footer", "header", "masthead", "copyright", "legal"], f"<p>{self.prose(2, 30)}</p>", 1)

    def main(self) -> str:
        parts = [f"<h1>{self.prose(2, 12)}</h1>"] if self.chance(0.85) else []
        for _ in range(int(self.rng.integers(1, 11))):
            kind = self.rng.random()
            if kind < 0.55:
                parts.append(f"<p>{self.prose(1, self.one([4, 90, 90]))}</p>")
            elif kind < 0.64:
                parts.append(f"<p><b>{self.prose(1, 40)}<br>")
            elif kind < 0.70:
                parts.append(f"<{(h := self.one(['h2', 'h3', 'h4']))}>{self.prose(1, 8)}</{h}>")
            elif kind < 0.77:
                parts.append("<ul>" + "".join(f"<li>{self.prose(1, 20)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.82:
                parts.append(f"<blockquote><p>{self.prose(4, 40)}</p></blockquote>")
            elif kind < 0.86:
                parts.append(f"<table><tr><td>{self.prose(1, 4)}</td><td>{self.prose(1, 4)}</td></tr></table>")
            elif self.chance(0.8):
                parts.append(self.off(self.boilerplate()))
            else:
                parts.append(f"<div>{self.prose(3, 60)}</div>")
        inner = "".join(parts)
        kind = self.rng.random()
        return f"<article>{inner}</article>" if kind < 0.45 else f"<main>{inner}</main>" if kind < 0.55 else self.wrap(["div", "section", "article", "main"], self.MAIN, inner, 0.85)

    def page(self) -> tuple[list[Block], list[int]]:
        around = lambda p: "".join(self.off(self.boilerplate()) for _ in range(int(self.rng.integers(0, 4)))) if self.chance(p) else ""
        head = self.off(f"<head><title>{self.prose(2, 12)}</title></head>")
        foot = self.off(f"<footer>{self.one(['&copy; ', 'Copyright ', ''])}{self.prose(1, 20)}</footer>") if self.chance(0.7) else ""
        top = self.off(f"<nav>{self.links(2, 8)}</nav>") if self.chance(0.6) else ""
        found = blocks(f"<html>{head}<body>{top}{around(0.8)}{self.main()}{around(0.8)}{foot}</body></html>")
        found = [b for b in found if b[0].strip("\x01 ")]
        return [(t.replace("\x01", "").strip(), p, k) for t, p, k in found], [int("\x01" not in t) for t, _, _ in found]


@functools.cache
def trained(pages: int = 1500, epochs: int = 12, seed: int = 3) -> Labeller:
    """The labeller after training; some twenty seconds, once in a session."""
    grammar, labeller = PageGrammar(seed), Labeller()
    drawn = [grammar.page() for _ in range(pages)]
    labeller.train([p for p in drawn if p[0]], epochs)
    return labeller


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", labeller: Labeller | None = None) -> DataFrame:
    """All columns and text_col: blocks labelled as main text, joined by line breaks. A column already named text_col is replaced."""
    sent = pages.sparkSession.sparkContext.broadcast(labeller or trained())
    kept = [f for f in pages.schema.fields if f.name != text_col]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(text_col, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html_col):
            found = [blocks(h) if h else [] for h in batch.column(names.index(html_col)).to_pylist()]
            good = sent.value.scores(found) >= 0.5
            out, at = [], 0
            for page in found:
                out.append("\n".join(b[0] for b, g in zip(page, good[at : at + len(page)]) if g))
                at += len(page)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*names, text_col])

    return map_arrow(pages.select(*(F.col(f"`{n}`") for n in names)), run, schema)
