"""Text clean-up of items: short names, the rest of a long name moved to the description, descriptions smoothed and tagged.

Texts are taken as normalised (NFKC) already; Spark has no function for that. NULL counts as empty. `cleanup.punctuation`
keeps signs between word characters; `marks` here removes them, as the source does."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cleanup

#: The tag of cleaned descriptions; characters and words from which a name is long; separators in their order.
TAG = "[AI Cleaned]"
LONG_CHARS, LONG_WORDS = 80, 12
SEPARATORS = [" - ", " — ", " – ", ":", " • ", " · "]
BREAKS = "topped with|served with|comes with|made with|includes|featuring"
JOINERS = ["with", "and", "or", "on", "in"]

_WORD = r"\p{L}\p{N}_"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def _replaced(text: Column, *rules: tuple[str, str]) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), rules, text)


def marks(text: Column) -> Column:
    """Dot leaders and clusters of odd signs become a space; signs between word characters go."""
    return cleanup.spaces(_replaced(_text(text), (r"\.{2,}\s*", " "), (rf"[^{_WORD}\s$.,&()/+'-]{{2,}}", " "), (r"\|{2,}", " "), (rf"(?<=[{_WORD}])[^{_WORD}\s]+(?=[{_WORD}])", "")))


def item_name(name: Column) -> Column:
    """A name without runs, clusters and punctuation at its end, in title case."""
    return cleanup.smart_title(F.trim(F.regexp_replace(marks(cleanup.runs(_text(name))), rf"[^{_WORD})\]]+$", "")))


def spelled_with(text: Column) -> Column:
    """w/, 'w. ', 'w, ' and a lone w as with."""
    return cleanup.spaces(_replaced(_text(text), (r"(?i)\bw/\s*", "with "), (r"(?i)\bw[.,]\s+", "with "), (r"(?i)\bw\b", "with")))


def without_symbols(text: Column) -> Column:
    """Tokens without a letter a to z or digit go; a text of ten letters or more, over 80 % capitals, becomes a sentence."""
    kept = F.array_join(F.filter(_words(_text(text)), lambda t: t.rlike("[A-Za-z0-9]")), " ")
    letters, capitals = (F.length(F.regexp_replace(kept, rf"[^\p{{{c}}}]", "")) for c in ("L", "Lu"))
    low = F.lower(kept)
    return F.when((letters >= 10) & (capitals * 100 > letters * 80), F.concat(F.upper(F.left(low, F.lit(1))), F.substr(low, F.lit(2)))).otherwise(kept)


def joined(text: Column) -> Column:
    """Doubled joining words become one, commas before them and joining words at the end go; texts that say 'on the side' stay."""
    t = _text(text)
    out = _replaced(
        t, (r"(?i)\band\s*/\s*or\b", "or"), (r"(?i)\bor\s*/\s*and\b", "or"), (r"(?i)\b(and|or|&)\s+(and|or|&)\b", "$1"), (r"(?i),\s+(and|or|&)\b", " $1"), (r"(?i)\b(?:with|and|or|&|on the|for the)\b[\s.,;:!]*$", ""),
    )
    return cleanup.spaces(F.when(t.rlike(r"(?i)\b(?:on\s+side|the\s+side|the\s+sid\b)"), t).otherwise(out))


def smoothed(text: Column) -> Column:
    """One space after commas; one joining word, then single letters at the end go, then short tokens without a meaning."""
    spaced = cleanup.spaces(_replaced(_text(text), (r"\s*,\s*", ", "), (r",\s*,+", ", ")))
    return cleanup.token_soup(_replaced(spaced, (rf"(?i)\s(?:{'|'.join(JOINERS)})$", ""), (r"(?:(?:^| )\p{L})+$", "")))


def salvaged(raw: Column, clean: Column) -> Column:
    """How many tokens of the cleaned description the raw one holds, per raw token; 0 for an empty one."""
    low = F.lower(_text(raw))
    found = F.size(F.filter(_words(clean), lambda t: F.contains(low, F.lower(t))))
    return F.when(_text(raw) == "", 0.0).otherwise(found / F.greatest(F.size(_words(_text(raw))), F.lit(1)))


def tagged(raw: Column, clean: Column, salvaged: Column) -> Column:
    """The cleaned description: the tag alone if hardly anything was salvaged, after the tag below half, else bare."""
    few = (salvaged < 0.2) & (F.size(_words(clean)) <= 3)
    return (
        F.when((F.trim(_text(raw)) == "") & (F.trim(clean) == ""), "").when(few, TAG).when((salvaged < 0.5) & ~clean.startswith(TAG), F.trim(F.concat(F.lit(TAG + " "), clean))).otherwise(clean)
    )


def _pair(head: Column, tail: Column) -> Column:
    return F.struct(head.alias("name"), tail.alias("tail"))


def _rebalanced(head: Column, tail: Column) -> Column:
    """A joining word at the end of the head begins the tail instead."""
    last = F.regexp_extract(head, rf"(?i)(?:^|\s)({'|'.join(JOINERS)})$", 1)
    return F.when(last == "", _pair(head, tail)).otherwise(_pair(F.array_join(F.slice(_words(head), 1, F.greatest(F.size(_words(head)) - 1, F.lit(0))), " "), F.trim(F.concat(last, F.lit(" "), tail))))


def rescued(name: Column, description: Column, long_chars: int = LONG_CHARS, long_words: int = LONG_WORDS, separators: Sequence[str] = SEPARATORS) -> Column:
    """struct(name, tail): a long name in two, if its description has under ten characters. Brackets split names of any
    length; then separators, phrases such as 'topped with', 'with', a comma, and at last six words are the name."""
    n = _text(name)
    size = lambda c: F.size(_words(c))
    enough = lambda head, tail: (size(head) >= 2) & (size(tail) >= 3)
    bracket = F.regexp_extract(n, r"\s*\(([^)]{5,})\)\s*", 0)
    inner = F.trim(F.regexp_extract(n, r"\s*\(([^)]{5,})\)\s*", 1))
    around = lambda part: (F.substr(n, F.lit(1), F.instr(n, part) - 1), F.substr(n, F.instr(n, part) + F.length(part)))
    before, after = around(bracket)
    outer = F.trim(F.concat(F.trim(before), F.lit(" "), F.trim(after)))
    options = []
    for s in separators:
        left, right = around(F.lit(s))
        head, tail = F.regexp_replace(left, r"^[ \-–—:·•]+|[ \-–—:·•]+$", ""), F.trim(right)
        options.append(F.when((F.instr(n, F.lit(s)) > 1) & enough(head, tail), _rebalanced(head, tail)))
    for pattern in (rf"(?i)\b(?:{BREAKS})\b", r"(?i)\bwith\b(?!\s*out)"):
        at = F.length(F.regexp_extract(n, rf"(?s)^(.*?){pattern}", 1))
        head, tail = F.trim(F.substr(n, F.lit(1), at)), F.trim(F.substr(n, at + 1))
        options.append(F.when(n.rlike(pattern) & enough(head, tail), _pair(head, tail)))
    left, right = around(F.lit(", "))
    head, tail, comma = F.regexp_replace(left, "^[, ]+|[, ]+$", ""), F.trim(right), F.instr(n, F.lit(", ")) - 1
    options.append(F.when((comma > 10) & (comma < F.length(n) - 10) & enough(head, tail), _rebalanced(head, tail)))
    words = _words(n)
    kept = F.least(F.lit(6), F.greatest(F.size(words) - 3, F.lit(1)))
    options.append(F.when(F.size(words) >= 8, _rebalanced(F.array_join(F.slice(words, 1, kept), " "), F.array_join(F.slice(words, kept + 1, F.size(words)), " "))))
    whole, long = _pair(n, F.lit("")), (F.length(n) >= long_chars) | (F.size(words) >= long_words)
    return (
        F.when(F.length(F.trim(_text(description))) >= 10, whole).when((bracket != "") & (size(outer) >= 1) & (size(inner) >= 2), _pair(outer, inner)).when(long, F.coalesce(*options, whole)).otherwise(whole)
    )
