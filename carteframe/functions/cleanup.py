"""Clean-up of names and descriptions, as chains of expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short tokens that mean something.
SHORT_WORDS = ["bbq", "blt", "ny", "nyc", "sm", "lg", "xl", "oz", "jr", "md", "w/", "w", "&", "and", "or"]


def spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def runs(text: Column) -> Column:
    """Three or more of a character become two."""
    return F.regexp_replace(text, r"(.)\1{2,}", "$1$1")


def punctuation(text: Column) -> Column:
    """Dot leaders, bars and clusters of symbols become a space."""
    return spaces(F.regexp_replace(F.regexp_replace(text, r"\.{2,}|…", " "), r"[|\\_~^=<>{}\[\]]+|[^\w\s]{3,}", " "))


def smart_title(text: Column) -> Column:
    """Title case, but tokens of two characters or fewer and tokens in capitals stay."""
    one = lambda t: F.when((F.length(t) <= 2) | ((t == F.upper(t)) & t.rlike("[A-Z]")), t).otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2)))))
    return F.array_join(F.transform(F.split(text, " "), one), " ")


def token_soup(text: Column) -> Column:
    """Tokens of one or two characters go, unless they are numbers or known short words."""
    core = lambda t: F.regexp_replace(t, r"^[,.;:/!?)(]+|[,.;:/!?)(]+$", "")
    keep = lambda t: (core(t) != "") & (F.lower(core(t)).isin(*SHORT_WORDS) | core(t).rlike(r"^\d+$") | (F.length(core(t)) > 2))
    return F.array_join(F.filter(F.split(F.trim(text), r"\s+"), keep), " ")


def with_slash(text: Column) -> Column:
    return spaces(F.regexp_replace(text, r"(?i)\bw/\s*", "with "))


def description(name: Column, text: Column) -> Column:
    """Without a leading repeat of the name, quotes, or spaces before punctuation; empty becomes NULL."""
    bare = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^[\"']+|[\"']+$", "")
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    rest = F.when((low != "") & F.lower(bare).startswith(low), F.regexp_replace(F.substr(bare, F.length(low) + 1), r"^[\s:,.\-]+", "")).otherwise(bare)
    out = F.trim(F.regexp_replace(rest, r"\s+([,.;:!?])", "$1"))
    return F.when(out != "", out)


def split_name(name: Column, text: Column) -> Column:
    """struct of name and description: split once at ' - ' where there is no description yet."""
    at = F.instr(name, " - ")
    empty = F.trim(F.coalesce(text, F.lit(""))) == ""
    yes = empty & (at > 0)
    return F.struct(F.when(yes, F.trim(F.substring(name, F.lit(1), at - 1))).otherwise(name).alias("name"), F.when(yes, F.trim(F.substr(name, at + 3))).otherwise(text).alias("description"))


def tier_url(url: Column) -> Column:
    """Lower case without query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"[?#].*$", ""), "/+$", "")
