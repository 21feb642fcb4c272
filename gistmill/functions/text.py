"""Column functions shared by the operators; regular expressions follow ASCII word bounds on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

_WORD = "[A-Za-z0-9_]"
_BOUND = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def java(pattern: str, ignore_case: bool = False) -> str:
    """A pattern for the JVM: ASCII word bounds, as the fixed patterns mean them."""
    return ("(?i)" if ignore_case else "") + pattern.replace(r"\b", _BOUND)


def trim(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+\z", "")


def replace_all(col: Column, chain: list[tuple[str, str, bool]]) -> Column:
    for pattern, by, ignore in chain:
        col = F.regexp_replace(col, java(pattern, ignore), by)
    return trim(col)


def tokens(col: Column) -> Column:
    """Number of tokens by the length/4 estimate."""
    return F.ceil(F.char_length(col) / 4.0).cast("long")


def level(col: Column) -> Column:
    out = F.lit("info")
    for name, pattern in reversed(P.LEVELS):
        out = F.when(col.rlike(java(pattern, True)), F.lit(name)).otherwise(out)
    return out


def level_score(col: Column) -> Column:
    out = F.lit(0.3)
    for name, score in P.LEVEL_SCORES.items():
        out = F.when(col == name, F.lit(score)).otherwise(out)
    return out


def terms(col: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-case ASCII words of two characters or more."""
    words = F.split(F.regexp_replace(F.lower(col), r"[^a-z0-9_\s]", " "), r"\s+")
    keep = F.filter(words, lambda w: F.char_length(w) >= 2)
    return F.filter(keep, lambda w: ~w.isin(stopwords)) if stopwords else keep


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def cost_micros(tokens_in: Column, tokens_out: Column, price_in: int, price_out: int) -> Column:
    """Cost in millionths of a unit, at prices a million tokens."""
    return tokens_in * price_in + tokens_out * price_out
