"""Text helpers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Whitespace-separated words, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    return words(F.lower(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column, pattern: str = r"[.!?]+") -> Column:
    """Stripped, non-empty parts between sentence marks."""
    return F.filter(F.transform(F.split(text, pattern), strip), lambda s: s != "")


def count_hits(text: Column, needles: list[str]) -> Column:
    """How many of the needles occur in the text."""
    out = F.lit(0)
    for w in needles:
        out = out + text.contains(w).cast("int")
    return out


def any_hit(text: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for w in needles:
        out = out | text.contains(w)
    return out


def head(text: Column | str, chars: int | None) -> Column:
    """The first so many characters, or all."""
    text = F.col(text) if isinstance(text, str) else text
    return text if chars is None else F.substring(text, 1, chars)
