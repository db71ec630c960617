"""Text predicates of the quality gate (B1-B3) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens.fixed_values import EMOJI_CLASS, EMOJI_ENCLOSING, WHITESPACE_CLASS, WORD_PATTERN


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Strip leading/trailing whitespace the way Python's ``str.strip()`` does."""
    ws = WHITESPACE_CLASS
    return F.regexp_replace(_c(col), f"^{ws}+|{ws}+$", "")


_NON_WS = WORD_PATTERN[:-1]  # one non-separator character


def is_blank(col) -> Column:
    """B1: null, empty or whitespace-only text (stops at the first non-space)."""
    c = _c(col)
    return c.isNull() | ~c.rlike(_NON_WS)


def has_min_words(col, n: int) -> Column:
    """B2: at least ``n`` words — the same predicate as ``word_count >= n``.

    The regex stops as soon as the n-th word starts instead of counting every
    word of a long text; possessive quantifiers keep a failing test linear.
    """
    if n <= 0:
        return F.lit(True)
    ws, word = WHITESPACE_CLASS, _NON_WS
    pattern = f"^{ws}*+(?:{word}++{ws}++){{{n - 1}}}{word}"
    return F.coalesce(_c(col).rlike(pattern), F.lit(False))


def word_count(col) -> Column:
    """B2 helper: number of whitespace-separated words (Unicode separators)."""
    return F.coalesce(F.regexp_count(_c(col), F.lit(WORD_PATTERN)), F.lit(0))


def has_emoji(col) -> Column:
    """B3 helper: any emoji code point.

    The exact class has many ranges and is slow to test on every character, so
    a text first has to meet the few wide ranges that enclose it.
    """
    c = _c(col)
    return F.coalesce(c.rlike(EMOJI_ENCLOSING) & c.rlike(EMOJI_CLASS), F.lit(False))
