"""Per-row display fields of the explorer and dashboard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens.fixed_values import (CLAMP_CHARS, DOC_SITE_ROOT, DOC_URL_PREFIX,
                                     FALLBACK_NEGATIVE, FALLBACK_NEUTRAL,
                                     FALLBACK_POSITIVE, SENTIMENT_ACTIONS,
                                     STATUS_LABELS, THEME_RULES, TOKEN_BUDGET_CAP)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sentiment(rating="rating") -> Column:
    """>= 4 pos, <= 2 neg, else neu."""
    r = _c(rating)
    return F.when(r >= 4, F.lit("pos")).when(r <= 2, F.lit("neg")).otherwise(F.lit("neu"))


def suggested_action(rating="rating") -> Column:
    """Action label by sentiment."""
    s = sentiment(rating)
    return (F.when(s == "pos", F.lit(SENTIMENT_ACTIONS["pos"]))
            .when(s == "neg", F.lit(SENTIMENT_ACTIONS["neg"]))
            .otherwise(F.lit(SENTIMENT_ACTIONS["neu"])))


def abbreviate_count(col="thumbs_up") -> Column:
    """C14: >= 1000 shows one decimal and K (half-up), else the number."""
    c = _c(col)
    return F.when(c >= 1000, F.concat(F.round(c / F.lit(1000.0), 1).cast("string"), F.lit("K"))) \
            .otherwise(c.cast("string"))


def author_initial(col="author") -> Column:
    """First character upper-cased; empty or null gives '?'."""
    return F.upper(F.substring(F.coalesce(F.nullif(_c(col), F.lit("")), F.lit("?")), 1, 1))


def display_date(ts) -> Column:
    """C16: 'd MMM yyyy'; unparseable time shows 'Invalid Date'."""
    return F.coalesce(F.date_format(_c(ts), "d MMM yyyy"), F.lit("Invalid Date"))


def needs_clamp(col="text") -> Column:
    """C17: text longer than 200 characters."""
    return F.char_length(_c(col)) > CLAMP_CHARS


def rating_class(avg) -> Column:
    """>= 3.5 green, >= 2.5 amber, else red."""
    a = _c(avg)
    return F.when(a >= 3.5, F.lit("green")).when(a >= 2.5, F.lit("amber")).otherwise(F.lit("red"))


def quote_class(rating) -> Column:
    """>= 4 green, <= 2 red, else amber."""
    r = _c(rating)
    return F.when(r >= 4, F.lit("green")).when(r <= 2, F.lit("red")).otherwise(F.lit("amber"))


def doc_url(doc_id, for_email: bool = False) -> Column:
    """Prefix + id; an empty id gives '' in the payload and the site root in e-mail."""
    d = _c(doc_id)
    empty = F.lit(DOC_SITE_ROOT) if for_email else F.lit("")
    return F.when(F.coalesce(d, F.lit("")) != "", F.concat(F.lit(DOC_URL_PREFIX), d)).otherwise(empty)


def status_label(col) -> Column:
    """Two known statuses mapped, others shown as they are."""
    c = _c(col)
    out = c
    for k, v in reversed(list(STATUS_LABELS.items())):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def budget_use_pct(used, limit=None) -> Column:
    """min(100, used / limit * 100), limit defaulting to 100000."""
    lim = F.coalesce(_c(limit), F.lit(TOKEN_BUDGET_CAP)) if limit is not None else F.lit(TOKEN_BUDGET_CAP)
    return F.least(F.lit(100.0), _c(used) / lim * 100)


def theme_tag(rules=THEME_RULES, text="text", rating="rating") -> tuple[Column, Column]:
    """(name, color) of the first matching rule, else the rating fallback.

    Rules are (priority, name, color, min_rating, max_rating, pattern); the
    pattern is a case-insensitive substring regex. The rules compile into one
    CASE expression, so tagging is a projection: no join, no shuffle.
    """
    t, r = _c(text), _c(rating)
    ordered = sorted(rules, key=lambda x: x[0])
    name = F.when(r >= 4, F.lit(FALLBACK_POSITIVE[0])).when(r <= 2, F.lit(FALLBACK_NEGATIVE[0])) \
            .otherwise(F.lit(FALLBACK_NEUTRAL[0]))
    color = F.when(r >= 4, F.lit(FALLBACK_POSITIVE[1])).when(r <= 2, F.lit(FALLBACK_NEGATIVE[1])) \
             .otherwise(F.lit(FALLBACK_NEUTRAL[1]))
    for _, rname, rcolor, lo, hi, pattern in reversed(ordered):
        cond = F.coalesce(t.rlike("(?i)" + pattern), F.lit(False))
        if lo is not None:
            cond = cond & (r >= lo)
        if hi is not None:
            cond = cond & (r <= hi)
        name = F.when(cond, F.lit(rname)).otherwise(name)
        color = F.when(cond, F.lit(rcolor)).otherwise(color)
    return name, color
