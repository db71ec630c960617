"""SQL twins of the column expressions, for the second-engine value check.

Each helper renders the same fixed values the DataFrame operators use, so the
two engines evaluate identical patterns and parameters.
"""

from __future__ import annotations

from reviewlens.fixed_values import (BASIC_TIMES, EMOJI_CLASS, FULL_DATE_PATTERN, MIN_WORDS, PII_PATTERNS,
                                     REDACTION_MARKER, WORD_PATTERN)
from reviewlens.plans.review_view import REVIEW_VIEW_SQL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(col: str) -> str:
    return f"coalesce(len(regexp_extract_all({col}, {q(WORD_PATTERN)})), 0)"


def has_emoji(col: str) -> str:
    return f"coalesce(regexp_matches({col}, {q(EMOJI_CLASS)}), false)"


def reject_reason(text: str = "text", lang: str = "lang") -> str:
    return (f"CASE WHEN {text} IS NULL OR {words(text)} = 0 THEN 'empty' "
            f"WHEN {words(text)} < {MIN_WORDS} THEN 'too_short' "
            f"WHEN {has_emoji(text)} THEN 'emoji' "
            f"WHEN coalesce({lang} <> 'en', true) THEN 'not_english' END")


def redact(col: str) -> tuple[str, str]:
    """(redacted text, redaction count) for one column."""
    t, counts = col, []
    for _, p in PII_PATTERNS:
        counts.append(f"coalesce(len(regexp_extract_all({t}, {q(p)})), 0)")
        t = f"regexp_replace({t}, {q(p)}, {q(REDACTION_MARKER)}, 'g')"
    return t, "(" + " + ".join(counts) + ")"


def ts(col: str = "timestamp") -> str:
    basic = "".join(f" WHEN regexp_matches({col}, {q(p)}) THEN TRY_CAST(regexp_replace({col}, {q(p)}, "
                    f"{q(extended.replace('$', chr(92)))}) AS TIMESTAMP)" for p, extended in BASIC_TIMES)
    return f"(CASE WHEN regexp_matches({col}, {q(FULL_DATE_PATTERN)}) THEN TRY_CAST({col} AS TIMESTAMP){basic} END)"


def iso_week(expr: str) -> str:
    return f"(CAST(isoyear({expr}) AS VARCHAR) || '-W' || lpad(CAST(week({expr}) AS VARCHAR), 2, '0'))"


def clean_ctes(as_of: str, window_weeks: int) -> str:
    """WITH-body: reviews -> gated -> windowed -> deduped -> clean."""
    text_r, text_n = redact("text")
    auth_r, auth_n = redact("author")
    return REVIEW_VIEW_SQL + f""",
gated AS (
  SELECT * FROM reviews WHERE ({reject_reason()}) IS NULL
),
windowed AS (
  SELECT * FROM gated
  WHERE {ts()} IS NULL OR {ts()} >= TIMESTAMP '{as_of}' - INTERVAL {7 * window_weeks} DAY
),
deduped AS (
  SELECT * FROM windowed QUALIFY row_number() OVER (PARTITION BY product, review_id ORDER BY seq) = 1
),
clean AS (
  SELECT product, seq, review_id,
         {auth_r} AS author, rating, {text_r} AS text, timestamp, thumbs_up, app_version, lang,
         CAST({text_n} AS INTEGER) AS text_redactions,
         CAST({auth_n} AS INTEGER) AS author_redactions,
         CAST({text_n} + {auth_n} AS INTEGER) AS redactions
  FROM deduped
)"""


def theme_tag_sql(text: str = "text", rating: str = "rating") -> tuple[str, str]:
    from reviewlens.fixed_values import (FALLBACK_NEGATIVE, FALLBACK_NEUTRAL,
                                         FALLBACK_POSITIVE, THEME_RULES)
    name, color = "CASE", "CASE"
    for _, rname, rcolor, lo, hi, pattern in sorted(THEME_RULES, key=lambda x: x[0]):
        cond = f"coalesce(regexp_matches({text}, {q(pattern)}, 'i'), false)"
        if lo is not None:
            cond += f" AND {rating} >= {lo}"
        if hi is not None:
            cond += f" AND {rating} <= {hi}"
        name += f" WHEN {cond} THEN {q(rname)}"
        color += f" WHEN {cond} THEN {q(rcolor)}"
    for i, out in ((0, "name"), (1, "color")):
        fb = (f" WHEN {rating} >= 4 THEN {q(FALLBACK_POSITIVE[i])} WHEN {rating} <= 2 THEN {q(FALLBACK_NEGATIVE[i])}"
              f" ELSE {q(FALLBACK_NEUTRAL[i])} END")
        if out == "name":
            name += fb
        else:
            color += fb
    return name, color


def card_sql() -> str:
    name, color = theme_tag_sql()
    return (f"CASE WHEN rating >= 4 THEN 'pos' WHEN rating <= 2 THEN 'neg' ELSE 'neu' END AS sentiment, "
            f"CASE WHEN rating >= 4 THEN 'Thank User' WHEN rating <= 2 THEN 'Escalate' ELSE 'Reply' END AS action, "
            f"CASE WHEN thumbs_up >= 1000 THEN CAST(round(thumbs_up / 1000.0, 1) AS VARCHAR) || 'K' "
            f"ELSE CAST(thumbs_up AS VARCHAR) END AS thumbs_label, "
            f"upper(substring(coalesce(nullif(author, ''), '?'), 1, 1)) AS initial, "
            f"coalesce(strftime({ts()}, '%-d %b %Y'), 'Invalid Date') AS display_date, "
            f"length(text) > 200 AS needs_clamp, {name} AS theme_tag, {color} AS theme_color")


def explore_filter_sql(stars=(), version="all", search="") -> str:
    cond = ["true"]
    if stars:
        cond.append(f"rating IN ({', '.join(str(s) for s in sorted(set(stars)))})")
    if version != "all":
        cond.append(f"coalesce(app_version = {q(version)}, false)")
    if search.strip():
        s = q(search.lower())
        cond.append(f"(coalesce(contains(lower(text), {s}), false) OR coalesce(contains(lower(author), {s}), false))")
    return " AND ".join(cond)


def sort_sql(sort: str = "helpful") -> str:
    if sort == "helpful":
        return "thumbs_up DESC NULLS LAST, seq"
    if sort == "newest":
        return f"{ts()} DESC NULLS LAST, seq"
    return f"{ts()} ASC NULLS LAST, seq"


def fmt(template: str, **exprs: str) -> str:
    """SQL twin of ``render.fmt``: literal parts quoted, fields cast to text."""
    import re
    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(q(template[pos:m.start()]))
        parts.append(f"CAST({exprs[m.group(1)]} AS VARCHAR)")
        pos = m.end()
    if pos < len(template):
        parts.append(q(template[pos:]))
    return "(" + " || ".join(parts) + ")"
