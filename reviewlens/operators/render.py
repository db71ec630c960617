"""Report text, e-mail and dashboard payload per (product, week)
(I1-I3, E14, C20-C23).

Each output is one row per run built from at most ``top_n`` theme rows:
themes are nested with ``array_sort(collect_list(struct(rank, ...)))`` and
rendered with ``transform`` + ``array_join`` — no UDF, no driver loop.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens import fixed_values as V
from reviewlens.functions.display import doc_url
from reviewlens.operators.summary import STARS

_FIELD = re.compile(r"\{(\w+)\}")


def fmt(template: str, **cols: Column) -> Column:
    """Fill a ``{name}`` template with columns (literal text stays literal)."""
    parts, pos = [], 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(cols[m.group(1)].cast("string"))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def nest_themes(themes: DataFrame, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """Ordered array of theme structs per run (order by theme rank)."""
    t = themes.select(*by, F.struct(
        F.col("theme_rank").alias("rank"), "theme_name", "review_count", "avg_rating", "description",
        "quotes", "action_ideas").alias("t"))
    return t.groupBy(*by).agg(F.array_sort(F.collect_list("t")).alias("themes"))


def _theme_block(t: Column) -> Column:
    quote_line = lambda q: fmt(V.REPORT_QUOTE_LINE, text=F.coalesce(q["text"], F.lit("")),
                               rating=F.coalesce(q["rating"].cast("string"), F.lit(V.MISSING_QUOTE_RATING_TEXT)))
    action_line = lambda a: fmt(V.REPORT_ACTION_LINE, title=F.coalesce(a["title"], F.lit("")),
                                detail=F.coalesce(a["detail"], F.lit("")))
    quotes = F.coalesce(t["quotes"], F.array())
    actions = F.coalesce(t["action_ideas"], F.array())
    head = fmt(V.REPORT_THEME_LINE, rank=t["rank"],
               name=F.coalesce(t["theme_name"], F.lit(V.MISSING_THEME_TEXT)),
               count=F.coalesce(t["review_count"], F.lit(0)),
               avg=F.coalesce(t["avg_rating"].cast("double"), F.lit(0.0)),
               description=F.coalesce(t["description"], F.lit("")))
    qblock = F.when(F.size(quotes) > 0, F.concat(F.lit(V.REPORT_QUOTES_HEADER),
                                                 F.array_join(F.transform(quotes, quote_line), ""),
                                                 F.lit("\n"))).otherwise(F.lit(""))
    ablock = F.when(F.size(actions) > 0, F.concat(F.lit(V.REPORT_ACTIONS_HEADER),
                                                  F.array_join(F.transform(actions, action_line), ""),
                                                  F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(head, qblock, ablock)


def report_text(nested: DataFrame, week: Column, window_weeks: int, title: str, product: Column | None = None) -> Column:
    """Heading with the caller's ``title``, period line, numbered themes, rule line."""
    p = product if product is not None else F.col("product")
    body = F.array_join(F.transform(F.coalesce(F.col("themes"), F.array()), _theme_block), "")
    return F.concat(fmt(V.REPORT_HEADING, product=p, title=F.lit(title), week=week),
                    fmt(V.REPORT_PERIOD, weeks=F.lit(window_weeks), week=week), body, F.lit(V.REPORT_END))


def email_columns(week: Column, doc_id: Column, title: str, product: Column | None = None) -> list[Column]:
    """Subject with the caller's ``title``, text body, HTML body (not escaped) and link."""
    p = product if product is not None else F.col("product")
    link = doc_url(doc_id, for_email=True)
    themes = F.coalesce(F.col("themes"), F.array())
    name = lambda t: F.coalesce(t["theme_name"], F.lit(V.MISSING_THEME_TEXT))
    count = lambda t: F.coalesce(t["review_count"], F.lit(0))
    text_lines = F.concat(
        F.array(F.lit(V.EMAIL_GREETING), fmt(V.EMAIL_INTRO, product=p, week=week)),
        F.transform(themes, lambda t: fmt(V.EMAIL_THEME_LINE, name=name(t), count=count(t))),
        F.array(fmt(V.EMAIL_LINK_LINE, link=link)))
    html_lines = F.concat(
        F.array(F.lit(V.EMAIL_HTML_GREETING), fmt(V.EMAIL_HTML_INTRO, product=p, week=week), F.lit("<ul>")),
        F.transform(themes, lambda t: fmt(V.EMAIL_HTML_THEME, name=name(t), count=count(t))),
        F.array(F.lit("</ul>"), fmt(V.EMAIL_HTML_LINK, link=link)))
    return [fmt(V.EMAIL_SUBJECT, product=p, title=F.lit(title), week=week).alias("subject"),
            F.array_join(text_lines, "\n").alias("text_body"),
            F.array_join(html_lines, "\n").alias("html_body"),
            link.alias("doc_link")]


def payload_themes(themes: Column) -> Column:
    """I3 theme list: payload defaults ('Unknown', 0, 0 rating), mean to 2 dp."""
    return F.transform(F.coalesce(themes, F.array()), lambda t: F.struct(
        t["rank"].alias("rank"),
        F.coalesce(t["theme_name"], F.lit(V.MISSING_THEME_PAYLOAD)).alias("theme_name"),
        F.coalesce(t["review_count"], F.lit(0)).alias("review_count"),
        F.bround(F.coalesce(t["avg_rating"].cast("double"), F.lit(0.0)), 2).alias("avg_rating"),
        F.coalesce(t["description"], F.lit("")).alias("description"),
        F.transform(F.coalesce(t["quotes"], F.array()), lambda q: F.struct(
            F.coalesce(q["text"], F.lit("")).alias("text"),
            F.coalesce(q["rating"], F.lit(0)).alias("rating"))).alias("quotes"),
        F.transform(F.coalesce(t["action_ideas"], F.array()), lambda a: F.struct(
            F.coalesce(a["title"], F.lit("")).alias("title"),
            F.coalesce(a["detail"], F.lit("")).alias("detail"))).alias("action_ideas")))


def payload(runs: DataFrame, week: str, window_weeks: int, model: str, doc_id: Column, run_timestamp: str,
            report_title: str, mail_title: str) -> DataFrame:
    """I3 + E14: one nested dashboard row per run.

    ``runs`` has the columns of ``weekly_summary``, ``themes`` of ``nest_themes``
    (null: none) and ``llm_tokens_used`` (null: 0).
    """
    used = F.coalesce("llm_tokens_used", F.lit(0)).cast("long")
    return runs.select(
        "product", F.lit(week).alias("iso_week"), F.lit(window_weeks).alias("window_weeks"),
        F.col("reviews").alias("reviews_ingested"), "avg_rating", payload_themes(F.col("themes")).alias("themes"),
        F.struct(*[F.col(f"pct_{s}").alias(str(s)) for s in STARS]).alias("rating_distribution"),
        F.struct(F.lit(model).alias("model"), used.alias("llm_tokens_used"),
                 F.lit(V.TOKEN_BUDGET_CAP).alias("llm_tokens_limit"), F.lit(V.DRY_RUN).alias("doc_status"),
                 F.lit(V.DRY_RUN).alias("gmail_status"), doc_url(doc_id).alias("doc_url"), F.lit(week).alias("run_id"),
                 F.lit(run_timestamp).alias("run_timestamp")).alias("pipeline"),
        F.struct(*email_columns(F.lit(week), doc_id, mail_title)).alias("email"),
        report_text(runs, F.lit(week), window_weeks, report_title).alias("docs_report"))


def idempotency_key(product="product", week="iso_week") -> Column:
    """C20: product slug (lower case, other runs than letters and digits to one dash) + ':' + week."""
    return F.concat_ws(":", F.regexp_replace(F.lower(F.col(product)), "[^a-z0-9]+", "-"), F.col(week))
