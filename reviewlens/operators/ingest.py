"""Ingest operators: record mapping, quality gate, bounded scan, rolling
window, keep-first dedup, redaction and stage counts (A1-A4, B1-B6, C3, E9,
E16, F1, F9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from reviewlens.fixed_values import (ACCEPTED_LANGUAGE, DEFAULT_WINDOW_WEEKS,
                                     MIN_WORDS, SORT_MODES)
from reviewlens.functions.dates import parse_time, window_cutoff
from reviewlens.functions.redact import redact_columns
from reviewlens.functions.text import has_emoji, has_min_words, is_blank
from reviewlens.operators.topk import prune
from reviewlens.schemas import REVIEW

REVIEW_COLUMNS = [f.name for f in REVIEW.fields]
RESPONSE_FIELDS = ("review_id", "author", "rating", "text", "timestamp", "thumbs_up", "app_version")
SALTS = 32  # parts of a product in the bounded scan
GROUP_LIMIT = 1000  # Spark's own bound for ranks that are cut before a shuffle


def map_records(raw: DataFrame, product: str | Column | None = None) -> DataFrame:
    """A3: landing record -> review with the source's defaults."""
    prod = F.lit(product) if isinstance(product, str) else product
    cols = []
    if prod is not None:
        cols.append(prod.alias("product"))
    elif "product" in raw.columns:
        cols.append(F.col("product"))
    if "seq" in raw.columns:
        cols.append(F.col("seq").cast("long"))
    else:
        cols.append(F.monotonically_increasing_id().alias("seq"))
    cols += [
        F.coalesce(F.col("reviewId"), F.lit("")).alias("review_id"),
        F.coalesce(F.col("userName"), F.lit("")).alias("author"),
        F.coalesce(F.col("score"), F.lit(0)).cast("int").alias("rating"),
        F.col("content").alias("text"),
        F.coalesce(F.col("at"), F.lit("")).alias("timestamp"),
        F.coalesce(F.col("thumbsUpCount"), F.lit(0)).cast("int").alias("thumbs_up"),
        F.col("reviewCreatedVersion").alias("app_version"),
    ]
    if "lang" in raw.columns:  # language reported at landing, if any
        cols.append(F.col("lang"))
    return raw.select(*cols)


def text_reject_reason(text: str = "text") -> Column:
    """First failing test of B1, B2, B3, which read the text alone; null = passed."""
    t = F.col(text)
    return (F.when(is_blank(t), F.lit("empty"))
            .when(~has_min_words(t, MIN_WORDS), F.lit("too_short"))
            .when(has_emoji(t), F.lit("emoji")))


def other_language(lang: str = "lang") -> Column:
    """B4 fails: another language, or none."""
    return F.coalesce(F.col(lang) != ACCEPTED_LANGUAGE, F.lit(True))


def reject_reason(text: str = "text", lang: str = "lang") -> Column:
    """First failing test of the gate in order B1, B2, B3, B4; null = accepted."""
    return F.coalesce(text_reject_reason(text), F.when(other_language(lang), F.lit("not_english")))


def quality_gate(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Keep rows passing all four tests (language from ``lang``)."""
    return df.filter(reject_reason(text, lang).isNull())


def sort_keys(mode: str) -> list[Column]:
    """A2: source order; unknown modes fall back to newest."""
    if mode not in SORT_MODES:
        mode = "newest"
    if mode == "rating":
        key = [F.col("rating").desc_nulls_last()]
    elif mode == "most_relevant":
        key = [F.col("thumbs_up").desc_nulls_last()]
    else:
        key = [parse_time("timestamp").desc_nulls_last()]
    return key + [F.col("seq").asc()]


def sort_value(mode: str) -> Column:
    """The first of ``sort_keys`` as a number, greatest first, nulls last."""
    return {"rating": F.col("rating"), "most_relevant": F.col("thumbs_up")}.get(
        mode, F.unix_micros(parse_time("timestamp"))).cast("double")


def bounded_scan(df: DataFrame, count: int, sort_mode: str = "newest",
                 lang: str = "lang", by: tuple[str, ...] = ("product",)) -> DataFrame:
    """A1 + F9: accepted records, the first ``count`` per product in source order.

    The cap counts rows after the gate. A product's rows are ranked in
    ``SALTS`` parts by hash of their arrival key first, so a hot product is not
    one task's sort; at most ``count`` rows of each part are ranked again.
    Above ``GROUP_LIMIT`` rows, where Spark no longer cuts groups before the
    shuffle, rows that can't be among the first are left out by
    ``topk.prune`` beforehand.
    """
    if count < 1:
        raise ValueError("count must be >= 1")
    if count > GROUP_LIMIT and not df.isStreaming:
        df = prune(df, quality_gate(df, lang=lang), count, sort_value(sort_mode), "seq", by)
    order = sort_keys(sort_mode)
    part = F.pmod(F.xxhash64("seq"), F.lit(SALTS))
    first = Window.partitionBy(*by, "__part").orderBy(*order)
    whole = Window.partitionBy(*by).orderBy(*order)
    return (quality_gate(df, lang=lang).withColumn("__part", part)
            .withColumn("__rn", F.row_number().over(first)).filter(F.col("__rn") <= count)
            .withColumn("__rn", F.row_number().over(whole)).filter(F.col("__rn") <= count).drop("__rn", "__part"))


def in_window(as_of, window_weeks: int = DEFAULT_WINDOW_WEEKS, ts: str = "timestamp") -> Column:
    """B6 predicate: parsed time >= cutoff, or time not parseable (kept)."""
    if window_weeks < 1:
        raise ValueError("window_weeks must be >= 1")
    parsed = parse_time(ts)
    return parsed.isNull() | (parsed >= window_cutoff(as_of, window_weeks))


def rolling_window(df: DataFrame, as_of, window_weeks: int = DEFAULT_WINDOW_WEEKS) -> DataFrame:
    """Keep reviews inside the window ending at ``as_of`` (plain filter, pushes down)."""
    return df.filter(in_window(as_of, window_weeks))


def dedup_keep_first(df: DataFrame, key: str = "review_id", order: str = "seq",
                     by: tuple[str, ...] = ("product",)) -> DataFrame:
    """one row per product and ``key``, the first in arrival order.

    ``row_number() == 1`` is planned with a partial WindowGroupLimit before the
    exchange: each map task forwards one row per key, so a key holding a third
    of the data costs one row per task in the shuffle.
    """
    w = Window.partitionBy(*[c for c in by if c in df.columns], key).orderBy(F.col(order).asc())
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def redact_reviews(df: DataFrame) -> DataFrame:
    """Redact text and author; per-row ``redactions`` = text + author counts."""
    df = redact_columns(df, "text", "text", "text_redactions")
    df = redact_columns(df, "author", "author", "author_redactions")
    return df.withColumn("redactions", F.col("text_redactions") + F.col("author_redactions"))


def clean_reviews(reviews: DataFrame, as_of, window_weeks: int = DEFAULT_WINDOW_WEEKS,
                  lang: str = "lang", max_reviews: int | None = None,
                  sort_mode: str = "newest") -> DataFrame:
    """Ingest chain in the reference's order: gate -> window -> dedup -> redact."""
    return redact_reviews(kept_reviews(reviews, as_of, window_weeks, lang, max_reviews, sort_mode))


def kept_reviews(reviews: DataFrame, as_of, window_weeks: int = DEFAULT_WINDOW_WEEKS,
                 lang: str = "lang", max_reviews: int | None = None,
                 sort_mode: str = "newest") -> DataFrame:
    """The rows of ``clean_reviews`` before redaction, which keeps them all."""
    gated = bounded_scan(reviews, max_reviews, sort_mode, lang) if max_reviews else quality_gate(reviews, lang=lang)
    return dedup_keep_first(rolling_window(gated, as_of, window_weeks))


def stage_counts(reviews: DataFrame, as_of, window_weeks: int = DEFAULT_WINDOW_WEEKS,
                 lang: str = "lang", by: tuple[str, ...] = ("product",)) -> DataFrame:
    """Rows after each ingest stage, in one aggregation pass.

    Keep-first dedup keeps exactly one row per distinct id, so the dedup count
    is a distinct count over the rows that passed gate and window.
    """
    # Flags are computed once per row in a projection (the gate runs regexes).
    flags = reviews.select(*by, "review_id", reject_reason("text", lang).isNull().alias("__acc"),
                           in_window(as_of, window_weeks).alias("__win"))
    flags = flags.withColumn("__win", F.col("__acc") & F.col("__win"))
    per_id = flags.groupBy(*by, "review_id").agg(
        F.count(F.lit(1)).alias("__n"), F.count_if("__acc").alias("__a"), F.count_if("__win").alias("__w"))
    # Two-level aggregation: per (group, id) first, so the distinct count of
    # surviving ids is a plain count; both levels combine map-side.
    return per_id.groupBy(*by).agg(
        F.sum("__n").alias("landed"), F.sum("__a").alias("accepted"), F.sum("__w").alias("in_window"),
        F.count_if(F.col("__w") > 0).alias("deduplicated"))


def observed_clean(reviews: DataFrame, as_of, products: tuple[str, ...], window_weeks: int = DEFAULT_WINDOW_WEEKS,
                   lang: str = "lang") -> tuple[DataFrame, list[Observation]]:
    """E16 without a pass of its own: the clean chain, counting rows of ``products`` while its sink runs.

    Read the observations by ``observed_counts`` after the first action on the
    result. The caller names the products, so the counts are of bounded number.
    A streaming query shows the same names in its progress. Counts are taken
    where rows pass, so run one action only.
    """
    gate, dedup = (Observation(), Observation())
    per = lambda stage, flag: [F.count_if((F.col("product") == p) & flag).alias(f"{stage}:{p}") for p in products]
    flags = reviews.withColumn("__acc", reject_reason("text", lang).isNull())
    flags = flags.withColumn("__win", F.col("__acc") & in_window(as_of, window_weeks)).observe(
        gate, *per("landed", F.lit(True)), *per("accepted", F.col("__acc")), *per("in_window", F.col("__win")))
    kept = dedup_keep_first(flags.filter("__win").drop("__acc", "__win")).observe(dedup, *per("deduplicated", F.lit(True)))
    return redact_reviews(kept), [gate, dedup]


def observed_counts(observations: list[Observation]) -> list[dict]:
    """``stage_counts`` as dicts, one for each product that had a row."""
    rows: dict[str, dict] = {}
    for observation in observations:
        for name, n in observation.get.items():
            stage, product = name.split(":", 1)
            rows.setdefault(product, {"product": product})[stage] = n
    return [r for r in rows.values() if r["landed"]]


def reject_counts(reviews: DataFrame, lang: str = "lang", by: tuple[str, ...] = ("product",)) -> DataFrame:
    """B5 + E16: rows per first failing test ('accepted' when none fails)."""
    return (reviews.withColumn("reason", F.coalesce(reject_reason("text", lang), F.lit("accepted")))
            .groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n")))


def response_rows(reviews: DataFrame, keys: tuple[str, ...] = ("product", "seq")) -> DataFrame:
    """A5: ``keys`` and the seven response fields of each review as one JSON object (``value``), nulls kept."""
    body = F.to_json(F.struct(*RESPONSE_FIELDS), {"ignoreNullFields": "false"})
    return reviews.select(*[k for k in keys if k in reviews.columns], body.alias("value"))


def decode_tool_response(df: DataFrame, col: str = "value") -> DataFrame:
    """A4: each element is JSON text; a JSON *string* is decoded once more.

    Required keys: review_id, author, rating, text, timestamp, thumbs_up;
    rows missing one get ``reject = true`` instead of failing the job.
    """
    from pyspark.sql import types as T
    schema = T.StructType([f for f in REVIEW.fields if f.name not in ("product", "seq")])
    first = F.col(col)
    inner = F.get_json_object(F.concat(F.lit('{"v":'), first, F.lit("}")), "$.v")
    unwrapped = F.when(F.ltrim(first).startswith('"'), inner).otherwise(first)
    parsed = F.from_json(unwrapped, schema)
    required = ["review_id", "author", "rating", "text", "timestamp", "thumbs_up"]
    ok = F.lit(True)
    for k in required:
        ok = ok & parsed[k].isNotNull()
    return df.select(parsed.alias("r"), (~F.coalesce(ok, F.lit(False))).alias("reject")).select("r.*", "reject")
