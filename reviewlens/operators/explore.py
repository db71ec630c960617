"""Review explorer: filter, search, sort, page and per-row cards
(B7-B9, E8, E11, E12, E15, F5-F7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions.dates import parse_time
from reviewlens.fixed_values import PAGE_SIZE
from reviewlens.functions import display


def filters(stars=(), version: str = "all", search: str = "") -> Column:
    """B7 AND B8 AND B9 as one predicate (pushes into the scan where it can)."""
    cond = F.lit(True)
    if stars:
        cond = cond & F.col("rating").isin(*sorted(set(stars)))
    if version != "all":
        cond = cond & F.coalesce(F.col("app_version") == F.lit(version), F.lit(False))
    if search.strip():
        q = search.lower()  # active when the trimmed query is non-empty; the untrimmed text is used
        cond = cond & (F.coalesce(F.lower(F.col("text")).contains(q), F.lit(False))
                       | F.coalesce(F.lower(F.col("author")).contains(q), F.lit(False)))
    return cond


def toggle_star(stars: frozenset | set, star: int) -> frozenset:
    """B7 click: symmetric difference with a singleton."""
    return frozenset(set(stars) ^ {star})


def sort_order(sort: str = "helpful") -> list[Column]:
    """helpful = thumbs desc; newest = time desc; anything else = time asc; stable by arrival."""
    ts = parse_time("timestamp")
    if sort == "helpful":
        key = [F.col("thumbs_up").desc_nulls_last()]
    elif sort == "newest":
        key = [ts.desc_nulls_last()]
    else:
        key = [ts.asc_nulls_last()]
    return key + [F.col("seq").asc()]


def card_columns(df: DataFrame) -> DataFrame:
    """C12-C17 + C25 on the rows shown."""
    name, color = display.theme_tag()
    ts = parse_time("timestamp")
    return df.select(
        "*",
        display.sentiment().alias("sentiment"),
        display.suggested_action().alias("action"),
        display.abbreviate_count().alias("thumbs_label"),
        display.author_initial().alias("initial"),
        display.display_date(ts).alias("display_date"),
        display.needs_clamp().alias("needs_clamp"),
        name.alias("theme_tag"), color.alias("theme_color"))


def explore_page(df: DataFrame, stars=(), version: str = "all", search: str = "", sort: str = "helpful",
                 page: int = 1, by: tuple[str, ...] = ("product",), page_size: int = PAGE_SIZE) -> DataFrame:
    """one page per group of the filtered, sorted feed, with card fields.

    ``row_number() <= page*size`` gets a partial WindowGroupLimit before the
    shuffle, so only the first pages of each map task are exchanged.
    """
    if page < 1:
        raise ValueError("page must be >= 1")
    lo, hi = (page - 1) * page_size, page * page_size
    w = Window.partitionBy(*by).orderBy(*sort_order(sort))
    f = df.filter(filters(stars, version, search)).withColumn("position", F.row_number().over(w))
    return card_columns(f.filter((F.col("position") > lo) & (F.col("position") <= hi)))


def explore_one(df: DataFrame, product: str, stars=(), version: str = "all", search: str = "",
                sort: str = "helpful", page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
    """F6 for a single product: distributed top-k (TakeOrderedAndProject) + offset."""
    f = df.filter((F.col("product") == product) & filters(stars, version, search))
    return card_columns(f.orderBy(*sort_order(sort)).offset((page - 1) * page_size).limit(page_size))


def explore_counts(df: DataFrame, stars=(), version: str = "all", search: str = "",
                   by: tuple[str, ...] = ("product",), page_size: int = PAGE_SIZE) -> DataFrame:
    """Filtered count and page count max(1, ceil(n / 10)) per group."""
    return (df.groupBy(*by).agg(F.count_if(filters(stars, version, search)).alias("filtered"))
            .withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("filtered") / F.lit(page_size))).cast("long")))


def versions(df: DataFrame, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """Non-empty distinct versions, string order descending (9.x above 18.x)."""
    return (df.filter(F.coalesce(F.col("app_version"), F.lit("")) != "")
            .select(*by, "app_version").distinct().orderBy(*by, F.col("app_version").desc()))


def theme_share(themes: DataFrame, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """E11 + E12 + C18: share of each theme among reviews in the shown themes (1 dp)."""
    w = Window.partitionBy(*by)
    return (themes.withColumn("reviews_in_themes", F.sum("review_count").over(w).cast("long"))
            .withColumn("share_pct", F.round(F.col("review_count") * 100.0 / F.col("reviews_in_themes"), 1))
            .withColumn("rating_class", display.rating_class("avg_rating")))
