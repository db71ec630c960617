"""Rating summaries: star dimension fill, distributions, means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STARS = (5, 4, 3, 2, 1)


def rating_distribution(df: DataFrame, by: tuple[str, ...] = ("product",), half_even: bool = True) -> DataFrame:
    """E6 (half-even, payload) / E7 (half-up, explorer): integer % per star.

    D3 fill without a join: one aggregation computes the total and a count per
    star (partial aggregation map-side, so a hot group ships one row per task),
    then a fixed five-element array is exploded into one row per star. Stars
    with no reviews get 0; ratings outside 1..5 count in the total only; an
    empty group divides by 1.
    """
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("rating") == s).alias(f"n{s}") for s in STARS])
    cells = F.array(*[F.struct(F.lit(s).alias("star"), F.col(f"n{s}").alias("n")) for s in STARS])
    rounder = F.bround if half_even else F.round
    return (counts.select(*by, "total", F.explode(cells).alias("c"))
            .select(*by, F.col("c.star").alias("star"), F.col("c.n").alias("n"), "total",
                    rounder(F.lit(100.0) * F.col("c.n") / F.greatest(F.col("total"), F.lit(1)), 0)
                    .cast("int").alias("pct")))


def rating_summary(df: DataFrame, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """E5 + E9 + E13: reviews, rating sum, mean (1 dp half-even, 0.0 when empty), redactions."""
    aggs = [F.count(F.lit(1)).alias("reviews"),
            F.sum("rating").cast("long").alias("rating_sum"),
            F.coalesce(F.bround(F.avg("rating"), 1), F.lit(0.0)).alias("avg_rating")]
    if "redactions" in df.columns:
        aggs.append(F.sum("redactions").cast("long").alias("redactions"))
    return df.groupBy(*by).agg(*aggs)


def weekly_summary(clean: DataFrame, iso_week: str, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """Flagship weekly row: counts, mean, redactions and the five star shares.

    One aggregation pass over the clean reviews (map-side partial aggregation),
    then a projection; no join, no second scan.
    """
    aggs = [F.count(F.lit(1)).alias("reviews"),
            F.sum("rating").cast("long").alias("rating_sum"),
            F.avg("rating").alias("__mean"),
            F.sum("redactions").cast("long").alias("redactions"),
            *[F.count_if(F.col("rating") == s).alias(f"__n{s}") for s in STARS]]
    g = clean.groupBy(*by).agg(*aggs)
    return g.select(
        *by, F.lit(iso_week).alias("iso_week"), "reviews", "rating_sum",
        F.coalesce(F.bround(F.col("__mean"), 1), F.lit(0.0)).alias("avg_rating"), "redactions",
        *[F.bround(F.lit(100.0) * F.col(f"__n{s}") / F.greatest(F.col("reviews"), F.lit(1)), 0)
          .cast("int").alias(f"pct_{s}") for s in STARS])
