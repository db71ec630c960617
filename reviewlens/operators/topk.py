"""Rows that can be among the first k of a group, found by thresholds.

Ranking needs every row of a group in one sort. Here one aggregation gives
approximate quantiles of the sort value, a second one counts exactly how many
rows lie above each of them, and only rows above the highest sufficient one
go on to the exact rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.plans.joins import salted_join
from reviewlens.sources.shared import checkpointed

LEVELS = 20          # thresholds a group: the upper half, quarter, ... of its rows
ACCURACY = 100_000   # of the approximate quantiles
WORTH = 8            # groups of at most so many times k rows are left as they are
SMALL = 100_000      # groups whose thresholds go to every task


def _meet(rows: DataFrame, cuts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``rows`` with the columns of their group in ``cuts``; nulls in ``by`` are a group (equal inside a struct)."""
    cuts = checkpointed(cuts.select(F.struct(*by).alias("__by"), *[c for c in cuts.columns if c not in by]))
    keyed = rows.withColumn("__by", F.struct(*by))
    met = keyed.join(F.broadcast(cuts), "__by") if cuts.count() <= SMALL else salted_join(keyed, cuts, ["__by"])
    return met.drop("__by")


def _cuts(rows: DataFrame, value: str, need: Column, by: tuple[str, ...]) -> DataFrame:
    """(by, cut, above): at least ``need`` rows have ``value`` >= cut, ``above`` rows exceed it; no cut if all are needed."""
    levels = F.percentile_approx(value, [1 - 2.0 ** -j for j in range(1, LEVELS + 1)], ACCURACY)
    steps = _meet(rows, rows.groupBy(*by).agg(F.array_distinct(levels).alias("steps"), F.max(need).alias("need")), by)
    # One row per group and stretch between thresholds: their sums are the exact counts.
    passed = F.size(F.filter("steps", lambda s: s <= F.col(value)))
    counts = steps.groupBy(*by, passed.alias("passed"), (F.col(value) == F.element_at("steps", F.greatest(passed, F.lit(1)))).alias("on")).agg(
        F.count("*").alias("n"), F.first("steps").alias("steps"), F.first("need").alias("need"))
    table = counts.groupBy(*by).agg(F.collect_list(F.struct("passed", "on", "n")).alias("c"), F.first("steps").alias("steps"),
                                    F.first("need").alias("need"))  # two entries a threshold at most
    total = lambda keep: F.aggregate(F.filter("c", keep), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    tried = F.transform("steps", lambda s, i: F.struct(
        s.alias("cut"), total(lambda x: x["passed"] > i).alias("reached"),
        total(lambda x: (x["passed"] > i + 1) | ((x["passed"] == i + 1) & ~x["on"])).alias("above")))
    enough = F.filter(tried, lambda t: t["reached"] >= F.col("need"))
    best = F.when(F.size(enough) > 0, F.element_at(enough, -1))  # steps ascend
    return table.select(*by, best["cut"].alias("cut"), best["above"].alias("above"), (F.col("need") - best["above"]).alias("rest"))


def prune(df: DataFrame, eligible: DataFrame, k: int, value: Column, tie: str, by: tuple[str, ...]) -> DataFrame:
    """Rows of ``df`` among which are the first ``k`` of ``eligible`` in every group, by ``value`` descending, then ``tie``.

    ``eligible`` are the rows that count, ``tie`` a whole number. Null values
    come last. Where many rows share the value at the threshold, a second
    threshold among them takes ``tie``. Only (group, value, tie) is written
    aside; texts are read again for the rows that stay.
    """
    low = F.coalesce(value, F.lit(float("-inf")))
    rows = checkpointed(eligible.select(*by, low.alias("value"), (-F.col(tie)).cast("double").alias("back")))
    largest = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if not largest:
        return df.limit(0)
    if largest <= WORTH * k:
        return df  # ranking them as they are costs less
    first = checkpointed(_cuts(rows, "value", F.lit(k).cast("long"), by))
    ties = _meet(rows, first.filter("cut is not null").select(*by, "cut", "rest"), by).filter("value = cut")
    second = _cuts(ties, "back", F.col("rest"), by).select(*by, F.col("cut").alias("back_cut"))
    both = first.select(*by, "cut", F.lit(None).cast("double").alias("back_cut")).unionByName(
        second.withColumn("cut", F.lit(None).cast("double")))
    cuts = both.groupBy(*by).agg(F.max("cut").alias("cut"), F.max("back_cut").alias("back_cut"))
    marked = _meet(df.withColumn("__value", low), cuts, by)
    back = F.col("back_cut").isNull() | ((-F.col(tie)).cast("double") >= F.col("back_cut"))
    stays = F.col("cut").isNull() | (F.col("__value") > F.col("cut")) | ((F.col("__value") == F.col("cut")) & back)
    return marked.filter(stays).drop("__value", "cut", "back_cut")
