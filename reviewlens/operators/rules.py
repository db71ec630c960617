"""Theme tags by a table of rules.

``display.theme_tag`` compiles a handful of rules into one CASE. Here rules
are rows, thousands of them: a review meets only the rules that one of its
trigrams leads to, and the pattern runs on those pairs alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.fixed_values import FALLBACK_NEGATIVE, FALLBACK_NEUTRAL, FALLBACK_POSITIVE, THEME_RULES
from reviewlens.operators.search_index import grams_of
from reviewlens.plans.joins import salted_join

RULES = "priority long, name string, color string, min_rating int, max_rating int, pattern string"
BROADCAST_BYTES = 32 << 20
# Signs after which an alternative's letters may not be needed as they stand: such a rule meets every review.
UNREADABLE = r"[\\()\[\]{}^$]"


def rules_table(spark: SparkSession, rules=THEME_RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], RULES)


def _fallbacks(spark: SparkSession) -> DataFrame:
    """By rating, behind all rules: rows without a pattern."""
    top = (1 << 62)
    rows = [(top, *FALLBACK_POSITIVE, 4, None, None), (top, *FALLBACK_NEGATIVE, None, 2, None),
            (top + 1, *FALLBACK_NEUTRAL, None, None, None)]
    return spark.createDataFrame(rows, RULES)


def keyed(rules: DataFrame) -> DataFrame:
    """Each rule under a trigram of every alternative of its pattern, one that no match can lack.

    A rule with an alternative of which no three letters in a row are surely
    needed stands under '' and meets every review.
    """
    alternatives = F.split(F.lower("pattern"), r"\|", -1)
    needed = lambda a: F.regexp_extract_all(F.regexp_replace(a, r".[?*]", "."), F.lit(r"[^.+?*|]{3,}"), F.lit(0))
    stems = F.transform(alternatives, lambda a: F.substring(F.element_at(F.array_sort(
        needed(a), lambda x, y: F.char_length(y) - F.char_length(x)), 1), 1, 3))
    readable = F.coalesce(~F.col("pattern").rlike(UNREADABLE) & F.forall(
        alternatives, lambda a: F.size(needed(a)) > 0), F.lit(False))
    return rules.withColumn("gram", F.explode(F.when(readable, F.array_distinct(stems)).otherwise(F.array(F.lit("")))))


def _holds(text: Column, rating: Column) -> Column:
    bounds = (F.col("min_rating").isNull() | (rating >= F.col("min_rating"))) & (
        F.col("max_rating").isNull() | (rating <= F.col("max_rating")))
    match = F.col("pattern").isNull() | F.coalesce(F.rlike(text, F.concat(F.lit("(?i)"), F.col("pattern"))), F.lit(False))
    return F.coalesce(bounds, F.lit(False)) & match


def tag_by_table(reviews: DataFrame, rules: DataFrame, key: tuple[str, ...] = ("product", "seq")) -> DataFrame:
    """(*key, theme_tag, theme_color): the matching rule of lowest priority, else the fallback of the rating.

    Rules without a pattern are left out; equal priorities go by name, then
    color. A null text matches no rule, a null rating no rule with bounds.
    ``key`` must tell reviews apart. The table of rules is measured: up to
    ``BROADCAST_BYTES`` it goes to every task and no text is shuffled, only
    one row per match; beyond it rules and trigrams meet in a salted shuffle
    without texts, which join again for the patterns.
    """
    table = keyed(rules.filter("pattern is not null")).unionByName(_fallbacks(reviews.sparkSession).withColumn("gram", F.lit("")))
    size = table.agg(F.sum(F.octet_length("pattern") + F.octet_length("name") + 64)).first()[0] or 0
    grams = F.array_union(F.coalesce(grams_of(F.lower("text")), F.array().cast("array<string>")), F.array(F.lit("")))
    if size <= BROADCAST_BYTES:
        rows = reviews.select(*key, "rating", "text", F.explode(grams).alias("gram"))
        pairs = rows.join(F.broadcast(table), "gram")
    else:
        narrow = reviews.select(*key, F.explode(grams).alias("gram"))
        pairs = salted_join(narrow, table, ["gram"]).drop("gram").distinct().join(reviews.select(*key, "rating", "text"), list(key))
    best = pairs.filter(_holds(F.col("text"), F.col("rating"))).groupBy(*key).agg(
        F.min(F.struct("priority", "name", "color")).alias("best"))
    return best.select(*key, F.col("best.name").alias("theme_tag"), F.col("best.color").alias("theme_color"))
