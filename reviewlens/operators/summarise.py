"""H1: extractive, deterministic cluster summaries.

A theme is named by the terms that set its cluster apart from the product's
other reviews; it quotes the shortest whole sentence of each representative,
verbatim, and suggests the action that belongs to the representatives' most
frequent tag. The result has the shape of a parsed summariser answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.fixed_values import MISSING_THEME_TEXT, THEME_ACTIONS
from reviewlens.functions.display import theme_tag
from reviewlens.operators.clusters import drop_noise

NAME_TERMS = 3
TERM_PATTERN = "[a-z]{4,}"
SENTENCE_PATTERN = r"[^.!?\n]+[.!?]*"


def theme_names(members: DataFrame, by: tuple[str, ...] = ("product",), terms: int = NAME_TERMS) -> DataFrame:
    """(by, cluster_id, theme_name): the terms of highest reviews-with-term * ln(reviews / reviews-with-term overall).

    Terms are counted once per review; ties go by the term. Both counts are
    combined in the map tasks, and the top terms by a limited window.
    """
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM_PATTERN), F.lit(0)))
    counts = (members.select(*by, "cluster_id", F.explode(found).alias("term"))
              .groupBy(*by, "cluster_id", "term").agg(F.count(F.lit(1)).alias("n")))
    spread = counts.groupBy(*by, "term").agg(F.sum("n").alias("df"))
    total = members.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    weighed = (drop_noise(counts).join(spread, [*by, "term"]).join(total, list(by))
               .withColumn("weight", F.round(F.col("n") * F.log(F.col("total") / F.col("df")), 6)))
    w = Window.partitionBy(*by, "cluster_id").orderBy(F.col("weight").desc(), F.col("term"))
    best = weighed.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= terms)
    named = F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda t: t["term"])
    return best.groupBy(*by, "cluster_id").agg(F.array_join(named, " / ").alias("theme_name"))


def shortest_sentence(text: Column) -> Column:
    """The shortest sentence (the first of equals), as it stands in the text; '' if there is none."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE_PATTERN), F.lit(0)), lambda s: F.trim(s))
    whole = F.filter(parts, lambda s: F.char_length(s) > 0)
    best = F.aggregate(whole, F.lit(None).cast("string"), lambda a, s: F.when(
        a.isNull() | (F.char_length(s) < F.char_length(a)), s).otherwise(a))
    return F.coalesce(best, F.lit(""))


def extractive_themes(ranked: DataFrame, reps: DataFrame, members: DataFrame,
                      by: tuple[str, ...] = ("product",)) -> DataFrame:
    """H1: one row per ranked cluster: theme_name, description, tag, quotes, action_ideas.

    Representatives are a few per cluster, so nesting them is bounded.
    """
    keys = [*by, "cluster_id"]
    quote = F.struct("rank", shortest_sentence(F.col("text")).alias("text"), "doc_id", "rating")
    quotes = reps.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(quote)), lambda q: F.struct(
        q["text"].alias("text"), q["doc_id"].alias("doc_id"), q["rating"].alias("rating"))).alias("quotes"))
    tags = (reps.groupBy(*keys, theme_tag()[0].alias("tag")).agg(F.count(F.lit(1)).alias("n"))
            .groupBy(*keys).agg(F.min_by("tag", F.struct((-F.col("n")).alias("n"), F.col("tag").alias("t"))).alias("tag")))
    title, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (t, d) in THEME_ACTIONS.items():
        title, detail = (F.when(F.col("tag") == name, F.lit(v)).otherwise(e) for v, e in ((t, title), (d, detail)))
    return (ranked.select(*keys, "rank", "size", "avg_rating").join(theme_names(members, by), keys, "left")
            .join(quotes, keys, "left").join(tags, keys, "left")
            .withColumn("theme_name", F.coalesce("theme_name", F.lit(MISSING_THEME_TEXT)))
            .withColumn("description", F.concat(F.col("size").cast("string"), F.lit(" reviews, most about "), F.col("tag")))
            .withColumn("action_ideas", F.array(F.struct(title.alias("title"), detail.alias("detail")))))
