"""Threshold pruning, search by index, rules as a table, and counts observed while a sink runs."""

import random

import pytest
from pyspark.sql import functions as F

from reviewlens.functions import display
from reviewlens.operators import explore, ingest, rules, search_index, topk
from reviewlens.operators.topk import prune

REVIEWS = "product string, seq long, author string, rating int, text string"


def _scored(spark, n=30_000, groups=("a", None)):
    return spark.range(n).select(
        F.element_at(F.array(*[F.lit(g) for g in groups]), (F.col("id") % len(groups) + 1).cast("int")).alias("product"),
        F.col("id").alias("seq"), (F.xxhash64("id") % 1000).alias("score"), (F.col("id") % 5).cast("int").alias("stars"))


@pytest.mark.parametrize("column", ["score", "stars"])
def test_prune_keeps_the_first_k_and_little_else(spark, column):
    rows, k = _scored(spark), 700
    value = F.when(F.col("seq") % 7 > 0, F.col(column)).cast("double")
    kept = prune(rows, rows.filter("seq % 3 > 0"), k, value, "seq", ("product",))
    assert kept.columns == rows.columns
    got = [r.asDict() for r in kept.select("*", value.alias("v")).collect()]
    whole = [r.asDict() for r in rows.select("*", value.alias("v")).collect()]
    order = lambda r: (-r["v"] if r["v"] is not None else float("inf"), r["seq"])
    for product in ("a", None):
        best = sorted((r for r in whole if r["product"] == product and r["seq"] % 3), key=order)[:k]
        mine = [r for r in got if r["product"] == product]
        assert {r["seq"] for r in best} <= {r["seq"] for r in mine}
        assert len(mine) < 5 * k  # of 15,000


def test_prune_small_groups_and_empty_table(spark):
    rows = _scored(spark, 50)
    assert prune(rows, rows, 700, F.col("score"), "seq", ("product",)).count() == 50
    assert prune(rows, rows.limit(0), 700, F.col("score"), "seq", ("product",)).count() == 0
    assert prune(rows.limit(0), rows.limit(0), 700, F.col("score"), "seq", ("product",)).count() == 0


@pytest.mark.parametrize("worth", [0, 8])
def test_bounded_scan_above_the_group_limit(spark, monkeypatch, worth):
    monkeypatch.setattr(topk, "WORTH", worth)
    rows = spark.range(9_000).select(
        F.lit("p").alias("product"), F.col("id").alias("seq"), (F.col("id") % 3).cast("int").alias("rating"),
        F.lit("enough plain words are in this text for it to pass the gate easily").alias("text"), F.lit("en").alias("lang"),
        F.concat(F.lit("2024-04-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")).alias("timestamp"))
    rows = rows.withColumn("lang", F.when(F.col("seq") % 4 > 0, F.col("lang")).otherwise("de"))
    for mode, key in (("rating", lambda r: -r.rating), ("newest", lambda r: [-ord(c) for c in r.timestamp])):
        got = {r.seq for r in ingest.bounded_scan(rows, 2_000, mode).collect()}
        want = sorted((r for r in rows.collect() if r.seq % 4), key=lambda r: (key(r), r.seq))[:2_000]
        assert got == {r.seq for r in want}


def _texts(spark):
    rng, words = random.Random(5), ["lag", "über", "chart", "İstanbul", "🙂ok", "support", "sip", "50%", "a_b", "don't"]
    rows = [("p" if i % 2 else None, i, rng.choice(["Ann", None, "Özil", "Xy"]), i % 5 + 1, " ".join(rng.choices(words, k=6)))
            for i in range(300)]
    rows += [("q", 1000, "", 1, None), ("q", 1001, None, 2, ""), ("q", 1002, "k", 3, "ab"), ("q", 1003, "Q", 3, "é"),
             ("q", 1004, "z", 5, "filler " * 30_000 + "needle at the end")]
    return spark.createDataFrame(rows, REVIEWS)


def test_search_by_index_equals_the_scan(spark, tmp_path):
    df, path = _texts(spark), str(tmp_path / "index")
    search_index.build(df, path, ("seq",))
    for term in ("lag", "LAG sup", " chart", "ab", "é", "a", "%", "needle at", "🙂", "xy", "özil", "no such term", "   ", "",
                 "don't", "filler needle", "i̇st", "r f"):
        got = sorted(r.seq for r in search_index.search(spark, path, term, ("seq",)).collect())
        assert got == sorted(r.seq for r in df.filter(explore.filters(search=term)).collect()), term


def test_search_leaves_folders_unread(spark, tmp_path):
    df, path = _texts(spark), str(tmp_path / "index")
    search_index.build(df, path, ("seq",))
    whole = spark.read.parquet(f"{path}/reviews").select("__part").distinct().count()
    found = search_index._candidates(spark.read.parquet(f"{path}/postings"), "needle at", ("seq",))
    assert found.count() == 1 and whole > 50


def _brute(table, text, rating):
    import re
    for _, name, color, lo, hi, pattern in sorted(table):
        if text is not None and re.search(pattern, text, re.I) and (lo is None or rating is not None and rating >= lo) and (
                hi is None or rating is not None and rating <= hi):
            return name, color
    if rating is not None and rating >= 4:
        return tuple(display.FALLBACK_POSITIVE)
    return tuple(display.FALLBACK_NEGATIVE if rating is not None and rating <= 2 else display.FALLBACK_NEUTRAL)


@pytest.mark.parametrize("budget", [rules.BROADCAST_BYTES, 0])
def test_thousand_rules_by_table(spark, monkeypatch, budget):
    monkeypatch.setattr(rules, "BROADCAST_BYTES", budget)
    rng = random.Random(3)
    table = [(i, f"rule {i}", "red", rng.choice([None, 2]), rng.choice([None, 4]),
              rng.choice([f"word{i}", f"colou?r{i}|x{i}y", f"a{i}.?b|long{i}", f"(ab|cd){i}", rf"\bend{i}$", f"UP{i}+z", f"q.*{i}"]))
             for i in range(1000)]
    texts = [rng.choice([f"see word{i} here", f"Color{i}", f"x{i}Y", f"cd{i}", f"the end{i}", f"up{i}{i % 10}z", "nothing", f"Q and {i}"])
             for i in rng.choices(range(1000), k=200)] + [None, ""]
    df = spark.createDataFrame([("p", i, None, rng.choice([1, 3, 5, None]), t) for i, t in enumerate(texts)], REVIEWS)
    got = {r.seq: (r.theme_tag, r.theme_color) for r in rules.tag_by_table(df, rules.rules_table(spark, table)).collect()}
    assert got == {r.seq: _brute(table, r.text, r.rating) for r in df.collect()}


def test_table_of_the_fixed_rules_is_the_case_expression(spark):
    df = _texts(spark).withColumn("product", F.lit("p"))
    name, color = display.theme_tag()
    want = {r.seq: (r.n, r.c) for r in df.select("seq", name.alias("n"), color.alias("c")).collect()}
    got = {r.seq: (r.theme_tag, r.theme_color) for r in rules.tag_by_table(df, rules.rules_table(spark)).collect()}
    assert got == want
    assert rules.tag_by_table(df.limit(0), rules.rules_table(spark)).count() == 0


def test_counts_observed_while_the_sink_runs(spark, tmp_path):
    from reviewlens.plans.review_view import review_view
    from conftest import SF_SMALL
    reviews = review_view(spark, SF_SMALL)
    products = tuple(sorted(r[0] for r in reviews.select("product").distinct().collect()))
    clean, observations = ingest.observed_clean(reviews, "2024-05-01 00:00:00", products + ("absent",))
    clean.write.parquet(str(tmp_path / "clean"))
    got = {tuple(sorted(r.items())) for r in ingest.observed_counts(observations)}
    want = {tuple(sorted(r.asDict().items())) for r in ingest.stage_counts(reviews, "2024-05-01 00:00:00").collect()}
    assert got == want
