"""Scans and sinks: every file written is read back; empty runs write nothing."""

import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from reviewlens.operators import render
from reviewlens.plans.joins import lookup_join
from reviewlens.sources import landing

REVIEWS = ("product string, iso_week string, review_id string, author string, rating int, text string, "
           "timestamp string, thumbs_up int, app_version string")
THEMES = ("product string, theme_rank int, theme_name string, review_count long, avg_rating double, description string, "
          "quotes array<struct<text: string, doc_id: string, rating: int>>, "
          "action_ideas array<struct<title: string, detail: string>>")


def _reviews(spark):
    return spark.createDataFrame(
        [("p", "2026-W24", "r1", "a", 5, "first\nline", "2026-06-10", 1, None),
         ("p", "2026-W25", "r2", "b", 4, "second \"quoted\" ₹", "2026-06-17", 0, "1.0"),
         ("q", "2026-W25", "r2", None, 1, "third", "2026-06-18", 2, "")], REVIEWS)


def _rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_normalized_file(spark, tmp_path):
    path = tmp_path / "normalized.json"
    path.write_text(json.dumps([
        {"rating": 5, "text": "one", "thumbs_up": 3, "app_version": "2.1"}, {"rating": 2, "text": "two"},
        {"text": "no rating"}, {"rating": 1}, {"rating": 1, "text": "three", "thumbs_up": None, "extra": 9}], indent=1))
    got = landing.read_normalized(spark, str(path), "app").orderBy("doc_id").collect()
    assert [(r.product, r.doc_id, r.rating, r.text, r.thumbs_up, r.app_version) for r in got] == [
        ("app", "doc_0", 5, "one", 3, "2.1"), ("app", "doc_1", 2, "two", 0, None), ("app", "doc_2", 1, "three", 0, None)]


def test_normalized_file_empty_broken_or_missing(spark, tmp_path):
    for name, text in (("empty.json", "[]"), ("broken.json", "[{\"rating\": 5, ")):
        (tmp_path / name).write_text(text)
        assert landing.read_normalized(spark, str(tmp_path / name)).filter("text is not null").count() == 0
    with pytest.raises(AnalysisException):
        landing.read_normalized(spark, str(tmp_path / "missing.json")).count()


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_reviews_round_trip(spark, tmp_path, fmt):
    df = _reviews(spark)
    landing.write_reviews(df, str(tmp_path / "full"), fmt=fmt)
    back = spark.read.schema(df.schema).format(fmt).load(str(tmp_path / "full"))
    assert _rows(back, df.columns) == _rows(df, df.columns)
    landing.write_anonymised(df, str(tmp_path / "anonymous"), fmt=fmt)
    anonymous = spark.read.format(fmt).load(str(tmp_path / "anonymous"))
    kept = ["product", "iso_week", "rating", "text", "thumbs_up", "app_version"]
    assert sorted(anonymous.columns) == sorted(kept)
    assert _rows(anonymous, kept) == _rows(df, kept)


def _themes(spark):
    return spark.createDataFrame(
        [("p", 1, "Lag", 12, 1.256, "slow", [("so slow", "doc_1", 1), (None, None, None)], [("Fix", None)]),
         ("p", 2, None, None, None, None, None, None)], THEMES)


def test_themes_replace_their_own_run_only(spark, tmp_path):
    themes = _themes(spark).withColumn("iso_week", F.lit("2026-W24"))
    path = str(tmp_path / "themes")
    landing.write_themes(themes, path)
    landing.write_themes(themes.withColumn("iso_week", F.lit("2026-W25")), path)
    landing.write_themes(themes.filter("theme_rank = 1").withColumn("iso_week", F.lit("2026-W25")), path)
    back = spark.read.schema(themes.schema).json(path)
    assert _rows(back, ["iso_week", "theme_rank"]) == [("2026-W24", 1), ("2026-W24", 2), ("2026-W25", 1)]
    assert _rows(back.filter("iso_week = '2026-W24'"), themes.columns) == _rows(themes, themes.columns)


def _payload(spark, week):
    runs = spark.createDataFrame(
        [("p", 40, 3.2, 50, 10, 10, 10, 20, 1200), ("q", 3, 5.0, 100, 0, 0, 0, 0, None)],
        "product string, reviews long, avg_rating double, pct_5 int, pct_4 int, pct_3 int, pct_2 int, pct_1 int, "
        "llm_tokens_used long").join(render.nest_themes(_themes(spark)), "product", "left")
    doc_id = F.when(F.col("product") == "p", "d1").otherwise("")
    return render.payload(runs, week, 12, "extractive", doc_id, "2026-06-20T00:00:00", "Pulse", "Mail")


def test_payload_defaults_differ_between_targets(spark):
    got = {r["product"]: r.asDict(True) for r in _payload(spark, "2026-W24").collect()}
    first, second = got["p"]["themes"]
    assert (first["avg_rating"], first["quotes"]) == (1.26, [{"text": "so slow", "rating": 1}, {"text": "", "rating": 0}])
    assert first["action_ideas"] == [{"title": "Fix", "detail": ""}]
    assert second == {"rank": 2, "theme_name": "Unknown", "review_count": 0, "avg_rating": 0.0, "description": "",
                      "quotes": [], "action_ideas": []}
    assert "Unknown Theme" in got["p"]["docs_report"] and "Unknown Theme" in got["p"]["email"]["text_body"]
    assert got["p"]["rating_distribution"] == {"5": 50, "4": 10, "3": 10, "2": 10, "1": 20}
    assert got["p"]["pipeline"]["doc_url"].endswith("/d1") and got["q"]["pipeline"]["doc_url"] == ""
    assert (got["q"]["themes"], got["q"]["pipeline"]["llm_tokens_used"]) == ([], 0)


def test_payload_round_trip_and_export(spark, tmp_path):
    one, two = _payload(spark, "2026-W24"), _payload(spark, "2026-W25")
    path = str(tmp_path / "payload")
    landing.write_payload(one, path)
    landing.write_payload(two, path)
    back = landing.read_payload(spark, path, "p", "2026-W25", two.schema)
    assert _rows(back, two.columns) == _rows(two.filter("product = 'p'"), two.columns)
    assert landing.read_payload(spark, path, "p", "2026-W26", two.schema).count() == 0
    landing.export_json(one, str(tmp_path / "export"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "export")).collect()]
    assert sorted((x["product"], len(x["themes"]), x["email"]["subject"] != "") for x in lines) == [("p", 2, True), ("q", 0, True)]


def test_empty_run_writes_nothing(spark, tmp_path):
    df, path = _reviews(spark), str(tmp_path / "guarded")
    assert not landing.write_if_any(df.filter("rating > 9"), landing.write_reviews, path)
    assert not os.path.exists(path)
    assert landing.write_if_any(df, landing.write_reviews, path)
    assert not landing.write_if_any(df.filter("rating > 9"), landing.write_reviews, path)
    assert spark.read.json(path).count() == 3


def test_lookup_join_agrees_when_too_large_to_broadcast(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        wide = lookup_join(big, small, ["k"], how)
        salted = lookup_join(big, small, ["k"], how, max_bytes=0, salt_cols=["id"])
        assert _rows(salted, sorted(wide.columns)) == _rows(wide, sorted(wide.columns)), how


def _odd_reviews(n):
    odd = ["a}, {\"rating\": 9, \"text\": \"b", "}", "[{", "]", "x}]", "back\\slash\\", "quote\" } , { \"k\" : 1", "line\nbreak", "", "ü🙂}"]
    return [{"rating": i % 5 + 1, "text": f"{i} {odd[i % len(odd)]}", "thumbs_up": i, "app_version": odd[i * 7 % len(odd)]} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("split", [64, 997, 1 << 20])
def test_array_is_read_in_splits(spark, tmp_path, indent, split):
    rows = _odd_reviews(300)
    (tmp_path / "one.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    key, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(key, split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        tasks = spark.read.option("lineSep", "}").text(str(tmp_path)).select(F.spark_partition_id()).distinct().count()
        got = landing.read_normalized(spark, str(tmp_path), "app").orderBy("seq").collect()
    finally:
        spark.conf.set(key, old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert tasks > (10 if split < 1000 else 0)
    assert [(r.rating, r.text, r.thumbs_up, r.app_version) for r in got] == [tuple(r.values()) for r in rows]
    assert [r.doc_id for r in got] == [f"doc_{i}" for i in range(300)]


def test_several_arrays_and_files_that_are_none(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps(_odd_reviews(5), indent=i))
    (tmp_path / "3.json").write_text('{"rating": 5, "text": "no array"}')
    (tmp_path / "4.json").write_text("")
    (tmp_path / "5.json").write_text('[{"rating": 4, "text": "whole"}, {"rating": 3, "te')
    got = landing.read_normalized(spark, str(tmp_path), "app").orderBy("seq").collect()
    assert [r.text for r in got] == [r["text"] for r in _odd_reviews(5)] * 3 + ["whole"]
    assert len({r.doc_id for r in got}) == 16
