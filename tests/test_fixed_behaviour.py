"""Literal inputs and results, independent of ``fixed_values``."""

from pyspark.sql import functions as F

from reviewlens.functions import dates, display, text
from reviewlens.functions.redact import redact_columns
from reviewlens.operators import ingest, render


def test_emoji_but_not_symbols(spark):
    cases = {"\u2605": False, "\u2713": False, "\u27a4": False, "\u266a": False, "\u2300": False, "\u2192": False,
             "\u2b50": True, "\u2714": True, "\u231a": True, "\U0001f600": True, "\U0001f1eb": True, "\u2764": True}
    df = spark.createDataFrame([(f"a {c} b", want) for c, want in cases.items()], "t string, want boolean")
    assert df.filter(text.has_emoji("t") != F.col("want")).count() == 0


def test_numbers_split_by_no_break_spaces_are_redacted(spark):
    rows = [("987\u00a0654\u00a03210 now",), ("call 987-654-3210",), ("1234\u00a05678\u20079012",)]
    got = [r.t for r in redact_columns(spark.createDataFrame(rows, "t string"), "t", "t", "n").collect()]
    assert not any(c.isdigit() for t in got for c in t)


def test_only_full_dates_are_times(spark):
    cases = {"2024-01-01": True, "2024-01-01T10:00:00Z": True, "2024-01-01 10:00:00+05:30": True, "2024": False,
             "2024-01": False, "12:30": False, "T10:00": False, " 2024-01-01 ": False, "soon": False, "2024-13-01": False}
    df = spark.createDataFrame(list(cases.items()), "t string, want boolean")
    assert df.filter(dates.parse_time("t").isNotNull() != F.col("want")).count() == 0


def test_labels_and_keys(spark):
    df = spark.createDataFrame([("appended",), ("draft_created",), ("dry_run",), ("failed",)], "s string")
    assert [r[0] for r in df.select(display.status_label("s")).collect()] == ["Appended", "Draft Created", "dry_run", "failed"]
    key = spark.createDataFrame([("My App & Co", "2024-W01")], "product string, iso_week string")
    assert key.select(render.idempotency_key()).first()[0] == "my-app-co:2024-W01"


def test_equal_ids_of_two_products_are_two_reviews(spark):
    rows = [("p", "r1", 1), ("q", "r1", 2), ("p", "r1", 3)]
    got = ingest.dedup_keep_first(spark.createDataFrame(rows, "product string, review_id string, seq long")).collect()
    assert sorted((r.product, r.seq) for r in got) == [("p", 1), ("q", 2)]
