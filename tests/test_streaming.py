"""S1/S2 on landing files written from the derived review view."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from reviewlens.operators import ingest
from reviewlens.plans.review_view import review_view
from reviewlens.streaming import ingest_stream


def _land(spark, path):
    rv = review_view(spark, SF_SMALL)
    raw = rv.select(F.col("review_id").alias("reviewId"), F.col("author").alias("userName"),
                    F.col("rating").alias("score"), F.col("text").alias("content"), F.col("timestamp").alias("at"),
                    F.col("thumbs_up").alias("thumbsUpCount"), F.col("app_version").alias("reviewCreatedVersion"),
                    "product", "seq", "lang")
    raw.repartition(4).write.mode("overwrite").json(path)
    return rv


def test_stream_ingest_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="rl-stream-")
    rv = _land(spark, f"{base}/landing")
    ingest_stream.start_ingest(spark, f"{base}/landing", f"{base}/out", f"{base}/ckpt").awaitTermination(120)
    clean = spark.read.parquet(f"{base}/out/clean")
    want = ingest.dedup_keep_first(ingest.quality_gate(rv))
    key = lambda df: sorted((r.product, r.review_id, r.seq) for r in df.select("product", "review_id", "seq").collect())
    assert key(clean) == key(want)
    from reviewlens.fixed_values import PII_PATTERNS
    assert clean.filter(F.col("text").rlike(PII_PATTERNS[0][1])).count() == 0


def test_late_files_keep_their_rows(spark):
    """One file per trigger, newest first: later files hold older, repeated and untimed reviews."""
    base = tempfile.mkdtemp(prefix="rl-late-")
    files = [[("p", "a", "2024-04-01T00:00:00", 1), ("p", "b", "2024-04-02T00:00:00", 2)],
             [("p", "c", "2024-01-01T00:00:00", 3), ("p", "a", "2024-04-01T00:00:00", 4)],
             [("q", "a", "2024-01-02T00:00:00", 5), ("p", "d", "no time", 6), ("p", "d", "no time", 7)]]
    for k, rows in enumerate(files):
        spark.createDataFrame([(i, "u", 5, "one two three four five six seven eight", t, 0, "1", p, s, "en")
                               for p, i, t, s in rows], ingest_stream.LANDING_SCHEMA.simpleString()[7:-1].replace(":", " ")
                              ).coalesce(1).write.mode("append").json(f"{base}/landing")
        run = ingest_stream.start_ingest(spark, f"{base}/landing", f"{base}/out", f"{base}/ckpt", max_files_per_trigger=1)
        run.awaitTermination(120)
    got = sorted((r.product, r.review_id, r.seq) for r in spark.read.parquet(f"{base}/out/clean").collect())
    assert got == [("p", "a", 1), ("p", "b", 2), ("p", "c", 3), ("p", "d", 6), ("q", "a", 5)]


def test_weekly_windows_start_on_monday(spark):
    df = spark.createDataFrame([("p", 5, "2024-01-03T10:00:00"), ("p", 4, "2024-01-08T00:00:00")],
                               "product string, rating int, timestamp string") \
        .withColumn("ts", F.to_timestamp("timestamp"))
    out = ingest_stream.weekly_rating_counts(df).orderBy("week_start").collect()
    assert [r.week_start.strftime("%Y-%m-%d") for r in out] == ["2024-01-01", "2024-01-08"]
    assert all(r.week_start.weekday() == 0 for r in out)


def _timed_stream(spark, path):
    return (spark.readStream.schema("product string, review_id string, rating int, ts timestamp")
            .option("maxFilesPerTrigger", 1).json(path))


def test_weekly_stream_with_late_rows_and_restart(spark):
    """Closed weeks = batch counts over all rows; late rows are in the side table; restarts go on from the checkpoint."""
    base = tempfile.mkdtemp(prefix="rl-weekly-")
    files = [[("p", "a", 5, "2024-01-03 10:00:00"), ("p", "b", 4, "2024-01-08 00:00:00"), ("q", "c", 5, None)],
             [("p", "d", 5, "2024-01-04 00:00:00"), ("q", "e", 1, "2024-02-20 00:00:00")],
             [("p", "f", 5, "2024-01-03 12:00:00"), ("p", "g", 4, "2024-01-09 00:00:00"), ("q", "h", 1, "2024-02-21 00:00:00")],
             [("p", "i", 2, "2024-05-01 00:00:00"), ("q", "j", 5, "2024-01-01 00:00:00")]]
    schema = "product string, review_id string, rating int, ts string"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{base}/in")
        run = ingest_stream.start_weekly_counts(_timed_stream(spark, f"{base}/in"), f"{base}/out", f"{base}/ckpt")
        run.awaitTermination(120)
    got = sorted((r.product, str(r.week_start), r.rating, r.n, r.n_late)
                 for r in ingest_stream.weekly_table(spark, f"{base}/out").collect())
    everything = spark.createDataFrame([r for rows in files for r in rows], schema).withColumn("ts", F.to_timestamp("ts"))
    want = sorted((r.product, str(r.week_start), r.rating, r.n) for r in ingest_stream.weekly_rating_counts(
        everything.filter("ts < '2024-04-20'")).collect())  # the week of 2024-04-29 is open
    assert [g[:4] for g in got] == want
    assert [(g[0], g[1], g[4]) for g in got if g[4]] == [
        ("p", "2024-01-01 00:00:00", 1), ("p", "2024-01-08 00:00:00", 1), ("q", "2024-01-01 00:00:00", 1)]


def test_ingest_reads_no_stored_rows(spark):
    """The plan of a batch has no scan of the stored table: its keys are state."""
    base = tempfile.mkdtemp(prefix="rl-state-")
    _land(spark, f"{base}/landing")
    run = ingest_stream.start_ingest(spark, f"{base}/landing", f"{base}/out", f"{base}/ckpt", max_files_per_trigger=1)
    run.awaitTermination(240)
    state = [p.stateOperators[0] for p in run.recentProgress if p.stateOperators]
    assert len(state) >= 4
    clean = spark.read.parquet(f"{base}/out/clean")
    assert state[-1].numRowsTotal == clean.count() == clean.select("product", "review_id").distinct().count()
