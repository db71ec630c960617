"""Incremental ingest of landed review files with Structured Streaming.

S1: landed JSON records -> record mapping (A3) -> quality gate (B1-B3, plus
B4 when a language column is present) -> redaction (C3) -> the first arrival
of each (product, review_id) is appended. The keys seen so far are state of
the stream, so a micro-batch reads its own files and no stored table. Late
files and records whose time cannot be parsed are ordinary rows: nothing
expires, no row is dropped for its time.

S2: weekly rating counts per product over event time, Monday-aligned
tumbling windows (the epoch is a Thursday, so a 4-day start offset aligns
7-day windows to Mondays). As a stream, a week is appended once the watermark
has passed its end; rows that come later go to a side table, none is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions.dates import parse_time
from reviewlens.operators import ingest
from reviewlens.schemas import RAW_RECORD

SHIFT_DAYS = 73_050  # 200 years
LANDING_SCHEMA = T.StructType(RAW_RECORD.fields + [
    T.StructField("product", T.StringType()), T.StructField("seq", T.LongType()),
    T.StructField("lang", T.StringType())])


def read_landing(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(LANDING_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def clean_stream(raw: DataFrame) -> DataFrame:
    """Gated and redacted records with their event time ``ts`` (null if it cannot be parsed)."""
    mapped = ingest.map_records(raw)
    gate = ingest.reject_reason("text", "lang") if "lang" in mapped.columns else _gate_no_lang()
    return ingest.redact_reviews(mapped.filter(gate.isNull()).withColumn("ts", parse_time("timestamp")))


def _gate_no_lang():
    from reviewlens.fixed_values import MIN_WORDS
    from reviewlens.functions.text import has_emoji, has_min_words, is_blank
    t = F.col("text")
    return (F.when(is_blank(t), F.lit("empty")).when(~has_min_words(t, MIN_WORDS), F.lit("too_short"))
            .when(has_emoji(t), F.lit("emoji")))


def weekly_rating_counts(timed: DataFrame) -> DataFrame:
    """Counts per product, Monday-aligned week and rating."""
    w = F.window("ts", "7 days", "7 days", "4 days")
    return (timed.groupBy("product", w.alias("week"), "rating").agg(F.count(F.lit(1)).alias("n"))
            .select("product", F.col("week.start").alias("week_start"), "rating", "n"))


def closing_counts(timed: DataFrame, delay: str = "7 days", slices: int = 8) -> DataFrame:
    """S2 on a stream, append mode: ``(product, week_start, rating, n, late)``.

    The count of an open week is state; it is emitted with ``late`` false
    when the watermark (highest ``ts`` so far less ``delay``) reaches the
    week's end. Rows of a week that is closed already are emitted at once
    with ``late`` true. Rows without ``ts`` belong to no week. A key's rows
    are spread over ``slices`` tasks, so a key has several rows: add them up.
    """
    def count(group, frames, state):
        import pandas as pd
        end = (int(group[1]) + 7 * 86_400) * 1000
        if state.hasTimedOut:
            n, late = state.get[0], False
            state.remove()
        else:
            n, late = sum(len(f) for f in frames), end <= state.getCurrentWatermarkMs()
            if not late:
                state.update((n + (state.get[0] if state.exists else 0),))
                state.setTimeoutTimestamp(end)
                return
        yield pd.DataFrame({"product": [group[0]], "week": [group[1]], "rating": [group[2]], "n": [n], "late": [late]})

    # Spark drops rows whose event time is behind the watermark. Time and delay are moved by the same
    # 200 years: the watermark is that of ts, and no row is behind it. Clamped to what pandas can hold.
    clamped = F.least(F.greatest("ts", F.lit("1900-01-01").cast("timestamp")), F.lit("2060-01-01").cast("timestamp"))
    week = F.window("ts", "7 days", "7 days", "4 days")["start"].cast("long")
    rows = (timed.filter("ts is not null").select(
        "product", week.alias("week"), "rating", F.pmod(F.xxhash64("review_id"), F.lit(slices)).alias("slice"),
        (clamped + F.make_dt_interval(days=F.lit(SHIFT_DAYS))).alias("event"))
        .withWatermark("event", f"{SHIFT_DAYS} days {delay}"))
    return (rows.groupBy("product", "week", "rating", "slice")
            .applyInPandasWithState(count, "product string, week long, rating int, n long, late boolean", "n long",
                                    "append", "EventTimeTimeout")
            .select("product", F.timestamp_seconds("week").alias("week_start"), "rating", "n", "late"))


def start_weekly_counts(timed: DataFrame, out_dir: str, checkpoint: str, delay: str = "7 days",
                        available_now: bool = True):
    """Append S2 to the tables ``weekly`` and ``weekly_late`` under ``out_dir``.

    Each batch has its own folder in both, which it replaces if it runs again
    after a failure. ``checkpoint`` must be a shared, durable folder.
    """
    def store(batch: DataFrame, i: int) -> None:
        batch = batch.persist()
        for name, rows in (("weekly", ~F.col("late")), ("weekly_late", F.col("late"))):
            batch.filter(rows).drop("late").write.mode("overwrite").parquet(f"{out_dir}/{name}/batch={i}")
        batch.unpersist()

    writer = closing_counts(timed, delay).writeStream.foreachBatch(store).option("checkpointLocation", f"{checkpoint}/weekly")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def weekly_table(spark: SparkSession, out_dir: str) -> DataFrame:
    """Counts of all closed weeks: what was emitted at their end plus what came later (``n_late``)."""
    schema = "product string, week_start timestamp, rating int, n long"
    read = lambda name: spark.read.schema(schema).parquet(f"{out_dir}/{name}")
    both = (read("weekly").select("*", F.lit(0).cast("long").alias("late"))
            .unionByName(read("weekly_late").select("*", F.col("n").alias("late"))))
    return both.groupBy("product", "week_start", "rating").agg(F.sum("n").alias("n"), F.sum("late").alias("n_late"))


def with_new_keys(clean: DataFrame) -> DataFrame:
    """``clean`` and, for each (product, review_id) not seen in earlier batches, a row with only the key (``fresh``).

    The keys are deduplicated in the state store without a watermark: exact
    for any delay, and what a batch reads does not grow with history. Many
    keys want the RocksDB state store, which keeps them on disk.
    """
    keys = clean.select("product", "review_id").dropDuplicates(["product", "review_id"])
    return (clean.withColumn("fresh", F.lit(False))
            .unionByName(keys.withColumn("fresh", F.lit(True)), allowMissingColumns=True))


def append_new(batch: DataFrame, path: str, batch_id: int) -> None:
    """Append the first arrival of each key that ``with_new_keys`` found fresh.

    Rows lie in a folder per batch: a batch that is run again after a failure
    replaces its own rows. A null review_id is a key like any other.
    """
    key = Window.partitionBy("product", "review_id")
    # A fresh key's marker comes first in its group; the row after it is the first arrival. The limit of
    # two rows a key works in the map tasks already, so a hot key does not gather in one task.
    two = batch.withColumn("place", F.row_number().over(key.orderBy(F.desc("fresh"), "seq"))).filter("place <= 2")
    kept = (two.withColumn("opened", F.max("fresh").over(key)).filter("opened and place = 2")
            .drop("place", "opened", "fresh"))
    kept.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def start_ingest(spark: SparkSession, landing: str, out_dir: str, checkpoint: str,
                 available_now: bool = True, max_files_per_trigger: int | None = None):
    """Run S1 into the parquet table ``clean`` under ``out_dir``.

    ``checkpoint`` must be a shared, durable folder (restarts resume from it).
    """
    clean = clean_stream(read_landing(spark, landing, max_files_per_trigger))
    writer = (with_new_keys(clean).writeStream.foreachBatch(lambda batch, i: append_new(batch, f"{out_dir}/clean", i))
              .option("checkpointLocation", f"{checkpoint}/clean"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
