"""Canonical review landing view derived from the driver tables.

The driver data has no review table, so one is derived by a fixed recipe
(identical in the SQL twin below):

* ``seq`` = document id, ``review_id`` = 'r' || id, ``product`` = event type;
* ``author`` = 'user ' || user id; ``text``/``lang`` from documents;
  ``app_version`` = source, with 'src0' meaning no version;
* ``rating`` = 1 + floor(value*100) mod 5, ``thumbs_up`` = floor(value);
* ``timestamp`` = ISO text of the event time shifted by (id mod 17) weeks,
  or 'not-a-date' when id mod 97 = 5 (dirty input the window must keep);
* every tenth review (id mod 10 = 3) arrives a second time later
  (seq + 1e9, same review_id) so keep-first dedup has work;
* a rocket emoji is appended when id mod 53 = 7 so the emoji gate has work.

These are data-generation rules that *add* dirt; no rows are filtered out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions.dates import parse_time
from reviewlens.sources.tables import read_table, read_text_table

DUPLICATE_SEQ_OFFSET = 1_000_000_000
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def review_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_text_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    j = docs.join(events, docs.doc_id == events.event_id, "inner")
    shifted = F.col("ts") + F.make_dt_interval(days=(F.col("doc_id") % 17 * 7).cast("int"))
    # Re-arrivals are generated in the same scan (explode of 1 or 2 copies),
    # so the two source tables are read once.
    copies = (F.when(F.col("doc_id") % 10 == 3, F.array(F.lit(0), F.lit(DUPLICATE_SEQ_OFFSET)))
              .otherwise(F.array(F.lit(0))))
    j = j.withColumn("__copy", F.explode(copies))
    return j.select(
        F.col("event_type").alias("product"),
        (F.col("doc_id") + F.col("__copy")).alias("seq"),
        F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("review_id"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("author"),
        (F.lit(1) + F.floor(F.col("value") * 100) % 5).cast("int").alias("rating"),
        F.when(F.col("doc_id") % 53 == 7, F.concat(F.col("text"), F.lit(" \U0001F680")))
         .otherwise(F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 97 == 5, F.lit("not-a-date"))
         .otherwise(F.date_format(shifted, ISO_FORMAT)).alias("timestamp"),
        F.floor(F.col("value")).cast("int").alias("thumbs_up"),
        F.nullif(F.col("source"), F.lit("src0")).alias("app_version"),
        F.col("lang"),
    )


REVIEW_VIEW_SQL = """
base AS (
  SELECT e.event_type AS product,
         d.doc_id AS seq,
         'r' || CAST(d.doc_id AS VARCHAR) AS review_id,
         'user ' || CAST(e.user_id AS VARCHAR) AS author,
         CAST(1 + CAST(floor(e.value * 100) AS BIGINT) % 5 AS INTEGER) AS rating,
         CASE WHEN d.doc_id % 53 = 7 THEN d.text || ' \U0001F680' ELSE d.text END AS text,
         CASE WHEN d.doc_id % 97 = 5 THEN 'not-a-date'
              ELSE strftime(e.ts + to_days(CAST(d.doc_id % 17 * 7 AS INTEGER)), '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp,
         CAST(floor(e.value) AS INTEGER) AS thumbs_up,
         NULLIF(d.source, 'src0') AS app_version,
         d.lang AS lang
  FROM documents d JOIN events e ON d.doc_id = e.event_id
),
reviews AS (
  SELECT * FROM base
  UNION ALL
  SELECT product, seq + 1000000000 AS seq, review_id, author, rating, text, timestamp, thumbs_up, app_version, lang
  FROM base WHERE seq % 10 = 3
)"""


def ts_col(col: str = "timestamp") -> Column:
    """Tolerant ISO-8601 parse (Z / offsets accepted, naive = UTC, junk = null)."""
    return parse_time(col)
