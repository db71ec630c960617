"""Run receipts and the delivery outbox.

Receipts are append-only versions ``(idempotency_key, version, ...)`` in plain
files; the current receipt of a key is its highest version (latest wins). A
receipt missing its key or timestamp is broken, and a key whose latest
version is broken has no receipt. Upserts append a new version; first-run
inserts append only keys that have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.fixed_values import DOC_DONE, FAILED, MAIL_DONE, PENDING
from reviewlens.schemas import RECEIPT

RECEIPT_COLS = ["idempotency_key", "run_timestamp", "reviews_ingested", "clusters_found", "themes_generated",
                "doc_status", "doc_id", "gmail_status", "draft_id"]


def flatten(receipts: DataFrame) -> DataFrame:
    """Nested receipt (J1 file schema) -> flat columns with the optional-field defaults."""
    return receipts.select(
        "idempotency_key", "run_timestamp",
        F.coalesce(F.col("reviews_ingested"), F.lit(0).cast("long")).alias("reviews_ingested"),
        F.coalesce(F.col("clusters_found"), F.lit(0).cast("long")).alias("clusters_found"),
        F.coalesce(F.col("themes_generated"), F.lit(0).cast("long")).alias("themes_generated"),
        F.coalesce(F.col("delivery.google_doc.status"), F.lit(PENDING)).alias("doc_status"),
        F.col("delivery.google_doc.doc_id").alias("doc_id"),
        F.coalesce(F.col("delivery.gmail.status"), F.lit(PENDING)).alias("gmail_status"),
        F.col("delivery.gmail.draft_id").alias("draft_id"),
        *[c for c in receipts.columns if c in ("version", "broken")])


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    """J1 scan: JSON Lines receipts with a fixed schema and a ``broken`` flag.

    A record is broken when it is not valid JSON or its delivery structs carry
    a field the receipt does not define (the same rule that makes a stored
    receipt unreadable). It stays, without a timestamp, so that ``latest``
    does not bring back an older version of its key.
    """
    schema = T.StructType(RECEIPT.fields + [T.StructField("version", T.LongType())])
    v = F.col("value")
    doc_fields = [f.name for f in RECEIPT["delivery"].dataType["google_doc"].dataType.fields]
    mail_fields = [f.name for f in RECEIPT["delivery"].dataType["gmail"].dataType.fields]

    def known(json_path, allowed):
        keys = F.json_object_keys(F.get_json_object(v, json_path))
        return F.coalesce(F.forall(keys, lambda k: k.isin(*allowed)), F.lit(True))

    ok = (F.json_object_keys(v).isNotNull() & known("$.delivery.google_doc", doc_fields)
          & known("$.delivery.gmail", mail_fields))
    rows = spark.read.text(path).select(F.from_json(v, schema).alias("r"), (~F.coalesce(ok, F.lit(False))).alias("broken"))
    flat = flatten(rows.select("r.*", "broken"))
    return flat.withColumn("run_timestamp", F.when(~F.col("broken"), F.col("run_timestamp")))


def latest(versions: DataFrame) -> DataFrame:
    """J1 + J2 read side: the highest version per key; keys whose latest version is broken are absent.

    ``max_by`` is partially aggregated before the shuffle, so a key with many
    versions costs one row per map task.
    """
    cols = [c for c in versions.columns if c not in ("idempotency_key", "version")]
    best = versions.groupBy("idempotency_key").agg(
        F.max("version").alias("version"),
        F.max_by(F.struct(*cols), F.col("version")).alias("r"))
    out = best.select("idempotency_key", "version", "r.*")
    return out.filter(F.col("idempotency_key").isNotNull() & F.col("run_timestamp").isNotNull())


def upsert(versions: DataFrame, updates: DataFrame) -> DataFrame:
    """J2 write side: rows to append so each updated key gets version = current max + 1."""
    cur = versions.groupBy("idempotency_key").agg(F.max("version").alias("__v"))
    return (updates.join(cur, "idempotency_key", "left")
            .withColumn("version", (F.coalesce(F.col("__v"), F.lit(0)) + 1).cast("long")).drop("__v"))


def insert_if_absent(versions: DataFrame, new_runs: DataFrame) -> DataFrame:
    """First writer wins — new receipts only for keys without a current receipt.

    The new version follows the highest stored one, broken or not, so it becomes the current one.
    """
    have = latest(versions).select("idempotency_key")
    return upsert(versions, new_runs.join(have, "idempotency_key", "left_anti"))


def delivery_outbox(current: DataFrame) -> DataFrame:
    """J4 + B12: delivery steps still to do, doc first; mail waits on a queued doc step.

    A doc step is queued unless the doc is appended; a mail step is queued
    unless the mail is drafted, and depends on the doc step when that one is
    queued too (a failed doc step stops the mail step).
    """
    doc_todo = F.col("doc_status") != DOC_DONE
    mail_todo = F.col("gmail_status") != MAIL_DONE
    steps = F.array(
        F.when(doc_todo, F.struct(F.lit("google_doc").alias("channel"), F.lit(1).alias("step"),
                                  F.lit(None).cast("string").alias("depends_on"))),
        F.when(mail_todo, F.struct(F.lit("gmail").alias("channel"), F.lit(2).alias("step"),
                                   F.when(doc_todo, F.lit("google_doc")).alias("depends_on"))))
    return (current.select("idempotency_key", "doc_status", "gmail_status", F.explode(steps).alias("s"))
            .filter(F.col("s").isNotNull())
            .select("idempotency_key", "s.channel", "s.step", "s.depends_on", "doc_status", "gmail_status"))


def status_all(current: DataFrame) -> DataFrame:
    """Key and the two statuses, ordered by key."""
    return current.select("idempotency_key", "doc_status", "gmail_status").orderBy("idempotency_key")


def status_report(versions: DataFrame) -> DataFrame:
    """J6 in full: the newest version of every key; one that can't be read is listed as such, without statuses.

    Versions whose key can't be read either are one row with a null key.
    """
    best = versions.groupBy("idempotency_key").agg(
        F.max_by(F.struct("run_timestamp", "doc_status", "gmail_status"), F.col("version")).alias("r"))
    readable = F.col("idempotency_key").isNotNull() & F.col("r.run_timestamp").isNotNull()
    return best.select("idempotency_key", readable.alias("readable"), F.when(readable, F.col("r.doc_status")).alias("doc_status"),
                       F.when(readable, F.col("r.gmail_status")).alias("gmail_status")).orderBy("idempotency_key")


def append_versions(rows: DataFrame, path: str) -> None:
    """J2 sink: versions are added as Parquet files, never rewritten; ``latest`` over the folder is the store."""
    rows.write.mode("append").parquet(path)


def status_of(current: DataFrame, key: str) -> DataFrame:
    """The receipt of one key (empty when none)."""
    return current.filter(F.col("idempotency_key") == key)


def record_outcome(current: DataFrame, results: DataFrame) -> DataFrame:
    """Fold delivery results ``(idempotency_key, channel, ok, ref)`` back into receipt rows (for J2)."""
    r = results.groupBy("idempotency_key").agg(
        F.max_by(F.struct("ok", "ref"), F.when(F.col("channel") == "google_doc", 1)).alias("doc"),
        F.max_by(F.struct("ok", "ref"), F.when(F.col("channel") == "gmail", 1)).alias("mail"))
    j = current.join(r, "idempotency_key", "inner")
    return j.select(
        *[c for c in current.columns if c not in ("doc_status", "doc_id", "gmail_status", "draft_id", "version")],
        F.when(F.col("doc").isNull(), F.col("doc_status"))
         .when(F.col("doc.ok"), F.lit(DOC_DONE)).otherwise(F.lit(FAILED)).alias("doc_status"),
        F.when(F.col("doc.ok"), F.col("doc.ref")).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(F.col("mail").isNull(), F.col("gmail_status"))
         .when(F.col("mail.ok"), F.lit(MAIL_DONE)).otherwise(F.lit(FAILED)).alias("gmail_status"),
        F.when(F.col("mail.ok"), F.col("mail.ref")).otherwise(F.col("draft_id")).alias("draft_id"))
