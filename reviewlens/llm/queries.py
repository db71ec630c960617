"""The registered queries of this subpackage, one for each operator."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from reviewlens.llm import (alignment, bpe, chat, decontaminate, fingerprints, language, lm_score, periodic, quality,
                             relative_lz, secret_scan, simhash_dedup, toxicity)
from reviewlens.llm.common import table


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Words whose presence in a document labelled toxic marks the two finer categories.
INSULTS = ("clown", "idiot", "loser", "moron", "scum", "stupid")
CONTEMPT = ("disgusting", "pathetic", "trash", "worthless")


def toxic_categories(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` (a bounded sample) refined: insult and contempt are the toxic documents that hold such a word."""
    low = F.lower("text")
    given = docs.select("doc_id", low.alias("low")).join(F.broadcast(labels.select("doc_id", "toxic")), "doc_id")
    holds = lambda words: F.coalesce((F.col("toxic") == 1) & F.col("low").rlike(rf"\b({'|'.join(words)})\b"), F.lit(False))
    return given.select("doc_id", holds(INSULTS).cast("int").alias("insult"),
                        holds(CONTEMPT).cast("int").alias("contempt"), "toxic")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").dropna(subset=["doc_id", "toxic"]).orderBy(F.xxhash64("doc_id")).limit(
        toxicity.MAX_ROWS)
    chain = toxicity.train(docs, toxic_categories(docs, labels), ["insult", "contempt", "toxic"])
    found = toxicity.predict(docs.select("doc_id", "text"), chain)
    return found.withColumn("toxic", (F.col("p_toxic") >= 0.5).cast("int"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scanner = secret_scan.train(secret_scan.labelled_findings(docs), docs)
    found = secret_scan.scan(docs, scanner)
    return found.select("doc_id", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"),
                        "score", "is_secret")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(_remainder(5) != 0).select("text", "lang"))
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    return language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.rotate(table(spark, sf_dir, "conversations"))
    marks = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return found.select("conv_id", "part", "perspective", F.col("n_turns").cast("long").alias("n_turns"),
                        F.col("n_trained").cast("long").alias("n_trained"), "text", marks.alias("spans"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.score(table(spark, sf_dir, "documents"))
    return found.withColumn("log_score", F.round("log_score", 4)).withColumn("mean_score", F.round("mean_score", 6))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(_remainder(4) != 2))
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    return quality.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def repeated_order(doc_id, n: int) -> np.ndarray | None:
    """Every tenth document by crc32 repeats a stretch of its own words up to its end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(table(spark, sf_dir, "documents"), arrange=repeated_order)
    greater = "best IS NULL OR r.length * best.period > best.length * r.period"  # equal ones: the first stays
    best = F.expr(f"aggregate(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>), (best, r) -> IF({greater}, r, best))")
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alignment.byte_level(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    b = alignment.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.align(table(spark, sf_dir, "documents"), a, b)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relative_lz.remove_duplicates(table(spark, sf_dir, "documents"))
    removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_toxicity, op3_simhash, op4_secrets, op5_language, op6_bpe, op7_fingerprints, op8_chat,
    op9_lm_score, op10_quality, op11_periodic,
    op12_alignment, op13_substring_dedup)}
