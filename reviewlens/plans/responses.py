"""Deterministic summariser answers for the ranked clusters.

Stands in for a model so the validation, retry and budget operators run on
real cluster data. Per (cluster, attempt) the first quote is, by
(cluster_id + attempt - 1) mod 4: 0 an exact substring of the nearest
representative, 1 that substring reversed (not verbatim), 2 the substring
under an unknown doc id, 3 an empty quote (passes). The second quote is an
exact substring of the second representative. Attempts with
(cluster_id*3 + attempt) mod 11 = 0 answer with truncated JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.fixed_values import MAX_ATTEMPTS

QUOTE_START, QUOTE_LEN = 5, 40
BROKEN_JSON = '{"theme_name": "'


def completion_tokens(attempt):
    return F.lit(120) + F.lit(15) * attempt


def synth_attempts(ranked: DataFrame, reps: DataFrame, by: tuple[str, ...] = ("product",)) -> DataFrame:
    keys = [*by, "cluster_id"]
    r1 = reps.filter(F.col("rank") == 1).select(*keys, F.col("doc_id").alias("d1"), F.col("text").alias("t1"),
                                                F.col("rating").alias("g1"))
    r2 = reps.filter(F.col("rank") == 2).select(*keys, F.col("doc_id").alias("d2"), F.col("text").alias("t2"),
                                                F.col("rating").alias("g2"))
    base = (ranked.select(*keys, "rank", "size").join(r1, keys, "inner").join(r2, keys, "left")
            .withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(MAX_ATTEMPTS)))))
    kind = (F.col("cluster_id") + F.col("attempt") - 1) % 4
    q1 = F.substring(F.col("t1"), QUOTE_START, QUOTE_LEN)
    q1_text = F.when(kind == 1, F.reverse(q1)).when(kind == 3, F.lit("")).otherwise(q1)
    q1_doc = F.when(kind == 2, F.lit("doc_x")).otherwise(F.col("d1"))
    quote1 = F.struct(q1_text.alias("text"), q1_doc.alias("doc_id"), F.col("g1").alias("rating"))
    quote2 = F.struct(F.substring(F.col("t2"), QUOTE_START, QUOTE_LEN).alias("text"), F.col("d2").alias("doc_id"),
                      F.col("g2").alias("rating"))
    quotes = F.when(F.col("d2").isNull(), F.array(quote1)).otherwise(F.array(quote1, quote2))
    body = F.struct(
        F.concat(F.lit("Theme "), F.col("cluster_id").cast("string")).alias("theme_name"),
        F.concat(F.lit("Cluster of "), F.col("size").cast("string"), F.lit(" reviews")).alias("description"),
        quotes.alias("quotes"),
        F.array(F.struct(F.concat(F.lit("Look into cluster "), F.col("cluster_id").cast("string")).alias("title"),
                         F.lit("Read the representative reviews.").alias("detail"))).alias("action_ideas"))
    broken = (F.col("cluster_id") * 3 + F.col("attempt")) % 11 == 0
    return base.select(*keys, "attempt",
                       F.when(broken, F.lit(BROKEN_JSON)).otherwise(F.to_json(body)).alias("response"),
                       completion_tokens(F.col("attempt")).cast("long").alias("completion_tokens"))


SYNTH_SQL = f"""
, tr1 AS (SELECT product, cluster_id, doc_id AS d1, text AS t1, rating AS g1 FROM reps WHERE rank = 1),
tr2 AS (SELECT product, cluster_id, doc_id AS d2, text AS t2, rating AS g2 FROM reps WHERE rank = 2),
tatt AS (
  SELECT k.product, k.cluster_id, k.rank, k.size, a.attempt, (k.cluster_id + a.attempt - 1) % 4 AS kind,
         substring(t1, {QUOTE_START}, {QUOTE_LEN}) AS q1, d1, g1, substring(t2, {QUOTE_START}, {QUOTE_LEN}) AS q2, d2, g2,
         CAST(120 + 15 * a.attempt AS BIGINT) AS completion_tokens,
         NOT ((k.cluster_id * 3 + a.attempt) % 11 = 0) AS parse_ok
  FROM ranked k JOIN tr1 USING (product, cluster_id) LEFT JOIN tr2 USING (product, cluster_id),
       range(1, {MAX_ATTEMPTS + 1}) a(attempt)
),
tquotes AS (
  SELECT product, cluster_id, attempt, 0 AS qidx,
         CASE WHEN kind = 1 THEN reverse(q1) WHEN kind = 3 THEN '' ELSE q1 END AS q_text,
         CASE WHEN kind = 2 THEN 'doc_x' ELSE d1 END AS q_doc_id, g1 AS q_rating
  FROM tatt WHERE parse_ok
  UNION ALL
  SELECT product, cluster_id, attempt, 1 AS qidx, q2, d2, g2 FROM tatt WHERE parse_ok AND d2 IS NOT NULL
),
tverdict AS (
  SELECT q.*, CASE WHEN r.text IS NULL THEN 'unknown_doc'
                   WHEN NOT contains(r.text, q.q_text) THEN 'not_verbatim' ELSE 'ok' END AS verdict
  FROM tquotes q LEFT JOIN reps r ON r.product = q.product AND r.cluster_id = q.cluster_id AND r.doc_id = q.q_doc_id
),
tcheck AS (
  SELECT a.product, a.cluster_id, a.rank, a.attempt, a.parse_ok, a.completion_tokens,
         a.parse_ok AND coalesce(v.all_ok, true) AS valid,
         CASE WHEN NOT a.parse_ok THEN 'invalid_json' ELSE v.reason END AS reason
  FROM tatt a LEFT JOIN (
    SELECT product, cluster_id, attempt, bool_and(verdict = 'ok') AS all_ok,
           arg_min(CASE WHEN verdict <> 'ok' THEN verdict END, CASE WHEN verdict <> 'ok' THEN qidx END) AS reason
    FROM tverdict GROUP BY ALL) v USING (product, cluster_id, attempt)
),
tend AS (
  SELECT *, min(CASE WHEN (parse_ok AND (valid OR attempt >= {MAX_ATTEMPTS})) OR attempt >= {MAX_ATTEMPTS}
                     THEN attempt END) OVER (PARTITION BY product, cluster_id) AS end_at
  FROM tcheck
),
tres AS (
  SELECT *, attempt <= end_at AS performed, attempt = end_at AS final,
         CASE WHEN attempt = end_at THEN CASE WHEN parse_ok THEN 'theme' ELSE 'skipped' END END AS outcome,
         CASE WHEN attempt = end_at THEN valid END AS keep_quotes
  FROM tend
)"""
