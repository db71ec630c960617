"""Registered queries and their SQL twins.

Every query reads the driver tables (through the derived review view) and
runs over whole tables. ``QUERIES[name](spark, sf_dir)`` returns a DataFrame;
``ORACLE_SQL[name]`` is the same computation in ANSI SQL for a second engine.
Computed columns carry the same alias in both.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.fixed_values import DEFAULT_MAX_REVIEWS
from reviewlens.functions.dates import iso_week_label, iso_week_valid, parse_time
from reviewlens.functions import display
from reviewlens.functions.redact import redact_columns
from reviewlens import fixed_values as V
from reviewlens.operators import (clusters, density, explore, hierarchy, ids, ingest, language, neighbours, receipts,
                                 render, rounds, spectral, summarise, summary, themes, vectors)
from reviewlens.plans import responses
from reviewlens.plans import sqlparts as S
from reviewlens.plans.review_view import review_view
from reviewlens.sources.shared import checkpointed, shared_folder, stored
from reviewlens.streaming import ingest_stream

# Run parameters shared by the Spark side and the SQL side.
AS_OF = "2024-05-01 00:00:00"
WINDOW_WEEKS = 12
RUN_WEEK = "2024-W18"  # ISO week of AS_OF
REPORT_TITLE = "Weekly Review Digest"
MAIL_TITLE = "Review Digest"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def _with(body: str) -> str:
    return "WITH " + S.clean_ctes(AS_OF, WINDOW_WEEKS) + "\n" + body


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.clean_reviews(review_view(spark, sf_dir), AS_OF, WINDOW_WEEKS)


# ---------------------------------------------------------------- ingest ----

@register("ingest_quality", _with(f"""
SELECT product, seq, review_id, author, rating, thumbs_up, app_version, timestamp
FROM gated
QUALIFY row_number() OVER (PARTITION BY product
                           ORDER BY {S.ts()} DESC NULLS LAST, seq) <= {DEFAULT_MAX_REVIEWS}
"""))
def q_ingest_quality(spark, sf_dir):
    """Accepted records, first 2000 per product, newest first."""
    df = ingest.bounded_scan(review_view(spark, sf_dir), DEFAULT_MAX_REVIEWS, "newest")
    return df.select("product", "seq", "review_id", "author", "rating", "thumbs_up", "app_version", "timestamp")


@register("ingest_reject_reasons", _with(f"""
SELECT product, coalesce({S.reject_reason()}, 'accepted') AS reason, count(*) AS n
FROM reviews GROUP BY ALL
"""))
def q_ingest_reject_reasons(spark, sf_dir):
    """B5 + E16: first failing test per row, counted per product."""
    return ingest.reject_counts(review_view(spark, sf_dir))


@register("ingest_stage_counts", _with(f"""
SELECT product,
       count(*) AS landed,
       count(*) FILTER (WHERE ({S.reject_reason()}) IS NULL) AS accepted,
       count(*) FILTER (WHERE ({S.reject_reason()}) IS NULL
                          AND ({S.ts()} IS NULL OR {S.ts()} >= TIMESTAMP '{AS_OF}' - INTERVAL {7 * WINDOW_WEEKS} DAY)) AS in_window,
       count(DISTINCT CASE WHEN ({S.reject_reason()}) IS NULL
                          AND ({S.ts()} IS NULL OR {S.ts()} >= TIMESTAMP '{AS_OF}' - INTERVAL {7 * WINDOW_WEEKS} DAY)
                      THEN review_id END) AS deduplicated
FROM reviews GROUP BY product
"""))
def q_ingest_stage_counts(spark, sf_dir):
    """Rows after gate, window and dedup per product (one pass)."""
    return ingest.stage_counts(review_view(spark, sf_dir), AS_OF, WINDOW_WEEKS)


@register("ingest_window", _with(f"""
SELECT product, seq, review_id, strftime({S.ts()}, '%Y-%m-%d %H:%M:%S') AS ts_utc
FROM windowed
"""))
def q_ingest_window(spark, sf_dir):
    """B6 + C8: gated rows inside the 12-week window; unparseable times kept."""
    df = ingest.rolling_window(ingest.quality_gate(review_view(spark, sf_dir)), AS_OF, WINDOW_WEEKS)
    return df.select("product", "seq", "review_id",
                     F.date_format(parse_time("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("ts_utc"))


@register("ingest_dedup", _with("""
SELECT product, seq, review_id, rating FROM deduped
"""))
def q_ingest_dedup(spark, sf_dir):
    """F1 after B6: first arrival per review_id."""
    df = ingest.dedup_keep_first(ingest.rolling_window(ingest.quality_gate(review_view(spark, sf_dir)), AS_OF, WINDOW_WEEKS))
    return df.select("product", "seq", "review_id", "rating")


@register("redact_reviews", _with("""
SELECT product, seq, review_id, author, text, text_redactions, author_redactions FROM clean
"""))
def q_redact_reviews(spark, sf_dir):
    """Redacted text and author with per-row counts (whole texts)."""
    return clean(spark, sf_dir).select("product", "seq", "review_id", "author", "text",
                                       "text_redactions", "author_redactions")


@register("redaction_totals", _with("""
SELECT product, count(*) AS reviews, CAST(sum(redactions) AS BIGINT) AS redactions,
       CAST(count(*) FILTER (WHERE text_redactions > 0) AS BIGINT) AS reviews_redacted
FROM clean GROUP BY product
"""))
def q_redaction_totals(spark, sf_dir):
    """Redactions per product."""
    return clean(spark, sf_dir).groupBy("product").agg(
        F.count(F.lit(1)).alias("reviews"),
        F.sum("redactions").cast("long").alias("redactions"),
        F.count_if(F.col("text_redactions") > 0).cast("long").alias("reviews_redacted"))


# --------------------------------------------------------------- summary ----

@register("iso_week_ratings", _with(f"""
SELECT product, {S.iso_week(S.ts())} AS iso_week, count(*) AS reviews,
       CAST(sum(rating) AS BIGINT) AS rating_sum, round_even(avg(rating), 1) AS avg_rating
FROM clean GROUP BY ALL
"""))
def q_iso_week_ratings(spark, sf_dir):
    """C6 + E5 per ISO week of the review time (unparseable -> null week)."""
    df = clean(spark, sf_dir).withColumn("iso_week", iso_week_label(parse_time("timestamp")))
    return df.groupBy("product", "iso_week").agg(
        F.count(F.lit(1)).alias("reviews"),
        F.sum("rating").cast("long").alias("rating_sum"),
        F.bround(F.avg("rating"), 1).alias("avg_rating"))


@register("iso_week_valid", _with(f"""
, years AS (SELECT DISTINCT isoyear({S.ts()}) AS y FROM reviews WHERE {S.ts()} IS NOT NULL),
labels AS (
  SELECT CAST(y AS VARCHAR) || '-W' || lpad(CAST(w AS VARCHAR), 2, '0') AS label
  FROM years, range(0, 55) t(w)
  UNION ALL SELECT DISTINCT timestamp AS label FROM reviews
)
SELECT label,
       CASE WHEN coalesce(regexp_matches(label, '^[0-9]{{4}}-W[0-9]{{2}}$'), false)
            THEN TRY_CAST(substr(label, 7, 2) AS INTEGER) BETWEEN 1
                 AND week(make_date(TRY_CAST(substr(label, 1, 4) AS INTEGER), 12, 28))
            ELSE false END AS valid
FROM labels
""".replace("\n, years", ", years", 1)))
def q_iso_week_valid(spark, sf_dir):
    """C7 over labels derived from the data: weeks 0..54 of each ISO year seen, plus raw time strings."""
    rv = review_view(spark, sf_dir)
    parsed = parse_time("timestamp")
    years = rv.filter(parsed.isNotNull()).select(F.extract(F.lit("YEAROFWEEK"), F.to_date(parsed)).alias("y")).distinct()
    weeks = (years.select("y", F.explode(F.sequence(F.lit(0), F.lit(54))).alias("w"))
             .select(F.concat(F.col("y").cast("string"), F.lit("-W"),
                              F.lpad(F.col("w").cast("string"), 2, "0")).alias("label")))
    raw = rv.select(F.col("timestamp").alias("label")).distinct()
    labels = weeks.unionByName(raw)
    return labels.select("label", iso_week_valid("label").alias("valid"))


@register("rating_distribution", _with("""
, counts AS (SELECT product, count(*) AS total, count(*) FILTER (WHERE rating = 5) AS n5,
         count(*) FILTER (WHERE rating = 4) AS n4, count(*) FILTER (WHERE rating = 3) AS n3,
         count(*) FILTER (WHERE rating = 2) AS n2, count(*) FILTER (WHERE rating = 1) AS n1
  FROM clean GROUP BY product)
SELECT product, s.star, s.n, total, CAST(round_even(100.0 * s.n / greatest(total, 1), 0) AS INTEGER) AS pct
FROM counts, (SELECT unnest([{'star': 5, 'n': n5}, {'star': 4, 'n': n4}, {'star': 3, 'n': n3},
                             {'star': 2, 'n': n2}, {'star': 1, 'n': n1}], recursive := true)) s
""".replace("\n, counts", ", counts", 1)))
def q_rating_distribution(spark, sf_dir):
    """E6 + D3: payload distribution, integer % half-even, all five stars."""
    return summary.rating_distribution(clean(spark, sf_dir), half_even=True)


@register("explorer_distribution", _with("""
, counts AS (SELECT product, count(*) AS total, count(*) FILTER (WHERE rating = 5) AS n5,
         count(*) FILTER (WHERE rating = 4) AS n4, count(*) FILTER (WHERE rating = 3) AS n3,
         count(*) FILTER (WHERE rating = 2) AS n2, count(*) FILTER (WHERE rating = 1) AS n1
  FROM clean GROUP BY product)
SELECT product, s.star, s.n, total, CAST(round(100.0 * s.n / greatest(total, 1), 0) AS INTEGER) AS pct
FROM counts, (SELECT unnest([{'star': 5, 'n': n5}, {'star': 4, 'n': n4}, {'star': 3, 'n': n3},
                             {'star': 2, 'n': n2}, {'star': 1, 'n': n1}], recursive := true)) s
""".replace("\n, counts", ", counts", 1)))
def q_explorer_distribution(spark, sf_dir):
    """Explorer distribution, integer % half-up, over all (unfiltered) reviews."""
    return summary.rating_distribution(clean(spark, sf_dir), half_even=False)


@register("weekly_summary", _with(f"""
SELECT product, '{RUN_WEEK}' AS iso_week, count(*) AS reviews, CAST(sum(rating) AS BIGINT) AS rating_sum,
       coalesce(round_even(avg(rating), 1), 0.0) AS avg_rating, CAST(sum(redactions) AS BIGINT) AS redactions,
       CAST(round_even(100.0 * count(*) FILTER (WHERE rating = 5) / greatest(count(*), 1), 0) AS INTEGER) AS pct_5,
       CAST(round_even(100.0 * count(*) FILTER (WHERE rating = 4) / greatest(count(*), 1), 0) AS INTEGER) AS pct_4,
       CAST(round_even(100.0 * count(*) FILTER (WHERE rating = 3) / greatest(count(*), 1), 0) AS INTEGER) AS pct_3,
       CAST(round_even(100.0 * count(*) FILTER (WHERE rating = 2) / greatest(count(*), 1), 0) AS INTEGER) AS pct_2,
       CAST(round_even(100.0 * count(*) FILTER (WHERE rating = 1) / greatest(count(*), 1), 0) AS INTEGER) AS pct_1
FROM clean GROUP BY product
"""))
def q_weekly_summary(spark, sf_dir):
    """Flagship: weekly clean-review summary per product (P0 slice)."""
    return summary.weekly_summary(clean(spark, sf_dir), RUN_WEEK)


# -------------------------------------------------------------- clusters ----

NOISE_SOURCE_LABELS = (9,)  # the given label 9 plays the noise label -1

CLUSTER_CTES = """
, normalized AS (
  SELECT *, 'doc_' || CAST(row_number() OVER (PARTITION BY product ORDER BY seq) - 1 AS VARCHAR) AS doc_id
  FROM clean
),
members AS (
  SELECT n.product, n.seq, n.doc_id, n.rating, n.text, n.thumbs_up, n.app_version,
         CASE WHEN e.label = 9 THEN -1 ELSE e.label END AS cluster_id, e.embedding
  FROM normalized n JOIN embeddings e ON n.seq = e.vec_id
),
expl AS (
  SELECT product, cluster_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS v
  FROM members WHERE cluster_id <> -1
),
cells AS (SELECT product, cluster_id, dim, avg(CAST(v AS DOUBLE)) AS value FROM expl GROUP BY ALL),
cents AS (SELECT product, cluster_id, list(value ORDER BY dim) AS centroid FROM cells GROUP BY ALL),
dists AS (
  SELECT m.*, sqrt(list_reduce(list_transform(range(1, len(m.embedding) + 1),
           lambda i: (CAST(m.embedding[i] AS DOUBLE) - c.centroid[i]) * (CAST(m.embedding[i] AS DOUBLE) - c.centroid[i])),
           lambda a, b: a + b)) AS dist
  FROM members m JOIN cents c USING (product, cluster_id)
),
reps AS (
  SELECT *, row_number() OVER (PARTITION BY product, cluster_id ORDER BY dist, seq) AS rank
  FROM dists QUALIFY rank <= 5
),
stats AS (
  SELECT product, cluster_id, count(*) AS size, CAST(sum(rating) AS BIGINT) AS rating_sum,
         round_even(avg(rating), 2) AS avg_rating
  FROM members WHERE cluster_id <> -1 GROUP BY ALL
),
gmean AS (SELECT product, avg(rating) AS global_mean FROM members GROUP BY product),
ranked AS (
  SELECT s.*, g.global_mean, s.avg_rating - g.global_mean AS rating_delta,
         row_number() OVER (PARTITION BY s.product ORDER BY s.size DESC, s.avg_rating - g.global_mean, s.cluster_id) AS rank
  FROM stats s JOIN gmean g USING (product) QUALIFY rank <= 5
)"""


def _with_clusters(body: str) -> str:
    return _with(CLUSTER_CTES + "\n" + body)


def numbered(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The clean reviews with doc ids, not yet redacted. Numbering reads its rows twice, so they are stored before."""
    kept = ingest.kept_reviews(review_view(spark, sf_dir), AS_OF, WINDOW_WEEKS)
    return ids.with_doc_ids(stored(kept.select(*columns) if columns else kept))


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 + C5: clean reviews with positional doc ids per product."""
    return ingest.redact_reviews(numbered(spark, sf_dir))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized reviews joined to their vectors and given labels."""
    from pyspark import StorageLevel

    from reviewlens.sources.tables import read_table
    rows = numbered(spark, sf_dir, "product", "seq", "text", "rating", "thumbs_up", "app_version")
    joined = clusters.attach_vectors(rows, read_table(spark, sf_dir, "embeddings"), noise_labels=NOISE_SOURCE_LABELS)
    # Read by several consumers (stats, means, centroids, distances): persisted
    # once; lost blocks are recomputed from lineage.
    return redact_columns(joined, "text").drop("text_redactions").persist(StorageLevel.MEMORY_AND_DISK)


@register("anonymised_reviews", _with_clusters("""
SELECT product, doc_id, rating, text, thumbs_up, app_version FROM normalized
"""))
def q_anonymised_reviews(spark, sf_dir):
    """C4 + C5: identity columns dropped, doc ids 0-based in arrival order per product."""
    return ids.anonymise(normalized(spark, sf_dir)).select(
        "product", "doc_id", "rating", "text", "thumbs_up", "app_version")


@register("cluster_stats", _with_clusters("""
SELECT product, cluster_id, size, rating_sum, avg_rating FROM stats
"""))
def q_cluster_stats(spark, sf_dir):
    """B10 + E1 + E2: size and mean rating per cluster (noise dropped)."""
    return clusters.cluster_stats(members(spark, sf_dir))


@register("cluster_centroids", _with_clusters("""
SELECT product, cluster_id, dim, round(value, 6) AS value FROM cells
"""))
def q_cluster_centroids(spark, sf_dir):
    """Element-wise mean of the original vectors (long form, 6 dp)."""
    return clusters.centroid_cells(members(spark, sf_dir)).withColumn("value", F.round("value", 6))


@register("cluster_representatives", _with_clusters("""
SELECT product, cluster_id, rank, doc_id, seq, rating, round(dist, 6) AS dist FROM reps
"""))
def q_cluster_representatives(spark, sf_dir):
    """G4 + F2: five members nearest the centroid per cluster."""
    m = members(spark, sf_dir)
    reps = clusters.representatives(clusters.member_distances(m, clusters.centroids(m)))
    return reps.select("product", "cluster_id", F.col("rank").cast("long").alias("rank"), "doc_id", "seq",
                       "rating", F.round("dist", 6).alias("dist"))


@register("cluster_ranking", _with_clusters("""
SELECT product, rank, cluster_id, size, avg_rating, round(global_mean, 6) AS global_mean,
       round(rating_delta, 6) AS rating_delta FROM ranked
"""))
def q_cluster_ranking(spark, sf_dir):
    """F3 + D6 + E4: top five clusters per product by size, then most negative rating delta."""
    m = members(spark, sf_dir)
    r = clusters.rank_clusters(clusters.cluster_stats(m), clusters.global_mean(m))
    return r.select("product", F.col("rank").cast("long").alias("rank"), "cluster_id", "size", "avg_rating",
                    F.round("global_mean", 6).alias("global_mean"), F.round("rating_delta", 6).alias("rating_delta"))


# ---------------------------------------------------------------- themes ----

# Per product run; small enough that the gate binds on this data. Only the two budget queries use it.
THEME_BUDGET = 20_000


def ranked_clusters(spark: SparkSession, sf_dir: str):
    """Ranked clusters and the representatives of those clusters."""
    m = members(spark, sf_dir)
    ranked = clusters.rank_clusters(clusters.cluster_stats(m), clusters.global_mean(m))
    reps = clusters.representatives(clusters.member_distances(m, clusters.centroids(m)))
    reps = reps.join(ranked.select("product", "cluster_id"), ["product", "cluster_id"], "left_semi")
    # Both are bounded by top_n clusters (x 5 representatives) per run and feed
    # several consumers (prompts, answers, verdicts, themes): persisted once.
    return ranked.persist(), reps.persist()


def theme_run(spark: SparkSession, sf_dir: str):
    """Prompts -> attempts -> verdicts -> resolution, shared by the theme queries."""
    ranked, reps = ranked_clusters(spark, sf_dir)
    prompts = themes.cluster_prompts(ranked, reps)
    parsed = themes.parse_responses(responses.synth_attempts(ranked, reps))
    verdicts = themes.quote_verdicts(parsed, reps)
    checked = themes.attempt_verdicts(parsed, verdicts)
    resolved = themes.resolve_attempts(checked).join(
        prompts.select("product", "cluster_id", "rank", "prompt_tokens"), ["product", "cluster_id"], "inner")
    return ranked, reps, prompts, verdicts, resolved


def rounds_run(spark: SparkSession, sf_dir: str):
    """Ranked clusters, their attempts in rounds, and what each cluster ends with."""
    ranked, reps = ranked_clusters(spark, sf_dir)
    made = rounds.theme_rounds(themes.cluster_prompts(ranked, reps), reps, rounds.extractive_answer())
    return ranked, themes.resolve_attempts(made)


_SYS = S.q(themes.SYSTEM_PROMPT)
_SYNTH = responses.SYNTH_SQL.replace("FROM reps WHERE rank", "FROM rreps WHERE rank")
THEME_CTES = CLUSTER_CTES + """,
rreps AS (SELECT r.* FROM reps r JOIN ranked k USING (product, cluster_id)),
tprompt AS (
  SELECT k.product, k.cluster_id, k.rank,
         string_agg('[doc_id: ' || r.doc_id || ' | Rating: ' || CAST(r.rating AS VARCHAR) || '/5]' || chr(10)
                    || r.text || chr(10), chr(10) || '---' || chr(10) ORDER BY r.rank) AS block
  FROM ranked k JOIN reps r USING (product, cluster_id) GROUP BY ALL
),
tprompt2 AS (
  SELECT *, CAST(3 + ceil(length('system') / 4) + ceil(length(""" + _SYS + """) / 4)
                 + 3 + ceil(length('user') / 4) + ceil(length('Reviews:' || chr(10) || block) / 4) + 3 AS BIGINT) AS prompt_tokens
  FROM tprompt
)""" + _SYNTH + f""",
tperf AS (
  SELECT r.product, r.cluster_id, r.rank, r.attempt, p.prompt_tokens,
         CAST(r.completion_tokens + p.prompt_tokens AS BIGINT) AS used_tokens,
         CAST(p.prompt_tokens + 500 AS BIGINT) AS est_tokens, r.final, r.outcome, r.keep_quotes
  FROM tres r JOIN tprompt2 p USING (product, cluster_id) WHERE r.performed
),
tgate AS (
  SELECT *, CAST(coalesce(sum(used_tokens) OVER wb, 0) AS BIGINT) AS tokens_before,
            CAST(coalesce(count(*) OVER wb, 0) AS BIGINT) AS requests_before
  FROM tperf
  WINDOW wb AS (PARTITION BY product ORDER BY rank, attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
tref AS (SELECT *, requests_before >= 1000 OR tokens_before + est_tokens >= {min(THEME_BUDGET, 100000)} AS refused FROM tgate),
tadm AS (
  SELECT *, NOT bool_or(refused) OVER (PARTITION BY product ORDER BY rank, attempt
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS admitted
  FROM tref
)"""


FULL_BUDGET_CTES = THEME_CTES.replace(f">= {THEME_BUDGET} AS refused", f">= {V.TOKEN_BUDGET_CAP} AS refused")

# The same with the answers of ``rounds.extractive_answer``; all that is rendered stands on these.
ROUND_CTES = FULL_BUDGET_CTES.replace(_SYNTH, rounds.ROUNDS_SQL)


def _with_themes(body: str, ctes: str = FULL_BUDGET_CTES) -> str:
    return _with(ctes + "\n" + body)


@register("cluster_prompts", _with_themes("""
SELECT product, cluster_id, rank, block FROM tprompt
"""))
def q_cluster_prompts(spark, sf_dir):
    """C9 + C10: representative block per ranked cluster (nearest first)."""
    _, _, prompts, _, _ = theme_run(spark, sf_dir)
    return prompts.select("product", "cluster_id", F.col("rank").cast("long").alias("rank"), "block")


@register("prompt_tokens", _with_themes("""
SELECT product, cluster_id, prompt_tokens FROM tprompt2
"""))
def q_prompt_tokens(spark, sf_dir):
    """C11: token estimate of the two prompt messages."""
    _, _, prompts, _, _ = theme_run(spark, sf_dir)
    return prompts.select("product", "cluster_id", "prompt_tokens")


@register("quote_validation", _with_themes("""
SELECT product, cluster_id, attempt, qidx, verdict FROM tverdict
"""))
def q_quote_validation(spark, sf_dir):
    """H2 + D2: verdict per quote against the cluster's representatives."""
    _, _, _, verdicts, _ = theme_run(spark, sf_dir)
    return verdicts.select("product", "cluster_id", F.col("attempt").cast("long").alias("attempt"),
                           F.col("qidx").cast("long").alias("qidx"), "verdict")


@register("theme_attempts", _with_themes("""
SELECT product, cluster_id, attempt, parse_ok, valid, reason, performed, final, outcome, keep_quotes FROM tres
"""))
def q_theme_attempts(spark, sf_dir):
    """H3 + H6 + H8: attempts made, first valid wins, last invalid keeps no quotes, broken JSON skips."""
    _, _, _, _, resolved = theme_run(spark, sf_dir)
    return resolved.select("product", "cluster_id", F.col("attempt").cast("long").alias("attempt"), "parse_ok",
                           "valid", "reason", "performed", "final", "outcome", "keep_quotes")


@register("token_budget", _with_themes("""
SELECT product, rank, cluster_id, attempt, est_tokens, used_tokens, tokens_before, requests_before, refused, admitted
FROM tadm
""", THEME_CTES))
def q_token_budget(spark, sf_dir):
    """H4: admission of each performed attempt under the run's token budget."""
    _, _, _, _, resolved = theme_run(spark, sf_dir)
    g = themes.budget_gate(resolved, THEME_BUDGET)
    return g.select("product", F.col("rank").cast("long").alias("rank"), "cluster_id",
                    F.col("attempt").cast("long").alias("attempt"), "est_tokens", "used_tokens",
                    "tokens_before", "requests_before", "refused", "admitted")


@register("token_totals", _with_themes("""
SELECT product,
       CAST(coalesce(sum(used_tokens) FILTER (WHERE final AND admitted AND outcome = 'theme'), 0) AS BIGINT) AS total_tokens,
       CAST(coalesce(sum(used_tokens) FILTER (WHERE admitted), 0) AS BIGINT) AS admitted_tokens,
       CAST(count(*) FILTER (WHERE admitted) AS BIGINT) AS requests,
       CAST(count(*) FILTER (WHERE final AND admitted AND outcome = 'theme') AS BIGINT) AS themes
FROM tadm GROUP BY product
""", THEME_CTES))
def q_token_totals(spark, sf_dir):
    """E10 + H7: tokens of finished themes and all admitted usage per run."""
    _, _, _, _, resolved = theme_run(spark, sf_dir)
    return themes.token_totals(themes.budget_gate(resolved, THEME_BUDGET))


@register("theme_summaries", _with_themes("""
SELECT a.product, row_number() OVER (PARTITION BY a.product ORDER BY a.rank) AS theme_rank, a.cluster_id,
       t.theme_name, k.size AS review_count, k.avg_rating,
       CAST(CASE WHEN a.keep_quotes THEN (SELECT count(*) FROM tquotes q WHERE q.product = a.product
             AND q.cluster_id = a.cluster_id AND q.attempt = a.attempt) ELSE 0 END AS INTEGER) AS n_quotes
FROM tadm a JOIN ranked k USING (product, cluster_id) JOIN tres t USING (product, cluster_id, attempt)
WHERE a.final AND a.admitted AND a.outcome = 'theme'
""", ROUND_CTES))
def q_theme_summaries(spark, sf_dir):
    """F4 + H3 + H4: finished themes renumbered in cluster order, with counts copied from the cluster."""
    ranked, resolved = rounds_run(spark, sf_dir)
    t = themes.finished_themes(themes.budget_gate(resolved, V.TOKEN_BUDGET_CAP), ranked)
    return t.select("product", F.col("theme_rank").cast("long").alias("theme_rank"), "cluster_id", "theme_name",
                    "review_count", "avg_rating", F.size("quotes").alias("n_quotes"))


@register("theme_rounds", _with_themes(f"""
SELECT product, cluster_id, attempt, parse_ok, valid, reason, final, outcome, completion_tokens, theme_name,
       CASE WHEN attempt = 1 THEN 2 ELSE 4 END AS n_messages,
       CASE WHEN attempt > 1 THEN 'Validation error: Hallucinated/paraphrased quote for ' || (
         SELECT arg_min(q.q_doc_id || ': ''' || q.q_text || '''', q.qidx) FROM tquotes q
         WHERE q.product = r.product AND q.cluster_id = r.cluster_id AND q.attempt = 1 AND NOT contains(q.text, q.q_text))
         || {S.q(rounds.RETRY_REQUEST)} END AS last_error
FROM tres r
""", ROUND_CTES))
def q_theme_rounds(spark, sf_dir):
    """H1 + H3 + C10: attempts of every ranked cluster, with the error that the retry prompt ends with."""
    _, resolved = rounds_run(spark, sf_dir)
    last = F.element_at("messages", -1)["content"]
    return resolved.select("product", "cluster_id", F.col("attempt").cast("long").alias("attempt"), "parse_ok", "valid",
                           "reason", "final", "outcome", "completion_tokens", F.col("parsed.theme_name").alias("theme_name"),
                           F.size("messages").cast("long").alias("n_messages"),
                           F.when(F.col("attempt") > 1, last).alias("last_error"))


# --------------------------------------------------------------- streams ----

ARRIVALS = 4  # clean reviews arrive in this many drops, by arrival number
LATENESS_DAYS = 7


@register("weekly_stream", _with(f"""
, w AS (SELECT product, date_trunc('week', {S.ts()}) AS week_start, rating, {S.ts()} AS ts FROM clean WHERE {S.ts()} IS NOT NULL)
SELECT product, strftime(week_start, '%Y-%m-%d') AS week_start, rating, count(*) AS n
FROM w WHERE week_start + INTERVAL 7 DAY < (SELECT date_trunc('millisecond', max(ts)) FROM w) - INTERVAL {LATENESS_DAYS} DAY
GROUP BY ALL
"""))
def q_weekly_stream(spark, sf_dir):
    """Weekly rating counts of all closed weeks, by a stream that is restarted for every drop of files.

    The drops are not in order of time, so many rows come behind the
    watermark; counts at closing and late rows add up to the whole.
    """
    base = f"{shared_folder(spark)}/weekly-{uuid.uuid4().hex}"
    rows = checkpointed(clean(spark, sf_dir).select("product", "review_id", "rating", parse_time("timestamp").alias("ts"),
                                                    (F.col("seq") % ARRIVALS).alias("part")))
    for part in range(ARRIVALS):
        rows.filter(F.col("part") == part).drop("part").write.parquet(f"{base}/in/part={part}")
        timed = spark.readStream.schema(rows.drop("part").schema).parquet(f"{base}/in/part=*")
        ingest_stream.start_weekly_counts(timed, f"{base}/out", f"{base}/state", f"{LATENESS_DAYS} days").awaitTermination()
    return ingest_stream.weekly_table(spark, f"{base}/out").select(
        "product", F.date_format("week_start", "yyyy-MM-dd").alias("week_start"), "rating", "n")


# -------------------------------------------------------------- explorer ----

FEED = dict(stars=(1, 2), version="all", search="", sort="newest", page=2)
SEARCH = dict(stars=(), version="src3", search=" ent", sort="helpful", page=1)
CARD_COLS = ["sentiment", "action", "thumbs_label", "initial", "display_date", "needs_clamp",
             "theme_tag", "theme_color"]


def _page_sql(p: dict) -> str:
    lo, hi = (p["page"] - 1) * 10, p["page"] * 10
    return _with(f"""
, f AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY {S.sort_sql(p['sort'])}) AS position
        FROM clean WHERE {S.explore_filter_sql(p['stars'], p['version'], p['search'])})
SELECT product, seq, rating, thumbs_up, position, {S.card_sql()}
FROM f WHERE position > {lo} AND position <= {hi}
""".replace("\n, f AS", ", f AS", 1))


def _page(spark, sf_dir, p: dict):
    out = explore.explore_page(clean(spark, sf_dir), p["stars"], p["version"], p["search"], p["sort"], p["page"])
    return out.select("product", "seq", "rating", "thumbs_up", F.col("position").cast("long").alias("position"),
                      *CARD_COLS)


@register("explore_feed", _page_sql(FEED))
def q_explore_feed(spark, sf_dir):
    """B7 + F5 + F6: 1-2 star reviews, newest first, page 2 per product, with cards."""
    return _page(spark, sf_dir, FEED)


@register("explore_search", _page_sql(SEARCH))
def q_explore_search(spark, sf_dir):
    """B8 + B9 + F5 + F6: version filter and untrimmed keyword search, most helpful first."""
    return _page(spark, sf_dir, SEARCH)


@register("explore_counts", _with(f"""
SELECT product, count(*) FILTER (WHERE {S.explore_filter_sql(SEARCH['stars'], SEARCH['version'], SEARCH['search'])}) AS filtered,
       CAST(greatest(1, ceil(count(*) FILTER (WHERE {S.explore_filter_sql(SEARCH['stars'], SEARCH['version'], SEARCH['search'])}) / 10)) AS BIGINT) AS pages
FROM clean GROUP BY product
"""))
def q_explore_counts(spark, sf_dir):
    """Filtered count and page count per product."""
    return explore.explore_counts(clean(spark, sf_dir), SEARCH["stars"], SEARCH["version"], SEARCH["search"])


@register("explore_versions", _with("""
SELECT DISTINCT product, app_version FROM clean WHERE coalesce(app_version, '') <> ''
"""))
def q_explore_versions(spark, sf_dir):
    """Distinct non-empty versions per product (descending string order)."""
    return explore.versions(clean(spark, sf_dir))


@register("review_cards", _with(f"""
SELECT product, seq, {S.card_sql()} FROM clean
"""))
def q_review_cards(spark, sf_dir):
    """C12-C17 + C25 for every clean review."""
    return explore.card_columns(clean(spark, sf_dir)).select("product", "seq", *CARD_COLS)


@register("theme_tags", _with(f"""
SELECT product, {S.theme_tag_sql()[0]} AS theme_tag, count(*) AS n FROM clean GROUP BY ALL
"""))
def q_theme_tags(spark, sf_dir):
    """C25 + D5: first-match rule tag per review, counted per product and tag."""
    name, _ = display.theme_tag()
    return clean(spark, sf_dir).groupBy("product", name.alias("theme_tag")).agg(F.count(F.lit(1)).alias("n"))


@register("theme_share", _with_themes("""
, th AS (
  SELECT a.product, a.cluster_id, k.size AS review_count, k.avg_rating
  FROM tadm a JOIN ranked k USING (product, cluster_id) WHERE a.final AND a.admitted AND a.outcome = 'theme'
)
SELECT product, cluster_id, review_count, CAST(sum(review_count) OVER (PARTITION BY product) AS BIGINT) AS reviews_in_themes,
       round(review_count * 100.0 / sum(review_count) OVER (PARTITION BY product), 1) AS share_pct,
       CASE WHEN avg_rating >= 3.5 THEN 'green' WHEN avg_rating >= 2.5 THEN 'amber' ELSE 'red' END AS rating_class
FROM th
""".replace("\n, th AS", ", th AS", 1), ROUND_CTES))
def q_theme_share(spark, sf_dir):
    """E11 + E12 + C18: share of each finished theme among reviews in the shown themes."""
    ranked, resolved = rounds_run(spark, sf_dir)
    t = themes.finished_themes(themes.budget_gate(resolved, V.TOKEN_BUDGET_CAP), ranked)
    return explore.theme_share(t).select("product", "cluster_id", "review_count", "reviews_in_themes",
                                         "share_pct", "rating_class")


# -------------------------------------------------------------- language ----

LANG_CTES = f"""
, lchars AS (
  SELECT lang, list_transform(string_split(lower(text), ''), lambda ch: CAST(unicode(ch) AS BIGINT)) AS c
  FROM documents WHERE lang IS NOT NULL
),
ltrain AS (
  SELECT lang, unnest(list_transform(range(1, len(c) - 1),
                lambda i: c[i] * 4398046511104 + c[i + 1] * 2097152 + c[i + 2])) AS gram FROM lchars
),
lcounts AS (SELECT lang, gram, count(*) AS c FROM ltrain GROUP BY ALL),
lvocab AS (SELECT count(DISTINCT gram) AS v FROM lcounts),
ltotals AS (SELECT lang, sum(c) AS n FROM lcounts GROUP BY lang),
lprofile AS (
  SELECT lang, gram, ln(c + 1) AS weight FROM lcounts
  UNION ALL
  SELECT lang, CAST(-1 AS BIGINT) AS gram, ln(n + (SELECT v FROM lvocab)) AS weight FROM ltotals
),
ldchars AS (SELECT seq, list_transform(string_split(lower(text), ''), lambda ch: CAST(unicode(ch) AS BIGINT)) AS c FROM reviews),
ldocs AS (
  SELECT seq, list_transform(range(1, len(c) - 1), lambda i: c[i] * 4398046511104 + c[i + 1] * 2097152 + c[i + 2]) AS g
  FROM ldchars
),
lrows AS (
  SELECT seq, unnest(g) AS gram, 1 AS mult FROM ldocs
  UNION ALL SELECT seq, CAST(-1 AS BIGINT) AS gram, len(g) AS mult FROM ldocs
),
lscores AS (
  SELECT r.seq, p.lang, sum(CASE WHEN r.gram = -1 THEN -r.mult * p.weight ELSE p.weight END) AS score,
         max(CASE WHEN r.gram = -1 THEN r.mult END) AS n
  FROM lrows r JOIN lprofile p USING (gram) GROUP BY ALL
),
lbest AS (
  SELECT seq, CASE WHEN n > 0 THEN lang END AS lang_pred FROM lscores
  QUALIFY row_number() OVER (PARTITION BY seq ORDER BY score DESC, lang) = 1
),
detected AS (SELECT r.*, b.lang_pred FROM reviews r LEFT JOIN lbest b USING (seq))"""


def detected(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    """Reviews (product, seq and ``columns``) with a predicted language from a model trained on the labelled documents."""
    from reviewlens.sources.tables import read_text_table
    profile = language.train_profile(read_text_table(spark, sf_dir, "documents"))
    reviews = review_view(spark, sf_dir).select("product", "seq", "text", *columns)
    return language.detect(reviews, profile)


@register("language_id", _with(LANG_CTES + """
SELECT product, seq, lang, lang_pred, coalesce(lang = lang_pred, false) AS correct FROM detected
"""))
def q_language_id(spark, sf_dir):
    """Trigram naive Bayes language of every review text (whole texts)."""
    d = detected(spark, sf_dir, "lang")
    return d.select("product", "seq", "lang", "lang_pred",
                    F.coalesce(F.col("lang") == F.col("lang_pred"), F.lit(False)).alias("correct"))


@register("ingest_quality_detected", _with(LANG_CTES + f"""
SELECT product, coalesce({S.reject_reason(lang='lang_pred')}, 'accepted') AS reason, count(*) AS n
FROM detected GROUP BY ALL
"""))
def q_ingest_quality_detected(spark, sf_dir):
    """B4 + B5 with the detector: first failing test per review, language from G0."""
    reason = F.coalesce("reason", F.when(ingest.other_language("lang_pred"), F.lit("not_english")), F.lit("accepted"))
    texts = detected(spark, sf_dir, ingest.text_reject_reason("text").alias("reason"))
    return texts.groupBy("product", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------- rendering ----

def _doc_id_col():
    # One product has no document id, so both URL defaults (C21) are exercised.
    return F.when(F.col("product") == "view", F.lit("")).otherwise(F.concat(F.lit("d_"), F.col("product")))


_DOC_ID_SQL = "CASE WHEN product = 'view' THEN '' ELSE 'd_' || product END"
_WK = S.q(RUN_WEEK)


def finished(spark, sf_dir):
    ranked, resolved = rounds_run(spark, sf_dir)
    gated = themes.budget_gate(resolved, V.TOKEN_BUDGET_CAP)
    return themes.finished_themes(gated, ranked), gated


RENDER_CTES = ROUND_CTES + f""",
th AS (
  SELECT a.product, a.cluster_id, a.attempt, a.keep_quotes, k.size AS review_count, k.avg_rating, r.theme_name, r.description, r.title, r.detail,
         row_number() OVER (PARTITION BY a.product ORDER BY a.rank) AS theme_rank
  FROM tadm a JOIN ranked k USING (product, cluster_id) JOIN tres r USING (product, cluster_id, attempt)
  WHERE a.final AND a.admitted AND a.outcome = 'theme'
),
thq AS (
  SELECT t.product, t.cluster_id,
         string_agg({S.fmt(V.REPORT_QUOTE_LINE, text='q.q_text', rating=f"coalesce(CAST(q.q_rating AS VARCHAR), {S.q(V.MISSING_QUOTE_RATING_TEXT)})")}, '' ORDER BY q.qidx) AS qlines
  FROM th t JOIN tquotes q ON q.product = t.product AND q.cluster_id = t.cluster_id AND q.attempt = t.attempt
  WHERE t.keep_quotes GROUP BY ALL
),
tblock AS (
  SELECT t.product, t.cluster_id, t.theme_rank, t.review_count,
         coalesce(t.theme_name, {S.q(V.MISSING_THEME_TEXT)}) AS theme_name,
         {S.fmt(V.REPORT_THEME_LINE, rank='t.theme_rank', name=f"coalesce(t.theme_name, {S.q(V.MISSING_THEME_TEXT)})",
                count='t.review_count', avg='CAST(t.avg_rating AS DOUBLE)',
                description='t.description')}
         || CASE WHEN q.qlines IS NOT NULL THEN {S.q(V.REPORT_QUOTES_HEADER)} || q.qlines || chr(10) ELSE '' END
         || {S.q(V.REPORT_ACTIONS_HEADER)}
         || {S.fmt(V.REPORT_ACTION_LINE, title='t.title', detail='t.detail')}
         || chr(10) AS block
  FROM th t LEFT JOIN thq q USING (product, cluster_id)
)"""


def _with_render(body: str) -> str:
    return _with(RENDER_CTES + "\n" + body)


@register("report_text", _with_render(f"""
SELECT product, {S.fmt(V.REPORT_HEADING, product='product', title=S.q(REPORT_TITLE), week=_WK)} || {S.fmt(V.REPORT_PERIOD, weeks=str(WINDOW_WEEKS), week=_WK)}
       || string_agg(block, '' ORDER BY theme_rank) || {S.q(V.REPORT_END)} AS report
FROM tblock GROUP BY product
"""))
def q_report_text(spark, sf_dir):
    """I1 + E14 + F4: report section per product run."""
    t, _ = finished(spark, sf_dir)
    n = render.nest_themes(t)
    return n.select("product", render.report_text(n, F.lit(RUN_WEEK), WINDOW_WEEKS, REPORT_TITLE).alias("report"))


_LINK_SQL = f"CASE WHEN {_DOC_ID_SQL} <> '' THEN {S.q(V.DOC_URL_PREFIX)} || {_DOC_ID_SQL} ELSE {S.q(V.DOC_SITE_ROOT)} END"


@register("email_payload", _with_render(f"""
SELECT product, {S.fmt(V.EMAIL_SUBJECT, product='product', title=S.q(MAIL_TITLE), week=_WK)} AS subject,
       {S.q(V.EMAIL_GREETING)} || chr(10) || {S.fmt(V.EMAIL_INTRO, product='product', week=_WK)} || chr(10)
         || string_agg({S.fmt(V.EMAIL_THEME_LINE, name='theme_name', count='review_count')}, chr(10) ORDER BY theme_rank)
         || chr(10) || {S.fmt(V.EMAIL_LINK_LINE, link=_LINK_SQL)} AS text_body,
       {S.q(V.EMAIL_HTML_GREETING)} || chr(10) || {S.fmt(V.EMAIL_HTML_INTRO, product='product', week=_WK)} || chr(10) || '<ul>' || chr(10)
         || string_agg({S.fmt(V.EMAIL_HTML_THEME, name='theme_name', count='review_count')}, chr(10) ORDER BY theme_rank)
         || chr(10) || '</ul>' || chr(10) || {S.fmt(V.EMAIL_HTML_LINK, link=_LINK_SQL)} AS html_body,
       {_LINK_SQL} AS doc_link
FROM tblock GROUP BY product
"""))
def q_email_payload(spark, sf_dir):
    """I2 + C21: e-mail subject, text and HTML bodies and link per product run."""
    t, _ = finished(spark, sf_dir)
    n = render.nest_themes(t)
    return n.select("product", *render.email_columns(F.lit(RUN_WEEK), _doc_id_col(), MAIL_TITLE))


MODEL = "extractive"  # no model is called

PAYLOAD_CTES = f"""
, tt AS (
  SELECT product, CAST(coalesce(sum(used_tokens) FILTER (WHERE final AND admitted AND outcome = 'theme'), 0) AS BIGINT) AS llm_tokens_used
  FROM tadm GROUP BY product
),
ws AS (
  SELECT product, count(*) AS reviews_ingested, coalesce(round_even(avg(rating), 1), 0.0) AS avg_rating,
         {', '.join(f"CAST(round_even(100.0 * count(*) FILTER (WHERE rating = {s}) / greatest(count(*), 1), 0) AS INTEGER) AS pct_{s}" for s in summary.STARS)}
  FROM clean GROUP BY product
),
pquote AS (
  SELECT t.product, t.cluster_id, list({{'text': coalesce(q.q_text, ''), 'rating': coalesce(q.q_rating, 0)}} ORDER BY q.qidx) AS quotes
  FROM th t JOIN tquotes q ON q.product = t.product AND q.cluster_id = t.cluster_id AND q.attempt = t.attempt
  WHERE t.keep_quotes GROUP BY ALL
),
ptheme AS (
  SELECT t.product, count(*) AS n_themes, CAST(sum(t.review_count) AS BIGINT) AS reviews_in_themes,
         CAST(to_json(list({{'rank': t.theme_rank, 'theme_name': coalesce(t.theme_name, {S.q(V.MISSING_THEME_PAYLOAD)}), 'review_count': t.review_count,
           'avg_rating': round_even(CAST(t.avg_rating AS DOUBLE), 2), 'description': t.description,
           'quotes': coalesce(q.quotes, []),
           'action_ideas': [{{'title': t.title, 'detail': t.detail}}]}}
           ORDER BY t.theme_rank)) AS VARCHAR) AS themes
  FROM th t LEFT JOIN pquote q USING (product, cluster_id) GROUP BY t.product
),
ptext AS (
  SELECT product, CAST(to_json({{
           'subject': {S.fmt(V.EMAIL_SUBJECT, product='product', title=S.q(MAIL_TITLE), week=_WK)},
           'text_body': {S.q(V.EMAIL_GREETING)} || chr(10) || {S.fmt(V.EMAIL_INTRO, product='product', week=_WK)} || chr(10)
             || coalesce(string_agg({S.fmt(V.EMAIL_THEME_LINE, name='theme_name', count='review_count')}, chr(10) ORDER BY theme_rank) || chr(10), '')
             || {S.fmt(V.EMAIL_LINK_LINE, link=_LINK_SQL)},
           'html_body': {S.q(V.EMAIL_HTML_GREETING)} || chr(10) || {S.fmt(V.EMAIL_HTML_INTRO, product='product', week=_WK)} || chr(10) || '<ul>' || chr(10)
             || coalesce(string_agg({S.fmt(V.EMAIL_HTML_THEME, name='theme_name', count='review_count')}, chr(10) ORDER BY theme_rank) || chr(10), '')
             || '</ul>' || chr(10) || {S.fmt(V.EMAIL_HTML_LINK, link=_LINK_SQL)},
           'doc_link': {_LINK_SQL}}}) AS VARCHAR) AS email,
         {S.fmt(V.REPORT_HEADING, product='product', title=S.q(REPORT_TITLE), week=_WK)} || {S.fmt(V.REPORT_PERIOD, weeks=str(WINDOW_WEEKS), week=_WK)}
           || coalesce(string_agg(block, '' ORDER BY theme_rank), '') || {S.q(V.REPORT_END)} AS docs_report
  FROM ws LEFT JOIN tblock USING (product) GROUP BY product
)"""


@register("dashboard_payload", _with_render(PAYLOAD_CTES.replace("\n, tt AS", ", tt AS", 1) + f"""
SELECT ws.product, {_WK} AS iso_week, {WINDOW_WEEKS} AS window_weeks, ws.reviews_ingested, ws.avg_rating,
       coalesce(p.themes, '[]') AS themes, coalesce(p.n_themes, 0) AS n_themes, coalesce(p.reviews_in_themes, 0) AS reviews_in_themes,
       CAST(to_json({{{', '.join(f"'{s}': pct_{s}" for s in summary.STARS)}}}) AS VARCHAR) AS rating_distribution,
       {S.q(MODEL)} AS model, coalesce(tt.llm_tokens_used, 0) AS llm_tokens_used, {V.TOKEN_BUDGET_CAP} AS llm_tokens_limit,
       least(100.0, coalesce(tt.llm_tokens_used, 0) / {V.TOKEN_BUDGET_CAP} * 100) AS budget_use_pct,
       'dry_run' AS doc_status, 'dry_run' AS doc_status_label, 'dry_run' AS gmail_status, 'dry_run' AS gmail_status_label,
       CASE WHEN {_DOC_ID_SQL.replace('product', 'ws.product')} <> '' THEN {S.q(V.DOC_URL_PREFIX)} || {_DOC_ID_SQL.replace('product', 'ws.product')} ELSE '' END AS doc_url,
       {_WK} AS run_id, {S.q(AS_OF)} AS run_timestamp, x.email, x.docs_report
FROM ws LEFT JOIN ptheme p USING (product) LEFT JOIN tt USING (product) JOIN ptext x USING (product)
"""))
def q_dashboard_payload(spark, sf_dir):
    """I3 + E14 + E5 + E6 + E10 + C21-C24: the whole dashboard row per product run, nested fields as JSON."""
    t, gated = finished(spark, sf_dir)
    tokens = themes.token_totals(gated).select("product", F.col("total_tokens").alias("llm_tokens_used"))
    runs = (summary.weekly_summary(clean(spark, sf_dir), RUN_WEEK).join(render.nest_themes(t), "product", "left")
            .join(tokens, "product", "left"))
    p = render.payload(runs, RUN_WEEK, WINDOW_WEEKS, MODEL, _doc_id_col(), AS_OF, REPORT_TITLE, MAIL_TITLE)
    nested = [F.to_json(c).alias(c) for c in ("themes", "rating_distribution", "email")]
    return p.select(
        "product", "iso_week", "window_weeks", "reviews_ingested", "avg_rating", *nested, "docs_report",
        F.size("themes").cast("long").alias("n_themes"),
        F.aggregate("themes", F.lit(0).cast("long"), lambda a, x: a + x["review_count"]).alias("reviews_in_themes"),
        "pipeline.*", display.budget_use_pct(F.col("pipeline.llm_tokens_used")).alias("budget_use_pct"),
        display.status_label(F.col("pipeline.doc_status")).alias("doc_status_label"),
        display.status_label(F.col("pipeline.gmail_status")).alias("gmail_status_label"))


# -------------------------------------------------------------- receipts ----

def receipt_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored receipt versions derived from the runs in the data.

    Every (product, ISO week) with clean reviews had a run: version 1 is the
    first write (both steps pending); version 2 records delivery by week
    number mod 3 (0: nothing, 1: doc appended and mail failed, 2: both done);
    weeks divisible by 5 end with a broken version 3 (no timestamp).
    """
    c = clean(spark, sf_dir).withColumn("iso_week", iso_week_label(parse_time("timestamp")))
    runs = (c.filter(F.col("iso_week").isNotNull()).groupBy("product", "iso_week")
            .agg(F.count(F.lit(1)).alias("reviews_ingested")))
    wk = F.substring("iso_week", 7, 2).cast("int")
    v = runs.withColumn("version", F.explode(
        F.when(wk % 5 == 0, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2)))))
    doc = F.when(F.col("version") == 1, F.lit("pending")).when(wk % 3 == 0, F.lit("pending")).otherwise(F.lit("appended"))
    mail = (F.when(F.col("version") == 1, F.lit("pending")).when(wk % 3 == 0, F.lit("pending"))
            .when(wk % 3 == 1, F.lit("failed")).otherwise(F.lit("drafted")))
    return v.select(
        render.idempotency_key().alias("idempotency_key"), F.col("version").cast("long").alias("version"),
        F.when(F.col("version") < 3, F.concat(F.col("iso_week"), F.lit("T00:00:00+00:00"))).alias("run_timestamp"),
        F.col("reviews_ingested").cast("long").alias("reviews_ingested"),
        F.lit(0).cast("long").alias("clusters_found"), F.lit(0).cast("long").alias("themes_generated"),
        doc.alias("doc_status"), F.when(doc == "appended", F.concat(F.lit("d_"), F.col("product"))).alias("doc_id"),
        mail.alias("gmail_status"), F.when(mail == "drafted", F.concat(F.lit("m_"), F.col("iso_week"))).alias("draft_id"))


INSERT_WEEKS = ("2024-W08", "2024-W10", RUN_WEEK)

RECEIPT_CTES = f"""
, rruns AS (
  SELECT product, {S.iso_week(S.ts())} AS iso_week, count(*) AS reviews_ingested
  FROM clean WHERE {S.ts()} IS NOT NULL GROUP BY ALL
),
rver AS (
  SELECT r.*, v.version, CAST(substr(iso_week, 7, 2) AS INTEGER) AS wk
  FROM rruns r, range(1, 4) v(version)
  WHERE v.version < 3 OR CAST(substr(iso_week, 7, 2) AS INTEGER) % 5 = 0
),
rst AS (
  SELECT *, CASE WHEN version = 1 OR wk % 3 = 0 THEN 'pending' ELSE 'appended' END AS doc_status,
            CASE WHEN version = 1 OR wk % 3 = 0 THEN 'pending' WHEN wk % 3 = 1 THEN 'failed' ELSE 'drafted' END AS gmail_status
  FROM rver
),
versions AS (
  SELECT regexp_replace(lower(product), '[^a-z0-9]+', '-', 'g') || ':' || iso_week AS idempotency_key, CAST(version AS BIGINT) AS version,
         CASE WHEN version < 3 THEN iso_week || 'T00:00:00+00:00' END AS run_timestamp,
         CAST(reviews_ingested AS BIGINT) AS reviews_ingested, CAST(0 AS BIGINT) AS clusters_found,
         CAST(0 AS BIGINT) AS themes_generated, doc_status,
         CASE WHEN doc_status = 'appended' THEN 'd_' || product END AS doc_id, gmail_status,
         CASE WHEN gmail_status = 'drafted' THEN 'm_' || iso_week END AS draft_id
  FROM rst
),
current AS (
  SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY version DESC) = 1
),
current_ok AS (SELECT * FROM current WHERE idempotency_key IS NOT NULL AND run_timestamp IS NOT NULL)"""


def _with_receipts(body: str) -> str:
    return _with(RECEIPT_CTES.replace("\n, rruns", ", rruns", 1) + "\n" + body)


@register("receipts_latest", _with_receipts("""
SELECT idempotency_key, version, run_timestamp, reviews_ingested, doc_status, doc_id, gmail_status, draft_id
FROM current_ok
"""))
def q_receipts_latest(spark, sf_dir):
    """J1 + J2: latest receipt version per key; a broken latest version means no receipt."""
    cur = receipts.latest(receipt_versions(spark, sf_dir))
    return cur.select("idempotency_key", "version", "run_timestamp", "reviews_ingested", "doc_status", "doc_id",
                      "gmail_status", "draft_id")


@register("receipts_insert", _with_receipts(f"""
, newruns AS (
  SELECT regexp_replace(lower(product), '[^a-z0-9]+', '-', 'g') || ':' || w.week AS idempotency_key, count(*) AS reviews_ingested
  FROM clean, (SELECT unnest([{', '.join(S.q(w) for w in INSERT_WEEKS)}]) AS week) w GROUP BY product, w.week
),
newest AS (SELECT idempotency_key, max(version) AS version FROM versions GROUP BY ALL)
SELECT n.idempotency_key, CAST(coalesce(v.version, 0) + 1 AS BIGINT) AS version, CAST(n.reviews_ingested AS BIGINT) AS reviews_ingested
FROM newruns n LEFT JOIN newest v USING (idempotency_key)
WHERE n.idempotency_key NOT IN (SELECT idempotency_key FROM current_ok)
""".replace("\n, newruns", ", newruns", 1)))
def q_receipts_insert(spark, sf_dir):
    """J3 + C20: receipts of three weeks appended only for keys without a current receipt.

    One week has healthy receipts, one broken newest versions, the run's week has none.
    """
    new = (clean(spark, sf_dir).groupBy("product").agg(F.count(F.lit(1)).cast("long").alias("reviews_ingested"))
           .withColumn("iso_week", F.explode(F.array(*map(F.lit, INSERT_WEEKS))))
           .select(render.idempotency_key().alias("idempotency_key"), "reviews_ingested"))
    out = receipts.insert_if_absent(receipt_versions(spark, sf_dir), new)
    return out.select("idempotency_key", "version", "reviews_ingested")


@register("delivery_outbox", _with_receipts("""
SELECT idempotency_key, 'google_doc' AS channel, 1 AS step, CAST(NULL AS VARCHAR) AS depends_on, doc_status, gmail_status
FROM current_ok WHERE doc_status <> 'appended'
UNION ALL
SELECT idempotency_key, 'gmail' AS channel, 2 AS step,
       CASE WHEN doc_status <> 'appended' THEN 'google_doc' END AS depends_on, doc_status, gmail_status
FROM current_ok WHERE gmail_status <> 'drafted'
"""))
def q_delivery_outbox(spark, sf_dir):
    """J4 + B12: delivery steps still to do; delivered steps are skipped."""
    return receipts.delivery_outbox(receipts.latest(receipt_versions(spark, sf_dir)))


@register("receipt_status", _with_receipts("""
SELECT idempotency_key, doc_status, gmail_status FROM current_ok
"""))
def q_receipt_status(spark, sf_dir):
    """J5 + J6: key and both delivery statuses, sorted by key."""
    return receipts.status_all(receipts.latest(receipt_versions(spark, sf_dir)))


RECEIPT_KEY = "view:2024-W08"


@register("receipt_one", _with_receipts(f"""
SELECT idempotency_key, version, doc_status, gmail_status FROM current_ok WHERE idempotency_key = {S.q(RECEIPT_KEY)}
"""))
def q_receipt_one(spark, sf_dir):
    """The current receipt of one product and week (no row when there is none)."""
    one = receipts.status_of(receipts.latest(receipt_versions(spark, sf_dir)), RECEIPT_KEY)
    return one.select("idempotency_key", "version", "doc_status", "gmail_status")


def delivery_attempts(current: DataFrame) -> DataFrame:
    """Results of the outbox's steps, derived from the receipts; a mail waiting on a failed doc is not tried."""
    todo = receipts.delivery_outbox(current).join(current.select("idempotency_key", "reviews_ingested"), "idempotency_key")
    is_doc, doc_ok = F.col("channel") == "google_doc", F.col("reviews_ingested") % 3 != 0
    return todo.filter(is_doc | F.col("depends_on").isNull() | doc_ok).select(
        "idempotency_key", "channel", F.when(is_doc, doc_ok).otherwise(F.col("reviews_ingested") % 2 == 0).alias("ok"),
        F.concat("channel", F.lit("-"), "idempotency_key").alias("ref"))


OUTCOME_CTES = """
, todo AS (
  SELECT *, doc_status <> 'appended' AS doc_todo, gmail_status <> 'drafted' AS mail_todo,
         reviews_ingested % 3 <> 0 AS doc_ok, reviews_ingested % 2 = 0 AS mail_ok
  FROM current_ok
),
outcome AS (
  SELECT idempotency_key, run_timestamp, reviews_ingested,
         CASE WHEN NOT doc_todo THEN doc_status WHEN doc_ok THEN 'appended' ELSE 'failed' END AS doc_status,
         CASE WHEN doc_todo AND doc_ok THEN 'google_doc-' || idempotency_key ELSE doc_id END AS doc_id,
         CASE WHEN NOT mail_todo OR (doc_todo AND NOT doc_ok) THEN gmail_status
              WHEN mail_ok THEN 'drafted' ELSE 'failed' END AS gmail_status,
         CASE WHEN mail_todo AND mail_ok AND NOT (doc_todo AND NOT doc_ok) THEN 'gmail-' || idempotency_key
              ELSE draft_id END AS draft_id
  FROM todo WHERE doc_todo OR mail_todo
)"""


@register("delivery_results", _with_receipts(OUTCOME_CTES.replace("\n, todo", ", todo", 1) + """
SELECT idempotency_key, reviews_ingested, doc_status, doc_id, gmail_status, draft_id FROM outcome
"""))
def q_delivery_results(spark, sf_dir):
    """Results of the delivery steps folded back into the receipts; a failed doc leaves the mail untried."""
    cur = receipts.latest(receipt_versions(spark, sf_dir))
    return receipts.record_outcome(cur, delivery_attempts(cur)).select(
        "idempotency_key", "reviews_ingested", "doc_status", "doc_id", "gmail_status", "draft_id")


@register("receipts_upsert", _with_receipts(OUTCOME_CTES.replace("\n, todo", ", todo", 1) + """
SELECT o.idempotency_key, CAST(v.version + 1 AS BIGINT) AS version, o.run_timestamp, o.doc_status, o.gmail_status
FROM outcome o JOIN (SELECT idempotency_key, max(version) AS version FROM versions GROUP BY ALL) v USING (idempotency_key)
"""))
def q_receipts_upsert(spark, sf_dir):
    """J2 write side: the delivered receipts as new versions."""
    versions = receipt_versions(spark, sf_dir)
    cur = receipts.latest(versions)
    return receipts.upsert(versions, receipts.record_outcome(cur, delivery_attempts(cur))).select(
        "idempotency_key", "version", "run_timestamp", "doc_status", "gmail_status")


# ------------------------------------------- bounded scans and responses ----

CAP = 25  # binds on every product of the given data
SCAN_MODES = {"newest": f"{S.ts()} DESC NULLS LAST", "rating": "rating DESC NULLS LAST",
              "most_relevant": "thumbs_up DESC NULLS LAST", "unlisted": f"{S.ts()} DESC NULLS LAST"}


@register("ingest_quality_capped", _with("\nUNION ALL\n".join(f"""(
SELECT {S.q(mode)} AS sort_mode, product, seq, review_id, rating, thumbs_up FROM gated
QUALIFY row_number() OVER (PARTITION BY product ORDER BY {order}, seq) <= {CAP})""" for mode, order in SCAN_MODES.items())))
def q_ingest_quality_capped(spark, sf_dir):
    """A1 + A2 + F9: a binding cap per product in each source order; an unlisted mode is newest."""
    rv, out = review_view(spark, sf_dir), None
    for mode in SCAN_MODES:
        one = ingest.bounded_scan(rv, CAP, mode).select(
            F.lit(mode).alias("sort_mode"), "product", "seq", "review_id", "rating", "thumbs_up")
        out = one if out is None else out.unionByName(one)
    return out


@register("response_rows", _with("""
SELECT product, seq, CAST(to_json({'review_id': review_id, 'author': author, 'rating': rating, 'text': text,
       'timestamp': timestamp, 'thumbs_up': thumbs_up, 'app_version': app_version}) AS VARCHAR) AS value
FROM gated
"""))
def q_response_rows(spark, sf_dir):
    """A5: the seven response fields of every accepted review as JSON."""
    return ingest.response_rows(ingest.quality_gate(review_view(spark, sf_dir)))


# ------------------------------------------ prompts, usage, cards, themes ----

@register("prompt_messages", _with_themes(f"""
SELECT product, cluster_id, 0 AS position, 'system' AS role, {_SYS} AS content FROM tprompt
UNION ALL
SELECT product, cluster_id, 1 AS position, 'user' AS role, 'Reviews:' || chr(10) || block AS content FROM tprompt
"""))
def q_prompt_messages(spark, sf_dir):
    """The two messages of each cluster's prompt."""
    prompts = themes.cluster_prompts(*ranked_clusters(spark, sf_dir))
    return prompts.select("product", "cluster_id", F.posexplode("messages").alias("position", "m")).select(
        "product", "cluster_id", "position", "m.role", "m.content")


@register("usage_daily", _with_themes(f"""
SELECT product, {S.q(AS_OF[:10])} AS day, count(*) AS requests, CAST(sum(used_tokens) AS BIGINT) AS tokens
FROM tadm WHERE admitted GROUP BY product
""", ROUND_CTES))
def q_usage_daily(spark, sf_dir):
    """H7: the usage table's requests and tokens per run and day."""
    _, gated = finished(spark, sf_dir)
    daily = themes.usage_daily(themes.usage_records(gated, F.lit(AS_OF).cast("timestamp")))
    return daily.withColumn("day", F.col("day").cast("string"))


@register("quote_cards", _with_render("""
SELECT t.product, t.cluster_id, q.qidx AS position, q.q_text AS text, q.q_rating AS rating,
       CASE WHEN q.q_rating >= 4 THEN 'green' WHEN q.q_rating <= 2 THEN 'red' ELSE 'amber' END AS quote_class
FROM th t JOIN tquotes q ON q.product = t.product AND q.cluster_id = t.cluster_id AND q.attempt = t.attempt
WHERE t.keep_quotes AND q.qidx < 3
"""))
def q_quote_cards(spark, sf_dir):
    """F7 + C19: first three quotes of each finished theme with their class."""
    return themes.quote_cards(finished(spark, sf_dir)[0])


@register("run_counters", _with_render("""
SELECT c.product, c.n AS reviews_ingested, coalesce(k.n, 0) AS clusters_found, coalesce(t.n, 0) AS themes_generated
FROM (SELECT product, count(*) AS n FROM clean GROUP BY product) c
LEFT JOIN (SELECT product, count(*) AS n FROM ranked GROUP BY product) k USING (product)
LEFT JOIN (SELECT product, count(*) AS n FROM th GROUP BY product) t USING (product)
"""))
def q_run_counters(spark, sf_dir):
    """Reviews, clusters and themes of each run."""
    ranked, resolved = rounds_run(spark, sf_dir)
    done = themes.finished_themes(themes.budget_gate(resolved, V.TOKEN_BUDGET_CAP), ranked)
    count = lambda df, name: df.groupBy("product").agg(F.count(F.lit(1)).alias(name))
    out = (count(clean(spark, sf_dir), "reviews_ingested").join(count(ranked, "clusters_found"), "product", "left")
           .join(count(done, "themes_generated"), "product", "left"))
    return out.fillna(0, ["clusters_found", "themes_generated"])


_ACTION_SQL = "CASE tag " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v[0])}" for k, v in V.THEME_ACTIONS.items()) + " END"


@register("cluster_themes", _with_clusters(f"""
, cterm AS (
  SELECT product, cluster_id, term, count(*) AS n
  FROM (SELECT product, cluster_id, unnest(list_distinct(regexp_extract_all(lower(text), '{summarise.TERM_PATTERN}'))) AS term
        FROM members) GROUP BY ALL
),
cname AS (
  SELECT product, cluster_id, string_agg(term, ' / ' ORDER BY place) AS theme_name
  FROM (SELECT t.product, t.cluster_id, t.term, row_number() OVER (
               PARTITION BY t.product, t.cluster_id ORDER BY round(t.n * ln(m.total / d.df), 6) DESC, t.term) AS place
        FROM cterm t JOIN (SELECT product, term, sum(n) AS df FROM cterm GROUP BY ALL) d USING (product, term)
        JOIN (SELECT product, count(*) AS total FROM members GROUP BY product) m USING (product)
        WHERE t.cluster_id <> -1)
  WHERE place <= {summarise.NAME_TERMS} GROUP BY ALL
),
csent AS (
  SELECT *, list_filter(list_transform(regexp_extract_all(text, '{summarise.SENTENCE_PATTERN}'), lambda s: trim(s)),
                        lambda s: length(s) > 0) AS sentences FROM reps
),
cquote AS (
  SELECT product, cluster_id, string_agg(doc_id || ': ' || CASE WHEN len(sentences) > 0 THEN list_reduce(
           sentences, lambda a, b: CASE WHEN length(b) < length(a) THEN b ELSE a END) ELSE '' END, chr(10) ORDER BY rank) AS quotes
  FROM csent GROUP BY ALL
),
ctag AS (
  SELECT product, cluster_id, tag, count(*) AS n
  FROM (SELECT product, cluster_id, {S.theme_tag_sql()[0]} AS tag FROM reps) GROUP BY product, cluster_id, tag
  QUALIFY row_number() OVER (PARTITION BY product, cluster_id ORDER BY count(*) DESC, tag) = 1
)
SELECT k.product, k.rank, k.cluster_id, coalesce(n.theme_name, {S.q(V.MISSING_THEME_TEXT)}) AS theme_name,
       CAST(k.size AS VARCHAR) || ' reviews, most about ' || tag AS description, q.quotes, {_ACTION_SQL} AS action
FROM ranked k LEFT JOIN cname n USING (product, cluster_id) LEFT JOIN cquote q USING (product, cluster_id)
LEFT JOIN ctag USING (product, cluster_id)
"""))
def q_cluster_themes(spark, sf_dir):
    """H1: extractive theme of each ranked cluster: name, description, verbatim quotes, action."""
    ranked, reps = ranked_clusters(spark, sf_dir)
    t = summarise.extractive_themes(ranked, reps, members(spark, sf_dir))
    lines = F.transform("quotes", lambda q: F.concat(q["doc_id"], F.lit(": "), q["text"]))
    return t.select("product", F.col("rank").cast("long").alias("rank"), "cluster_id", "theme_name", "description",
                    F.array_join(lines, "\n").alias("quotes"), F.get("action_ideas", F.lit(0))["title"].alias("action"))


# --------------------------------------------------------------- vectors ----

TEXT_DIMS = 16
_SIGNED_SUMS = ", ".join(f"sum(CASE WHEN substr(h, {i + 1}, 1) >= '8' THEN -w ELSE w END) AS s{i}" for i in range(TEXT_DIMS))


@register("embed_text", _with(f"""
, terms AS (
  SELECT product, seq, term, count(*) AS tf
  FROM (SELECT product, seq, unnest(string_split_regex(lower(text), '\\W+')) AS term FROM clean) WHERE term <> '' GROUP BY ALL),
held AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
weighted AS (
  SELECT product, seq, tf * ln(((SELECT count(*) FROM clean) + 1.0) / (df + 1)) AS w, md5(term) AS h
  FROM terms JOIN held USING (term)),
sums AS (SELECT product, seq, sqrt(sum(w * w)) AS length, {_SIGNED_SUMS} FROM weighted GROUP BY ALL)
SELECT product, seq, {", ".join(f"round(coalesce(s{i} / nullif(length, 0), 0), 9) + 0.0 AS x{i}" for i in range(TEXT_DIMS))}
FROM clean LEFT JOIN sums USING (product, seq)
""".replace("\n, terms", ", terms", 1)))
def q_embed_text(spark, sf_dir):
    """G1: a vector of every clean review from all of its words: TF-IDF over the whole vocabulary, projected by hashed signs."""
    placed = vectors.project_terms(checkpointed(clean(spark, sf_dir).select("product", "seq", "text")), dims=TEXT_DIMS, portable=True)
    return placed.select("product", "seq", *[(F.get("reduced", F.lit(i)) + F.lit(0.0)).alias(f"x{i}") for i in range(TEXT_DIMS)])


NEAR, LINKED, QUERY_EVERY = 5, 20, 100  # neighbours that count, links of a node, every so many ids are a query


def embedded(spark, sf_dir):
    """Distinct given vectors as nodes, the rows they stand for, and the neighbour graph between them."""
    from reviewlens.sources.tables import read_table
    nodes, rows = neighbours.classes(read_table(spark, sf_dir, "embeddings"), 64, "vec_id", "embedding", NEAR)
    return nodes, checkpointed(rows), neighbours.descend(nodes, 64, LINKED)


def nearest_queries(rows, vec, squares=False):
    """(query, near) of every hundredth id by brute force; ``rows`` (key, vec)."""
    points = rows.select("key", F.col(vec).alias("p"))
    asked = points.filter(F.col("key") % QUERY_EVERY == 0).select(F.col("key").alias("query"), F.col("p").alias("q"))
    return neighbours.nearest(asked, points, NEAR, squares)


@register("knn_graph")
def q_knn_graph(spark, sf_dir):
    """Five nearest neighbours of every given vector, with the recall of every hundredth id (rows only: approximate)."""
    from reviewlens.sources.tables import read_table
    vectors_ = read_table(spark, sf_dir, "embeddings")
    found = checkpointed(neighbours.knn_graph(vectors_, NEAR, 64, degree=LINKED))
    unit = vectors_.select(F.col("vec_id").alias("key"), neighbours.unit_vector(F.col("embedding"), 64).alias("vec")).dropna()
    exact = nearest_queries(unit, "vec")
    lists = found.groupBy(F.col("vec_id").alias("query")).agg(F.collect_list("neighbour").alias("near"))
    kept = neighbours.recall(lists, exact)
    return found.join(kept, found["vec_id"] == kept["query"], "left").select("vec_id", "rank", "neighbour", "distance", F.col("kept").alias("recall"))


@register("reduce_dims")
def q_reduce_dims(spark, sf_dir):
    """Five dimensions along the neighbour graph; the share of near neighbours that every hundredth id keeps, and
    keeps in as many sign projections (rows only)."""
    nodes, rows, graph = embedded(spark, sf_dir)
    reduced = spectral.spectral_reduce(nodes, graph, 64)
    places = checkpointed(rows.join(nodes.select("id", "vec"), "id").join(reduced, "id", "left").select(
        "key", "vec", "reduced", vectors.sign_projection(F.col("vec"), 64, spectral.START_MASKS[:5]).alias("signs")))
    truth = checkpointed(nearest_queries(places, "vec", squares=True))
    reduced_near = nearest_queries(places.dropna(subset=["reduced"]), "reduced", squares=True)
    kept = neighbours.recall(reduced_near, truth).withColumnRenamed("query", "key")
    signs = neighbours.recall(nearest_queries(places, "signs", squares=True), truth).select(
        F.col("query").alias("key"), F.col("kept").alias("kept_by_signs"))
    return places.join(kept, "key", "left").join(signs, "key", "left").select(
        F.col("key").alias("vec_id"), F.size("reduced").alias("k"), "reduced", "kept", "kept_by_signs")


@register("density_hierarchy")
def q_density_hierarchy(spark, sf_dir):
    """Clusters of the given vectors without a distance, by excess of mass over the neighbour graph (rows only)."""
    nodes, rows, graph = embedded(spark, sf_dir)
    sizes = checkpointed(rows.groupBy("id").agg(F.count("*").alias("n")))
    found = hierarchy.density_hierarchy(graph, sizes)
    return rows.join(found, "id").select(F.col("key").alias("vec_id"), "cluster_id")


# --------------------------------------------------- density clustering ----

MASKS, DENSITY_EPS = (11, 21, 38), 0.4
REVIEW_EPS = 0.8  # projected texts lie about one from the origin in each coordinate
_COORDINATES = ", ".join("(" + " ".join(("-" if (i & m).bit_count() % 2 else "+") + f" CAST(embedding[{i + 1}] AS DOUBLE)"
                                        for i in range(64)).removeprefix("+ ") + f") AS x{j}" for j, m in enumerate(MASKS))


@register("density_components", f"""
WITH RECURSIVE p AS (SELECT vec_id, {_COORDINATES} FROM embeddings),
near AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM p a, p b
  WHERE {' + '.join(f'(a.x{j} - b.x{j}) * (a.x{j} - b.x{j})' for j in range(len(MASKS)))} <= {DENSITY_EPS * DENSITY_EPS!r}
),
core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) > {V.MIN_SAMPLES}),
link AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id AS root, id AS node FROM core UNION SELECT r.root, l.b FROM reach r JOIN link l ON l.a = r.node),
label AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
kept AS (SELECT root FROM label GROUP BY root HAVING count(*) >= {V.MIN_CLUSTER_SIZE})
SELECT p.vec_id, coalesce(k.root, -1) AS cluster_id
FROM p LEFT JOIN label l ON l.node = p.vec_id LEFT JOIN kept k USING (root)
""")
def q_density_components(spark, sf_dir):
    """G3 + G3a: density clusters of the projected vectors, found without a fixed number of clusters."""
    from reviewlens.sources.tables import read_table
    v = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", vectors.sign_projection(F.col("embedding"), 64, MASKS).alias("reduced"))
    return density.density_components(v, DENSITY_EPS, len(MASKS), key="vec_id").select("vec_id", "cluster_id")


@register("review_pipeline")
def q_review_pipeline(spark, sf_dir):
    """Every clean review from text to ranked cluster: G1, G2, G3, G5, F3 (rows only: hashed signs have no SQL twin)."""
    reviews = checkpointed(normalized(spark, sf_dir))
    placed = density.density_components(vectors.project_terms(reviews), REVIEW_EPS, 3, key="seq", by=("product",))
    m = checkpointed(reviews.join(placed.withColumnRenamed("reduced", "embedding"), ["product", "seq"]))
    ranked = clusters.rank_clusters(clusters.cluster_stats(m), clusters.global_mean(m))
    built = clusters.build_clusters(m).select("product", "cluster_id", "centroid", "representatives")
    return ranked.join(built, ["product", "cluster_id"]).select(
        "product", F.col("rank").cast("long").alias("rank"), "cluster_id", "size", "avg_rating",
        F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"),
        F.transform("representatives", lambda r: r["doc_id"]).alias("representatives"))


from reviewlens.plans import catalog_io  # noqa: E402,F401 (registers its queries)
