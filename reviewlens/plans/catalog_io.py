"""Registered queries that write and read back: landing scans, sinks, indexes, and counts taken while a sink runs.

Each writes into a folder of its own below the shared folder and returns what
a reader finds there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens import fixed_values as V
from reviewlens.functions.dates import iso_week_label, parse_time
from reviewlens.operators import clusters, explore, ingest, receipts, render, rules, search_index
from reviewlens.plans import sqlparts as S
from reviewlens.plans.catalog import (AS_OF, CARD_COLS, ORACLE_SQL, QUERIES, RUN_WEEK, WINDOW_WEEKS, _page_sql, _with,
                                      OUTCOME_CTES, _with_clusters, _with_receipts, clean, delivery_attempts, members,
                                      receipt_versions, register)
from reviewlens.plans.review_view import review_view
from reviewlens.sources import landing
from reviewlens.sources.shared import shared_folder

PRODUCTS = ("click", "error", "purchase", "signup", "view")
FAR = "2100-01-01 00:00:00"  # no review that has a time lies in the window that ends here


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(spark, sf_dir).withColumn("iso_week", iso_week_label(parse_time("timestamp")))


# --------------------------------------------------------------- landing ----

@register("landing_scan", "WITH " + S.REVIEW_VIEW_SQL + """
SELECT CASE WHEN seq % 6 = 1 THEN '' ELSE review_id END AS review_id, CASE WHEN seq % 7 = 1 THEN '' ELSE author END AS author,
       CASE WHEN seq % 8 = 1 THEN 0 ELSE rating END AS rating, CASE WHEN seq % 9 = 1 THEN NULL ELSE text END AS text,
       CASE WHEN seq % 10 = 1 THEN '' ELSE timestamp END AS timestamp,
       CASE WHEN seq % 11 = 1 THEN 0 ELSE thumbs_up END AS thumbs_up, app_version
FROM reviews
""")
def q_landing_scan(spark, sf_dir):
    """A1 + A3: JSON Lines landings, some fields missing, scanned with the fixed schema and mapped with the defaults."""
    path, rv = _folder(spark, "landing"), review_view(spark, sf_dir)
    some = lambda n, c: F.when(F.col("seq") % n != 1, F.col(c))
    rv.select(some(6, "review_id").alias("reviewId"), some(7, "author").alias("userName"), some(8, "rating").alias("score"),
              some(9, "text").alias("content"), some(10, "timestamp").alias("at"), some(11, "thumbs_up").alias("thumbsUpCount"),
              F.col("app_version").alias("reviewCreatedVersion")).write.json(path)
    return ingest.map_records(landing.read_raw_records(spark, path), "app").select(*landing.REVIEW_FIELDS)


@register("tool_responses", _with("""
SELECT CASE WHEN seq % 5 <> 2 THEN review_id END AS review_id, author, CASE WHEN seq % 5 <> 2 THEN rating END AS rating,
       CASE WHEN seq % 5 <> 2 THEN text END AS text, CASE WHEN seq % 5 <> 2 THEN timestamp END AS timestamp,
       CASE WHEN seq % 5 <> 2 THEN thumbs_up END AS thumbs_up, CASE WHEN seq % 5 <> 2 THEN app_version END AS app_version,
       seq % 5 = 2 OR review_id IS NULL OR author IS NULL OR rating IS NULL OR text IS NULL OR timestamp IS NULL
           OR thumbs_up IS NULL AS reject
FROM gated
"""))
def q_tool_responses(spark, sf_dir):
    """A4 + A5: response rows decoded again; every third one is JSON text in a JSON string, every fifth lacks its fields."""
    rows = ingest.response_rows(ingest.quality_gate(review_view(spark, sf_dir)))
    poor = F.to_json(F.struct(F.get_json_object("value", "$.author").alias("author")))
    rows = rows.withColumn("value", F.when(F.col("seq") % 5 == 2, poor).otherwise(F.col("value")))
    wrapped = F.regexp_extract(F.to_json(F.struct(F.col("value").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return ingest.decode_tool_response(rows.select(F.when(F.col("seq") % 3 == 0, wrapped).otherwise(F.col("value")).alias("value")))


# ----------------------------------------------------------------- sinks ----

_WEEK = S.iso_week(S.ts())


@register("review_sink", _with(f"""
SELECT product, {_WEEK} AS iso_week, review_id, author, rating, text, timestamp, thumbs_up, app_version FROM clean
"""))
def q_review_sink(spark, sf_dir):
    """All review fields by product and week, read back; the second write replaces its own partitions only."""
    path, df = _folder(spark, "reviews"), weekly(spark, sf_dir)
    landing.write_reviews(df, path)
    landing.write_reviews(df.filter(F.col("product") == PRODUCTS[0]), path)
    fields = df.select("product", "iso_week", *landing.REVIEW_FIELDS)
    return spark.read.schema(fields.schema).json(path).select(fields.columns)


@register("anonymised_sink", _with(f"""
SELECT product, {_WEEK} AS iso_week, rating, text, thumbs_up, app_version FROM clean
"""))
def q_anonymised_sink(spark, sf_dir):
    """A8 + C4: identity columns never reach the files."""
    path, df = _folder(spark, "anonymised"), weekly(spark, sf_dir)
    landing.write_anonymised(df, path)
    fields = df.select("product", "iso_week", "rating", "text", "thumbs_up", "app_version")
    return spark.read.schema(fields.schema).json(path).select(fields.columns)


@register("themes_sink", "SELECT *, " + S.q(RUN_WEEK) + " AS iso_week FROM (" + ORACLE_SQL["theme_summaries"] + ")")
def q_themes_sink(spark, sf_dir):
    """Finished themes of a run, written and read back."""
    path, df = _folder(spark, "themes"), QUERIES["theme_summaries"](spark, sf_dir).withColumn("iso_week", F.lit(RUN_WEEK))
    landing.write_themes(df, path)
    return spark.read.schema(df.schema).json(path).select(df.columns)


@register("payload_load", "SELECT * FROM (" + ORACLE_SQL["dashboard_payload"] + ") WHERE product = 'view'")
def q_payload_load(spark, sf_dir):
    """A10 + A11: dashboard rows written once, one product's row loaded from its partition."""
    path, df = _folder(spark, "payload"), QUERIES["dashboard_payload"](spark, sf_dir)
    landing.write_payload(df, path)
    return landing.read_payload(spark, path, "view", RUN_WEEK, df.schema).select(df.columns)


@register("export_lines", _with("""
SELECT product, seq, review_id, author, rating, text, thumbs_up, app_version FROM clean
"""))
def q_export_lines(spark, sf_dir):
    """Every clean review as one JSON line, parsed again."""
    path, df = _folder(spark, "export"), clean(spark, sf_dir).select(
        "product", "seq", "review_id", "author", "rating", "text", "thumbs_up", "app_version")
    landing.export_json(df, path)
    return spark.read.text(path).select(F.from_json("value", df.schema).alias("r")).select("r.*")


@register("guarded_sink", _with(f"""
SELECT product, {_WEEK} AS iso_week, count(*) AS n, true AS written, false AS written_when_empty FROM clean GROUP BY ALL
"""))
def q_guarded_sink(spark, sf_dir):
    """The run's reviews are written; a later run without any writes nothing and replaces nothing."""
    path, df = _folder(spark, "guarded"), weekly(spark, sf_dir)
    written = landing.write_if_any(df, landing.write_reviews, path)
    late = ingest.clean_reviews(review_view(spark, sf_dir).filter(parse_time("timestamp").isNotNull()), FAR, WINDOW_WEEKS)
    again = landing.write_if_any(late.withColumn("iso_week", F.lit(RUN_WEEK)), landing.write_reviews, path)
    back = spark.read.schema("product string, iso_week string, rating int").json(path)
    return back.groupBy("product", "iso_week").agg(F.count("*").alias("n")).select(
        "*", F.lit(written).alias("written"), F.lit(again).alias("written_when_empty"))


@register("ingest_observed_counts", ORACLE_SQL["ingest_stage_counts"])
def q_ingest_observed_counts(spark, sf_dir):
    """The stage counts, taken while the clean reviews are written; the reviews are read once."""
    df, observations = ingest.observed_clean(review_view(spark, sf_dir), AS_OF, PRODUCTS, WINDOW_WEEKS)
    df.write.parquet(_folder(spark, "observed"))
    rows = [(r["product"], r["landed"], r["accepted"], r["in_window"], r["deduplicated"])
            for r in ingest.observed_counts(observations)]
    return spark.createDataFrame(rows, "product string, landed long, accepted long, in_window long, deduplicated long")


@register("receipt_report", _with_receipts("""
SELECT idempotency_key, run_timestamp IS NOT NULL AS readable, CASE WHEN run_timestamp IS NOT NULL THEN doc_status END AS doc_status,
       CASE WHEN run_timestamp IS NOT NULL THEN gmail_status END AS gmail_status
FROM current
"""))
def q_receipt_report(spark, sf_dir):
    """Status of every key, unreadable receipts among them."""
    return receipts.status_report(receipt_versions(spark, sf_dir))


@register("receipts_store", _with_receipts(OUTCOME_CTES.replace("\n, todo", ", todo", 1) + """
SELECT c.idempotency_key, CAST(c.version + CASE WHEN o.idempotency_key IS NULL THEN 0 ELSE 1 END AS BIGINT) AS version,
       coalesce(o.doc_status, c.doc_status) AS doc_status, coalesce(o.gmail_status, c.gmail_status) AS gmail_status
FROM current_ok c LEFT JOIN outcome o USING (idempotency_key)
"""))
def q_receipts_store(spark, sf_dir):
    """J1 + J2: versions in a store of files; delivered receipts are appended and read back as the newest."""
    path, versions = _folder(spark, "receipts"), receipt_versions(spark, sf_dir)
    receipts.append_versions(versions, path)
    stored = spark.read.schema(versions.schema).parquet(path)
    cur = receipts.latest(stored)
    new = receipts.upsert(stored, receipts.record_outcome(cur, delivery_attempts(cur)))
    receipts.append_versions(new.select(versions.columns), path)
    return receipts.latest(spark.read.schema(versions.schema).parquet(path)).select(
        "idempotency_key", "version", "doc_status", "gmail_status")


# ------------------------------------------------ themes, clusters, rules ----

@register("theme_defaults", _with(f"""
SELECT product, CAST(rating AS BIGINT) AS rank, CASE WHEN rating = 1 THEN {S.q(V.MISSING_THEME_PAYLOAD)} ELSE 'rated ' || rating END AS theme_name,
       CASE WHEN rating = 2 THEN 0 ELSE count(*) END AS review_count,
       CASE WHEN rating = 3 THEN 0.0 ELSE CAST(rating AS DOUBLE) END AS avg_rating,
       CASE WHEN rating = 4 THEN '' ELSE min(review_id) END AS description,
       CASE WHEN rating = 5 THEN '' ELSE min(review_id) || ' ' || CASE WHEN rating = 1 THEN 0 ELSE rating END END AS quotes,
       CASE WHEN rating = 5 THEN '' ELSE 'act|' END AS actions
FROM clean GROUP BY product, rating
"""))
def q_theme_defaults(spark, sf_dir):
    """A theme for each rating of a product, each lacking another field; the payload fills the gaps."""
    r = F.col("rating")
    t = clean(spark, sf_dir).groupBy("product", "rating").agg(F.count("*").alias("n"), F.min("review_id").alias("id")).select(
        "product", r.cast("long").alias("theme_rank"), F.when(r != 1, F.concat(F.lit("rated "), r.cast("string"))).alias("theme_name"),
        F.when(r != 2, F.col("n")).alias("review_count"), F.when(r != 3, r.cast("double")).alias("avg_rating"),
        F.when(r != 4, F.col("id")).alias("description"),
        F.when(r != 5, F.array(F.struct(F.col("id").alias("text"), F.when(r != 1, r).alias("rating")))).alias("quotes"),
        F.when(r != 5, F.array(F.struct(F.lit("act").alias("title"), F.lit(None).cast("string").alias("detail")))).alias("action_ideas"))
    filled = render.nest_themes(t).select("product", F.explode(render.payload_themes(F.col("themes"))).alias("t"))
    return filled.select(
        "product", "t.rank", "t.theme_name", "t.review_count", "t.avg_rating", "t.description",
        F.array_join(F.transform("t.quotes", lambda q: F.concat_ws(" ", q["text"], q["rating"])), "").alias("quotes"),
        F.array_join(F.transform("t.action_ideas", lambda a: F.concat_ws("|", a["title"], a["detail"])), "").alias("actions"))


@register("cluster_build", _with_clusters("""
SELECT s.product, s.cluster_id, s.size, s.avg_rating, c.dims, c.total, r.representatives
FROM stats s JOIN (SELECT product, cluster_id, count(*) AS dims, round(sum(value), 4) AS total FROM cells GROUP BY ALL) c
     USING (product, cluster_id)
JOIN (SELECT product, cluster_id, string_agg(doc_id, ',' ORDER BY rank) AS representatives FROM reps GROUP BY ALL) r
     USING (product, cluster_id)
"""))
def q_cluster_build(spark, sf_dir):
    """Each cluster as one nested row: size, mean, centroid, representatives."""
    built = clusters.build_clusters(members(spark, sf_dir))
    return built.select(
        "product", "cluster_id", "size", "avg_rating", F.size("centroid").cast("long").alias("dims"),
        F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
        F.array_join("representatives.doc_id", ",").alias("representatives"))


@register("theme_tags_by_table", _with(f"""
SELECT product, seq, {S.theme_tag_sql()[0]} AS theme_tag, {S.theme_tag_sql()[1]} AS theme_color FROM clean
"""))
def q_theme_tags_by_table(spark, sf_dir):
    """C25 + D5: tag and color of every clean review by a table of rules."""
    return rules.tag_by_table(clean(spark, sf_dir), rules.rules_table(spark))


# ---------------------------------------------------------------- search ----

SEARCHES = {term: dict(stars=(), version="all", search=term, sort="newest", page=1) for term in (
    " ent", "er 1", "ab", "no such words at all", "  ")}


@register("explore_search_indexed", "\nUNION ALL\n".join(
    f"SELECT {S.q(term)} AS term, * FROM ({_page_sql(p)})" for term, p in SEARCHES.items()))
def q_explore_search_indexed(spark, sf_dir):
    """B9 + F5 + F6: first pages of five searches of an index, short, absent and blank terms among them."""
    path, out = _folder(spark, "search"), None
    search_index.build(clean(spark, sf_dir), path)
    for term, p in SEARCHES.items():
        page = explore.explore_page(search_index.search(spark, path, term), p["stars"], p["version"], p["search"], p["sort"], p["page"])
        one = page.select(F.lit(term).alias("term"), "product", "seq", "rating", "thumbs_up",
                          F.col("position").cast("long").alias("position"), *CARD_COLS)
        out = one if out is None else out.unionByName(one)
    return out
