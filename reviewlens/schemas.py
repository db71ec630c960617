"""Schemas of the data model (landing records, reviews, clusters, themes, receipts)."""

from pyspark.sql import types as T

# Raw store record as landed (one JSON object per line).
RAW_RECORD = T.StructType([
    T.StructField("reviewId", T.StringType()),
    T.StructField("userName", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("at", T.StringType()),
    T.StructField("thumbsUpCount", T.IntegerType()),
    T.StructField("reviewCreatedVersion", T.StringType()),
])

# Review after the record mapping; ``seq`` is arrival order, ``product`` the app.
REVIEW = T.StructType([
    T.StructField("product", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("review_id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("thumbs_up", T.IntegerType()),
    T.StructField("app_version", T.StringType()),
])

# Normalised review file (anonymised): rating and text required.
NORMALIZED_REVIEW = T.StructType([
    T.StructField("rating", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("thumbs_up", T.IntegerType()),
    T.StructField("app_version", T.StringType()),
])

QUOTE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("doc_id", T.StringType()),
    T.StructField("rating", T.IntegerType()),
])
ACTION = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("detail", T.StringType()),
])
# Theme as returned by a summariser (JSON text parsed with this schema).
THEME_RESPONSE = T.StructType([
    T.StructField("theme_name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("quotes", T.ArrayType(QUOTE)),
    T.StructField("action_ideas", T.ArrayType(ACTION)),
])

DOC_DELIVERY = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("doc_id", T.StringType()),
    T.StructField("heading_id", T.StringType()),
    T.StructField("revision_id", T.StringType()),
])
MAIL_DELIVERY = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("draft_id", T.StringType()),
    T.StructField("message_id", T.StringType()),
])
RECEIPT = T.StructType([
    T.StructField("idempotency_key", T.StringType()),
    T.StructField("run_timestamp", T.StringType()),
    T.StructField("review_window", T.MapType(T.StringType(), T.StringType())),
    T.StructField("reviews_ingested", T.LongType()),
    T.StructField("clusters_found", T.LongType()),
    T.StructField("themes_generated", T.LongType()),
    T.StructField("delivery", T.StructType([
        T.StructField("google_doc", DOC_DELIVERY),
        T.StructField("gmail", MAIL_DELIVERY),
    ])),
    T.StructField("llm_usage", T.MapType(T.StringType(), T.LongType())),
])
