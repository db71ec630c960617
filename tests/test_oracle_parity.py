"""Spark result == SQL twin (DuckDB) for a sample of registered queries at sf0.001."""

import duckdb
import pytest

from conftest import SF_SMALL
from reviewlens.plans.catalog import ORACLE_SQL, QUERIES
from reviewlens.sources.tables import TABLES
from tools.oracle_check import rows_of

SAMPLE = ["weekly_summary", "ingest_stage_counts", "redact_reviews", "anonymised_reviews",
          "cluster_representatives", "quote_validation", "token_budget", "explore_feed",
          "theme_tags", "report_text", "delivery_outbox", "cluster_themes", "ingest_quality_capped",
          "response_rows", "quote_cards", "receipts_upsert", "density_components", "dashboard_payload", "embed_text", "weekly_stream",
          "landing_scan", "tool_responses", "review_sink", "guarded_sink", "theme_defaults", "cluster_build",
          "theme_tags_by_table", "ingest_observed_counts", "explore_search_indexed"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_parity(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    res = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert rows_of(df.columns, s_rows) == rows_of(res.columns, res.fetchall())
