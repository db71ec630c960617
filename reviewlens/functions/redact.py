"""Personal-data redaction as chained regex column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.fixed_values import PII_PATTERNS, REDACTION_MARKER

NEEDS_AT = ("email", "payment_handle")  # their matches hold an @, all others four digits in a row


def redact_columns(df: DataFrame, col: str, out_col: str | None = None,
                   count_col: str | None = None) -> DataFrame:
    """Replace every pattern in order, each on the previous result.

    Adds ``out_col`` (redacted text; null/empty pass through) and ``count_col``
    (matches replaced, counted on the progressively replaced text). Each step is
    its own projection so the JVM evaluates every regex once per row, and only
    on texts that hold what every match needs (the marker adds neither).
    """
    out_col = out_col or col
    count_col = count_col or f"{col}_redactions"
    cur, n, at, digits = (f"__{col}_{k}" for k in "rnad")
    df = df.withColumns({cur: F.col(col), n: F.lit(0), at: F.col(col).contains("@"), digits: F.col(col).rlike("[0-9]{4}")})
    for name, pattern in PII_PATTERNS:
        may = F.col(at if name in NEEDS_AT else digits)
        df = df.withColumns({
            n: F.col(n) + F.when(may, F.regexp_count(F.col(cur), F.lit(pattern))).otherwise(F.lit(0)),
            cur: F.when(may, F.regexp_replace(F.col(cur), pattern, REDACTION_MARKER)).otherwise(F.col(cur)),
        })
    return df.withColumn(out_col, F.col(cur)).withColumn(count_col, F.col(n).cast("int")).drop(cur, n, at, digits)


def redact_text(col) -> Column:
    """Redacted text only, as a single column expression."""
    c = F.col(col) if isinstance(col, str) else col
    for _, pattern in PII_PATTERNS:
        c = F.regexp_replace(c, pattern, REDACTION_MARKER)
    return c
