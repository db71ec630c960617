"""ISO week label and check (C6, C7) and the rolling-window cutoff."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens.fixed_values import BASIC_TIMES, FULL_DATE_PATTERN


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_time(col) -> Column:
    """Timestamp of an ISO text that has its full date, with or without separators; null for anything else."""
    c = _c(col)
    out = F.when(c.rlike(FULL_DATE_PATTERN), F.try_to_timestamp(c))
    for pattern, extended in BASIC_TIMES:
        out = out.when(c.rlike(pattern), F.try_to_timestamp(F.regexp_replace(c, pattern, extended)))
    return out


def iso_week_label(col) -> Column:
    """``YYYY-Www`` using the ISO week-numbering year."""
    d = F.to_date(_c(col))
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def iso_week_valid(col) -> Column:
    """Pattern ``4 digits-W-2 digits`` and the week exists in that ISO year."""
    c = _c(col)
    year = F.substring(c, 1, 4).cast("int")
    week = F.substring(c, 7, 2).cast("int")
    weeks_in_year = F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))
    shape = F.coalesce(c.rlike(r"^\d{4}-W\d{2}$"), F.lit(False))
    return F.when(shape, (week >= 1) & (week <= weeks_in_year)).otherwise(F.lit(False))


def window_cutoff(as_of, window_weeks: int) -> Column:
    """Start of the rolling window: ``as_of`` minus 7 x weeks days (inclusive)."""
    a = F.lit(as_of).cast("timestamp") if not isinstance(as_of, Column) else as_of
    return a - F.make_dt_interval(days=F.lit(7 * int(window_weeks)))
