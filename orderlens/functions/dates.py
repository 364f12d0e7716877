"""Date expressions.

The reference keeps order dates as ``MM/DD/YYYY`` text and parses them in
every query. Here dates are parsed once at ingest (``parse_text_date``) and
every operator works on a typed DATE column, so range filters reach parquet
statistics and partition pruning.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.plans.broadcast import bounded

# Fixed value: the reference's text date format is MM/DD/YYYY. ``M/d`` also
# accepts the single-digit month/day forms that format tolerates.
TEXT_DATE_PATTERN = "M/d/yyyy"
# Extracts also carry ISO dates, with or without a time of day.
ISO_DATE = r"^\s*([0-9]{4}-[0-9]{2}-[0-9]{2})([ T][0-9:.]*)?\s*$"

# Months between year 1 and year 9999: the most rows a month spine can have.
MAX_SPINE_MONTHS = 9999 * 12


def to_date_value(value) -> dt.date:
    """A date parameter (date, datetime, ``YYYY-MM-DD`` or ``MM/DD/YYYY``) as a date."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    text = str(value).strip()
    for fmt in ("%Y-%m-%d", "%m/%d/%Y"):
        try:
            return dt.datetime.strptime(text, fmt).date()
        except ValueError:
            pass
    raise ValueError(f"not a date (YYYY-MM-DD or MM/DD/YYYY): {value!r}")


def session_today(spark: SparkSession) -> dt.date:
    """Today by the session clock and time zone (what ``current_date()`` gives)."""
    return spark.range(1).select(F.current_date()).first()[0]


def parse_text_date(col: Column | str, pattern: str = TEXT_DATE_PATTERN) -> Column:
    """Text -> DATE; unparsable or impossible dates (13/45, 02/30) give NULL."""
    return F.try_to_date(F.col(col) if isinstance(col, str) else col, pattern)


def parse_extract_date(col: Column | str) -> Column:
    """Text -> DATE for both forms extracts have, M/d/yyyy and ISO; NULL for
    text that neither reads (``unread_date`` tells it from a missing one)."""
    c = F.col(col) if isinstance(col, str) else col
    iso = F.nullif(F.regexp_extract(c, ISO_DATE, 1), F.lit(""))
    return F.coalesce(parse_text_date(F.trim(c)), F.try_to_date(iso, "yyyy-MM-dd"))


def unread_date(col: Column | str) -> Column:
    """True where there is text but no date in it."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull() & parse_extract_date(c).isNull()


def strict_extract_date(col: Column | str) -> Column:
    """``parse_extract_date`` that fails the job, naming the text, instead of
    losing a date."""
    c = F.col(col) if isinstance(col, str) else col
    error = F.raise_error(F.concat(F.lit("not a date (M/d/yyyy or yyyy-MM-dd): "), c)).cast("date")
    return F.when(unread_date(c), error).otherwise(parse_extract_date(c))


def month_start(col: Column | str) -> Column:
    """First day of the month, as DATE (``date_trunc`` would give a timestamp)."""
    return F.trunc(F.col(col) if isinstance(col, str) else col, "MM")


def month_end(col: Column | str) -> Column:
    return F.last_day(F.col(col) if isinstance(col, str) else col)


def year_month_text(col: Column | str) -> Column:
    return F.date_format(F.col(col) if isinstance(col, str) else col, "yyyy-MM")


def month_spine(bounds: DataFrame, lo: str, hi: str, name: str = "month") -> DataFrame:
    """One row per month from ``lo`` to ``hi`` (month starts) of a one-row frame.

    NULL bounds give no rows. The result is bounded by ``MAX_SPINE_MONTHS``,
    so it is safe to broadcast into a join.
    """
    spine = bounds.select(
        F.explode(F.sequence(F.col(lo), F.col(hi), F.expr("INTERVAL 1 MONTH"))).alias(name)
    )
    return bounded(spine, MAX_SPINE_MONTHS)
