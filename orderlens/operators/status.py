"""Order-status overview: count and share of header rows per listed status.

Every listed status appears (0 when absent). The share's denominator is
*all* header rows, including unlisted and NULL statuses, so the listed shares
need not add up to 100.

Plan: one scan and one global aggregate – per task, nine counters (the eight
listed codes and the total) – merged in a single partition; the one result
row is exploded into the eight labelled rows. No group-by shuffle, join or
subquery, and a status holding most rows is just a counter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.numeric import half_up, percent_of

# The reference's status codes and their labels, in its order.
STATUS_LABELS = (
    ("0", "Order in process"),
    ("1", "Open order"),
    ("2", "Open back order"),
    ("3", "Released back order"),
    ("4", "In warehouse"),
    ("8", "To invoice"),
    ("9", "Complete"),
    ("F", "Forwarded order"),
)


def status_counts(master: DataFrame) -> DataFrame:
    """Rows per status value (all values, NULL included) – a general-purpose
    breakdown; ``status_overview`` needs only the listed codes."""
    return master.groupBy(F.col("order_status").alias("status_code")).agg(
        F.count(F.lit(1)).alias("count")
    )


def status_overview(master: DataFrame) -> DataFrame:
    """Columns: status_desc, status_code, count (bigint), percentage (double,
    SQL half-up rounding to 2 places). Ordered by count desc, then code."""
    status = F.col("order_status")
    counters = master.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(F.when(status == code, 1)).alias(f"n{i}") for i, (code, _) in enumerate(STATUS_LABELS)],
    )
    rows = counters.select(
        "total",
        F.explode(F.array(*[
            F.struct(F.lit(desc).alias("status_desc"), F.lit(code).alias("status_code"),
                     F.col(f"n{i}").alias("count"))
            for i, (code, desc) in enumerate(STATUS_LABELS)
        ])).alias("s"),
    )
    return rows.select(
        "s.status_desc",
        "s.status_code",
        F.col("s.count").cast("bigint").alias("count"),
        half_up(F.coalesce(percent_of(F.col("s.count"), F.col("total")), F.lit(0.0)), 2).alias("percentage"),
    ).orderBy(F.col("count").desc(), F.col("status_code"))
