"""Numeric expressions: percentages and the two rounding modes.

The reference rounds in SQL (``ROUND``: half away from zero) in one place and
in Python (``round``: half to even) in another; both are kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_of(part: Column, total: Column) -> Column:
    """``part * 100 / total`` as double; NULL when the total is 0 or NULL."""
    return F.when(total.isNull() | (total == 0), F.lit(None).cast("double")).otherwise(
        part.cast("double") * F.lit(100.0) / total.cast("double")
    )


def half_up(col: Column, scale: int = 0) -> Column:
    return F.round(col, scale)


def half_even(col: Column, scale: int = 0) -> Column:
    return F.bround(col, scale)
