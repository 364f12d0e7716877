"""Optional dimension filters and the order-date range.

The reference writes ``(:p IS NULL OR col = :p)`` for each filter; here a
predicate is only emitted for a given value, so the plan carries plain
equalities that reach the parquet scan (``PushedFilters``). ``None`` means
"no filter"; ``''`` is a literal match, as in the reference.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.dates import month_end, month_start, to_date_value


@dataclass(frozen=True)
class DimensionFilters:
    branch: str | None = None
    area: str | None = None
    customer: str | None = None
    product_class: str | None = None
    salesperson: str | None = None

    @classmethod
    def of(cls, filters: DimensionFilters | Mapping[str, str | None] | None) -> DimensionFilters:
        if filters is None:
            return cls()
        if isinstance(filters, DimensionFilters):
            return filters
        unknown = set(filters) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown filter(s): {sorted(unknown)}")
        return cls(**filters)

    def predicate(self) -> Column | None:
        pred = None
        for f in fields(self):
            value = getattr(self, f.name)
            if value is None:
                continue
            # codes are text: compare as text (77 and "77" both mean code "77")
            term = F.col(f.name) == F.lit(str(value))
            pred = term if pred is None else pred & term
        return pred


def apply_filters(df: DataFrame, filters=None) -> DataFrame:
    pred = DimensionFilters.of(filters).predicate()
    return df if pred is None else df.where(pred)


_as_date = to_date_value


def date_range_predicate(df: DataFrame, start, end) -> Column:
    """Inclusive ``start <= order_date <= end``; NULL dates drop.

    ``start``/``end`` are dates/strings or Columns (e.g. scalar subqueries).
    When the table is laid out by ``order_month`` the same range is also put
    on that partition column so whole month directories are pruned.
    """
    lo = F.lit(_as_date(start)) if not isinstance(start, Column) else start
    hi = F.lit(_as_date(end)) if not isinstance(end, Column) else end
    pred = F.col("order_date").between(lo, hi)
    if "order_month" in df.columns:
        pred = pred & F.col("order_month").between(month_start(lo), month_start(hi))
    return pred


def default_range(enriched: DataFrame) -> DataFrame:
    """One row: first day of the earliest order month, last day of the latest.

    On the stored layout the partition column ``order_month`` gives the same
    answer without reading any data column (a NULL date has a NULL month)."""
    if "order_month" in enriched.columns:
        return enriched.agg(
            F.min("order_month").alias("min_date"), month_end(F.max("order_month")).alias("max_date")
        )
    return enriched.agg(
        month_start(F.min("order_date")).alias("min_date"),
        month_end(F.max("order_date")).alias("max_date"),
    )


def resolve_range(enriched: DataFrame, start=None, end=None) -> tuple[Column, Column]:
    """The reference's rule: if either bound is missing or empty, **both** take
    the default range of the unfiltered table. The default is one scalar
    subquery, evaluated once by Spark, never collected by this code."""
    if start in (None, "") or end in (None, ""):
        # one subquery for both bounds (its repeated uses are reused, not re-run)
        rng = default_range(enriched).select(F.struct("min_date", "max_date")).scalar()
        return rng["min_date"], rng["max_date"]
    lo, hi = _as_date(start), _as_date(end)
    return F.lit(lo), F.lit(hi)
