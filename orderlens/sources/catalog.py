"""Stored tables in the session's catalog, with statistics, and the named queries as SQL with parameters.

``register_tables`` makes stored Parquet folders tables of a database and collects the row counts and column statistics
(distinct values, ranges, nulls, widths) by which the cost-based optimizer orders joins and sizes their sides.
``named_query`` runs one of the reference's statements by name. Parameters go in through markers, never into
the text, and a filter that is not given is left out of the statement, so what is pushed down to the files is what
the DataFrame form pushes down.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from orderlens.functions.dates import to_date_value
from orderlens.operators.detail import ADDRESS_PARTS, DETAIL_OUTPUT, DETAIL_SORT, _check_paging
from orderlens.operators.filters import DimensionFilters
from orderlens.operators.options import DIMENSIONS

CBO_CONFS = {"spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true", "spark.sql.statistics.histogram.enabled": "false"}


def _name(text: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", text):
        raise ValueError(f"not a plain name: {text!r}")
    return text


def register_tables(spark: SparkSession, paths: Mapping[str, str], database: str = "orderlens",
                    columns: Mapping[str, Sequence[str]] | None = None, analyze: bool = True) -> None:
    """Makes each folder of ``paths`` (name -> Parquet folder) a table of ``database``, replacing one of that name; the
    files stay where they are. Statistics are collected for ``columns`` of each table, all by default. A folder
    with partition folders is registered with its partitions."""
    columns = columns or {}
    spark.sql(f"create database if not exists {_name(database)}")
    for name, path in paths.items():
        table = f"{database}.{_name(name)}"
        spark.sql(f"drop table if exists {table}")
        spark.catalog.createTable(table, path=path, source="parquet")
        if any(c.isPartition for c in spark.catalog.listColumns(table)):
            spark.catalog.recoverPartitions(table)
        if analyze:
            wanted = columns.get(name)
            which = f"for columns {', '.join(f'`{c}`' for c in wanted)}" if wanted else "for all columns"
            spark.sql(f"analyze table {table} compute statistics {which}")


def drop_tables(spark: SparkSession, names: Sequence[str], database: str = "orderlens") -> None:
    """Takes tables out of the catalog; their files stay."""
    for name in names:
        spark.sql(f"drop table if exists {_name(database)}.{_name(name)}")


def table_rows(spark: SparkSession, name: str, database: str = "orderlens") -> int | None:
    """The row count of the collected statistics, None before any were collected."""
    for r in spark.sql(f"describe extended {_name(database)}.{_name(name)}").collect():
        if r.col_name == "Statistics":
            found = re.search(r"([0-9]+) rows", r.data_type)
            return int(found.group(1)) if found else None
    return None


# ------------------------------------------------------------------ named queries

def _conditions(filters, args: dict) -> list[str]:
    given = DimensionFilters.of(filters)
    out = []
    for d in DIMENSIONS:
        if getattr(given, d) is not None:
            args[d] = str(getattr(given, d))
            out.append(f"{d} = :{d}")
    return out


def _range(enriched: str, start, end, args: dict, monthly: bool) -> list[str]:
    """Both bounds, or the default range of the whole table."""
    if start in (None, "") or end in (None, ""):
        return [f"order_date between (select trunc(min(order_date), 'MM') from {enriched}) and (select last_day(max(order_date)) from {enriched})"]
    args["start"], args["end"] = to_date_value(start), to_date_value(end)
    return ["order_date between :start and :end"] + (["order_month between trunc(:start, 'MM') and trunc(:end, 'MM')"] if monthly else [])


def _where(conditions: list[str]) -> str:
    return f" where {' and '.join(conditions)}" if conditions else ""


def _detail_columns() -> str:
    return ", ".join(f"concat_ws(', ', {', '.join(ADDRESS_PARTS)}) as {name}" if source is None else f"{source} as {name}" for name, source in DETAIL_OUTPUT)


def _detail_order() -> str:
    return ", ".join(f"{name} {'desc nulls first' if down else 'asc nulls last'}" for name, down in DETAIL_SORT)


def named_query(spark: SparkSession, name: str, database: str = "orderlens", filters=None, start=None, end=None,
                page: int = 1, per_page: int = 50) -> DataFrame:
    """One of ``NAMED`` over the registered tables: ``enriched`` (the stored layout or a plain table) for trend,
    page, count and options, ``sor_master`` for the status counts."""
    if name not in NAMED:
        raise ValueError(f"unknown query {name!r}: one of {', '.join(sorted(NAMED))}")
    args: dict[str, object] = {}
    lines = f"{_name(database)}.enriched"
    if name == "status_counts":
        return spark.sql(f"select order_status, count(*) as n from {database}.sor_master group by order_status order by n desc, order_status")
    if name == "filter_options":
        each = " union all ".join(f"select '{d}' as dimension, {d} as value from {lines}" for d in DIMENSIONS)
        return spark.sql(f"select distinct dimension, value from ({each}) where value is not null and value <> '' order by dimension, value")
    if name == "order_trend":
        keep = _where([*_conditions(filters, args), "order_date is not null"])
        return spark.sql(f"""
            with spine as (
              select explode(sequence(trunc(min(order_date), 'MM'), trunc(max(order_date), 'MM'), interval 1 month)) as month from {lines}),
            monthly as (select trunc(order_date, 'MM') as month, sum(order_qty) as qty from {lines}{keep} group by 1)
            select month, date_format(month, 'yyyy-MM') as year_month, coalesce(qty, 0) as total_order_qty
            from spine left join monthly using (month) order by month""", args=args)
    monthly = "order_month" in spark.table(lines).columns
    keep = _where([*_conditions(filters, args), *_range(lines, start, end, args, monthly)])
    page, per_page = _check_paging(page, per_page)
    if name == "detail_count":
        args["per_page"] = per_page
        return spark.sql(f"select total_count, cast(ceil(total_count / :per_page) as bigint) as total_pages, :per_page as per_page "
                         f"from (select count(*) as total_count from {lines}{keep})", args=args)
    args |= {"per_page": per_page, "offset": (page - 1) * per_page}
    return spark.sql(f"select {_detail_columns()} from {lines}{keep} order by {_detail_order()} limit :per_page offset :offset", args=args)


NAMED = ("order_trend", "detail_page", "detail_count", "filter_options", "status_counts")
