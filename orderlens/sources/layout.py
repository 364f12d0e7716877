"""Physical layout of the materialised enriched table.

The reference builds the enriched table once and indexes it (order, ship
date, the five filter dimensions, customer names). On Spark the equivalent is
layout:

* ``partitionBy(order_month)`` – a date-range filter (detail page) prunes
  whole month directories; ``filters.date_range_predicate`` adds the month
  predicate for that;
* by default the rows are written by the tasks of the last join, sorted by month
  and the filter columns: the wide rows are not shuffled again (that shuffle was
  half of all bytes on disk while the table was built). Few tasks write, about
  ``TASKS_A_CORE`` a core, each all partitions of the join that it got, one after
  the other, with one open file a month, so there are about as many files as
  months times tasks, however large the table. A month holding a third of the
  lines is spread over all tasks. Small row groups bound what the open files
  hold in memory;
* with an explicit ``num_files``, ``repartitionByRange(order_month, branch,
  area, customer, sales_order, sales_order_line)`` instead – every file then
  covers one narrow key range (the trailing order/line keys let the sampled
  bounds split any hot prefix);
* a new snapshot version per build (see ``snapshots``): readers keep the
  previous version until the new one is committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

import calendar
import datetime as dt

from orderlens.functions.dates import month_start
from orderlens.sources.fs import list_entries
from orderlens.sources.snapshots import read_latest, snapshot_versions, version_path, write_snapshot

CLUSTER_COLUMNS = ("branch", "area", "customer", "product_class", "salesperson")
# Write tasks a core, months that a task has open at once (it sorts the rows of others), and bytes of a row group, of
# which each open file holds one.
TASKS_A_CORE, OPEN_MONTHS, ROW_GROUP_BYTES = 2, 120, 8 << 20
RANGE_KEY = ("order_month", "branch", "area", "customer", "sales_order", "sales_order_line")


def write_enriched(enriched: DataFrame, base: str, run_ts: str | None = None,
                   num_files: int | None = None) -> str:
    """Write a new version of the enriched table under ``base``; returns run_ts.

    ``num_files``: ``None`` writes from the tasks that make the rows, without a
    shuffle; a number gives that many range-partitioned write tasks, for fewer
    and larger files.
    """
    with_month = enriched.withColumn("order_month", month_start("order_date"))
    if num_files is None:
        tasks = TASKS_A_CORE * enriched.sparkSession.sparkContext.defaultParallelism
        return write_snapshot(with_month.sortWithinPartitions("order_month", *CLUSTER_COLUMNS).coalesce(tasks), base, run_ts,
                              partition_by=("order_month",), open_files=OPEN_MONTHS, block_bytes=ROW_GROUP_BYTES)
    laid_out = with_month.repartitionByRange(num_files, *[F.col(c) for c in RANGE_KEY if c in with_month.columns])
    return write_snapshot(laid_out, base, run_ts, partition_by=("order_month",),
                          sort_within=CLUSTER_COLUMNS)


def read_enriched(spark: SparkSession, base: str) -> DataFrame:
    """The newest enriched version (keeps ``order_month`` for partition pruning;
    a DATE also when no line has one and the folder names give no type)."""
    df = read_latest(spark, base).drop("run_ts")
    if isinstance(df.schema["order_month"].dataType, DateType):
        return df
    return df.withColumn("order_month", F.col("order_month").cast("date"))


def stored_month_range(spark: SparkSession, base: str) -> tuple[dt.date, dt.date] | None:
    """First and last ``order_month`` of the newest version, read from its
    folder names: one directory listing, no data file is opened. A month
    folder exists only when rows were written to it; NULL dates (the default
    partition) are not a month. ``None`` when there is no dated line."""
    versions = snapshot_versions(spark, base)
    if not versions:
        raise FileNotFoundError(f"no snapshot under {base}")
    prefix = "order_month="
    months = []
    for name, is_dir in list_entries(spark, version_path(base, versions[-1])):
        if is_dir and name.startswith(prefix):
            try:
                months.append(dt.date.fromisoformat(name[len(prefix):]))
            except ValueError:  # __HIVE_DEFAULT_PARTITION__
                continue
    return (min(months), max(months)) if months else None


def stored_default_range(spark: SparkSession, base: str) -> tuple[dt.date, dt.date] | None:
    """The detail page's default range (first day of the first month, last
    day of the last month) from the month folders alone."""
    rng = stored_month_range(spark, base)
    if rng is None:
        return None
    lo, hi = rng
    return lo, hi.replace(day=calendar.monthrange(hi.year, hi.month)[1])
