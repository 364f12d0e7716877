"""

``entry(spark)`` runs the flagship query (the monthly trend) at sf0.001.
``queries()`` maps each named operator to a callable (spark, sf_dir) ->
DataFrame built with the library's DataFrame API over reference-shaped
stand-in views of the given tables. ``oracle_sql()`` gives, for the same
names, DuckDB SQL over the base tables; the stand-in views are repeated there
as CTEs, written independently from the Spark code.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import sys
import threading
import time
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pyspark.sql.types import DateType  # noqa: E402

from orderlens.operators.bucketed import BucketedStore  # noqa: E402
from orderlens.operators.detail import detail_after, detail_count, detail_page, next_cursor  # noqa: E402
from orderlens.operators.dictionary import apply_counts, dictionary, option_lists  # noqa: E402
from orderlens.operators.enrich import build_enriched, enriched_from  # noqa: E402
from orderlens.operators.filters import default_range  # noqa: E402
from orderlens.operators.history import price_history_json, top_stock_with_history  # noqa: E402
from orderlens.operators.options import filter_options  # noqa: E402
from orderlens.operators.product_class import product_class_share, share_total  # noqa: E402
from orderlens.operators.report import category_report, latest_report, report_labels, write_report  # noqa: E402
from orderlens.operators.report_state import apply_changes, month_state, read_state, report_from_state, write_state  # noqa: E402
from orderlens.operators.rollup import build_rollup, merged, rollup_count, rollup_for, rollup_trend  # noqa: E402
from orderlens.operators.status import status_overview  # noqa: E402
from orderlens.operators.stock import stock_details, top_stock, top_stock_price_history, warehouse_summary  # noqa: E402
from orderlens.operators.trend import order_trend  # noqa: E402
from orderlens.session import ensure_checkpoint_dir  # noqa: E402
from orderlens.sources.access import lookup, write_access_table  # noqa: E402
from orderlens.sources.catalog import named_query, register_tables  # noqa: E402
from orderlens.sources.commitlog import CommitLog  # noqa: E402
from orderlens.sources.csv_ingest import ingest_csv_dir  # noqa: E402
from orderlens.sources.fs import delete  # noqa: E402
from orderlens.sources.layout import (  # noqa: E402
    read_enriched,
    stored_default_range,
    stored_month_range,
    write_enriched,
)
from orderlens.sources.positions import Positions, write_positions  # noqa: E402
from orderlens.sources.snapshots import new_run_ts, snapshot_versions, version_path  # noqa: E402
from orderlens.sources.standins import StandIns  # noqa: E402

try:  # the training-data operators are optional: without their folder the rest works alone
    import orderlens.llm.queries as llm_queries  # noqa: E402
except ModuleNotFoundError as missing:
    if not (missing.name or "").startswith("orderlens.llm"):
        raise
    llm_queries = None
try:
    import corpus_pipeline  # noqa: E402
except ModuleNotFoundError as missing:
    if not (missing.name or "").startswith(("corpus_pipeline", "orderlens.llm")):
        raise
    corpus_pipeline = None

SMOKE_DIR = "/root/testdata/sf0.001"

# Fixed query parameters used by the registered queries.
TREND_FILTERS = {"customer": "77"}
DETAIL_FILTERS = {"branch": "ASIA"}
DETAIL_START, DETAIL_END, DETAIL_PAGE, DETAIL_PER_PAGE = "1998-01-01", "1998-01-31", 2, 50
REPORT_AS_OF = "2000-03-15"
ALL_FILTERS = {"branch": "ASIA", "area": "INDIA", "product_class": "Brand#32", "salesperson": "1-URGENT",
               "customer": None}
# Secondary lookups, and the rows of a file and changes of a chunk in the stored structures.
LOOKUP_ORDERS = ["1", "7", "32", "1000", "9999"]
LOOKUP_SHIPPED = ("1998-01-05", "1998-01-09")
LOOKUP_ACCOUNT = {"short_name": "BUILDING", "master_account": ["Customer#000000004", "Customer#000000026", "Customer#000000034"]}
LOOKUP_COLUMNS = ("sales_order", "sales_order_line", "invoice", "stock_code", "order_qty", "line_ship_date", "order_date",
                  "customer", "short_name", "master_account")
COUNT_START, COUNT_END = "1997-12-15", "1998-03-02"
BLOCK_ROWS, HISTORY_CHUNK, OPTIONS_CHUNK = 20_000, 16, 100


def _dates_as_text(df: DataFrame) -> DataFrame:
    """ISO text for DATE columns so both engines hash the same value."""
    return df.select(*[
        F.date_format(f.name, "yyyy-MM-dd").alias(f.name) if isinstance(f.dataType, DateType)
        else F.col(f.name)
        for f in df.schema.fields
    ])


def _standins(spark: SparkSession, sf_dir: str) -> StandIns:
    return StandIns(spark, sf_dir)


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched table; the sides of its joins are stored once per input
    and process, so every call reads the same scratch tables."""
    s = _standins(spark, sf_dir)
    key = (ensure_checkpoint_dir(spark), os.path.abspath(sf_dir))
    with _BUILD_LOCK:
        if key not in _BUILT:
            base = _scratch(spark, "build", sf_dir)
            build_enriched(s.sor_detail, s.sor_master, s.ar_customer, s.inv_master, base)
            for joined in ("headers", "customers"):  # both are in headers_with_customers
                delete(spark, f"{base}/{joined}", recursive=True)
            _BUILT[key] = base
    return enriched_from(spark, s.sor_detail, _BUILT[key])


_BUILT: dict[tuple[str, str], str] = {}
_BUILD_LOCK = threading.Lock()
_STORED: dict[tuple[str, str], str] = {}
_STORED_LOCK = threading.Lock()
# other processes never share these folders; nothing in them is deleted while
# the process runs. They live in the checkpoint folder, which is scratch space
# and may be cleared after a run
_PROCESS = uuid.uuid4().hex[:12]


def _scratch(spark: SparkSession, kind: str, sf_dir: str) -> str:
    """A folder per (kind, input, process) under the shared checkpoint folder,
    removed when the process ends."""
    key = hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:12]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/orderlens_{kind}/{key}-{_PROCESS}"
    if not _SCRATCH:
        atexit.register(_clear_scratch)
    _SCRATCH[path] = spark
    return path


_SCRATCH: dict[str, SparkSession] = {}


def _clear_scratch() -> None:
    for path, spark in _SCRATCH.items():
        try:
            delete(spark, path, recursive=True)
        except Exception:  # the session has ended: the folder's own clean-up is left
            return


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The enriched table written with its layout (month partitions, clustered
    files) under the checkpoint folder and read back – the form the reference
    queries after its one-time build – and its folder. Built once per input
    and process (like the reference's one-time build), older builds pruned."""
    base = _scratch(spark, "enriched", sf_dir)
    key = (ensure_checkpoint_dir(spark), os.path.abspath(sf_dir))
    with _STORED_LOCK:
        if key not in _STORED or not snapshot_versions(spark, base):
            write_enriched(_enriched(spark, sf_dir), base, _unique_run_ts())
            _STORED[key] = base
    return read_enriched(spark, base), base


_LAST_RUN_TS = [""]


def _unique_run_ts() -> str:
    """A version name later than any this process used (callers hold the lock),
    so a lazily read version is never rewritten; nothing here is pruned."""
    ts = new_run_ts()
    while ts <= _LAST_RUN_TS[0]:
        time.sleep(0.2)
        ts = new_run_ts()
    _LAST_RUN_TS[0] = ts
    return ts


def _stored_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir)[0]


def _once(spark: SparkSession, sf_dir: str, kind: str, build: Callable[[str], object]) -> str:
    """The folder of a structure that is built from the stored table once per input and process."""
    base = _scratch(spark, kind, sf_dir)
    key = (ensure_checkpoint_dir(spark), f"{kind}:{os.path.abspath(sf_dir)}")
    with _KIND_LOCK:
        if key not in _STORED:
            build(base)
            _STORED[key] = base
    return base


_KIND_LOCK = threading.Lock()


def _access(spark, sf_dir):
    lines = _stored_enriched(spark, sf_dir)
    return _once(spark, sf_dir, "access", lambda base: write_access_table(lines.drop("order_month"), base))


def _rollup(spark, sf_dir):
    lines = _stored_enriched(spark, sf_dir)
    return _once(spark, sf_dir, "rollup", lambda base: build_rollup(lines, base))


def _positions(spark, sf_dir):
    lines = _stored_enriched(spark, sf_dir)
    return Positions(spark, _once(spark, sf_dir, "positions", lambda base: write_positions(lines, base, block_rows=BLOCK_ROWS)))


def _database(spark, sf_dir):
    """The stored tables in the catalog, with statistics."""
    df, stored = _stored(spark, sf_dir)
    name = f"orderlens_{hashlib.sha1(stored.encode()).hexdigest()[:12]}"
    folder = version_path(stored, snapshot_versions(spark, stored)[-1])
    columns = {"enriched": ("order_date", "order_month", "branch", "customer")}
    _once(spark, sf_dir, "catalog", lambda _: register_tables(spark, {"enriched": folder}, name, columns))
    return name


def q_order_trend_sql(spark, sf_dir):
    return named_query(spark, "order_trend", _database(spark, sf_dir), TREND_FILTERS).select("year_month", "total_order_qty")


def q_detail_page_sql(spark, sf_dir):
    return _dates_as_text(named_query(spark, "detail_page", _database(spark, sf_dir), DETAIL_FILTERS, DETAIL_START, DETAIL_END,
                                      DETAIL_PAGE, DETAIL_PER_PAGE))


def q_enriched_bucketed(spark, sf_dir):
    """The header join bucket by bucket, heavy orders apart."""
    s = _standins(spark, sf_dir)

    def build(base):
        store = bucketed(base)
        store.write_lines(s.sor_detail, s.inv_master)
        store.write_headers(s.sor_master, s.ar_customer)

    def bucketed(base):
        return BucketedStore(spark, base, int(spark.conf.get("spark.sql.shuffle.partitions")), f"orderlens_{hashlib.sha1(base.encode()).hexdigest()[:12]}")

    return _dates_as_text(bucketed(_once(spark, sf_dir, "bucketed", build)).enriched())


def q_category_report_state(spark, sf_dir):
    """The report from stored months."""
    lines = _stored_enriched(spark, sf_dir)
    base = _once(spark, sf_dir, "report_state", lambda base: write_state(month_state(lines), base))
    return report_from_state(read_state(spark, base), REPORT_AS_OF)


def q_category_report_state_changes(spark, sf_dir):
    """The report after all lines of 1999 were taken out of the state, and those of February put back."""
    lines = _stored_enriched(spark, sf_dir)
    base = _once(spark, sf_dir, "report_state", lambda base: write_state(month_state(lines), base))
    year = lines.where(F.col("order_month").between("1999-01-01", "1999-12-01"))
    return report_from_state(apply_changes(read_state(spark, base), added=year.where("order_month = '1999-02-01'"), removed=year), REPORT_AS_OF)


def q_filter_option_lists(spark, sf_dir):
    """Options as sorted lists in chunks, from the dictionary of all lines but those of 1999, which are then added."""
    lines = _stored_enriched(spark, sf_dir)
    late = F.coalesce(F.col("order_month").between("1999-01-01", "1999-12-01"), F.lit(False))
    known = apply_counts(dictionary(lines.where(~late)), dictionary(lines.where(late)), dictionary(lines.limit(0)))
    lists = option_lists(known, f"{_scratch(spark, 'options', sf_dir)}/{uuid.uuid4().hex}", OPTIONS_CHUNK)
    return lists.withColumn("values", F.array_join("values", "|"))


def q_stock_strings_committed(spark, sf_dir):
    """Warehouse and price tables committed together by one transaction, read back from the log."""
    s = _standins(spark, sf_dir)

    def build(base):
        load = CommitLog(spark, base).begin()
        load.write(s.inv_warehouse, "inv_warehouse")
        load.write(s.inv_price, "inv_price")
        load.commit()

    log = CommitLog(spark, _once(spark, sf_dir, "committed", build))
    at = log.head()  # both tables as of one entry
    return stock_details(log.read("inv_warehouse", at), log.read("inv_price", at))


def q_lines_by_order(spark, sf_dir):
    return _dates_as_text(lookup(spark, _access(spark, sf_dir), {"sales_order": LOOKUP_ORDERS}).select(*LOOKUP_COLUMNS))


def q_lines_by_ship_date(spark, sf_dir):
    return _dates_as_text(lookup(spark, _access(spark, sf_dir), {"line_ship_date": LOOKUP_SHIPPED}).select(*LOOKUP_COLUMNS))


def q_lines_by_account(spark, sf_dir):
    return _dates_as_text(lookup(spark, _access(spark, sf_dir), LOOKUP_ACCOUNT).select(*LOOKUP_COLUMNS))


def q_order_trend_rollup(spark, sf_dir):
    return rollup_trend(spark, _rollup(spark, sf_dir), TREND_FILTERS).select("year_month", "total_order_qty")


def q_detail_count_rollup(spark, sf_dir):
    """All rows of a range that cuts two months, with a filter."""
    return rollup_count(spark, _rollup(spark, sf_dir), _stored_enriched(spark, sf_dir), DETAIL_FILTERS, COUNT_START, COUNT_END, DETAIL_PER_PAGE)


def q_monthly_area_totals_rollup(spark, sf_dir):
    """Lines and quantity of every month, branch and area, added up from the smallest stored grouping that has both."""
    by = merged(rollup_for(spark, _rollup(spark, sf_dir), columns=("branch", "area")), "month", "branch", "area")
    return _dates_as_text(by.drop("n_qty"))


def q_detail_page_positions(spark, sf_dir):
    return _dates_as_text(_positions(spark, sf_dir).page(DETAIL_FILTERS, DETAIL_START, DETAIL_END, DETAIL_PAGE, DETAIL_PER_PAGE))


def q_detail_page_deep_positions(spark, sf_dir):
    """The last full page of all lines, by the stored counts."""
    stored = _positions(spark, sf_dir)
    return _dates_as_text(stored.page(page=stored.count() // 50, per_page=50))


def _rounded_history(s: StandIns) -> DataFrame:
    """Prices with four decimals, so that both engines write the same digits."""
    return s.inv_price_history.withColumns({c: F.col(c).cast("decimal(18,4)") for c in ("new_selling_price", "old_selling_price")})


def q_price_history_json(spark, sf_dir):
    """The nested history of every item in the item master."""
    s = _standins(spark, sf_dir)
    return price_history_json(_rounded_history(s), s.inv_master, f"{_scratch(spark, 'history', sf_dir)}/{uuid.uuid4().hex}", HISTORY_CHUNK)


def q_top_stock_history(spark, sf_dir):
    s = _standins(spark, sf_dir)
    return top_stock_with_history(s.sor_detail, s.inv_master, s.inv_warehouse, s.inv_price, _rounded_history(s),
                                  f"{_scratch(spark, 'history', sf_dir)}/{uuid.uuid4().hex}", chunk_rows=HISTORY_CHUNK)


def q_enriched(spark, sf_dir):
    return _dates_as_text(_enriched(spark, sf_dir))


def q_status_overview(spark, sf_dir):
    return status_overview(_standins(spark, sf_dir).sor_master)


def q_filter_options(spark, sf_dir):
    return filter_options(_enriched(spark, sf_dir))


def q_order_trend(spark, sf_dir):
    return order_trend(_enriched(spark, sf_dir), TREND_FILTERS).select("year_month", "total_order_qty")


def q_detail_page(spark, sf_dir):
    return _dates_as_text(detail_page(_enriched(spark, sf_dir), DETAIL_FILTERS, DETAIL_START, DETAIL_END,
                                      DETAIL_PAGE, DETAIL_PER_PAGE))


def q_detail_page_deep(spark, sf_dir):
    """The last full page of all lines of the default range, of 50 rows."""
    rows = _stored_enriched(spark, sf_dir)
    pages = detail_count(rows, None, None, None, 50).first()["total_count"] // 50
    return _dates_as_text(detail_page(rows, None, None, None, pages, 50))


def q_detail_after(spark, sf_dir):
    """Page 2 again, by the cursor that page 1 gives."""
    rows = _enriched(spark, sf_dir)
    first = detail_page(rows, DETAIL_FILTERS, DETAIL_START, DETAIL_END, 1, DETAIL_PER_PAGE)
    last, skip = next_cursor(first.collect())
    return _dates_as_text(detail_after(rows, last, DETAIL_FILTERS, DETAIL_START, DETAIL_END, DETAIL_PER_PAGE, skip))


def q_detail_count_filtered(spark, sf_dir):
    """All five filters, and a missing bound: both bounds are then the default range."""
    return detail_count(_enriched(spark, sf_dir), ALL_FILTERS, DETAIL_START, None, DETAIL_PER_PAGE)


def q_detail_count(spark, sf_dir):
    return detail_count(_enriched(spark, sf_dir), DETAIL_FILTERS, DETAIL_START, DETAIL_END, DETAIL_PER_PAGE)


def q_default_range(spark, sf_dir):
    return _dates_as_text(default_range(_enriched(spark, sf_dir)))


def q_order_trend_stored(spark, sf_dir):
    df, base = _stored(spark, sf_dir)
    months = stored_month_range(spark, base)  # from the month folders, no scan
    return order_trend(df, TREND_FILTERS, month_range=months).select("year_month", "total_order_qty")


def q_detail_page_stored(spark, sf_dir):
    return _dates_as_text(detail_page(_stored_enriched(spark, sf_dir), DETAIL_FILTERS, DETAIL_START,
                                      DETAIL_END, DETAIL_PAGE, DETAIL_PER_PAGE))


def q_detail_count_default_range_stored(spark, sf_dir):
    """No bounds given: the default range comes from the month folder names."""
    df, base = _stored(spark, sf_dir)
    return detail_count(df, DETAIL_FILTERS, *(stored_default_range(spark, base) or (None, None)), DETAIL_PER_PAGE)


def q_detail_count_stored(spark, sf_dir):
    return detail_count(_stored_enriched(spark, sf_dir), DETAIL_FILTERS, DETAIL_START, DETAIL_END,
                        DETAIL_PER_PAGE)


def q_default_range_stored(spark, sf_dir):
    """From the month folder names: no file is opened."""
    days = stored_default_range(spark, _stored(spark, sf_dir)[1]) or (None, None)
    return spark.createDataFrame([tuple(d and d.isoformat() for d in days)], "min_date string, max_date string")


def q_top_stock(spark, sf_dir):
    s = _standins(spark, sf_dir)
    return top_stock(s.sor_detail, s.inv_master, s.inv_warehouse, s.inv_price)


def q_stock_strings(spark, sf_dir):
    s = _standins(spark, sf_dir)
    return stock_details(s.inv_warehouse, s.inv_price)


def q_price_history(spark, sf_dir):
    s = _standins(spark, sf_dir)
    return _dates_as_text(top_stock_price_history(s.sor_detail, s.inv_price_history))


def q_product_class_share(spark, sf_dir):
    s = _standins(spark, sf_dir)
    return product_class_share(s.sor_detail, s.sal_product_class)


def q_product_class_share_total(spark, sf_dir):
    return share_total(q_product_class_share(spark, sf_dir))


def q_category_report(spark, sf_dir):
    return category_report(_enriched(spark, sf_dir), REPORT_AS_OF)


def q_category_report_bounded(spark, sf_dir):
    return category_report(_enriched(spark, sf_dir), REPORT_AS_OF, bounded=True)


def _latest_report(spark, sf_dir):
    """Write the report as a snapshot under the checkpoint folder, read the newest back."""
    base = _scratch(spark, "reports", sf_dir)
    with _STORED_LOCK:
        key = (ensure_checkpoint_dir(spark), f"report:{os.path.abspath(sf_dir)}")
        if key not in _STORED:
            write_report(category_report(_enriched(spark, sf_dir), REPORT_AS_OF, sort=False), base,
                         _unique_run_ts(), REPORT_AS_OF)
            _STORED[key] = base
    return latest_report(spark, base).drop("run_ts")


def q_latest_report(spark, sf_dir):
    return _dates_as_text(_latest_report(spark, sf_dir))


def q_report_labels(spark, sf_dir):
    """The months that the newest stored report covers."""
    return _dates_as_text(report_labels(_latest_report(spark, sf_dir)))


def _ingested(spark: SparkSession, sf_dir: str, table: str, attr: str, iso_dates: bool = False) -> DataFrame:
    """A stand-in table written as a reference CSV extract, then loaded back
    through the CSV ingest (text overrides, NA tokens, date parsing, type
    inference)."""
    from tools.csv_extract import write_extract

    folder = _scratch(spark, f"extract_{table}", sf_dir)
    with _BUILD_LOCK:
        if folder not in _EXTRACTS:
            write_extract(getattr(_standins(spark, sf_dir), attr), folder, table, iso_dates)
            _EXTRACTS.add(folder)
    return ingest_csv_dir(spark, folder)[attr]


_EXTRACTS: set[str] = set()


def q_ingest_sor_detail(spark, sf_dir):
    return _dates_as_text(_ingested(spark, sf_dir, "SorDetailRep", "sor_detail"))


def q_ingest_sor_master(spark, sf_dir):
    return _dates_as_text(_ingested(spark, sf_dir, "SorMasterRep", "sor_master"))


def q_ingest_price_history(spark, sf_dir):
    """An extract whose dates are ISO text."""
    return _dates_as_text(_ingested(spark, sf_dir, "InvPriceHistory", "inv_price_history", iso_dates=True))


def q_ingest_inv_warehouse(spark, sf_dir):
    """Quantities loaded as doubles, as text in the warehouse strings."""
    return warehouse_summary(_ingested(spark, sf_dir, "InvWarehouse", "inv_warehouse"))


def entry(spark: SparkSession) -> DataFrame:
    return q_order_trend(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _own_queries() | (llm_queries.QUERIES if llm_queries else {}) | (
        {"pipeline": corpus_pipeline.run} if corpus_pipeline else {})


def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "enriched": q_enriched,
        "status_overview": q_status_overview,
        "filter_options": q_filter_options,
        "order_trend": q_order_trend,
        "detail_page": q_detail_page,
        "detail_page_deep": q_detail_page_deep,
        "detail_after": q_detail_after,
        "detail_count": q_detail_count,
        "detail_count_filtered": q_detail_count_filtered,
        "default_range": q_default_range,
        "top_stock": q_top_stock,
        "stock_strings": q_stock_strings,
        "price_history": q_price_history,
        "product_class_share": q_product_class_share,
        "product_class_share_total": q_product_class_share_total,
        "category_report": q_category_report,
        "category_report_bounded": q_category_report_bounded,
        "latest_report": q_latest_report,
        "report_labels": q_report_labels,
        "ingest_sor_detail": q_ingest_sor_detail,
        "ingest_sor_master": q_ingest_sor_master,
        "ingest_price_history": q_ingest_price_history,
        "ingest_inv_warehouse": q_ingest_inv_warehouse,
        "order_trend_stored": q_order_trend_stored,
        "detail_page_stored": q_detail_page_stored,
        "detail_count_stored": q_detail_count_stored,
        "default_range_stored": q_default_range_stored,
        "detail_count_default_range_stored": q_detail_count_default_range_stored,
        "lines_by_order": q_lines_by_order,
        "lines_by_ship_date": q_lines_by_ship_date,
        "lines_by_account": q_lines_by_account,
        "order_trend_rollup": q_order_trend_rollup,
        "detail_count_rollup": q_detail_count_rollup,
        "monthly_area_totals_rollup": q_monthly_area_totals_rollup,
        "detail_page_positions": q_detail_page_positions,
        "detail_page_deep_positions": q_detail_page_deep_positions,
        "order_trend_sql": q_order_trend_sql,
        "detail_page_sql": q_detail_page_sql,
        "enriched_bucketed": q_enriched_bucketed,
        "category_report_state": q_category_report_state,
        "category_report_state_changes": q_category_report_state_changes,
        "filter_option_lists": q_filter_option_lists,
        "stock_strings_committed": q_stock_strings_committed,
        "price_history_json": q_price_history_json,
        "top_stock_history": q_top_stock_history,
    }


# ---------------------------------------------------------------- oracle SQL
# Stand-in views (same definitions as orderlens.sources.standins), DuckDB text.
_VIEWS = {
    "ar_customer": """
select case when c_acctbal >= 0 and c_acctbal < 500 then 'X' else '' end || cast(c_custkey as varchar) customer,
  c_mktsegment short_name, case when c_acctbal < 0 then null else c_name end master_account
from customer""",
    "sor_master": """
select cast(o_orderkey as varchar) sales_order,
  cast(o_orderkey as varchar) || '-' || coalesce(l.l_returnflag, 'X') invoice_number,
  case when o_orderstatus = 'O' then '1' else o_orderstatus end order_status,
  cast(o_custkey as varchar) customer, o_orderpriority salesperson,
  cast(o_orderdate as date) order_date, r_name branch, n_name area, l.req_ship_date,
  c_name customer_name, c_name ship_addr1, cast(null as varchar) ship_addr2, n_name ship_addr3,
  r_name ship_addr4, cast(null as varchar) ship_addr5,
  case when c_acctbal < 0 then null else cast(c_nationkey as varchar) end postal_code
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey
  left join (select l_orderkey, l_returnflag, cast(min(l_shipdate) as date) req_ship_date
             from lineitem group by l_orderkey, l_returnflag) l on o_orderkey = l.l_orderkey""",
    "sor_detail": """
select cast(l_orderkey as varchar) || '-' || l_returnflag invoice, cast(l_orderkey as varchar) sales_order,
  l_linenumber sales_order_line, l_linestatus line_type, cast(l_partkey as varchar) stock_code,
  p_type stock_description, l_returnflag warehouse, l_quantity order_qty,
  case when l_linestatus = 'F' then l_quantity else 0.0 end ship_qty,
  case when l_linestatus = 'F' then 0.0 else l_quantity end back_order_qty,
  cast(l_shipdate as date) line_ship_date, l_extendedprice price,
  case when p_size = 50 then null when p_size = 49 then '  ' else p_brand end product_class
from lineitem join part on l_partkey = p_partkey""",
    "inv_master": """
select case when p_size <= 5 then 'X' else '' end || cast(p_partkey as varchar) stock_code,
  p_name description, p_type supplier, p_brand product_class
from part""",
    "inv_warehouse": """
select cast(l_partkey as varchar) stock_code, l_returnflag warehouse, cast(sum(l_quantity) as bigint) qty_on_hand
from lineitem group by l_partkey, l_returnflag""",
    "inv_price": """
select cast(p_partkey as varchar) stock_code, 'A' price_code, cast(p_retailprice as decimal(18,2)) selling_price from part
union all
select case when p_size <= 16 then 'X' else '' end || cast(p_partkey as varchar), 'B',
  cast(p_retailprice * 0.5 as decimal(18,2)) from part""",
    "inv_price_history": """
select cast(l_partkey as varchar) stock_code, l_returnflag price_code, cast(l_shipdate as date) date_changed,
  l_linenumber time_changed, l_extendedprice new_selling_price, l_extendedprice * (1 - l_tax) old_selling_price
from lineitem""",
    "sal_product_class": """
select distinct r_name branch, case when p_brand like '%4' then 'X' else '' end || p_brand product_class,
  case when p_brand like '%2' then null else 'Class ' || p_brand || ' ' || r_name end description
from (select distinct p_brand, p_size from part) b
  join nation on b.p_size = n_nationkey join region on n_regionkey = r_regionkey""",
    # one row per key first (all columns in order decide), each line looks its rows up
    "enriched": """
select line.* exclude (stock_description), coalesce(master_text.description, line.stock_description) stock_description,
  head.* exclude (sales_order, invoice_number, order_status), buyer.* exclude (customer)
from sor_detail line
  left join (select stock_code, min(description) description from inv_master group by stock_code) master_text using (stock_code)
  left join (
    select distinct on (sales_order) * from sor_master
    order by sales_order, invoice_number nulls last, customer nulls last, salesperson nulls last, order_date nulls last,
      branch nulls last, area nulls last, req_ship_date nulls last, customer_name nulls last, ship_addr1 nulls last,
      ship_addr2 nulls last, ship_addr3 nulls last, ship_addr4 nulls last, ship_addr5 nulls last, postal_code nulls last
  ) head on head.sales_order = line.sales_order
  left join (
    select distinct on (customer) * from ar_customer order by customer, short_name nulls last, master_account nulls last
  ) buyer on buyer.customer = head.customer""",
}

# which stand-ins each view needs (in dependency order)
_DEPS = {"enriched": ["sor_detail", "sor_master", "ar_customer", "inv_master"]}


def _with(*names: str) -> str:
    order: list[str] = []
    for n in names:
        for d in _DEPS.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    return "with " + ",\n".join(f"{n} as ({_VIEWS[n]})" for n in order) + "\n"


def _report_sql(bounded: bool, lines: str = "enriched") -> str:
    # as_of 2000-03-15: current month 2000-03; window from 1999-10-01
    months = [(2000, 3), (2000, 2), (2000, 1), (1999, 12), (1999, 11), (1999, 10)]
    sums = ["sum(order_qty) total_all_time"]
    for name, year in (("current_month_qty", 2000), ("last_year_month_qty", 1999),
                       ("two_years_ago_month_qty", 1998)):
        sums.append(f"sum(case when extract(year from order_date) = {year} and extract(month from order_date) = 3 "
                    f"then order_qty else 0 end) {name}")
    for k, (y, m) in enumerate(months):
        if bounded:
            cond = f"date_trunc('month', order_date) = date '{y}-{m:02d}-01'"
        else:
            cond = f"order_date >= date '1999-10-01' and extract(month from order_date) = {m}"
        sums.append(f"sum(case when {cond} then order_qty else 0 end) month_{k}_qty")
    blocks = [
        f"select '{c}' category, {c} category_value, {', '.join(sums)} from {lines} "
        f"where {c} is not null and trim({c}) <> '' group by {c}"
        for c in ("branch", "area", "customer", "stock_code", "product_class", "salesperson")
    ]
    return _with("enriched") + "\nunion all\n".join(blocks)


_DETAIL_WHERE = ("order_date >= date '1998-01-01' and order_date <= date '1998-01-31' "
                 "and branch = 'ASIA'")
# newest order date first, then order, line (the reference's keys), then every
# other output column as a tie-break; SQL NULL placement (ASC last, DESC first)
_DETAIL_ORDER = """order_date desc nulls first, sor_id asc nulls last, sor_line asc nulls last,
  invoice asc nulls last, stock_code asc nulls last, order_qty asc nulls last, customer_id asc nulls last,
  customer_name asc nulls last, short_name asc nulls last, master_account asc nulls last,
  line_type asc nulls last, stock_desc asc nulls last, ship_qty asc nulls last,
  back_order_qty asc nulls last, product_class asc nulls last, branch asc nulls last, area asc nulls last,
  shipping_address asc nulls last, salesperson_id asc nulls last"""

_TOP30 = """t as (select stock_code, stock_description, sum(order_qty) q from sor_detail
  group by stock_code, stock_description
  order by q desc nulls first, stock_code asc nulls last, stock_description asc nulls last limit 30)"""

_WH_TEXT = "iw.warehouse || ': ' || cast(iw.qty_on_hand as varchar)"
_PR_TEXT = "ip.price_code || ': $' || cast(ip.selling_price as varchar)"

_SHARE = _with("sor_detail", "sal_product_class") + """,
c as (select product_class, sum(order_qty) q,
        rank() over (order by sum(order_qty) desc nulls last) rk
      from sor_detail where product_class is not null group by product_class),
g as (select case when rk <= 5 then product_class else 'Others' end id, rk > 5 is_others, sum(q) q
      from c group by 1, 2),
d as (select product_class, coalesce(max(description), 'Unknown') description
      from sal_product_class group by product_class)
select g.id, case when g.is_others then 'Others' else coalesce(d.description, 'Unknown') || ' (' || g.id || ')' end label,
  cast(round_even(g.q, 0) as bigint) value,
  round_even(g.q / (select sum(q) from c) * 100, 2) percentage, g.is_others
from g left join d on g.id = d.product_class and not g.is_others
where not g.is_others or g.q > 0"""


def _detail_page_sql(where: str, page: str) -> str:
    return _with("enriched") + f"""
select * replace (cast(order_date as varchar) as order_date) from (
  select invoice, customer customer_id, customer_name, short_name, master_account,
    sales_order sor_id, sales_order_line sor_line, line_type, stock_code, stock_description stock_desc,
    order_qty, ship_qty, back_order_qty, product_class, branch, area,
    concat_ws(', ', ship_addr1, ship_addr2, ship_addr3, ship_addr4, ship_addr5, postal_code) shipping_address,
    order_date, salesperson salesperson_id
  from enriched where {where}
  order by {_DETAIL_ORDER} {page}) y"""


_ORACLE = {
    "enriched": _with("enriched") + """
select * replace (cast(line_ship_date as varchar) as line_ship_date, cast(order_date as varchar) as order_date,
  cast(req_ship_date as varchar) as req_ship_date) from enriched""",
    "status_overview": _with("sor_master") + """
select label.status_desc, label.status_code,
  count(*) filter (where sor_master.order_status = label.status_code) "count",
  round(100.0 * count(*) filter (where sor_master.order_status = label.status_code) / count(*), 2) percentage
from sor_master, (values ('0', 'Order in process'), ('1', 'Open order'), ('2', 'Open back order'),
  ('3', 'Released back order'), ('4', 'In warehouse'), ('8', 'To invoice'), ('9', 'Complete'),
  ('F', 'Forwarded order')) label(status_code, status_desc)
group by label.status_desc, label.status_code""",
    "filter_options": _with("enriched") + """
select distinct dimension, value from (
  select 'branch' dimension, branch value from enriched
  union all select 'area', area from enriched
  union all select 'customer', customer from enriched
  union all select 'product_class', product_class from enriched
  union all select 'salesperson', salesperson from enriched) x
where value is not null and value <> ''""",
    # every month number from the first dated line's to the last one's
    "order_trend": _with("enriched") + """,
dated as (select extract(year from order_date) * 12 + extract(month from order_date) - 1 month_no,
    case when customer = '77' then order_qty else 0 end qty from enriched where order_date is not null)
select (month_no // 12)::varchar || '-' || lpad((month_no % 12 + 1)::varchar, 2, '0') year_month,
  (select coalesce(sum(qty), 0) from dated where dated.month_no = months.month_no) total_order_qty
from (select unnest(range(min(month_no), max(month_no) + 1)) month_no from dated) months""",
    "detail_page": _detail_page_sql(_DETAIL_WHERE, "limit 50 offset 50"),
    "detail_page_deep": _detail_page_sql("order_date is not null", "limit 50 offset (select (count(*) // 50 - 1) * 50 from enriched where order_date is not null)"),
    "detail_after": _detail_page_sql(_DETAIL_WHERE, "limit 50 offset 50"),
    "detail_count_filtered": _with("enriched") + """
select count(*) total_count, cast(ceil(count(*) / 50.0) as bigint) total_pages, 50 per_page
from enriched where order_date is not null and branch = 'ASIA' and area = 'INDIA' and product_class = 'Brand#32'
  and salesperson = '1-URGENT'""",
    "detail_count_default_range_stored": _with("enriched") + """
select count(*) total_count, cast(ceil(count(*) / 50.0) as bigint) total_pages, 50 per_page
from enriched where order_date is not null and branch = 'ASIA'""",
    "detail_count": _with("enriched") + f"""
select count(*) total_count, cast(ceil(count(*) / 50.0) as bigint) total_pages, 50 per_page
from enriched where {_DETAIL_WHERE}""",
    "default_range": _with("enriched") + """
select cast(cast(date_trunc('month', min(order_date)) as date) as varchar) min_date,
  cast(last_day(max(order_date)) as varchar) max_date from enriched""",
    # the fan-out sum is checked as a product of row counts: warehouse quantity, times price
    # rows, times equal item rows
    "top_stock": _with("sor_detail", "inv_master", "inv_warehouse", "inv_price") + f""",
{_TOP30},
store as (select stock_code, sum(qty_on_hand) qty, list(distinct {_WH_TEXT}) texts from inv_warehouse iw group by all),
tariff as (select stock_code, count(*) n, list(distinct {_PR_TEXT}) texts from inv_price ip group by all),
variant as (select stock_code, description, supplier, product_class, count(*) n from inv_master group by all)
select best.stock_code, coalesce(best.stock_description, variant.description) description, cast(best.q as double) total_order_qty,
  variant.supplier, variant.product_class, list_aggregate(list_sort(store.texts), 'string_agg', ', ') warehouse_qty,
  list_aggregate(list_sort(tariff.texts), 'string_agg', ', ') price_details,
  cast(coalesce(store.qty * coalesce(tariff.n, 1) * coalesce(variant.n, 1), 0) as double) total_qty_on_hand,
  cast(coalesce(store.qty, 0) as double) qty_on_hand
from t best left join variant using (stock_code) left join store using (stock_code) left join tariff using (stock_code)""",
    # the joined rows themselves, one for each warehouse and price of an item
    "stock_strings": _with("inv_warehouse", "inv_price") + f"""
select stock_code, string_agg(distinct {_WH_TEXT}, ', ' order by {_WH_TEXT}) warehouse_qty,
  string_agg(distinct {_PR_TEXT}, ', ' order by {_PR_TEXT}) price_details,
  cast(sum(iw.qty_on_hand) filter (ip.k is null or ip.k = 1) as bigint) qty_on_hand,
  cast(coalesce(max(ip.k), 0) as bigint) price_rows, cast(sum(iw.qty_on_hand) as bigint) total_qty_on_hand
from inv_warehouse iw full join (
    select *, row_number() over (partition by stock_code order by price_code, selling_price) k from inv_price) ip using (stock_code)
group by stock_code""",
    "price_history": _with("sor_detail", "inv_price_history") + f""",
{_TOP30}
select ph.stock_code, ph.price_code, cast(ph.date_changed as varchar) date_changed, ph.time_changed,
  ph.new_selling_price new_price, ph.old_selling_price old_price
from inv_price_history ph where ph.stock_code in (select stock_code from t)""",
    "product_class_share": _SHARE,
    "product_class_share_total": "select round_even(sum(percentage), 2) total_percentage from (\n"
                                 + _SHARE + "\n) share",
    "category_report": _report_sql(bounded=False),
    "category_report_bounded": _report_sql(bounded=True),
    "latest_report": "select *, '2000-03-15' as_of from (" + _report_sql(bounded=False) + ") r",
    "report_labels": """
select '2000-03-15' as_of, measure, label from (values ('total_all_time', 'Total Quantity'),
  ('current_month_qty', 'March 2000'), ('last_year_month_qty', 'March 1999'), ('two_years_ago_month_qty', 'March 1998'),
  ('month_0_qty', 'March 2000'), ('month_1_qty', 'February 2000'), ('month_2_qty', 'January 2000'),
  ('month_3_qty', 'December 1999'), ('month_4_qty', 'November 1999'), ('month_5_qty', 'October 1999')) l(measure, label)""",
    "ingest_sor_detail": _with("sor_detail") + """
select * replace (cast(sales_order_line as bigint) as sales_order_line,
  cast(line_ship_date as varchar) as line_ship_date) from sor_detail""",
    "ingest_sor_master": _with("sor_master") + """
select * replace (cast(order_date as varchar) as order_date, cast(req_ship_date as varchar) as req_ship_date)
from sor_master""",
    "ingest_price_history": _with("inv_price_history") + """
select * replace (cast(date_changed as varchar) as date_changed, cast(time_changed as bigint) as time_changed,
  cast(new_selling_price as double) as new_selling_price, cast(old_selling_price as double) as old_selling_price)
from inv_price_history""",
    "ingest_inv_warehouse": _with("inv_warehouse") + f"""
select stock_code, string_agg(distinct {_WH_TEXT}, ', ' order by {_WH_TEXT}) warehouse_qty,
  cast(sum(qty_on_hand) as double) qty_on_hand from inv_warehouse iw group by stock_code""",
}


def _lookup_sql(where: str) -> str:
    return _with("enriched") + f"""
select sales_order, sales_order_line, invoice, stock_code, order_qty, cast(line_ship_date as varchar) line_ship_date,
  cast(order_date as varchar) order_date, customer, short_name, master_account
from enriched where {where}"""


# changes of each item, newest first, 16 to an array; JSON written out field by field
_CHUNKS = """
changes as (
  select stock_code, row_number() over item - 1 position,
    '{"priceCode":"' || price_code || '","dateChanged":"' || date_changed || '","timeChanged":' || time_changed || ',"newPrice":'
      || cast(new_selling_price as decimal(18,4)) || ',"oldPrice":' || cast(old_selling_price as decimal(18,4)) || '}' change
  from inv_price_history window item as (partition by stock_code order by date_changed desc, time_changed desc, price_code, new_selling_price, old_selling_price)),
chunks as (
  select stock_code, position // 16 chunk, count(*) n_changes, '[' || string_agg(change, ',' order by position) || ']' price_history
  from changes group by all)"""
_ORACLE |= {
    "lines_by_order": _lookup_sql("sales_order in ('1', '7', '32', '1000', '9999')"),
    "lines_by_ship_date": _lookup_sql("line_ship_date between date '1998-01-05' and date '1998-01-09'"),
    "lines_by_account": _lookup_sql("short_name = 'BUILDING' and master_account in ('Customer#000000004', 'Customer#000000026', 'Customer#000000034')"),
    "order_trend_rollup": _ORACLE["order_trend"],
    "detail_count_rollup": _with("enriched") + """
select count(*) total_count, cast(ceil(count(*) / 50.0) as bigint) total_pages, 50 per_page
from enriched where branch = 'ASIA' and order_date between date '1997-12-15' and date '1998-03-02'""",
    "monthly_area_totals_rollup": _with("enriched") + """
select cast(cast(date_trunc('month', order_date) as date) as varchar) as month, branch, area, count(*) n_lines, sum(order_qty) qty
from enriched group by all""",
    "detail_page_positions": _ORACLE["detail_page"],
    "detail_page_deep_positions": _ORACLE["detail_page_deep"],
    "order_trend_sql": _ORACLE["order_trend"],
    "detail_page_sql": _ORACLE["detail_page"],
    "enriched_bucketed": _ORACLE["enriched"],
    "category_report_state": _ORACLE["category_report"],
    "category_report_state_changes": _report_sql(bounded=False, lines="(select * from enriched where order_date is null or extract(year from order_date) <> 1999 or extract(month from order_date) = 2) kept"),
    "filter_option_lists": _with("enriched") + """,
options as (
  select distinct dimension, value from (
    select 'branch' dimension, branch value from enriched union all select 'area', area from enriched union all select 'customer', customer from enriched
    union all select 'product_class', product_class from enriched union all select 'salesperson', salesperson from enriched)
  where value is not null and value <> ''),
numbered as (select *, row_number() over (partition by dimension order by value) - 1 position from options)
select dimension, position // 100 chunk, count(*) n_values, string_agg(value, '|' order by value) "values" from numbered group by all""",
    "stock_strings_committed": _ORACLE["stock_strings"],
    "price_history_json": _with("inv_master", "inv_price_history") + "," + _CHUNKS + """
select stock_code, coalesce(chunk, 0) chunk, coalesce(n_changes, 0) n_changes, coalesce(price_history, '[]') price_history
from (select distinct stock_code from inv_master) left join chunks using (stock_code)""",
    "top_stock_history": _ORACLE["top_stock"].replace("with ", _with("inv_price_history").rstrip() + "," + _CHUNKS + ",\n", 1).replace(
        "select best.stock_code,", "select best.stock_code, coalesce(chunk, 0) chunk, coalesce(n_changes, 0) n_changes, coalesce(price_history, '[]') price_history,", 1)
        + " left join chunks using (stock_code)",
}
_ORACLE.update({f"{name}_stored": _ORACLE[name]
                for name in ("order_trend", "detail_page", "detail_count", "default_range")})


def oracle_sql() -> dict[str, str]:
    return _ORACLE | (llm_queries.ORACLE_SQL if llm_queries else {}) | (
        {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline and corpus_pipeline.ORACLE_SQL else {})
