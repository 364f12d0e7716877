"""Benchmark: the named queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Mirrors how the reference is used: the source tables are loaded once
(``load_tables``: the reference-shaped views over the test tables stored as
parquet snapshots, the counterpart of its CSV load), the enriched table is
built from them once and stored with its layout (``enriched_build``), then
every query runs against the stored tables. Each step and query is run once
to warm up, then 3 times; the median is reported. Results are forced with the
``noop`` sink (full execution, nothing collected).

The measured run of each query carries a job group; Spark's event log,
written to a fresh scratch folder, gives its shuffle bytes (``shuffle_mb`` in
the output).

Names are those of ``__spark_entry__.queries()``; ``*_stored`` queries and
those on the stored enriched table read it, as the reference's queries do
after its build. Prints one JSON line: ``value`` is the sum of the medians of
the build and the queries; ``setup`` (deriving and storing the test views and
the CSV extract) is reported apart, since it stands in for data the reference
already has.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import statistics
import sys
import tempfile
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from orderlens.operators.detail import detail_count, detail_page  # noqa: E402
from orderlens.operators.enrich import build_enriched  # noqa: E402
from orderlens.operators.history import price_history_json  # noqa: E402
from orderlens.operators.options import filter_options  # noqa: E402
from orderlens.operators.product_class import product_class_share, share_total  # noqa: E402
from orderlens.operators.report import category_report, latest_report, write_report  # noqa: E402
from orderlens.operators.report_state import month_state, read_state, report_from_state, write_state  # noqa: E402
from orderlens.operators.rollup import build_rollup, rollup_trend  # noqa: E402
from orderlens.operators.status import status_overview  # noqa: E402
from orderlens.operators.stock import stock_details, top_stock, top_stock_price_history  # noqa: E402
from orderlens.operators.trend import order_trend  # noqa: E402
from orderlens.session import ensure_checkpoint_dir, local_session  # noqa: E402
from orderlens.sources.access import lookup, write_access_table  # noqa: E402
from orderlens.sources.csv_ingest import ingest_csv_dir  # noqa: E402
from orderlens.sources.layout import read_enriched, stored_default_range, stored_month_range, write_enriched  # noqa: E402
from orderlens.sources.positions import Positions, write_positions  # noqa: E402
from orderlens.sources.snapshots import RUN_COLUMN, read_latest, write_snapshot  # noqa: E402
from orderlens.sources.standins import StandIns  # noqa: E402
from tools.csv_extract import write_extract  # noqa: E402
from tools.event_metrics import group_metrics  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
AS_OF = dt.date(2000, 3, 15)
BENCH_RUN_TS = "20000101_000000"  # one fixed version name, rewritten by each run


def _sf(path: str) -> str:
    tail = path.rstrip("/").rsplit("/", 1)[-1]
    return tail[2:] if tail.startswith("sf") else tail


def _force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _time(spark, name: str, fn, runs: int = RUNS) -> float:
    sc = spark.sparkContext
    sc.setJobGroup(f"warm:{name}", name)
    fn()  # warm-up
    samples = []
    for i in range(runs):
        sc.setJobGroup(name if i == 0 else f"run{i}:{name}", name)
        t0 = time.perf_counter()
        fn()
        samples.append(time.perf_counter() - t0)
    sc.setJobGroup("", "")
    return round(statistics.median(samples), 3)


def main() -> None:
    events = tempfile.mkdtemp(prefix="orderlens-events-")
    spark = local_session(cores=CPUS, shuffle_partitions=max(CPUS, 8), extra_confs={
        "spark.eventLog.enabled": "true",
        "spark.eventLog.dir": f"file://{events}",
        "spark.eventLog.compress": "false",
    })
    views = StandIns(spark, SF_DIR)
    store = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex[:8]}"
    tables = ("sor_master", "sor_detail", "ar_customer", "inv_master", "inv_warehouse", "inv_price",
              "inv_price_history", "sal_product_class")

    def load():
        for t in tables:
            write_snapshot(getattr(views, t), f"{store}/{t}", run_ts=BENCH_RUN_TS)

    def extract():
        write_extract(views.inv_price_history, f"{store}/extract", "InvPriceHistory", iso_dates=True)

    setup = {"load_tables": _time(spark, "load_tables", load), "write_extract": _time(spark, "write_extract", extract, 1)}
    timings = {}
    s = type("Stored", (), {t: read_latest(spark, f"{store}/{t}").drop(RUN_COLUMN) for t in tables})

    def build():
        e = build_enriched(s.sor_detail, s.sor_master, s.ar_customer, s.inv_master, f"{store}/sides")
        write_enriched(e, f"{store}/enriched", run_ts=BENCH_RUN_TS)

    timings["enriched_build"] = _time(spark, "enriched_build", build)
    enriched = read_enriched(spark, f"{store}/enriched")
    months = stored_month_range(spark, f"{store}/enriched")  # folder names, no scan

    # structures that are built once: timed as set-up
    for name, make in (("build_rollup", lambda: build_rollup(enriched, f"{store}/rollup", BENCH_RUN_TS)),
                       ("build_positions", lambda: write_positions(enriched, f"{store}/positions", BENCH_RUN_TS, 50_000)),
                       ("build_access", lambda: write_access_table(enriched.drop("order_month"), f"{store}/access", run_ts=BENCH_RUN_TS)),
                       ("build_report_state", lambda: write_state(month_state(enriched), f"{store}/state", BENCH_RUN_TS))):
        t0 = time.perf_counter()
        make()
        setup[name] = round(time.perf_counter() - t0, 3)
    positions = Positions(spark, f"{store}/positions")

    def report():
        write_report(category_report(enriched, AS_OF, sort=False), f"{store}/reports", BENCH_RUN_TS, AS_OF)
        return latest_report(spark, f"{store}/reports")

    def deep():
        pages = detail_count(enriched, per_page=50).first()["total_count"] // 50
        return detail_page(enriched, page=pages, per_page=50)

    queries = {
        "status_overview": lambda: status_overview(s.sor_master),
        "filter_options": lambda: filter_options(enriched),
        "order_trend_stored": lambda: order_trend(enriched, {"customer": "77"}, month_range=months),
        "detail_page_stored": lambda: detail_page(enriched, {"branch": "ASIA"}, "1998-01-01", "1998-01-31", 2, 50),
        "detail_count_stored": lambda: detail_count(enriched, {"branch": "ASIA"}, "1998-01-01", "1998-01-31"),
        "detail_page_deep": deep,
        "detail_page_deep_positions": lambda: positions.page(page=positions.count() // 50, per_page=50),
        "order_trend_rollup": lambda: rollup_trend(spark, f"{store}/rollup", {"customer": "77"}),
        "category_report_state": lambda: report_from_state(read_state(spark, f"{store}/state"), AS_OF),
        "lines_by_order": lambda: lookup(spark, f"{store}/access", {"sales_order": ["1", "7", "32", "1000", "9999"]}),
        "price_history_json": lambda: price_history_json(s.inv_price_history, s.inv_master, f"{store}/history/{uuid.uuid4().hex}"),
        "default_range_stored": lambda: spark.createDataFrame([stored_default_range(spark, f"{store}/enriched")], "a date, b date"),
        "top_stock": lambda: top_stock(s.sor_detail, s.inv_master, s.inv_warehouse, s.inv_price),
        "stock_strings": lambda: stock_details(s.inv_warehouse, s.inv_price),
        "price_history": lambda: top_stock_price_history(s.sor_detail, s.inv_price_history),
        "product_class_share": lambda: product_class_share(s.sor_detail, s.sal_product_class),
        "product_class_share_total": lambda: share_total(product_class_share(s.sor_detail, s.sal_product_class)),
        "category_report": lambda: category_report(enriched, AS_OF),
        "category_report_bounded": lambda: category_report(enriched, AS_OF, bounded=True),
        "latest_report": report,
        "ingest_price_history": lambda: ingest_csv_dir(spark, f"{store}/extract")["inv_price_history"],
    }
    for name, make in queries.items():
        timings[name] = _time(spark, name, lambda make=make: _force(make()))

    spark.stop()
    io = group_metrics(events)
    mb = 1024 * 1024
    steps = {**setup, **timings}
    print(json.dumps({
        "metric": "sum_of_median_query_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "setup": setup,
        "sf": _sf(SF_DIR),
        "cpus": CPUS,
        "runs": RUNS,
        "shuffle_mb": {q: round(io.get(q, {}).get("shuffle_write_bytes", 0) / mb, 2) for q in steps},
    }))


if __name__ == "__main__":
    main()
