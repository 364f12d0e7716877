"""Batch jobs, one per step of the reference's pipeline, for ``spark-submit``.

    spark-submit -m orderlens.jobs ingest --csv <extract folder> --store <store>
    spark-submit -m orderlens.jobs build  --store <store>
    spark-submit -m orderlens.jobs report --store <store> [--as-of YYYY-MM-DD] [--bounded]

(or ``python -m orderlens.jobs ...`` with a local session). Each step reads the
newest committed snapshots of its inputs and writes a new snapshot version,
so a failed step is re-run on its own and readers never see partial output.
The session comes from the cluster's configuration; ``spark.checkpoint.dir``
must name shared storage outside local mode.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys
import uuid

from pyspark.sql import SparkSession

from orderlens.operators.enrich import build_enriched, duplicate_keys
from orderlens.operators.report import category_report, resolve_as_of, write_report
from orderlens.session import ensure_checkpoint_dir
from orderlens.sources.csv_ingest import ingest_csv_dir
from orderlens.sources.fs import delete
from orderlens.sources.layout import read_enriched, write_enriched
from orderlens.plans.config import SCALE_CONFS
from orderlens.sources.snapshots import RUN_COLUMN, prune_versions, read_latest

BUILD_INPUTS = ("sor_detail", "sor_master", "ar_customer", "inv_master")
# versions kept per built table: the newest and the one readers may still be on
KEEP_VERSIONS = 2


def _latest(spark: SparkSession, store: str, table: str):
    """Newest committed version of a table (loads commit all their tables
    together, so these are never half of a failed load)."""
    return read_latest(spark, f"{store.rstrip('/')}/{table}").drop(RUN_COLUMN)


def apply_scale_confs(spark: SparkSession) -> None:
    """The engine settings of ``plans.config`` for every one the cluster did
    not set itself."""
    submitted = spark.sparkContext.getConf()
    for key, value in SCALE_CONFS.items():
        if not submitted.contains(key):
            spark.conf.set(key, value)


def run_ingest(spark: SparkSession, csv_dir: str, store: str, run_ts: str | None = None,
               multi_line: bool = False, bad_dates: str = "fail") -> list[str]:
    rejects: dict[str, int] = {}
    tables = sorted(ingest_csv_dir(spark, csv_dir, store, run_ts=run_ts, multi_line=multi_line,
                                   bad_dates=bad_dates, rejects=rejects))
    for column, n in sorted(rejects.items()):
        print(f"{column}: {n} values are not dates and were loaded as missing")
    return tables


def report_duplicates(customer, item) -> dict[str, int]:
    """Codes that occur more than once and are reduced to one row by rule
    (the reference would multiply lines by them): printed and returned."""
    counts = {name: duplicate_keys(df, key).count()
              for name, df, key in (("ar_customer", customer, "customer"), ("inv_master", item, "stock_code"))}
    for name, n in counts.items():
        if n:
            print(f"{name}: {n} codes occur more than once; the first row of each is used")
    return counts


def run_build(spark: SparkSession, store: str, run_ts: str | None = None, keep: int = KEEP_VERSIONS) -> str:
    detail, master, customer, item = (_latest(spark, store, t) for t in BUILD_INPUTS)
    report_duplicates(customer, item)
    scratch = f"{ensure_checkpoint_dir(spark).rstrip('/')}/orderlens-build-{uuid.uuid4().hex}"
    enriched = build_enriched(detail, master, customer, item, scratch)
    version = write_enriched(enriched, f"{store.rstrip('/')}/enriched", run_ts)
    delete(spark, scratch, recursive=True)
    prune_versions(spark, f"{store.rstrip('/')}/enriched", keep, protect=(version,))
    return version


def run_report(spark: SparkSession, store: str, as_of: dt.date | None = None, bounded: bool = False,
               run_ts: str | None = None, keep: int = KEEP_VERSIONS) -> str:
    enriched = read_enriched(spark, f"{store.rstrip('/')}/enriched")
    as_of = resolve_as_of(spark, as_of)  # one date for the data and any headings
    report = category_report(enriched, as_of, bounded, sort=False)
    version = write_report(report, f"{store.rstrip('/')}/reports", run_ts, as_of)
    prune_versions(spark, f"{store.rstrip('/')}/reports", keep, protect=(version,))
    return version


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="orderlens.jobs")
    sub = parser.add_subparsers(dest="step", required=True)
    p_ingest = sub.add_parser("ingest", help="CSV extracts -> typed table snapshots")
    p_ingest.add_argument("--csv", required=True)
    p_ingest.add_argument("--store", required=True)
    p_ingest.add_argument("--multi-line", action="store_true", help="quoted fields may hold line breaks")
    p_ingest.add_argument("--bad-dates", choices=("fail", "count"), default="fail")
    p_build = sub.add_parser("build", help="enriched order-line table with its layout")
    p_build.add_argument("--store", required=True)
    p_report = sub.add_parser("report", help="category report snapshot")
    p_report.add_argument("--store", required=True)
    p_report.add_argument("--as-of", type=dt.date.fromisoformat, default=None)
    p_report.add_argument("--bounded", action="store_true")
    for p in (p_ingest, p_build, p_report):
        p.add_argument("--run-ts", default=None, help="version name (default: now, UTC)")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName(f"orderlens-{args.step}").getOrCreate()
    apply_scale_confs(spark)
    ensure_checkpoint_dir(spark)
    if args.step == "ingest":
        print("ingested:", ", ".join(run_ingest(
            spark, args.csv, args.store, args.run_ts, args.multi_line, args.bad_dates)))
    elif args.step == "build":
        print("enriched version:", run_build(spark, args.store, args.run_ts))
    else:
        print("report version:", run_report(spark, args.store, args.as_of, args.bounded, args.run_ts))
    return 0


if __name__ == "__main__":
    sys.exit(main())
