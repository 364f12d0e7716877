"""The batch jobs chained as the reference's pipeline: ingest -> build -> report."""

import datetime as dt
import tempfile

from orderlens import jobs
from orderlens.operators.report import category_report, latest_report
from orderlens.sources.layout import read_enriched
from tools.csv_extract import write_extract

SOURCES = {"SorMasterRep": "sor_master", "SorDetailRep": "sor_detail", "ArCustomer": "ar_customer",
           "InvMaster": "inv_master"}


def test_pipeline_jobs(spark, standins, enriched):
    csv_dir = tempfile.mkdtemp(prefix="orderlens-jobs-csv-")
    store = tempfile.mkdtemp(prefix="orderlens-jobs-store-")
    for table, attr in SOURCES.items():
        write_extract(getattr(standins, attr), csv_dir, table)

    assert jobs.run_ingest(spark, csv_dir, store, run_ts="20240101_000000") == sorted(SOURCES.values())
    assert jobs.run_build(spark, store, run_ts="20240101_000100") == "20240101_000100"
    assert read_enriched(spark, f"{store}/enriched").count() == enriched.count()

    as_of = dt.date(2000, 3, 15)
    jobs.run_report(spark, store, as_of, run_ts="20240101_000200")
    stored = latest_report(spark, f"{store}/reports").drop("run_ts")
    expected = category_report(enriched, as_of, sort=False)
    key = ["category", "category_value"]
    assert sorted(map(tuple, stored.select(*expected.columns).orderBy(*key).collect())) == \
        sorted(map(tuple, expected.orderBy(*key).collect()))


def test_cli_parses_steps():
    import pytest

    with pytest.raises(SystemExit):
        jobs.main(["bogus"])
