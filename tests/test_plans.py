"""Plan shapes that matter at scale, checked on a materialised enriched table."""

import datetime as dt
import tempfile

import pytest

from orderlens.operators.detail import detail_count, detail_page
from orderlens.operators.enrich import first_headers
from orderlens.operators.report import category_report
from orderlens.operators.stock import top_stock
from orderlens.operators.trend import order_trend
from orderlens.plans.inspect import count_nodes, plan_text, scans_of
from orderlens.sources.layout import read_enriched, write_enriched


@pytest.fixture(scope="module")
def stored(spark, enriched):
    base = tempfile.mkdtemp(prefix="orderlens-enriched-") + "/enriched"
    write_enriched(enriched, base, run_ts="20240101_000000")
    return base, read_enriched(spark, base)


def test_layout_roundtrip(stored, enriched):
    _, df = stored
    assert df.count() == enriched.count()
    assert "order_month" in df.columns and "run_ts" not in df.columns


def test_report_is_one_scan_one_shuffle(stored):
    base, df = stored
    text = plan_text(category_report(df, dt.date(2000, 3, 15)))
    assert scans_of(text, "enriched") == 1
    assert count_nodes(text, "Expand") == 1
    assert "partial_sum" in text


def test_detail_page_is_top_k_with_pruning_and_pushdown(stored):
    _, df = stored
    q = detail_page(df, {"branch": "ASIA"}, "1998-01-01", "1998-01-31", page=2, per_page=50)
    text = plan_text(q)
    assert "TakeOrderedAndProject" in text
    assert "(order_month" in text and ">= 1998-01-01" in text
    assert "EqualTo(branch,ASIA)" in text


def test_latest_version_lists_only_its_files(stored, spark):
    base, df = stored
    assert all("run_ts=20240101_000000" in f for f in df.inputFiles())
    q = detail_count(df, {"branch": "ASIA"}, "1998-01-01", "1998-01-31")
    assert "(order_month" in plan_text(q)


def test_trend_aggregates_before_join(stored):
    _, df = stored
    text = plan_text(order_trend(df, {"customer": "77"}))
    assert "partial_sum" in text
    assert "BroadcastHashJoin" in text or "BroadcastNestedLoopJoin" not in text


def test_first_headers_limit_before_shuffle(standins):
    text = plan_text(first_headers(standins.sor_master))
    assert count_nodes(text, "WindowGroupLimit") >= 2


def test_top_stock_semi_joins_dimensions_to_bounded_keys(standins):
    s = standins
    text = plan_text(top_stock(s.sor_detail, s.inv_master, s.inv_warehouse, s.inv_price))
    assert count_nodes(text, "TakeOrderedAndProject") >= 1
    assert text.count("LeftSemi") >= 3


def _executed(df):
    df.collect()
    return plan_text(df, "simple")


def test_inline_trend_builds_enriched_once(spark):
    import __spark_entry__ as entry
    from conftest import SF01
    from tools.plan_report import final_sections

    text = final_sections(_executed(entry.q_order_trend(spark, SF01)))
    enriched_text = final_sections(_executed(entry.q_enriched(spark, SF01)))
    assert text.count("FileScan parquet") == enriched_text.count("FileScan parquet")


def test_stored_trend_range_reads_partition_values_only(stored):
    _, df = stored
    text = plan_text(order_trend(df, {"customer": "77"}), "formatted")
    read_schemas = [line for line in text.splitlines() if line.strip().startswith("ReadSchema:")]
    assert any(line.strip() == "ReadSchema: struct<>" for line in read_schemas)
    assert "EqualTo(customer,77)" in text


def test_class_share_scalars_reuse_the_class_aggregate(standins):
    from orderlens.operators.product_class import product_class_share
    from tools.plan_report import final_sections

    text = final_sections(_executed(product_class_share(standins.sor_detail, standins.sal_product_class)))
    assert "ReusedExchange" in text and "ReusedSubquery" in text
    # lineitem (the lines) is read once, by the main query; subqueries reuse its shuffle
    assert text.count("lineitem.parquet") == 1


def test_keyset_page_prunes_months_after_the_cursor(stored):
    import datetime as dt

    from orderlens.operators.detail import detail_after

    _, df = stored
    q = detail_after(df, [dt.date(1996, 3, 15)], start="1995-01-01", end="1998-12-31", per_page=10)
    text = plan_text(q)
    assert "LessThanOrEqual(order_date,1996-03-15)" in text
    assert "(order_month" in text and "<= 1996-03-01" in text
    assert all(r.order_date <= dt.date(1996, 3, 15) for r in q.collect())


def test_a_page_beyond_the_sorted_rows_is_served(stored):
    from orderlens.operators.detail import SORTED_ROWS, _sort_columns, detail_rows

    _, df = stored
    rows = [tuple(r) for r in detail_rows(df).orderBy(*_sort_columns()).collect()]
    page = SORTED_ROWS // 50 + 777
    assert [tuple(r) for r in detail_page(df, page=page, per_page=50).collect()] == rows[(page - 1) * 50:page * 50] != []
    assert detail_page(df, page=2_001, per_page=50).collect() == rows[100_000:]


def test_stored_month_range_from_folders_matches_the_data(stored, enriched, spark):
    from pyspark.sql import functions as F

    from orderlens.operators.filters import default_range
    from orderlens.sources.layout import stored_default_range, stored_month_range

    base, df = stored
    lo, hi = stored_month_range(spark, base)
    row = enriched.agg(F.min("order_date").alias("a"), F.max("order_date").alias("b")).first()
    assert (lo, hi) == (row.a.replace(day=1), row.b.replace(day=1))
    rng = default_range(enriched).first()
    assert stored_default_range(spark, base) == (rng.min_date, rng.max_date)
    # the trend with the folder range reads the table once, filtered
    text = plan_text(order_trend(df, {"customer": "77"}, month_range=(lo, hi)), "formatted")
    assert sum(1 for line in text.splitlines() if line.startswith("(") and "Scan parquet" in line) == 1
    assert [tuple(r) for r in order_trend(df, {"customer": "77"}, month_range=(lo, hi)).collect()] == \
        [tuple(r) for r in order_trend(df, {"customer": "77"}).collect()]
