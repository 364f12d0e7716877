"""A key holding a third of all rows: the big joins split it, aggregates
pre-aggregate it on the map side. Broadcasts are disabled so the shuffle
joins a large cluster would use are the ones planned."""

import contextlib

from pyspark.sql import functions as F

import pytest

from fixtures import CUSTOMER, DETAIL, ITEM, MASTER, frame, header, line
from orderlens.operators.enrich import build_enriched
from orderlens.operators.report import category_report
from orderlens.plans.inspect import plan_text

SKEW_CONFS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@contextlib.contextmanager
def confs(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


N = 3000


def tables(spark, order=None, item=None, customer=None):
    """Lines, headers, customers and items with at most the given hot keys."""
    lines = [line(sales_order=order or f"O{i}" if i % 3 == 0 else f"O{i}", stock_code=item or f"S{i % 97}" if i % 3 == 1 else f"S{i % 97}",
                  qty=1.0, line_no=i) for i in range(N)]
    headers = [header(sales_order=f"O{i}", customer=customer if customer and i % 3 == 2 else f"C{i % 50}") for i in range(N)]
    headers += [header(sales_order=order)] if order else []
    items = [dict(stock_code=f"S{k}", description=f"d{k}") for k in range(97)] + ([dict(stock_code=item, description="hot item")] if item else [])
    customers = [dict(customer=f"C{k}", short_name="x") for k in range(50)] + ([dict(customer=customer, short_name="hot")] if customer else [])
    return frame(spark, DETAIL, lines), frame(spark, MASTER, headers), frame(spark, CUSTOMER, customers), frame(spark, ITEM, items)


@pytest.fixture(scope="module")
def skewed(spark):
    return tables(spark, order="HOT", item="HOT")


def joins(text, key):
    """Lines of the sort-merge joins on ``key`` in the plan that ran."""
    return [x for x in text.split("== Initial Plan ==")[0].splitlines() if "SortMergeJoin" in x and f"[{key}#" in x]


def build(spark, tmp_path, inputs, **more):
    with confs(spark, {**SKEW_CONFS, **more}):
        e = build_enriched(*inputs, scratch=str(tmp_path / "sides"))
        rows = e.collect()
        return rows, plan_text(e, "simple")


@pytest.mark.parametrize(("hot", "key"), [({"order": "HOT"}, "sales_order"), ({"item": "HOT"}, "stock_code")])
def test_one_hot_key_is_split_in_its_own_join(spark, tmp_path, hot, key):
    rows, plan = build(spark, tmp_path, tables(spark, **hot))
    assert len(rows) == N
    assert [("skew=true" in x) for x in joins(plan, key)] == [True]
    other = {"sales_order": "stock_code", "stock_code": "sales_order"}[key]
    assert len(joins(plan, other)) == 1


def test_hot_customer_is_split_in_the_header_join(spark, tmp_path):
    """That join is written with the sides; its plan is that of the same join."""
    inputs = tables(spark, customer="HOT")
    rows, _ = build(spark, tmp_path, inputs)
    assert sum(r.short_name == "hot" for r in rows) == N // 3
    with confs(spark, SKEW_CONFS):
        headers, customers = (spark.read.parquet(str(tmp_path / "sides" / t)) for t in ("headers", "customers"))
        joined = headers.join(customers, "customer", "left")
        joined.collect()
        assert ["skew=true" in x for x in joins(plan_text(joined, "simple"), "customer")] == [True]


def test_hot_order_and_item_are_split_together(spark, tmp_path):
    inputs = tables(spark, order="HOT", item="HOT")
    rows, plan = build(spark, tmp_path, inputs)
    assert sum(1 for r in rows if r.sales_order == "HOT" and r.branch == "B1") == N // 3
    assert all("skew=true" in x for key in ("sales_order", "stock_code") for x in joins(plan, key))


def test_items_are_joined_before_the_wide_headers(spark, tmp_path):
    """The shuffle on the order carries lines and a description, not header columns twice."""
    _, plan = build(spark, tmp_path, tables(spark))
    order, item = (plan.index(joins(plan, k)[0]) for k in ("sales_order", "stock_code"))
    assert order < item  # printed from the top: the header join is the last one


def test_hot_values_pre_aggregated_in_report(spark, skewed):
    with confs(spark, SKEW_CONFS):
        e = build_enriched(*skewed)
        text = plan_text(category_report(e, "2024-01-20"))
        got = {(r.category, r.category_value): r.total_all_time
               for r in category_report(e, "2024-01-20").collect()}
    assert "partial_sum" in text
    assert got[("stock_code", "HOT")] == 1000.0
    assert got[("branch", "B1")] == 3000.0


def test_layout_write_splits_a_hot_customer_month(spark, skewed):
    import tempfile

    from orderlens.sources.layout import write_enriched

    detail, master, customer, item = skewed
    # every line in one month, one customer: only the trailing order/line keys can split it
    hot_master = master.withColumn("customer", F.lit("C0")).withColumn("order_date", F.lit("2024-01-15").cast("date"))
    e = build_enriched(detail, hot_master, customer, item)
    base = tempfile.mkdtemp(prefix="orderlens-hot-") + "/e"
    write_enriched(e, base, run_ts="20240101_000000", num_files=6)
    written = spark.read.parquet(base)
    assert written.count() == 3000
    files = written.inputFiles()
    assert len(files) >= 4   # the single (month, customer) group went to several tasks


def test_one_description_reaches_the_header_join(spark, skewed):
    with confs(spark, SKEW_CONFS):
        text = plan_text(build_enriched(*skewed), "simple")
    header_join = text.index("SortMergeJoin [sales_order#")
    assert "coalesce(_item_description" not in text[:header_join] and "coalesce(_item_description" in text[header_join:]


def test_lines_are_shuffled_once_for_part_and_item(spark, standins):
    with confs(spark, SKEW_CONFS):
        alone, joined = plan_text(standins.sor_detail), plan_text(standins.sor_detail.join(standins.inv_master.select("stock_code", "description"), "stock_code", "left"))
    assert joined.count("Exchange") == alone.count("Exchange") + 2  # that of the items, named twice in the text
