"""The bucketed header join: the same rows, no exchange for light orders, heavy orders spread."""

import uuid

import pytest
from pyspark.sql import functions as F

from fixtures import CUSTOMER, DETAIL, ITEM, MASTER, frame, header, line
from orderlens.operators.bucketed import BucketedStore, heavy_orders
from orderlens.operators.enrich import build_enriched
from orderlens.plans.inspect import plan_text


@pytest.fixture()
def store(spark, tmp_path):
    made = []

    def make(*inputs, buckets=8, share=1000):
        detail, master, customer, item = inputs
        s = BucketedStore(spark, f"{tmp_path}/store", buckets, f"t{uuid.uuid4().hex[:8]}")
        made.append(s)
        s.write_lines(detail, item, share)
        s.write_headers(master, customer)
        return s
    yield make
    for s in made:
        s.drop()


def rows(df, columns=None):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


def skewed(spark, n=3000):
    """A third of the lines have one order, a tenth another."""
    lines = [line(sales_order="HOT" if i % 3 == 0 else "WARM" if i % 10 == 1 else f"O{i}", stock_code=f"S{i % 7}", line_no=i) for i in range(n)]
    lines += [line(sales_order=None, line_no=i) for i in range(5)]
    headers = [header(sales_order=f"O{i}", customer=f"C{i % 9}") for i in range(0, n, 2)] + [header(sales_order="HOT"), header(sales_order="HOT", invoice_number="Z")]
    return (frame(spark, DETAIL, lines), frame(spark, MASTER, headers), frame(spark, CUSTOMER, [dict(customer=f"C{i}", short_name="s") for i in range(6)]),
            frame(spark, ITEM, [dict(stock_code=f"S{i}", description=f"d{i}") for i in range(5)]))


def test_heavy_orders_are_exact(spark):
    detail = skewed(spark)[0]
    want = {r[0]: r[1] for r in detail.where("sales_order is not null").groupBy("sales_order").count().where("count * 100 > 3000").collect()}
    assert set(want) == {"HOT", "WARM"}
    assert {r.sales_order: r.n for r in heavy_orders(detail, 100).collect()} == want
    assert heavy_orders(detail.limit(0)).collect() == []


def test_equals_the_shuffled_build(spark, store):
    inputs = skewed(spark)
    s = store(*inputs, share=100)
    want = build_enriched(*inputs)
    assert rows(s.enriched(), want.columns) == rows(want) and set(s.enriched().columns) == set(want.columns)
    # a third of all lines: not in a bucket, and not in one task
    assert spark.table(f"{s.name}_light_lines").where("sales_order in ('HOT', 'WARM')").count() == 0
    sizes = [r["count"] for r in spark.table(f"{s.name}_light_lines").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 600


def test_no_exchange_for_light_lines(spark, store):
    s = store(*skewed(spark), share=100)
    enriched = s.enriched()
    enriched.collect()
    text = plan_text(enriched, "simple").split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in text and "Exchange hashpartitioning" not in text and "Exchange rangepartitioning" not in text
    assert "SelectedBucketsCount: 8 out of 8" in plan_text(enriched, "formatted") or "Bucketed: true" in plan_text(enriched, "formatted")
    assert "BroadcastHashJoin" in text  # the heavy orders' headers, fewer than the share


def test_new_headers_leave_the_lines_alone(spark, store, tmp_path):
    detail, master, customer, item = skewed(spark)
    s = store(detail, master, customer, item, share=100)
    before = sorted(p.name for p in (tmp_path / "store" / "light_lines").iterdir())
    later = master.withColumn("branch", F.lit("moved"))
    s.write_headers(later, customer)
    want = build_enriched(detail, later, customer, item)
    assert rows(s.enriched(), want.columns) == rows(want)
    assert sorted(p.name for p in (tmp_path / "store" / "light_lines").iterdir()) == before


def test_a_new_session_attaches(spark, store):
    inputs = skewed(spark, 300)
    s = store(*inputs, share=10)
    want = rows(build_enriched(*inputs), build_enriched(*inputs).columns)
    s.drop()
    s.attach()
    assert rows(s.enriched(), build_enriched(*inputs).columns) == want
    assert "Exchange hashpartitioning" not in plan_text(s.enriched(), "simple")


def test_whole_tables_and_empty_ones(spark, store, standins, enriched):
    s = store(standins.sor_detail, standins.sor_master, standins.ar_customer, standins.inv_master)
    assert rows(s.enriched(), enriched.columns) == rows(enriched)
    assert spark.read.parquet(f"{s.folder}/heavy_orders").count() == 0
    e = store(*(t.limit(0) for t in (standins.sor_detail, standins.sor_master, standins.ar_customer, standins.inv_master)))
    assert e.enriched().collect() == []
