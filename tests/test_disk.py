"""What builds leave on disk while they run: no shuffle of a finished write, no second shuffle of wide rows."""

import os

import pytest
from pyspark.sql import functions as F

from orderlens.operators import rollup
from orderlens.operators.report_state import month_state, write_state
from orderlens.operators.rollup import build_rollup, rollup_count, rollup_for, rollup_trend
from orderlens.operators.detail import detail_count
from orderlens.operators.trend import order_trend
from orderlens.sources import layout
from orderlens.sources.layout import read_enriched, write_enriched
from orderlens.sources.positions import write_positions
from orderlens.sources.snapshots import FREE_SHUFFLES, OPEN_FILES, write_snapshot


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for x in folders for _, _, names in os.walk(str(x)) for f in names if f.startswith("shuffle_")}


def lines(spark, n=4000):
    day = F.date_add(F.lit("2024-01-15").cast("date"), (F.col("id") % 90).cast("int"))
    text = {c: F.concat(F.lit(c), (F.col("id") % m).cast("string")) for c, m in (("branch", 3), ("area", 7), ("customer", 50), ("product_class", 5), ("salesperson", 4))}
    return spark.range(0, n, 1, 4).select(F.col("id").cast("string").alias("sales_order"), F.when(F.col("id") % 11 != 0, day).alias("order_date"),
                                          F.when(F.col("id") % 13 != 0, (F.col("id") % 9).cast("double")).alias("order_qty"),
                                          F.col("id").cast("string").alias("stock_code"), *[c.alias(k) for k, c in text.items()])


def test_a_write_frees_its_shuffles_and_restores_the_settings(spark, tmp_path):
    settings = [spark.conf.get(k, None) for k in (FREE_SHUFFLES, OPEN_FILES)]
    before = shuffle_files(spark)
    df = lines(spark).groupBy("customer").agg(F.count(F.lit(1)).alias("n"))
    write_snapshot(df, f"{tmp_path}/t", "20240101_000000", open_files=3)
    assert shuffle_files(spark) <= before
    assert [spark.conf.get(k, None) for k in (FREE_SHUFFLES, OPEN_FILES)] == settings
    assert df.count() == 50  # the same frame can be run again


@pytest.mark.parametrize("kind", ["report_state", "rollup"])
def test_stored_structures_leave_no_shuffle_of_lines(spark, tmp_path, kind):
    before = shuffle_files(spark)
    if kind == "report_state":
        write_state(month_state(lines(spark)), f"{tmp_path}/s")
    else:
        build_rollup(lines(spark), f"{tmp_path}/s", "20240101_000000")
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    left = shuffle_files(spark) - before
    size = sum(os.path.getsize(f"{d}/{f}") for x in folders for d, _, names in os.walk(str(x)) for f in names if f in left and f.endswith(".data"))
    assert size < 20_000  # of single rows and sketches only
    assert os.listdir(tmp_path) == ["s"]  # the roll-up keeps no second copy of its groupings


def test_positions_leave_no_shuffle_of_lines(spark, enriched, tmp_path):
    some = enriched.limit(2000).cache()
    some.count()
    before = {f for f in shuffle_files(spark) if f.endswith(".data")}
    write_positions(some, f"{tmp_path}/p", "20240101_000000", block_rows=500)
    assert len({f for f in shuffle_files(spark) if f.endswith(".data")} - before) <= 1  # of the count of all rows


def test_the_enriched_rows_are_written_by_the_tasks_that_have_them(spark, tmp_path):
    """Before, all rows of a month were shuffled to one place first."""
    write_enriched(lines(spark).withColumn("task", F.spark_partition_id()), f"{tmp_path}/e", "20240101_000000")
    stored = read_enriched(spark, f"{tmp_path}/e")
    file = stored.select("*", stored.metadataColumn("_metadata")["file_path"].alias("file"))
    per_file = file.groupBy("file", "order_month").agg(F.count_distinct("task").alias("tasks"), F.count(F.lit(1)).alias("n")).collect()
    assert stored.count() == 4000 and {r.tasks for r in per_file} == {1} and len(per_file) == 4 * 5


def test_many_tasks_make_few_files_and_more_months_than_open_files_are_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "OPEN_MONTHS", 2)
    df = lines(spark).repartition(40 * spark.sparkContext.defaultParallelism, "sales_order")
    write_enriched(df, f"{tmp_path}/e", "20240101_000000")
    stored = read_enriched(spark, f"{tmp_path}/e")
    assert len(stored.inputFiles()) <= 5 * layout.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert sorted(map(str, stored.select(*df.columns).collect())) == sorted(map(str, df.collect()))


@pytest.mark.parametrize("slice_lines", [100, 1_000_000])
def test_sliced_months_give_the_same_roll_up(spark, tmp_path, monkeypatch, slice_lines):
    monkeypatch.setattr(rollup, "SLICE_LINES", slice_lines)
    df = lines(spark).cache()
    build_rollup(df, f"{tmp_path}/r", "20240101_000000")
    for shape in ({}, {"branch": "branch1"}, {"customer": "customer7", "salesperson": "salesperson3"}):
        assert [tuple(r) for r in rollup_trend(spark, f"{tmp_path}/r", shape).collect()] == [tuple(r) for r in order_trend(df, shape).collect()]
        assert rollup_count(spark, f"{tmp_path}/r", df, shape).collect() == detail_count(df, shape).collect()
    for g in rollup.read_state(spark, f"{tmp_path}/r")["groupings"]:
        got = rollup_for(spark, f"{tmp_path}/r", columns=g)
        assert got.count() == got.select("month", *g).distinct().count() and got.agg(F.sum("n_lines")).first()[0] == 4000
