"""The maintained dictionary against the options of the lines."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orderlens.operators.dictionary import apply_counts, changed_months, dictionary, option_lists, update_from_snapshots
from orderlens.operators.numbering import numbered_in_group
from orderlens.operators.options import DIMENSIONS, filter_options


@pytest.fixture(scope="module")
def lines(spark, enriched):
    some = enriched.select(*DIMENSIONS, "order_date", "order_qty", "sales_order").where("order_date < '1997-01-01'")
    return some.unionByName(some.limit(4).withColumn("order_date", F.lit(None).cast("date"))).cache()


def options(df):
    return [tuple(r) for r in df.select("dimension", "value").orderBy("dimension", "value").collect()]


def test_equals_the_options(lines):
    d = dictionary(lines)
    assert options(d) == options(filter_options(lines))
    assert d.where("dimension = 'branch'").agg(F.sum("n_lines")).first()[0] == lines.where("branch is not null and branch != ''").count()


def test_inserts_deletes_and_changes(spark, lines):
    before = dictionary(lines).cache()
    gone = (F.trunc("order_date", "MM") == F.lit(dt.date(1995, 4, 1))) | (F.col("customer") == "77")
    new = spark.createDataFrame([("MOON", "", "new customer", None, "7", dt.date(1996, 8, 9), 1.0, "x"), ("ASIA", "INDIA", None, "  ", "7", None, 1.0, "y")],
                                lines.schema)
    after = lines.where(~F.coalesce(gone, F.lit(False))).unionByName(new).cache()
    updated = update_from_snapshots(before, lines, after)
    key = lambda r: str(tuple(r))
    assert sorted(updated.collect(), key=key) == sorted(dictionary(after).collect(), key=key)
    assert options(updated) == options(filter_options(after)) and ("customer", "77") not in options(updated) and ("branch", "MOON") in options(updated)
    back = update_from_snapshots(updated, after, lines)
    assert sorted(back.collect(), key=key) == sorted(before.collect(), key=key)


def test_only_changed_months_are_read(lines):
    after = lines.withColumn("branch", F.when(F.trunc("order_date", "MM") == F.lit(dt.date(1996, 2, 1)), F.lit("Z")).otherwise(F.col("branch")))
    assert changed_months(lines, after) == [dt.date(1996, 2, 1)]
    undated = after.withColumn("area", F.when(F.col("order_date").isNull(), F.lit("Q")).otherwise(F.col("area")))
    assert changed_months(lines, undated) == [dt.date(1996, 2, 1), None]
    same = dictionary(lines)
    assert update_from_snapshots(same, lines, lines.repartition(3)) is same


@pytest.mark.parametrize("chunk", [7, 10_000])
def test_lists(lines, tmp_path, chunk):
    got = option_lists(dictionary(lines), f"{tmp_path}/runs", chunk, 5).collect()
    want = {}
    for d, v in options(filter_options(lines)):
        want.setdefault(d, []).append(v)
    for d in DIMENSIONS:
        mine = sorted((r for r in got if r.dimension == d), key=lambda r: r.chunk)
        assert [r.chunk for r in mine] == list(range(len(mine))) and all(len(r["values"]) == r.n_values == chunk for r in mine[:-1])
        assert [v for r in mine for v in r["values"]] == want[d]


def test_empty(lines, tmp_path):
    none = dictionary(lines.limit(0))
    assert none.collect() == [] and apply_counts(none, dictionary(lines), dictionary(lines)).collect() == []
    assert sorted(tuple(r) for r in option_lists(none, f"{tmp_path}/r").collect()) == sorted((d, 0, 0, []) for d in DIMENSIONS)


def test_numbers_of_a_group_with_a_third_of_all_rows(spark, tmp_path):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), (F.col("id") * 7919 % 1000).alias("v"))
    got = numbered_in_group(df, "g", [F.col("v").desc()], f"{tmp_path}/runs", 9).collect()
    for g in {r.g for r in got}:
        mine = sorted((r.position, r.v) for r in got if r.g == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted((v for _, v in mine), reverse=True)
    runs = [r["count"] for r in spark.read.parquet(f"{tmp_path}/runs").groupBy("_run").count().collect()]
    assert max(runs) < 700
