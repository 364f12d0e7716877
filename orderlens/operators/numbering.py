"""Numbers of rows in the order of their group, without one task ever holding a group.

``row_number`` over a group sorts the whole group in one task. Here the order is made in two levels:

1. all rows are range-partitioned and sorted by (group, order), which gives runs: what one partition holds of one
   group. The sort key ends in an arbitrary number, so even equal rows spread over partitions;
2. each run is counted, and the counts before it in its group (a window over runs, not over rows) place its
   first row. A row's number is that plus its place in the run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_in_group(df: DataFrame, group: str, order: Sequence[Column], scratch: str, runs: int | None = None) -> DataFrame:
    """``df`` with ``position``, from 0, in ``order`` within its ``group`` (NULL is a group). Equal rows get any of
    their numbers. ``scratch`` is a folder on shared storage: the sorted runs are written there once, so that every
    reader sees the same numbers. ``runs`` is how many range partitions to cut (the session's shuffle partitions by
    default)."""
    spark = df.sparkSession
    by = [F.col(group).asc_nulls_last(), *order, F.col("_copy")]
    n = runs or int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = df.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by).drop("_copy")
    # ids ascend by one along a sorted partition, whose number is in the high bits
    run.withColumn("_id", F.monotonically_increasing_id()).withColumn("_run", F.spark_partition_id()).write.mode("overwrite").parquet(scratch)
    stored = spark.read.parquet(scratch)
    runs_of = stored.groupBy(group, "_run").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs_of.select(F.col(group).alias("_group"), F.col("_run").alias("_of"), "_first",
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = stored.join(placed, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_run") == F.col("_of")))
    return joined.select(*df.columns, (F.col("_before") + F.col("_id") - F.col("_first")).alias("position"))
