"""The filter options as a maintained dictionary.

The reference caches its option lists, since each costs a scan. Here every option is stored with how many lines have it.
Counts can be added and taken away, so the dictionary follows the table: ``update_from_snapshots`` finds the months
whose lines differ between two snapshots of the lines, reads only these from both, and adds the difference. An
option whose last line is gone goes with it.

``option_lists`` gives the options as arrays, as the reference returns them, in numbered chunks of bounded size:
a dimension may have millions of values, which no row or task should hold together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.dates import month_start
from orderlens.functions.text import non_empty
from orderlens.operators.numbering import numbered_in_group
from orderlens.operators.options import DIMENSIONS
from orderlens.operators.rollup import month_fingerprints

CHUNK_VALUES = 10_000


def dictionary(lines: DataFrame) -> DataFrame:
    """dimension, value, n_lines of every option; NULL and empty values are no options. One scan, one Expand,
    combined on the map side."""
    long = lines.select(*DIMENSIONS).unpivot(ids=[], values=list(DIMENSIONS), variableColumnName="dimension", valueColumnName="value")
    return long.where(non_empty("value")).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n_lines"))


def apply_counts(known: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The dictionary ``known`` with the counts of two others added and taken away; options without lines go."""
    minus = removed.withColumn("n_lines", -F.col("n_lines"))
    total = known.unionByName(added).unionByName(minus).groupBy("dimension", "value").agg(F.sum("n_lines").alias("n_lines"))
    return total.where("n_lines > 0")


def changed_months(old: DataFrame, new: DataFrame) -> list:
    """Months (None for undated lines) whose lines differ between two snapshots, by their fingerprints: one narrow
    scan of each, one row a month."""
    a, b = ({r.month: (r.n_lines, r.checksum) for r in month_fingerprints(df).collect()} for df in (old, new))
    return sorted((m for m in a.keys() | b.keys() if a.get(m) != b.get(m)), key=lambda m: (m is None, m))


def _of_months(lines: DataFrame, months: list) -> DataFrame:
    dated = [F.lit(m) for m in months if m is not None]
    month = F.col("order_month") if "order_month" in lines.columns else month_start("order_date")  # prunes folders
    keep = month.isin(dated) if dated else F.lit(False)
    return lines.where(keep | F.col("order_date").isNull() if None in months else keep)


def update_from_snapshots(known: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The dictionary of ``new`` from that of ``old``, reading only the months that differ."""
    months = changed_months(old, new)
    if not months:
        return known
    return apply_counts(known, dictionary(_of_months(new, months)), dictionary(_of_months(old, months)))


def option_lists(known: DataFrame, scratch: str, chunk_values: int = CHUNK_VALUES, runs: int | None = None) -> DataFrame:
    """dimension, chunk, n_values, values: the sorted options of each dimension, ``chunk_values`` to an array. A
    dimension without options has the single chunk of an empty array. ``scratch``: see ``numbered_in_group``."""
    numbered = numbered_in_group(known.select("dimension", "value"), "dimension", [F.col("value").asc()], scratch, runs)
    chunks = (numbered.groupBy("dimension", F.floor(F.col("position") / chunk_values).cast("long").alias("chunk"))
              .agg(F.count(F.lit(1)).alias("n_values"), F.array_sort(F.collect_list("value")).alias("values")))
    every = known.sparkSession.range(1).select(F.explode(F.array(*[F.lit(d) for d in DIMENSIONS])).alias("dimension"))
    return every.join(chunks, "dimension", "left").select(
        "dimension", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("n_values", F.lit(0)).alias("n_values"),
        F.coalesce("values", F.array().cast("array<string>")).alias("values"))
