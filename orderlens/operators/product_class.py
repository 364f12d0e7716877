"""Ordered quantity by product class: the top five by rank plus "Others".

Semantics kept from the reference: lines with a NULL class are ignored (a
blanks-only class counts); ``RANK`` ties can put more than five classes in
the top; the remainder is emitted as "Others" only when it is positive;
percentages are shares of the grand total rounded half-to-even to 2 places
(Python ``round``), values rounded half-to-even to an integer. A real class
named "Others" stays apart from the remainder via ``is_others``.

Plan, without a single-task global window: the per-class totals are a
partial/final aggregate; ``orderBy().limit(5)`` (TakeOrderedAndProject, five
rows per task) gives the 5th value, and a class has rank <= 5 exactly when
its total is at least that value. The cut and the grand total are scalar
subqueries, the rest is another small aggregate and a left join to the class
descriptions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.numeric import half_even
from orderlens.functions.text import label_with_code

# Five ranked classes, the remainder label.
TOP_CLASSES = 5
OTHERS = "Others"


def class_totals(detail: DataFrame) -> DataFrame:
    return (
        detail.where(F.col("product_class").isNotNull())
        .groupBy("product_class")
        .agg(F.sum("order_qty").alias("total_order_qty"))
    )


def _top_flag(totals: DataFrame, n: int) -> Column:
    """True for classes whose ``RANK() OVER (ORDER BY total DESC NULLS LAST)``
    is at most n."""
    head = totals.orderBy(F.col("total_order_qty").desc_nulls_last(), F.col("product_class")).limit(n)
    cut = head.agg(
        F.struct(
            F.count(F.lit(1)).alias("rows"),
            F.count("total_order_qty").alias("valued"),
            F.min("total_order_qty").alias("value"),
        )
    ).scalar()
    # fewer than n classes, or NULL within the first n: every class ranks <= n
    return (cut["rows"] < n) | (cut["valued"] < n) | (F.col("total_order_qty") >= cut["value"])


def class_descriptions(class_lookup: DataFrame) -> DataFrame:
    """One description per class (the lookup has a row per branch × class)."""
    return class_lookup.groupBy("product_class").agg(
        F.coalesce(F.max("description"), F.lit("Unknown")).alias("description")
    )


def product_class_share(detail: DataFrame, class_lookup: DataFrame, n: int = TOP_CLASSES) -> DataFrame:
    """Columns: id, label, value (bigint), percentage (double), is_others."""
    totals = class_totals(detail)
    grand = totals.agg(F.sum("total_order_qty")).scalar()
    is_top = _top_flag(totals, n)
    grouped = (
        totals.groupBy(
            F.when(is_top, F.col("product_class")).otherwise(F.lit(OTHERS)).alias("id"),
            (~is_top).alias("is_others"),
        )
        .agg(F.sum("total_order_qty").alias("qty"))
        .where(~F.col("is_others") | (F.col("qty") > 0))
    )
    desc = class_descriptions(class_lookup)
    joined = grouped.join(
        desc, (grouped["id"] == desc["product_class"]) & ~grouped["is_others"], "left"
    )
    share = F.when(grand.isNull() | (grand == 0), F.lit(None).cast("double")).otherwise(
        F.col("qty") / grand * F.lit(100)
    )
    return joined.select(
        "id",
        F.when(F.col("is_others"), F.lit(OTHERS))
        .otherwise(label_with_code(F.coalesce("description", F.lit("Unknown")), F.col("id")))
        .alias("label"),
        half_even(F.col("qty"), 0).cast("bigint").alias("value"),
        half_even(share.cast("double"), 2).alias("percentage"),
        "is_others",
    ).orderBy(F.col("is_others"), F.col("value").desc_nulls_last(), F.col("id"))


def share_total(share: DataFrame) -> DataFrame:
    """One row: the rounded percentages summed, rounded half-to-even to 2."""
    return share.agg(half_even(F.sum("percentage"), 2).alias("total_percentage"))
