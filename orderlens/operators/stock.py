"""Top ordered stock items with item, warehouse, price and price-history detail.

Plan: one partial/final aggregate of the order lines per (item, description);
``orderBy(...).limit(n)`` becomes a ``TakeOrderedAndProject`` (each task
keeps n rows); the n keys are broadcast (bounded by n) and every dimension is
*semi-joined* to them before it is aggregated, so whole dimensions are never
shuffled for n rows. Each dimension is pre-aggregated per item and then
left-joined, which replaces the reference's join fan-out and correlated
subquery.

The reference's ``SUM(QtyOnHand)`` runs after joining the item master,
warehouses *and* prices and grouping by the item master's description,
supplier and class, so it equals the true warehouse sum times the number of
price rows (1 when none) times the number of identical item-master rows in
that group (1 when none). ``total_qty_on_hand`` reproduces that number from
per-item aggregates; ``qty_on_hand`` is the plain warehouse sum. An item with
several *different* item-master rows yields one row per variant, as in the
reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.text import sql_number_text
from orderlens.plans.broadcast import bounded

# Fixed value: the reference lists the 30 most ordered items.
TOP_ITEMS = 30


def item_totals(detail: DataFrame) -> DataFrame:
    return detail.groupBy("stock_code", "stock_description").agg(
        F.sum("order_qty").alias("total_order_qty")
    )


def top_items(detail: DataFrame, n: int = TOP_ITEMS) -> DataFrame:
    """The n (item, line description) groups with the largest ordered quantity.

    SQL ``DESC`` puts NULL totals first; code then description break ties.
    """
    return item_totals(detail).orderBy(
        F.col("total_order_qty").desc_nulls_first(),
        F.col("stock_code").asc_nulls_last(),
        F.col("stock_description").asc_nulls_last(),
    ).limit(n)


def _distinct_text(col: str) -> Column:
    """Distinct non-NULL values joined by ', ' in code-point order; NULL if none
    (SQL ``STRING_AGG(DISTINCT …)``). ``collect_set`` is an ordinary partial/
    final aggregate – one shuffle – unlike a DISTINCT aggregate, which Spark
    rewrites into an Expand and two shuffles. The set holds one item's
    distinct warehouse or price strings."""
    values = F.array_sort(F.collect_set(col))
    return F.when(F.size(values) > 0, F.array_join(values, ", "))


def warehouse_summary(warehouse: DataFrame) -> DataFrame:
    """Per item: ``'<warehouse>: <qty>'`` list, warehouse row count, quantity sum."""
    qty_text = sql_number_text("qty_on_hand", warehouse.schema["qty_on_hand"].dataType)
    w = warehouse.withColumn("_wq", F.concat(F.col("warehouse"), F.lit(": "), qty_text))
    return w.groupBy("stock_code").agg(
        _distinct_text("_wq").alias("warehouse_qty"),
        F.sum("qty_on_hand").alias("qty_on_hand"),
    )


def price_summary(price: DataFrame) -> DataFrame:
    """Per item: ``'<code>: $<price>'`` list and the number of price rows."""
    price_text = sql_number_text("selling_price", price.schema["selling_price"].dataType)
    p = price.withColumn("_pd", F.concat(F.col("price_code"), F.lit(": $"), price_text))
    return p.groupBy("stock_code").agg(
        _distinct_text("_pd").alias("price_details"),
        F.count(F.lit(1)).alias("price_rows"),
    )


def _fan_out_qty(qty: Column, price_rows: Column, item_rows: Column | None = None) -> Column:
    """Warehouse sum as the reference's item×warehouse×price join counts it."""
    factor = F.greatest(F.coalesce(price_rows, F.lit(0)), F.lit(1))
    if item_rows is not None:
        factor = factor * F.greatest(F.coalesce(item_rows, F.lit(0)), F.lit(1))
    return qty * factor


def stock_details(warehouse: DataFrame, price: DataFrame) -> DataFrame:
    """Warehouse and price detail for every item present in either table.

    Both sides are aggregated on ``stock_code``, so the full outer join reuses
    that partitioning (no further shuffle).
    """
    w, p = warehouse_summary(warehouse), price_summary(price)
    return w.join(p, "stock_code", "full").select(
        "stock_code",
        "warehouse_qty",
        "price_details",
        "qty_on_hand",
        F.coalesce("price_rows", F.lit(0)).cast("bigint").alias("price_rows"),
        _fan_out_qty(F.col("qty_on_hand"), F.col("price_rows")).alias("total_qty_on_hand"),
    )


def top_stock(detail: DataFrame, item: DataFrame, warehouse: DataFrame, price: DataFrame,
              n: int = TOP_ITEMS) -> DataFrame:
    """Columns: stock_code, description, total_order_qty, supplier,
    product_class, warehouse_qty, price_details, total_qty_on_hand (the
    reference's fan-out number, 0 when none), qty_on_hand (plain sum, 0 when
    none). Ordered by total_order_qty desc, then code, description, supplier,
    class. Only the n keys are broadcast-hinted.

    The description prefers the line's text over the item master's (the
    opposite of the enriched table, as in the reference).
    """
    top = top_items(detail, n)
    keys = bounded(top.select("stock_code"), n)
    # item-master variants of the n items, with how many identical rows each has
    items = (
        item.join(keys, "stock_code", "left_semi")
        .groupBy("stock_code", "description", "supplier", "product_class")
        .agg(F.count(F.lit(1)).alias("item_rows"))
    )
    wh = warehouse_summary(warehouse.join(keys, "stock_code", "left_semi"))
    pr = price_summary(price.join(keys, "stock_code", "left_semi"))
    joined = (
        top.join(items, "stock_code", "left")
        .join(wh, "stock_code", "left")  # text of any width: AQE broadcasts by measured size
        .join(pr, "stock_code", "left")
    )
    return joined.select(
        "stock_code",
        F.coalesce("stock_description", "description").alias("description"),
        F.col("total_order_qty").cast("double").alias("total_order_qty"),
        "supplier",
        "product_class",
        "warehouse_qty",
        "price_details",
        F.coalesce(_fan_out_qty(F.col("qty_on_hand"), F.col("price_rows"), F.col("item_rows")), F.lit(0))
        .cast("double").alias("total_qty_on_hand"),
        F.coalesce(F.col("qty_on_hand"), F.lit(0)).cast("double").alias("qty_on_hand"),
    ).orderBy(
        F.col("total_order_qty").desc_nulls_first(),
        *[F.col(c).asc_nulls_last() for c in ("stock_code", "description", "supplier", "product_class")],
    )


def price_history(history: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Price changes per item, newest first (SQL ``DESC``: NULL dates first).

    Long form – one row per change with the reference's five fields – sorted
    by item and change order. A global sort range-partitions the rows, so even
    an item with a huge history is spread over many tasks; nothing is
    collected per item. ``keys`` (a frame with ``stock_code``) restricts the
    items, e.g. to ``top_items(...)``; it is semi-joined, never broadcast
    unless bounded by the caller.
    """
    h = history if keys is None else history.join(keys.select("stock_code"), "stock_code", "left_semi")
    return h.select(
        "stock_code",
        "price_code",
        "date_changed",
        "time_changed",
        F.col("new_selling_price").alias("new_price"),
        F.col("old_selling_price").alias("old_price"),
    ).orderBy(
        F.col("stock_code").asc_nulls_last(),
        F.col("date_changed").desc_nulls_first(),
        F.col("time_changed").desc_nulls_first(),
        F.col("price_code").asc_nulls_last(),
        F.col("new_price").asc_nulls_last(),
        F.col("old_price").asc_nulls_last(),
    )


def top_stock_price_history(detail: DataFrame, history: DataFrame, n: int = TOP_ITEMS) -> DataFrame:
    """``price_history`` of the top-n items (keys bounded by n, broadcast)."""
    return price_history(history, bounded(top_items(detail, n).select("stock_code"), n))
