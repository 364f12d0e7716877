"""The enriched order-line table: every line with its first order header, the
header's customer and the item master description.

Plan shape:

* first header per order: ``row_number() == 1`` over ``sales_order`` plans as a
  partial ``WindowGroupLimit`` before the shuffle, so a hot order with many
  header rows sends at most one row per map task;
* lines are joined to the items first, while they are narrow, then to the
  headers with their customers: the wide row is built by the last join and
  never shuffled;
* with ``scratch`` (a folder), the headers, customers and items made unique are
  written there and read back. Every join then has a plain shuffle on both
  sides, which is what AQE needs to split a hot order, item or customer. Without
  it their de-duplication shares the join's shuffle, one less, but a hot key
  stays in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlens.sources.snapshots import CODEC, shuffles_freed

# Columns of the reference's enriched table, in its order. Optional ones are
# carried when the inputs have them.
DETAIL_COLUMNS = (
    "invoice", "sales_order", "sales_order_line", "line_type", "stock_code",
    "stock_description", "warehouse", "order_qty", "ship_qty", "back_order_qty",
    "line_ship_date", "price", "product_class", "buying_group", "tariff_code", "contract",
)
HEADER_COLUMNS = (
    "customer", "salesperson", "order_date", "branch", "area", "customer_po_number",
    "req_ship_date", "customer_name", "cash_credit", "currency", "ship_addr1",
    "ship_addr2", "ship_addr3", "ship_addr4", "ship_addr5", "postal_code",
)
CUSTOMER_COLUMNS = ("short_name", "master_account")


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per ``key``: the first in ``order`` (a total order is advised).

    ``row_number`` + ``== 1`` is planned as partial and final
    ``WindowGroupLimit`` around the shuffle, so per-key volume is reduced on
    the map side.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def _present(df: DataFrame, names: Sequence[str]) -> list[str]:
    cols = set(df.columns)
    return [n for n in names if n in cols]


def dedupe_dimension(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A dimension made unique on ``key`` by a fixed rule (lowest values first).

    The reference joins its item master and customer table without keys, so a
    duplicated code would silently multiply lines; here it is reduced to one
    row. The window shares the join's shuffle on ``key``.
    """
    cols = [c for c in columns if c != key]
    ordered = [F.col(c).asc_nulls_last() for c in cols]
    return first_per_key(df.select(key, *cols), key, ordered or [F.col(key)])


def duplicate_keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts (a data check;
    ``build_enriched`` reduces such keys to one row by rule). One partial/
    final count, so a hot key costs nothing extra."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def first_headers(master: DataFrame) -> DataFrame:
    """First header row per sales order by invoice number (text order, NULLs
    last); remaining header columns break ties so the result is deterministic."""
    cols = _present(master, HEADER_COLUMNS)
    order = [F.col("invoice_number").asc_nulls_last()] + [F.col(c).asc_nulls_last() for c in cols]
    return first_per_key(master.select("sales_order", "invoice_number", *cols), "sales_order", order).drop(
        "invoice_number"
    )


def build_enriched(detail: DataFrame, master: DataFrame, customer: DataFrame,
                   item: DataFrame, scratch: str | None = None) -> DataFrame:
    """Lines ⟕ item master ⟕ (first header per order ⟕ customer).

    ``stock_description`` prefers the item master's description over the
    line's own text. Row count equals the line count.
    """
    def stored(df: DataFrame, name: str) -> DataFrame:
        if scratch is None:
            return df
        path = f"{scratch.rstrip('/')}/{name}"
        with shuffles_freed(df.sparkSession):
            df.write.mode("overwrite").option("compression", CODEC).parquet(path)
        return df.sparkSession.read.parquet(path)

    headers = stored(first_headers(master), "headers")
    cust = stored(dedupe_dimension(customer, "customer", _present(customer, CUSTOMER_COLUMNS)), "customers")
    headers = stored(headers.join(cust, "customer", "left"), "headers_with_customers")
    items = stored(dedupe_dimension(item, "stock_code", ["description"]), "items")
    return _join_sides(detail, headers, items)


def enriched_from(spark: SparkSession, detail: DataFrame, scratch: str) -> DataFrame:
    """``build_enriched`` again from the sides that an earlier call stored in ``scratch``."""
    headers, items = (spark.read.parquet(f"{scratch.rstrip('/')}/{t}") for t in ("headers_with_customers", "items"))
    return _join_sides(detail, headers, items)


def _join_sides(detail: DataFrame, headers: DataFrame, items: DataFrame) -> DataFrame:
    names = _present(detail, DETAIL_COLUMNS)
    items = items.withColumnRenamed("description", "_item_description")
    text = F.coalesce("_item_description", "stock_description").alias("stock_description")
    # one description a line goes on to the header join, not both
    described = detail.select(*names).join(items, "stock_code", "left").select(*[text if c == "stock_description" else F.col(c) for c in names])
    joined = described.join(headers, "sales_order", "left")
    return joined.select(*names, *_present(headers, HEADER_COLUMNS + CUSTOMER_COLUMNS))
