"""Price history nested per item, as ordered JSON arrays of bounded size.

The reference puts all changes of an item into one array, newest first. One item may hold a third of all
changes, so here an item's array comes in numbered chunks of at most ``chunk_rows`` changes; their
concatenation is the reference's array, and an item without changes has the single chunk ``[]``.

The changes are numbered in two levels, without one task ever holding an item (``numbering``). They then meet
by (item, chunk), a group of bounded size, and become one ``to_json`` text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.operators.numbering import numbered_in_group
from orderlens.operators.stock import TOP_ITEMS, top_items, top_stock
from orderlens.plans.broadcast import bounded

CHUNK_ROWS = 1000

# The five JSON fields of a change (name, source column), in the reference's order.
CHANGE_FIELDS = (("priceCode", "price_code"), ("dateChanged", "date_changed"), ("timeChanged", "time_changed"),
                 ("newPrice", "new_selling_price"), ("oldPrice", "old_selling_price"))


def _newest_first():
    # SQL DESC: NULL dates first; the other fields make the order total
    return [F.col("date_changed").desc_nulls_first(), F.col("time_changed").desc_nulls_first(),
            *[F.col(c).asc_nulls_last() for c in ("price_code", "new_selling_price", "old_selling_price")]]


def numbered_changes(history: DataFrame, scratch: str, runs: int | None = None) -> DataFrame:
    """The changes with ``position``, from 0, newest first within their item (see ``numbered_in_group``)."""
    return numbered_in_group(history.select("stock_code", *[c for _, c in CHANGE_FIELDS]), "stock_code", _newest_first(), scratch, runs)


def price_history_json(history: DataFrame, items: DataFrame, scratch: str, chunk_rows: int = CHUNK_ROWS,
                       runs: int | None = None) -> DataFrame:
    """stock_code, chunk, n_changes, price_history of every distinct item of ``items`` (stock_code): the
    changes as a JSON array, newest first, NULL fields as null; ``[]`` in chunk 0 for an item without any. Changes of items that are not asked for do not appear; a NULL code finds nothing."""
    wanted = items.select("stock_code").distinct()
    own = history.join(wanted, "stock_code", "left_semi")
    change = F.struct(*[F.col(source).alias(name) for name, source in CHANGE_FIELDS])
    chunks = (numbered_changes(own, scratch, runs)
              .groupBy("stock_code", F.floor(F.col("position") / chunk_rows).cast("long").alias("chunk"))
              .agg(F.count(F.lit(1)).alias("n_changes"), F.array_sort(F.collect_list(F.struct("position", change.alias("change")))).alias("_c"))
              .select("stock_code", "chunk", "n_changes", F.to_json(F.transform("_c", lambda c: c["change"]), {"ignoreNullFields": "false"}).alias("price_history")))
    return wanted.join(chunks, "stock_code", "left").select(
        "stock_code", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("n_changes", F.lit(0)).alias("n_changes"),
        F.coalesce("price_history", F.lit("[]")).alias("price_history"))


def top_stock_with_history(detail: DataFrame, item: DataFrame, warehouse: DataFrame, price: DataFrame, history: DataFrame,
                           scratch: str, n: int = TOP_ITEMS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The reference's whole top-stock answer: ``top_stock`` with the price history of each item, a row for each
    chunk of it (one for most items, and for those without changes)."""
    keys = bounded(top_items(detail, n).select("stock_code").distinct(), n)
    chunks = price_history_json(history, keys, scratch, chunk_rows)
    top = top_stock(detail, item, warehouse, price, n)
    return top.join(chunks, "stock_code", "left").withColumn("chunk", F.coalesce("chunk", F.lit(0))).withColumn(
        "n_changes", F.coalesce("n_changes", F.lit(0))).withColumn("price_history", F.coalesce("price_history", F.lit("[]")))
