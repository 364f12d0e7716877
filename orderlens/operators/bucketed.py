"""The header join without a shuffle of the lines: bucketed storage, heavy orders apart.

Lines bucketed by order join their headers bucket by bucket, with no exchange on either side. What spoils that
is an order with a large share of all lines: its bucket is one task, and a bucketed scan leaves no shuffle for
adaptive execution to split. So the orders are told apart when the lines are stored:

* ``heavy_orders`` finds them with a frequent-items sketch (``approx_top_k``: one mergeable aggregate of bounded
  size) and counts the candidates exactly. An order is heavy when more than 1 / ``SHARE`` of the lines have it,
  so fewer than ``SHARE`` are;
* light lines are stored bucketed and sorted by order. Since no light order is large, neither is a bucket;
* heavy lines are stored as they come, in files of any number, and join the heavy orders' headers, which are
  fewer than ``SHARE`` rows and therefore broadcast: the lines of one order stay spread over all tasks.

The lines are stored with their item description, since that join has another key. When headers or customers
change, only the header side is stored anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.operators.enrich import (
    CUSTOMER_COLUMNS,
    DETAIL_COLUMNS,
    HEADER_COLUMNS,
    _present,
    dedupe_dimension,
    first_headers,
)
from orderlens.plans.broadcast import bounded

SHARE = 1000
# Items the sketch tracks. Any order with more than 1 / (0.75 * TRACKED) of the lines is among them.
TRACKED = 16_384
KEY = "sales_order"


def heavy_orders(detail: DataFrame, share: int = SHARE) -> DataFrame:
    """``sales_order`` and its count ``n`` of every order that more than 1 / ``share`` of the lines have
    (fewer than ``share`` rows). Exact: the sketch names candidates, a second pass counts them."""
    lines = detail.where(F.col(KEY).isNotNull()).select(KEY)
    top = lines.agg(F.expr(f"approx_top_k({KEY}, {share}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("total"))
    candidates = bounded(top.select(F.explode("top").alias("c"), "total").select(F.col("c.item").alias(KEY), "total"), share)
    counted = lines.join(candidates, KEY).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("total"))
    return counted.where(F.col("n") * share > F.col("total")).select(KEY, "n")


class BucketedStore:
    """Lines and headers under ``folder`` (shared storage), bucketed by order into ``buckets``. The light lines and
    the headers are tables of the session's catalog with names that begin with ``name``: a bucketed layout is
    known to Spark through the catalog only. ``attach`` registers them again in a new session."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, name: str = "orderlens"):
        if buckets < 1:
            raise ValueError("at least one bucket")
        self.spark, self.folder, self.buckets, self.name = spark, folder.rstrip("/"), buckets, name

    def _table(self, part: str) -> str:
        return f"{self.name}_{part}"

    def _write_bucketed(self, df: DataFrame, part: str) -> None:
        # dealt by the buckets' own hash first, so that each bucket is one file
        (df.repartition(self.buckets, KEY).write.mode("overwrite").format("parquet").option("path", f"{self.folder}/{part}")
         .bucketBy(self.buckets, KEY).sortBy(KEY).saveAsTable(self._table(part)))

    def write_lines(self, detail: DataFrame, item: DataFrame, share: int = SHARE) -> None:
        """Stores the lines with their item description: light ones bucketed, heavy ones beside them."""
        heavy_orders(detail, share).write.mode("overwrite").parquet(f"{self.folder}/heavy_orders")
        heavy = self._heavy(share)
        names = _present(detail, DETAIL_COLUMNS)
        items = dedupe_dimension(item, "stock_code", ["description"]).withColumnRenamed("description", "_item_description")
        text = F.coalesce("_item_description", "stock_description").alias("stock_description")

        def described(lines: DataFrame) -> DataFrame:
            return lines.select(*names).join(items, "stock_code", "left").select(*[text if c == "stock_description" else F.col(c) for c in names])

        # told apart first: each line is shuffled to its item once, as a light or a heavy one
        self._write_bucketed(described(detail.join(heavy, KEY, "left_anti")), "light_lines")
        described(detail.join(heavy, KEY, "left_semi")).write.mode("overwrite").parquet(f"{self.folder}/heavy_lines")

    def write_headers(self, master: DataFrame, customer: DataFrame) -> None:
        """Stores the first header of each order with its customer, bucketed like the lines."""
        cust = dedupe_dimension(customer, "customer", _present(customer, CUSTOMER_COLUMNS))
        self._write_bucketed(first_headers(master).join(cust, "customer", "left"), "headers")

    def _heavy(self, share: int = SHARE) -> DataFrame:
        return bounded(self.spark.read.parquet(f"{self.folder}/heavy_orders").select(KEY), share)

    def attach(self) -> None:
        """Registers the stored tables in this session's catalog."""
        for part in ("light_lines", "headers"):
            schema = self.spark.read.parquet(f"{self.folder}/{part}").schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            self.spark.sql(f"create table if not exists {self._table(part)} ({columns}) using parquet "
                           f"clustered by ({KEY}) sorted by ({KEY}) into {self.buckets} buckets location '{self.folder}/{part}'")

    def drop(self) -> None:
        """Takes the tables out of the catalog; the files stay."""
        for part in ("light_lines", "headers"):
            self.spark.sql(f"drop table if exists {self._table(part)}")

    def enriched(self) -> DataFrame:
        """The enriched lines, as ``build_enriched`` gives them. Light lines meet their headers without an
        exchange; a NULL order is light and finds none."""
        headers = self.spark.table(self._table("headers"))
        light = self.spark.table(self._table("light_lines"))
        heavy = self.spark.read.schema(light.schema).parquet(f"{self.folder}/heavy_lines")
        out = [*_present(light, DETAIL_COLUMNS), *_present(headers, HEADER_COLUMNS + CUSTOMER_COLUMNS)]
        few = bounded(headers.join(self._heavy(), KEY, "left_semi"), SHARE)
        # the hint keeps small tables from being broadcast: their layout makes the merge join free
        return (light.join(headers.hint("merge"), KEY, "left").select(*out)
                .unionByName(heavy.join(few, KEY, "left").select(*out)))
