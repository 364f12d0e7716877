"""Reference-shaped tables derived from the TPC-H-like test tables.

The reference reads ERP extracts (order headers, order lines, customers, item
master, warehouses, prices, price history, product classes). The test data
has other names and columns, so each reference table is derived here with
DataFrame operations over the given parquet tables. Each view carries a
deliberate imperfection, chosen from data attributes, so the left joins,
NULL handling and fan-out of the reference are exercised:

* ``ar_customer``: customers with an account balance in [0, 500) have another
  spelling of their code (``X`` before it), so their orders find none; a
  negative balance gives a NULL master account.
* ``sor_master``: one header row per (order, return flag) => several
  "invoices" per order; status ``O`` is mapped to ``1``, ``P`` has no label.
* ``sor_detail``: size-50 parts have a NULL product class, size-49 parts a
  blanks-only one.
* ``inv_master``: the parts of the five smallest sizes have another spelling.
* ``inv_warehouse``: one row per (part, return flag) => up to 3 warehouses.
* ``inv_price``: prices ``A`` and ``B`` for every part, ``B`` under another
  spelling for sizes up to 16 => one or two prices per item (the fan-out case).
* ``inv_price_history``: every line, as a price change.
* ``sal_product_class``: one row per (region, brand) for the regions of the
  nations whose key equals a part size of that brand; brands ending in 4 have
  another spelling, brands ending in 2 a NULL description.

No view leaves out a row of its base table. The oracle SQL in
``__spark_entry__.py`` defines the same views for DuckDB.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _text(c: str):
    return F.col(c).cast("string")


def _respelt(code, where):
    """The code, with an ``X`` before it where the condition holds."""
    return F.when(where, F.concat(F.lit("X"), code)).otherwise(code)


class StandIns:
    """Lazily built stand-in views over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def ar_customer(self) -> DataFrame:
        c = self.base("customer")
        low = (F.col("c_acctbal") >= 0) & (F.col("c_acctbal") < 500)
        return c.select(
            _respelt(_text("c_custkey"), low).alias("customer"),
            F.col("c_mktsegment").alias("short_name"),
            F.when(F.col("c_acctbal") < 0, F.lit(None).cast("string"))
            .otherwise(F.col("c_name"))
            .alias("master_account"),
        )

    @cached_property
    def sor_master(self) -> DataFrame:
        o = self.base("orders")
        c = self.base("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
        n = self.base("nation").select("n_nationkey", "n_name", "n_regionkey")
        r = self.base("region").select("r_regionkey", "r_name")
        invoices = (
            self.base("lineitem")
            .groupBy("l_orderkey", "l_returnflag")
            .agg(F.min("l_shipdate").cast("date").alias("req_ship_date"))
        )
        joined = (
            o.join(c, o.o_custkey == c.c_custkey)
            .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            # by the text that is the order: what takes headers of an order together needs no second shuffle
            .join(invoices, _text("o_orderkey") == _text("l_orderkey"), "left")
        )
        null_text = F.lit(None).cast("string")
        return joined.select(
            _text("o_orderkey").alias("sales_order"),
            F.concat(_text("o_orderkey"), F.lit("-"), F.coalesce("l_returnflag", F.lit("X"))).alias(
                "invoice_number"
            ),
            F.when(F.col("o_orderstatus") == "O", F.lit("1"))
            .otherwise(F.col("o_orderstatus"))
            .alias("order_status"),
            _text("o_custkey").alias("customer"),
            F.col("o_orderpriority").alias("salesperson"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            F.col("r_name").alias("branch"),
            F.col("n_name").alias("area"),
            F.col("req_ship_date"),
            F.col("c_name").alias("customer_name"),
            F.col("c_name").alias("ship_addr1"),
            null_text.alias("ship_addr2"),
            F.col("n_name").alias("ship_addr3"),
            F.col("r_name").alias("ship_addr4"),
            null_text.alias("ship_addr5"),
            F.when(F.col("c_acctbal") < 0, null_text)
            .otherwise(_text("c_nationkey"))
            .alias("postal_code"),
        )

    @cached_property
    def sor_detail(self) -> DataFrame:
        li = self.base("lineitem")
        p = self.base("part").select("p_partkey", "p_type", "p_size", "p_brand")
        shipped = F.col("l_linestatus") == "F"
        # joined by the text that is the stock code: a join by stock code that follows needs no second shuffle
        return li.join(p, _text("l_partkey") == _text("p_partkey")).select(
            F.concat(_text("l_orderkey"), F.lit("-"), F.col("l_returnflag")).alias("invoice"),
            _text("l_orderkey").alias("sales_order"),
            F.col("l_linenumber").alias("sales_order_line"),
            F.col("l_linestatus").alias("line_type"),
            _text("l_partkey").alias("stock_code"),
            F.col("p_type").alias("stock_description"),
            F.col("l_returnflag").alias("warehouse"),
            F.col("l_quantity").alias("order_qty"),
            F.when(shipped, F.col("l_quantity")).otherwise(F.lit(0.0)).alias("ship_qty"),
            F.when(shipped, F.lit(0.0)).otherwise(F.col("l_quantity")).alias("back_order_qty"),
            F.col("l_shipdate").cast("date").alias("line_ship_date"),
            F.col("l_extendedprice").alias("price"),
            F.when(F.col("p_size") == 50, F.lit(None).cast("string"))
            .when(F.col("p_size") == 49, F.lit("  "))
            .otherwise(F.col("p_brand"))
            .alias("product_class"),
        )

    @cached_property
    def inv_master(self) -> DataFrame:
        return self.base("part").select(
            _respelt(_text("p_partkey"), F.col("p_size") <= 5).alias("stock_code"),
            F.col("p_name").alias("description"),
            F.col("p_type").alias("supplier"),
            F.col("p_brand").alias("product_class"),
        )

    @cached_property
    def inv_warehouse(self) -> DataFrame:
        return (
            self.base("lineitem")
            .groupBy("l_partkey", "l_returnflag")
            .agg(F.sum("l_quantity").cast("bigint").alias("qty_on_hand"))
            .select(
                _text("l_partkey").alias("stock_code"),
                F.col("l_returnflag").alias("warehouse"),
                "qty_on_hand",
            )
        )

    @cached_property
    def inv_price(self) -> DataFrame:
        p = self.base("part")
        price_a = p.select(
            _text("p_partkey").alias("stock_code"),
            F.lit("A").alias("price_code"),
            F.col("p_retailprice").cast("decimal(18,2)").alias("selling_price"),
        )
        price_b = p.select(
            _respelt(_text("p_partkey"), F.col("p_size") <= 16).alias("stock_code"),
            F.lit("B").alias("price_code"),
            (F.col("p_retailprice") * 0.5).cast("decimal(18,2)").alias("selling_price"),
        )
        return price_a.unionByName(price_b)

    @cached_property
    def inv_price_history(self) -> DataFrame:
        return self.base("lineitem").select(
            _text("l_partkey").alias("stock_code"),
            F.col("l_returnflag").alias("price_code"),
            F.col("l_shipdate").cast("date").alias("date_changed"),
            F.col("l_linenumber").alias("time_changed"),
            F.col("l_extendedprice").alias("new_selling_price"),
            (F.col("l_extendedprice") * (1 - F.col("l_tax"))).alias("old_selling_price"),
        )

    @cached_property
    def sal_product_class(self) -> DataFrame:
        brands = self.base("part").select("p_brand", "p_size").distinct()
        n = self.base("nation").select("n_nationkey", "n_regionkey")
        r = self.base("region").select("r_regionkey", "r_name")
        pairs = (
            brands.join(n, brands.p_size == n.n_nationkey)
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("r_name", "p_brand")
            .distinct()
        )
        return pairs.select(
            F.col("r_name").alias("branch"),
            _respelt(F.col("p_brand"), F.col("p_brand").endswith("4")).alias("product_class"),
            F.when(F.col("p_brand").endswith("2"), F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("Class "), F.col("p_brand"), F.lit(" "), F.col("r_name")))
            .alias("description"),
        )
