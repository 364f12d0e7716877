"""Builders for small hand-written tables in the reference's shape."""

from __future__ import annotations

import datetime as dt
import re

DETAIL = ("invoice string, sales_order string, sales_order_line int, line_type string, "
          "stock_code string, stock_description string, warehouse string, order_qty double, "
          "ship_qty double, back_order_qty double, line_ship_date date, price double, "
          "product_class string")
MASTER = ("sales_order string, invoice_number string, order_status string, customer string, "
          "salesperson string, order_date date, branch string, area string, req_ship_date date, "
          "customer_name string, ship_addr1 string, ship_addr2 string, ship_addr3 string, "
          "ship_addr4 string, ship_addr5 string, postal_code string")
CUSTOMER = "customer string, short_name string, master_account string"
ITEM = "stock_code string, description string, supplier string, product_class string"
WAREHOUSE = "stock_code string, warehouse string, qty_on_hand bigint"
PRICE = "stock_code string, price_code string, selling_price decimal(18,2)"
HISTORY = ("stock_code string, price_code string, date_changed date, time_changed int, "
           "new_selling_price double, old_selling_price double")
CLASSES = "branch string, product_class string, description string"


def _names(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in re.split(r",(?![^(]*\))", schema)]


def frame(spark, schema: str, rows: list[dict]):
    names = _names(schema)
    for r in rows:
        unknown = set(r) - set(names)
        assert not unknown, unknown
    data = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(data, schema)


def d(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def line(sales_order="1", stock_code="S1", qty=1.0, line_no=1, product_class="PC", **kw) -> dict:
    row = dict(invoice=f"{sales_order}-I", sales_order=sales_order, sales_order_line=line_no,
               stock_code=stock_code, stock_description=f"desc {stock_code}", order_qty=qty,
               product_class=product_class)
    row.update(kw)
    return row


def header(sales_order="1", invoice_number="10", order_date="2024-01-15", branch="B1",
           customer="C1", **kw) -> dict:
    row = dict(sales_order=sales_order, invoice_number=invoice_number, order_status="1",
               customer=customer, salesperson="SP1",
               order_date=d(order_date) if order_date else None, branch=branch, area="A1")
    row.update(kw)
    return row
