"""Per-table column rules for the ERP CSV extracts.

Columns listed in ``TEXT_COLUMNS`` are always read as text (codes such as
``0012`` keep their zeros); ``DECLARED_TYPES`` fixes the numeric and date
columns the queries use; any other column's type is decided at ingest from
its values (integer, then double, else text), as a CSV reader with type
inference would.
"""

from __future__ import annotations

import re

# The reference's text-typed columns per table.
TEXT_COLUMNS: dict[str, tuple[str, ...]] = {
    "ArCustomer": (
        "Customer", "Name", "ShortName", "CustomerType", "MasterAccount", "CreditStatus",
        "Salesperson", "CustomerClass", "Branch", "Area", "StateCode", "TaxStatus", "Telephone",
        "Contact", "Fax", "Currency", "BuyingGroup1", "BuyingGroup2", "BuyingGroup3",
        "BuyingGroup4", "BuyingGroup5", "Email", "ShipToAddr1", "ShipToAddr2", "ShipToAddr3",
        "ShipToAddr4", "ShipToAddr5", "ShipPostalCode",
    ),
    "ArMultAddress": (
        "Customer", "AddrCode", "ShipToName", "ShipToAddr1", "ShipToAddr2", "ShipToAddr3",
        "ShipToAddr4", "ShipToAddr5", "ShipPostalCode", "Area", "State", "CountyZip", "City",
    ),
    "SorMasterRep": (
        "InvoiceNumber", "SalesOrder", "OrderStatus", "Customer", "Salesperson",
        "CustomerPoNumber", "Branch", "CustomerName", "Area", "CashCredit", "Currency",
        "ShipAddr1", "ShipAddr2", "ShipAddr3", "ShipAddr4", "ShipAddr5", "PostalCode",
    ),
    "SorDetailRep": (
        "Invoice", "SalesOrder", "LineType", "StockCode", "StockDescription", "Warehouse",
        "ProductClass", "BuyingGroup", "TariffCode", "Contract",
    ),
    "SalArea": ("Area", "Description", "TaxCode"),
    "SalBranch": (
        "Branch", "Description", "BranchAddr1", "BranchAddr2", "BranchAddr3",
        "BranchAddr3Country", "BranchPostalCode",
    ),
    "SalProductClass": ("Branch", "ProductClass", "Description"),
    "SalSalesperson": ("Branch", "Salesperson", "Name"),
    "ArTrnDetail": (
        "Invoice", "Branch", "Salesperson", "Customer", "OrderType", "StockCode", "Warehouse",
        "Area", "ProductClass", "TaxCode", "TaxStatus", "CustomerClass", "DocumentType",
        "SalesOrder", "CustomerPoNumber", "PostCurrency", "ContractPrcNum", "BuyingGroup",
        "TransactionGlCode",
    ),
    "ArInvoice": (
        "Customer", "Invoice", "DocumentType", "SalesOrder", "CustomerPoNumber", "Salesperson",
        "Branch", "Area", "PostCurrency", "TaxStatus",
    ),
    "ArPayHistory": ("Customer", "PaymentNumber"),
    "InvMaster": (
        "StockCode", "Description", "Supplier", "ProductClass", "TaxCode", "PriceCategory",
        "PriceMethod",
    ),
    "InvWarehouse": ("StockCode", "Warehouse"),
    "InvPrice": ("StockCode", "PriceCode", "PriceBasis"),
    "InvPriceHistory": ("PriceCode", "StockCode", "NewPriceBasis", "OldPriceBasis"),
}

# Columns the queries compute with, typed once at ingest. Dates arrive as
# MM/DD/YYYY or ISO text and become DATE.
DECLARED_TYPES: dict[str, dict[str, str]] = {
    "SorMasterRep": {"OrderDate": "date", "ReqShipDate": "date"},
    "SorDetailRep": {
        "SalesOrderLine": "bigint", "OrderQty": "double", "ShipQty": "double",
        "BackOrderQty": "double", "Price": "double", "LineShipDate": "date",
    },
    "InvWarehouse": {"QtyOnHand": "double"},
    "InvPrice": {"SellingPrice": "double"},
    "InvPriceHistory": {"DateChanged": "date", "NewSellingPrice": "double", "OldSellingPrice": "double"},
}

# The text a CSV reader with pandas defaults reads as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Reference table -> name used by the operators.
TABLE_ALIASES = {
    "SorMasterRep": "sor_master",
    "SorDetailRep": "sor_detail",
    "EnrichedSorDetail": "enriched",
}


def snake_case(name: str) -> str:
    """``SalesOrderLine`` -> ``sales_order_line``, ``ShipAddr1`` -> ``ship_addr1``."""
    s = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    s = re.sub(r"(?<=[A-Z])(?=[A-Z][a-z])", "_", s)
    return s.lower()


def table_alias(table: str) -> str:
    return TABLE_ALIASES.get(table, snake_case(table))
