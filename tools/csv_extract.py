"""Write DataFrames as ERP-style CSV extracts (test tooling, the inverse of
``orderlens.sources.csv_ingest``): CamelCase headers, dates as MM/DD/YYYY
text (or ISO), NULL as an empty field, blanks kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType


def camel_case(name: str) -> str:
    return "".join(part[:1].upper() + part[1:] for part in name.split("_"))


def write_extract(df: DataFrame, folder: str, table: str, iso_dates: bool = False) -> str:
    cols = []
    for f in df.schema.fields:
        c = F.date_format(f.name, "yyyy-MM-dd" if iso_dates else "MM/dd/yyyy") if isinstance(f.dataType, DateType) else F.col(f.name)
        cols.append(c.alias(camel_case(f.name)))
    path = f"{folder.rstrip('/')}/{table}.csv"
    (
        df.select(*cols).write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')  # RFC 4180 doubled quotes, as the reader expects
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path
