"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, IntegralType


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def non_empty(col: Column | str) -> Column:
    """Not NULL and not ``''`` (a blanks-only value is kept)."""
    c = _c(col)
    return c.isNotNull() & (c != "")


def non_blank(col: Column | str) -> Column:
    """Not NULL, not ``''`` and not blanks-only (``trim`` strips spaces only)."""
    c = _c(col)
    return c.isNotNull() & (F.trim(c) != "")


def _sql_exponent_text(c: Column) -> Column:
    """Spark's ``1.0E-5`` / ``1.2345E25`` as SQL prints a double in
    exponent form: ``1e-05`` / ``1.2345e+25`` (mantissa without a trailing
    ``.0``, signed exponent of at least two digits)."""
    text = c.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).cast("int")
    sign = F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+"))
    digits = F.abs(exponent).cast("string")
    # lpad would also cut longer text: pad only one-digit exponents
    digits = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    formatted = F.concat(mantissa, F.lit("e"), sign, digits)
    return F.when(text.contains("E"), formatted).otherwise(text)


def sql_number_text(col: Column | str, data_type: DataType) -> Column:
    """A number as SQL ``::text`` prints it: integers and decimals as they are
    (``12``, ``12.50``); a double in its shortest form, plainly for
    ``1e-4 <= |x| < 1e15`` (``12``, not ``12.0``; ``12345678.9``, not
    ``1.23456789E7``) and in exponent form outside (``5e-05``, ``1e+25``)."""
    c = _c(col)
    if isinstance(data_type, (IntegralType, DecimalType)):
        return c.cast("string")
    integral = c == F.floor(c)
    # decimal(38,22) keeps all 17 significant digits of a double in the plain
    # range (the double converts through its shortest text)
    plain = F.regexp_replace(
        F.regexp_replace(c.try_cast("decimal(38,22)").cast("string"), "0+$", ""), r"\.$", ""
    )
    in_plain_range = (F.abs(c) >= 1e-4) & (F.abs(c) < 1e15)
    return (
        F.when(integral & (F.abs(c) < 1e15), c.cast("bigint").cast("string"))
        .when(in_plain_range, F.coalesce(plain, c.cast("string")))
        .otherwise(_sql_exponent_text(c))
    )


def label_with_code(description: Column, code: Column) -> Column:
    """``"<description> (<code>)"``."""
    return F.concat(description, F.lit(" ("), code, F.lit(")"))
