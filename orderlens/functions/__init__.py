"""Column-level helpers: built-in Spark expressions only (JVM side, codegen'd)."""

from orderlens.functions.dates import (  # noqa: F401
    month_end,
    month_spine,
    month_start,
    parse_text_date,
    year_month_text,
)
from orderlens.functions.numeric import half_even, half_up, percent_of  # noqa: F401
from orderlens.functions.text import (  # noqa: F401
    label_with_code,
    non_blank,
    non_empty,
    sql_number_text,
)
