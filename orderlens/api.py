"""Everything a user calls, in one place.

Loading goes ``ingest_csv_dir`` -> ``build_enriched`` -> ``write_enriched``;
queries take the frame that ``read_enriched`` returns, or the typed tables.
Structures that answer without a scan are built from it: ``build_rollup``,
``write_positions``, ``write_access_table``, ``month_state``, ``dictionary``.
Ranges of a stored table come from its folder names (``stored_month_range``,
``stored_default_range``), without opening a file. Reports are written with
their date and read back by ``latest_report``; ``report_labels`` names their
months.

``filters`` is a dict (or ``DimensionFilters``) with any of branch, area,
customer, product_class, salesperson; ``None`` values mean "no filter".
"""

from orderlens.operators.bucketed import BucketedStore, heavy_orders  # noqa: F401
from orderlens.operators.detail import (  # noqa: F401
    detail_after,
    detail_count,
    detail_page,
    detail_rows,
    next_cursor,
)
from orderlens.operators.dictionary import dictionary, option_lists, update_from_snapshots  # noqa: F401
from orderlens.operators.enrich import build_enriched, duplicate_keys, first_per_key  # noqa: F401
from orderlens.operators.filters import DimensionFilters, default_range  # noqa: F401
from orderlens.operators.history import price_history_json, top_stock_with_history  # noqa: F401
from orderlens.operators.options import filter_options  # noqa: F401
from orderlens.operators.product_class import product_class_share, share_total  # noqa: F401
from orderlens.operators.report import (  # noqa: F401
    category_report,
    latest_report,
    report_headings,
    report_labels,
    resolve_as_of,
    write_report,
)
from orderlens.operators.report_state import apply_changes, month_state, report_from_state  # noqa: F401
from orderlens.operators.rollup import build_rollup, refresh_rollup, rollup_count, rollup_trend  # noqa: F401
from orderlens.operators.status import status_overview  # noqa: F401
from orderlens.operators.stock import (  # noqa: F401
    price_history,
    stock_details,
    top_stock,
    top_stock_price_history,
)
from orderlens.operators.trend import order_trend  # noqa: F401
from orderlens.sources.access import lookup, write_access_table  # noqa: F401
from orderlens.sources.catalog import named_query, register_tables  # noqa: F401
from orderlens.sources.commitlog import CommitConflict, CommitLog  # noqa: F401
from orderlens.sources.csv_ingest import ingest_csv_dir, read_table  # noqa: F401
from orderlens.sources.layout import (  # noqa: F401
    read_enriched,
    stored_default_range,
    stored_month_range,
    write_enriched,
)
from orderlens.sources.positions import Positions, write_positions  # noqa: F401
from orderlens.sources.snapshots import read_latest, write_snapshot  # noqa: F401
