"""Plan text helpers (used by tests and for reviewing plans by hand)."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """What ``df.explain(mode)`` prints; after an action it is the final
    adaptive plan."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def count_nodes(text: str, node: str) -> int:
    """Nodes named ``node`` in a ``formatted`` plan (one ``(id) Node`` header
    per node, subqueries included)."""
    return len(re.findall(rf"^\(\d+\) {re.escape(node)}\b", text, flags=re.M))


def scans_of(text: str, path_fragment: str) -> int:
    """Number of file scans whose location mentions ``path_fragment``
    (in ``formatted`` mode, one ``Location:`` line per scan node)."""
    return sum(1 for line in text.splitlines()
               if line.strip().startswith("Location:") and path_fragment in line)
