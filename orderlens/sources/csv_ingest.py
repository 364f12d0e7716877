"""Load a directory of ERP CSV extracts, one table per file.

* Table name = file name before the first dot (``a.b.csv`` -> ``a``); two
  files claiming one table is an error (the reference would silently keep the
  last one). Only ``*.csv`` entries are read; an entry may be one file or a
  folder of part files (a split extract).
* Every column is read as text first (no inference pass over the file), the
  missing-value tokens become NULL, listed text columns stay text, declared
  columns are cast/parsed, and the remaining columns are typed from their
  values with one aggregate pass (three counts per column, one row back).
* Column names become snake_case; each table is written as a new snapshot
  version (see ``snapshots``), never overwritten in place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.functions.dates import parse_extract_date, strict_extract_date, unread_date
from orderlens.sources.fs import delete, list_entries
from orderlens.sources.schemas import DECLARED_TYPES, NA_TOKENS, TEXT_COLUMNS, snake_case, table_alias
from orderlens.sources.snapshots import (
    RUN_COLUMN,
    commit_load,
    new_run_ts,
    uncommit_load,
    read_version,
    write_snapshot,
)

_INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"
# a float as a CSV reader reads one: digits, a point, an exponent, or inf
_FLOAT_TEXT = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI]nf(inity)?)\s*$"
# The text a pandas-default reader takes as booleans.
BOOL_TEXT = ("True", "TRUE", "true", "False", "FALSE", "false")


def list_csv_files(spark: SparkSession, in_dir: str) -> list[str]:
    """Paths of the ``*.csv`` entries directly under ``in_dir``: single files,
    or folders of part files as Spark writes them."""
    base = in_dir.rstrip("/")
    return [f"{base}/{name}" for name, _ in list_entries(spark, base) if name.endswith(".csv")]


def table_files(paths: Sequence[str]) -> dict[str, str]:
    """Map table name (text before the first dot of the file name) to its path."""
    tables: dict[str, str] = {}
    for p in paths:
        file_name = p.rstrip("/").rsplit("/", 1)[-1]
        if not file_name.endswith(".csv"):
            continue
        name = file_name.split(".")[0]
        if name in tables:
            raise ValueError(f"files {tables[name]} and {p} both load table {name!r}")
        tables[name] = p
    return tables


def normalise_missing(col: Column, tokens: Sequence[str] = NA_TOKENS) -> Column:
    """Missing-value tokens -> NULL; anything else (also blanks-only) kept."""
    return F.when(col.isin(*tokens), F.lit(None).cast("string")).otherwise(col)


def infer_types(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Type of each text column from its values, as a pandas-default CSV
    reader decides it: ``bigint`` if every value is an integer that fits in
    64 bits and none is missing; ``double`` if every present value is a number
    (integers with gaps, and all-missing columns, included); ``boolean`` for
    True/False text; else ``string``. Integer text beyond 64 bits stays text
    (exact) rather than a rounded double. One aggregate, one row back."""
    if not columns:
        return {}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`")
        is_int = col.rlike(_INTEGER_TEXT)
        aggs += [
            F.count(col).alias(f"n{i}"),
            F.count(F.when(is_int, 1)).alias(f"i{i}"),
            F.count(F.when(is_int & col.try_cast("bigint").isNotNull(), 1)).alias(f"l{i}"),
            F.count(F.when(col.rlike(_FLOAT_TEXT) & col.try_cast("double").isNotNull(), 1)).alias(f"d{i}"),
            F.count(F.when(col.isin(*BOOL_TEXT), 1)).alias(f"b{i}"),
        ]
    counts = df.agg(*aggs).first()
    rows, types = counts["rows"], {}
    for i, c in enumerate(columns):
        n, ints, longs = counts[f"n{i}"], counts[f"i{i}"], counts[f"l{i}"]
        dbls, bools = counts[f"d{i}"], counts[f"b{i}"]
        if n == 0:
            types[c] = "double" if rows > 0 else "string"
        elif longs == n and n == rows:
            types[c] = "bigint"
        elif ints == n and longs < n:
            types[c] = "string"  # integers beyond 64 bits: keep the exact text
        elif dbls == n:
            types[c] = "double"
        elif bools == n:
            types[c] = "boolean"
        else:
            types[c] = "string"
    return types


def read_table(spark: SparkSession, path: str, table: str,
               text_columns: Mapping[str, Sequence[str]] = TEXT_COLUMNS,
               declared: Mapping[str, Mapping[str, str]] = DECLARED_TYPES,
               infer: bool = True, multi_line: bool = False, bad_dates: str = "fail",
               rejects: dict[str, int] | None = None, staging: str | None = None) -> DataFrame:
    """One extract as a typed DataFrame (snake_case columns).

    ``infer=False`` skips the type pass (undeclared columns stay text).
    Declared numeric columns use a strict cast: a value that is not a number
    fails the job (under ANSI) instead of becoming NULL; inferred columns are
    cast only to a type every value was checked to have.
    ``multi_line=True`` allows quoted fields with line breaks, at the price of
    reading each file in one task (such files cannot be split); without it a
    file with such fields fails to load (FAILFAST) instead of being misread.
    Declared dates are read as M/d/yyyy or ISO. Other text fails the load
    (``bad_dates="fail"``) or becomes NULL after being counted into ``rejects``
    (``bad_dates="count"``: ``<table>.<column>`` -> rows).
    ``staging`` (a folder) keeps the text rows as parquet, so the CSV is parsed
    once and the counting passes and the result read the parquet.
    """
    if bad_dates not in ("fail", "count"):
        raise ValueError(f"bad_dates must be 'fail' or 'count', got {bad_dates!r}")
    if bad_dates == "count" and rejects is None:
        raise ValueError("bad_dates='count' needs a dict to report the counts in")
    raw = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')  # RFC 4180: a quote inside a quoted field is doubled
        .option("mode", "FAILFAST")  # a malformed row fails the load, never shifts values
        .csv(path)
    )
    clean = raw.select(*[normalise_missing(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if staging:
        clean.write.mode("overwrite").parquet(staging)
        clean = spark.read.schema(clean.schema).parquet(staging)
    text = set(text_columns.get(table, ()))
    fixed = dict(declared.get(table, {}))
    rest = [c for c in clean.columns if c not in text and c not in fixed]
    types = {**(infer_types(clean, rest) if infer else {c: "string" for c in rest}), **fixed}
    dates = [c for c in clean.columns if types.get(c) == "date" and c not in text]
    if bad_dates == "count" and dates:
        counts = clean.agg(*[F.count_if(unread_date(F.col(f"`{c}`"))).alias(f"n{i}") for i, c in enumerate(dates)]).first()
        rejects.update({f"{table}.{c}": counts[f"n{i}"] for i, c in enumerate(dates) if counts[f"n{i}"]})
    out = []
    for c in clean.columns:
        col = F.col(f"`{c}`")
        if c in text or types.get(c, "string") == "string":
            expr = col
        elif types[c] == "date":
            expr = strict_extract_date(col) if bad_dates == "fail" else parse_extract_date(col)
        elif types[c] == "boolean":
            expr = col.isin("True", "TRUE", "true")  # only BOOL_TEXT values are here
        else:
            expr = col.cast(types[c])
        out.append(expr.alias(snake_case(c)))
    return clean.select(*out)


def ingest_csv_dir(spark: SparkSession, in_dir: str, out_dir: str | None = None,
                   run_ts: str | None = None, **kwargs) -> dict[str, DataFrame]:
    """Read every CSV table under ``in_dir``. With ``out_dir``, write each to
    ``out_dir/<alias>`` as a snapshot version and return readers of the
    written parquet (later jobs do not parse the CSV again); otherwise return
    the typed CSV readers. Keys are the table aliases.

    A load is committed as a whole: every table is written first, then one
    manifest file commits all of them at once (``snapshots.commit_load``). A
    load that fails at any point – also between the per-table markers –
    leaves either all its tables visible or none, so the build never joins
    new lines to old headers; a load of only some tables is fine.
    """
    files = table_files(list_csv_files(spark, in_dir))
    run_ts = run_ts or new_run_ts()  # one version name for the whole load
    if out_dir:
        uncommit_load(spark, out_dir, run_ts)  # a retried load is invisible until it commits again
    tables, written = {}, []
    for table, path in sorted(files.items()):
        alias = table_alias(table)
        staged = f"{out_dir.rstrip('/')}/_staging/{run_ts}/{table}" if out_dir else None
        df = read_table(spark, path, table, staging=staged, **kwargs)
        if out_dir:
            base = f"{out_dir.rstrip('/')}/{alias}"
            write_snapshot(df, base, run_ts=run_ts, commit=False)
            written.append(alias)
            df = read_version(spark, base, run_ts).drop(RUN_COLUMN)
        tables[alias] = df
    if out_dir:
        delete(spark, f"{out_dir.rstrip('/')}/_staging/{run_ts}", recursive=True)
    if out_dir and written:
        commit_load(spark, out_dir, run_ts, written)
    return tables
