"""Versioned table snapshots: write a new version, read the newest one.

Replaces the reference's "drop table, create as select" and its "serve the
newest report file". Each run writes ``<base>/run_ts=<yyyyMMdd_HHmmss>/``
(plus any layout partitions inside it). A version counts only once a
``_COMMITTED`` marker is in its folder; the marker is written last, after
Spark's job commit (and after the schema file of an empty result), so

* readers never see a half-written version: ``read_latest`` takes the newest
  folder that has the marker, and an in-flight or failed write has none;
* a re-run with the same ``run_ts`` (a retried job after lost executors)
  replaces that folder only, and until it commits readers keep the previous
  version;
* an empty result is still a version: when a committed folder holds no data
  file, one empty parquet file carrying the schema is added, so the newest
  version reads as an empty table rather than falling back to an older one.

Listing is one directory level with one entry per version; the newest
version is read with ``basePath`` so ``run_ts`` stays a column.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from orderlens.sources.fs import delete, list_entries, read_text, touch, write_text

RUN_COLUMN = "run_ts"
COMMIT_MARKER = "_COMMITTED"
RUN_FORMAT = "%Y%m%d_%H%M%S"
RUN_PATTERN = re.compile(r"[0-9]{8}_[0-9]{6}")
# Stored versions are read many times and stay on disk: the codec that makes them smallest.
CODEC = "zstd"
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # of Spark 4.1; earlier ones do not know it


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession, **more: str) -> Iterator[None]:
    """What is written inside frees its shuffle files as soon as it is stored. Otherwise they stay on the executors' disks
    until the driver's garbage collector happens to run, so those of several builds lie there at once. ``more``: other
    settings of the write."""
    settings = {FREE_SHUFFLES: "true", **more}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def new_run_ts(now: dt.datetime | None = None) -> str:
    return (now or dt.datetime.now(dt.timezone.utc)).strftime(RUN_FORMAT)


def check_run_ts(run_ts: str) -> str:
    """Versions are ordered by name, so every name must be a ``yyyyMMdd_HHmmss``
    stamp: an ad-hoc name would sort after (and shadow) later versions."""
    if not RUN_PATTERN.fullmatch(run_ts or ""):
        raise ValueError(f"run_ts must look like 20240131_235959, got {run_ts!r}")
    return run_ts


def write_snapshot(df: DataFrame, base: str, run_ts: str | None = None,
                   partition_by: Sequence[str] = (), sort_within: Sequence[str | Column] = (),
                   fmt: str = "parquet", commit: bool = True, file_rows: int = 0,
                   open_files: int = 0, block_bytes: int = 0, append: bool = False) -> str:
    """Write ``df`` as version ``run_ts`` under ``base``; returns the run_ts. A task begins
    a new file after ``file_rows`` rows (0: never). With ``open_files`` a task writes the
    rows as they come, to so many folders of ``partition_by`` at once, instead of sorting
    by folder; ``block_bytes`` is the size of a row group (0: the default). ``append`` adds to an
    uncommitted version what belongs to it, too.

    ``commit=False`` leaves the version invisible until ``commit_version`` –
    for writing several tables that must appear together."""
    run_ts = check_run_ts(run_ts or new_run_ts())
    path = version_path(base, run_ts)
    spark = df.sparkSession
    # a rewrite of the same version is uncommitted from its first moment
    delete(spark, f"{path}/{COMMIT_MARKER}")
    out = df.sortWithinPartitions(*partition_by, *sort_within) if sort_within else df
    options = {"partitionOverwriteMode": "static",  # replace the whole version folder
               "maxRecordsPerFile": file_rows, **({"parquet.block.size": block_bytes} if block_bytes else {}),
               **({"compression": CODEC} if fmt == "parquet" else {})}
    with shuffles_freed(spark, **({OPEN_FILES: str(open_files)} if open_files else {})):
        out.write.format(fmt).mode("append" if append else "overwrite").options(**options).partitionBy(*partition_by).save(path)
    if not any(not name.startswith(("_", ".")) for name, _ in list_entries(spark, path)):
        # no row was written: keep the schema so the empty version is readable
        spark.createDataFrame([], df.schema).coalesce(1).write.format(fmt).mode("append").save(path)
    if commit:
        commit_version(spark, base, run_ts)
    return run_ts


def commit_version(spark: SparkSession, base: str, run_ts: str) -> None:
    """Make a written version visible to readers (its marker, written last)."""
    touch(spark, f"{version_path(base, run_ts)}/{COMMIT_MARKER}")


def version_path(base: str, run_ts: str) -> str:
    return f"{base.rstrip('/')}/{RUN_COLUMN}={run_ts}"


LOADS_FOLDER = "_loads"


def commit_load(spark: SparkSession, store: str, run_ts: str, tables: Sequence[str]) -> None:
    """Commit several tables written under ``store`` with one version name as
    one unit: a single manifest file (created in one call) lists them, and
    from that moment all of them are committed; the per-table markers written
    afterwards only save readers a look at the manifest."""
    store = store.rstrip("/")
    write_text(spark, f"{store}/{LOADS_FOLDER}/{run_ts}", "\n".join(tables))
    for table in tables:
        commit_version(spark, f"{store}/{table}", run_ts)


def uncommit_load(spark: SparkSession, store: str, run_ts: str) -> None:
    """Withdraw a committed load before it is rewritten (a retry with the
    same version name): the listed tables' markers go first – the manifest
    still keeps them all visible meanwhile – then the manifest, so readers see
    the whole load or none of it."""
    store = store.rstrip("/")
    manifest = read_text(spark, f"{store}/{LOADS_FOLDER}/{run_ts}")
    for table in (manifest or "").split("\n"):
        if table:
            delete(spark, f"{version_path(f'{store}/{table}', run_ts)}/{COMMIT_MARKER}")
    delete(spark, f"{store}/{LOADS_FOLDER}/{run_ts}")


def _in_committed_load(spark: SparkSession, base: str, run_ts: str) -> bool:
    store, _, table = base.rstrip("/").rpartition("/")
    manifest = read_text(spark, f"{store}/{LOADS_FOLDER}/{run_ts}")
    return manifest is not None and table in manifest.split("\n")


def snapshot_versions(spark: SparkSession, base: str) -> list[str]:
    """Committed versions under ``base``, oldest first: folders with the
    marker, or listed by a load manifest (``commit_load``)."""
    prefix = f"{RUN_COLUMN}="
    folders = [name[len(prefix):] for name, is_dir in list_entries(spark, base)
               if is_dir and name.startswith(prefix)]
    return sorted(
        v for v in folders
        if any(n == COMMIT_MARKER for n, _ in list_entries(spark, version_path(base, v)))
        or _in_committed_load(spark, base, v)
    )


def prune_versions(spark: SparkSession, base: str, keep: int = 2,
                   protect: Sequence[str] = ()) -> list[str]:
    """Retention: delete committed versions older than the newest ``keep``,
    and uncommitted folders older than the oldest kept version (failed
    writes; a newer uncommitted folder may be a write in flight and stays).
    Returns the deleted version names. Readers of a deleted version that is
    still in use fail, so keep at least the versions being read. Versions in
    ``protect`` (e.g. the one just written) are never deleted."""
    if keep < 1:
        raise ValueError("keep at least one version")
    committed = snapshot_versions(spark, base)
    if len(committed) <= keep:
        return []
    oldest_kept = committed[-keep]
    prefix = f"{RUN_COLUMN}="
    folders = [n[len(prefix):] for n, is_dir in list_entries(spark, base) if is_dir and n.startswith(prefix)]
    doomed = sorted(v for v in folders if v < oldest_kept and v not in set(protect))
    for v in doomed:
        delete(spark, version_path(base, v), recursive=True)
    return doomed


def read_version(spark: SparkSession, base: str, run_ts: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).option("basePath", base).load(version_path(base, run_ts))


def read_latest(spark: SparkSession, base: str, fmt: str = "parquet") -> DataFrame:
    """The newest snapshot under ``base`` (all of its rows, ``run_ts`` kept)."""
    versions = snapshot_versions(spark, base)
    if not versions:
        raise FileNotFoundError(f"no snapshot under {base}")
    return read_version(spark, base, versions[-1], fmt)
