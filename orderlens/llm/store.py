"""Intermediate tables of an operator, written to the cluster's shared checkpoint folder.

A written table cuts lineage: a lost executor costs a re-read, not a recomputation, and both inputs
of a later join start from plain scans, so adaptive execution can split a hot key on either side.
"""

from __future__ import annotations

import atexit
import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import orderlens
from orderlens.session import ensure_checkpoint_dir
from orderlens.sources.fs import delete

_ROOTS: list[tuple[SparkSession, str]] = []


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this library to the executors, once a Spark application: their Python need not have it. The
    archive lies in the shared checkpoint folder, as everything that executors read."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package, archive = Path(orderlens.__file__).parent, io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/orderlens-llm/package-{uuid.uuid4().hex}"
    if not _ROOTS:
        atexit.register(_clear)
    _ROOTS.append((spark, root))
    write_bytes(spark, f"{root}/orderlens.zip", archive.getvalue())
    spark.sparkContext.addPyFile(f"{root}/orderlens.zip")


def write_bytes(spark: SparkSession, file_path: str, data: bytes) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file_path)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


class Scratch:
    """A folder of its own under ``spark.checkpoint.dir`` for one call of one operator.

    ``write`` stores a frame and reads it back; ``drop`` removes tables that nothing reads any more.
    What remains (the result may still be read from it) goes when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/orderlens-llm/{name}-{uuid.uuid4().hex}"
        if not _ROOTS:
            atexit.register(_clear)
        _ROOTS.append((spark, self.root))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}", recursive=True)


def _clear() -> None:
    for spark, root in _ROOTS:
        try:
            delete(spark, root, recursive=True)
        except Exception:  # the session may be gone: the cluster's own clean-up of the folder is left
            return
