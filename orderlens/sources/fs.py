"""Directory listing through the cluster's Hadoop file system (one level;
names only, so the driver holds one entry per table or version)."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def list_entries(spark: SparkSession, folder: str) -> list[tuple[str, bool]]:
    """(name, is_directory) of the entries directly under ``folder``; [] if missing."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted((st.getPath().getName(), bool(st.isDirectory())) for st in fs.listStatus(path))


def touch(spark: SparkSession, file_path: str) -> None:
    """Create an empty file (a commit marker), replacing any existing one."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(file_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.create(path, True).close()


def delete(spark: SparkSession, file_path: str, recursive: bool = False) -> None:
    """Remove a file (or, with ``recursive``, a folder) if it exists."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(file_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        fs.delete(path, recursive)


def write_text(spark: SparkSession, file_path: str, text: str) -> None:
    """Create (or replace) a small text file in one call (a manifest)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(file_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, file_path: str) -> str | None:
    """The content of a small text file, or None when it does not exist."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(file_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_if_absent(spark: SparkSession, file_path: str, text: str) -> bool:
    """Create a small file with its whole content unless it exists; False if it does. Of several writers at
    once exactly one succeeds, and no reader sees a part of it: the content is written beside it, then given the
    name by a hard link (local disks) or a rename that does not overwrite (HDFS and other Hadoop file systems
    whose rename is atomic)."""
    sc = spark.sparkContext
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(file_path)
    conf = sc._jsc.hadoopConfiguration()
    fs = path.getFileSystem(conf)
    beside = f"{path.getParent()}/.{path.getName()}.{uuid.uuid4().hex}"
    write_text(spark, beside, text)
    part = jvm.org.apache.hadoop.fs.Path(beside)
    try:
        if fs.getUri().getScheme() == "file":
            local = [jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri()) for p in (path, part)]
            jvm.java.nio.file.Files.createLink(*local)
        else:
            never = sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(part, path, never)
    except Py4JJavaError as error:
        if not error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            raise
        return False
    finally:
        delete(spark, beside)
    return True
