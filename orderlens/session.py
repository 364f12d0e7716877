"""Spark session helpers.

The library itself never creates a session: every operator takes and returns
DataFrames. These helpers are for tests, ``bench.py`` and the driver entry.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

from orderlens.plans.config import SCALE_CONFS


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "orderlens", extra_confs: dict[str, str] | None = None) -> SparkSession:
    """A local session with the same engine settings a cluster run uses.

    Only the shuffle partition count is scaled down to the local core count;
    on a cluster it is left to AQE's partition coalescing (see plans.config).
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("ORDERLENS_DRIVER_MEMORY", "16g"))
    )
    for key, value in {**SCALE_CONFS, **(extra_confs or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session (Spark applies it to the
    context at start). Only when it is unset and the master is local (tests)
    is a scratch folder registered with ``setCheckpointDir``; the setting
    itself is never modified on a running session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder on the cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="orderlens-ckpt-"))
    return sc.getCheckpointDir()
