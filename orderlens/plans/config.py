"""Engine settings the operators are designed around.

Every operator is written so that Catalyst and AQE choose the physical plan:
shuffle-partition counts are coalesced at runtime, sort-merge joins become
broadcast joins only when the *measured* shuffle output of a side is below the
threshold, and skewed join partitions are split. Explicit ``F.broadcast`` is
used only for frames whose size is bounded by construction (see
``plans.broadcast``).
"""

SCALE_CONFS: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # target post-shuffle partition size; fits executor memory at any scale
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    # a join side becomes a broadcast only from its measured runtime size
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}

# Cluster sizing note: with ``advisoryPartitionSizeInBytes`` = 128m, AQE
# coalesces ``spark.sql.shuffle.partitions`` downwards; set the initial value
# to about (largest shuffle bytes / 128m), e.g. 100 TB of line shuffle ->
# ~800k, or lower it with ``spark.sql.adaptive.coalescePartitions.initialPartitionNum``.
