"""Session settings the plans rely on, and the folder for files they write."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Subjects, admissions and items can be hot (one may hold a third of all rows).
# Aggregations combine map-side, so only row-preserving joins meet the hot key;
# AQE splits those partitions, also where a later operator wants the same key.
# Narrow rows of ids shrink to a tenth in a shuffle, and a task sorts and hashes
# them unpacked, so partitions are merged to less than Spark's 64 MB.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


_CONFIGURED: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Sets what the plans rely on, once for each application; later changes are the caller's."""
    application = spark.sparkContext.applicationId
    if application not in _CONFIGURED:
        for key, value in ADAPTIVE.items():
            spark.conf.set(key, value)
        _CONFIGURED.add(application)
    return spark


def files_dir(spark: SparkSession, name: str) -> str:
    """The path of ``name`` in this application's folder below the session's warehouse.

    The warehouse is shared by driver and executors. Writers replace what an
    earlier call of the same application left there.
    """
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{warehouse}/carecycle_files/{spark.sparkContext.applicationId}/{name}"
