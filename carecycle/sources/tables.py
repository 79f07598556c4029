"""Parquet tables with declared schemas, and written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carecycle.sources.schemas import TABLES


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def replace_table(df: DataFrame, name: str) -> DataFrame:
    """Write a query's result as a catalog table, dropping an older one, and read it.

    Use it for a cohort that several extracts share: it is computed once and
    survives the loss of the executors that computed it.
    """
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df.write.saveAsTable(name)
    return spark.table(name)


def replace_bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """Write a result as a catalog table in buckets of ``key``, sorted, and read it.

    Joins by ``key`` then take the table as it lies: a dozen extracts of one
    cohort shuffle their own rows only. Buckets are as many as the session's
    shuffle partitions by default; with fewer, Spark would rather shuffle the
    table again. A bucket can't be split, so a hot key stays in one task: use
    it for ids that occur once.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    # One task for each bucket, so that a bucket is one file and its order holds.
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def own_name(spark: SparkSession, name: str) -> str:
    """A table name that other applications on the same warehouse do not use."""
    return f"{name}_{spark.sparkContext.applicationId}".replace("-", "_")
