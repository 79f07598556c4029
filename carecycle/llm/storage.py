"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def folder(spark: SparkSession, name: str) -> str:
    """A path of its own for ``name`` below ``spark.checkpoint.dir``.

    Where that setting is missing, as in tests, the session's warehouse folder
    takes its place; it is shared by definition.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, outlives executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def removed(*tables: DataFrame) -> None:
    """Deletes the files of tables from ``written`` that nothing will read again.

    All that was made of them must itself be written by now; frames that still
    read them, lazily, would fail. Other frames are left alone.
    """
    for table in tables:
        path = _PATHS.pop(table, None)
        if path:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
