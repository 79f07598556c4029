"""Joins that stay splittable when one key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shuffled_apart(keys: DataFrame) -> DataFrame:
    """Detach the small side of a join from its own partitioning.

    AQE splits the partitions of a hot key only if both sides of the join come
    straight out of a shuffle. A side that was aggregated or windowed by the
    join key already is partitioned by it and gets none; then one task would
    read every row of the hot key. The rebalance costs a shuffle of that side,
    which holds one narrow row per key.
    """
    return keys.hint("rebalance")


def members(df: DataFrame, ids: DataFrame, key: str = "subject_id") -> DataFrame:
    """Rows whose key is among the ids."""
    return df.join(shuffled_apart(ids.select(key)), key, "left_semi")


def bucket_members(df: DataFrame, ids: DataFrame, key: str = "subject_id") -> DataFrame:
    """The same where ``ids`` is a table in buckets of the key, which is joined as it lies."""
    return df.join(ids.select(key), key, "left_semi")


def non_members(df: DataFrame, ids: DataFrame, key: str = "subject_id") -> DataFrame:
    """Rows whose key is not NULL and not among the ids."""
    known = df.filter(df[key].isNotNull())
    return known.join(shuffled_apart(ids.select(key)), key, "left_anti")
