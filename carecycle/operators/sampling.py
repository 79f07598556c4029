"""Reproducible sampling and shuffling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecycle.functions.ordering import seeded_key


def sample_ids(ids: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` distinct ids, uniformly and repeatably drawn (all if fewer)."""
    return (
        ids.select(key)
        .dropna()
        .distinct()
        .orderBy(seeded_key(seed, F.col(key)), key)
        .limit(n)
    )


def blind_shuffle(
    labelled: list[tuple[DataFrame, int]], row_key: str, required: str, seed: str
) -> DataFrame:
    """Stack labelled note sets and order them by a seeded hash of the row key.

    Rows without the ``required`` id are dropped.
    """
    stacked = None
    for df, label in labelled:
        part = df.withColumn("cohort", F.lit(label))
        stacked = part if stacked is None else stacked.unionByName(part)
    return shuffled(stacked.filter(F.col(required).isNotNull()), row_key, seed)


def shuffled(df: DataFrame, row_key: str, seed: str) -> DataFrame:
    """Rows in the order of a seeded hash of the row key."""
    return df.withColumn("shuffle_key", seeded_key(seed, F.col(row_key))).orderBy("shuffle_key", row_key)
