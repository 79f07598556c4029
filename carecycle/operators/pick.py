"""One row per key, repeats, and numbered batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carecycle.operators.joins import shuffled_apart
from carecycle.operators.ranges import number_rows


def first_per(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of every key; ``order`` must end in a unique column.

    Spark trims each key to its first row before the shuffle (window group
    limit), so a hot key costs one row per map task. Rows with a NULL key are
    no group of their own and are dropped.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return (
        df.filter(known)
        .withColumn("_rank", F.row_number().over(w))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def repeats(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Every row but the first (by ``row_id``) of its key."""
    first = df.groupBy(*keys).agg(F.min(row_id).alias("_first"))
    same_key = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    return (
        df.alias("r")
        .join(shuffled_apart(first).alias("f"), same_key)
        .filter(F.col(row_id) > F.col("_first"))
        .select("r.*")
    )


def group_size_excess(df: DataFrame, key: str) -> DataFrame:
    """Keys held by more than one row, and the rows beyond one per key."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    return sizes.agg(
        F.count("*").alias("duplicated_keys"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("excess_rows"),
    )


def batches(df: DataFrame, key: str | list[str], size: int, out: str = "batch") -> DataFrame:
    """Consecutive batches of exactly ``size`` rows in the order of a key of any orderable type."""
    return number_rows(df, key, "_row").withColumn(
        out, F.ceil(F.col("_row") / F.lit(size)).cast("long")
    ).drop("_row")
