"""Completeness checks between tables that should hold the same ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecycle.operators.joins import members, non_members


def id_completeness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows, NULL ids and distinct ids of one id column per table.

    Each id is counted by itself: grouping by id first keeps every row count
    and distinct count in one aggregation. Several columns of one frame are
    counted in one scan of it, as rows of (column, id).
    """
    frames: dict[int, tuple[DataFrame, list[tuple[str, str]]]] = {}
    for name, (df, column) in tables.items():
        frames.setdefault(id(df), (df, []))[1].append((name, column))
    parts = []
    for df, columns in frames.values():
        ids = [
            F.struct(F.lit(name).alias("table"), F.lit(c).alias("id"), F.col(c).cast("string").alias("_id"))
            for name, c in columns
        ]
        per_id = df.select(F.inline(F.array(*ids))).groupBy("table", "id", "_id").agg(F.count("*").alias("_n"))
        found = per_id.groupBy("table", "id").agg(
            F.sum("_n").alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("_id").isNull(), F.col("_n"))), F.lit(0)).alias("null_ids"),
            F.count("_id").alias("distinct_ids"),
        )
        names = df.sparkSession.createDataFrame(columns, "table string, id string")
        counts = ["n_rows", "null_ids", "distinct_ids"]
        parts.append(names.join(found, ["table", "id"], "left").fillna(0, counts).select("table", "id", *counts))
    return reduce(DataFrame.unionByName, parts)


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs per column, one row per column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns]
    return counts.select(F.inline(F.array(*rows)))


def missing_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct ids of ``left`` absent from ``right``; NULL equals NULL here."""
    return left.select(key).subtract(right.select(key))


def id_sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every distinct id (NULL is one) with ``side``: in_both (INTERSECT), left_only or right_only (EXCEPT).

    Both sides are read once and reduced to ids on the map side.
    """
    sides = (
        left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
        .unionByName(right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
        .groupBy(key)
        .agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    )
    side = F.when((F.col("_l") == 1) & (F.col("_r") == 1), "in_both").when(F.col("_l") == 1, "left_only")
    return sides.select(key, side.otherwise("right_only").alias("side"))


def id_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many distinct ids (NULL is one) are in both, or in one side only."""
    sides = ("in_both", "left_only", "right_only")
    return id_sides(left, right, key).agg(*[F.count_if(F.col("side") == s).alias(s) for s in sides])


def uncovered(
    admissions: DataFrame,
    stays: DataFrame,
    cohort: DataFrame,
    age_group: str = "icustay_age_group",
    neonate: str = "neonate",
) -> DataFrame:
    """Cohort admissions of never-neonate subjects that no stay accounts for.

    A stay accounts for its (admission, subject) pair unless it is neonatal.
    Every candidate has a cohort subject, so a stay with the same pair has one
    too, and the stays need no cohort join of their own.
    """
    pair = ["hadm_id", "subject_id"]
    wanted = members(admissions.select(*pair), cohort)
    named = stays.select(*pair, age_group)
    newborn = F.lower(F.col(age_group)).like(f"%{neonate}%")
    candidates = non_members(wanted, named.filter(newborn).select("subject_id"))
    return candidates.select(*pair).subtract(named.filter(~newborn).select(*pair))


def below_threshold(
    df: DataFrame, subject: str = "subject_id", seq: str = "hospital_seq", least: int = 3
) -> DataFrame:
    """Subjects with fewer rows, or a smaller largest sequence, than expected."""
    per_subject = df.groupBy(subject).agg(
        F.count("*").alias("n_stays"), F.max(seq).alias("max_seq")
    )
    return per_subject.filter(
        (F.col("n_stays") < least) | (F.coalesce(F.col("max_seq"), F.lit(0)) < least)
    )
