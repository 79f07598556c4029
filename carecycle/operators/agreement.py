"""Agreement between annotators over binary features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_agreement(
    annotations: DataFrame, features: list[str], note: str = "icu_id", least: int = 2
) -> DataFrame:
    """Per note and feature: annotations, mean, positives, and full agreement.

    Notes with fewer than ``least`` annotations are left out. One aggregation
    per note covers all features; it combines map-side, so a note with many
    annotations is no hot spot.
    """
    n = F.count("*")
    sums = annotations.groupBy(note).agg(
        n.alias("num_notes"), *[F.sum(f).cast("long").alias(f) for f in features]
    )
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f).alias("pos_note")) for f in features]
    long = sums.filter(F.col("num_notes") >= least).select(
        note, "num_notes", F.inline(F.array(*rows))
    )
    return long.select(
        note,
        "feature",
        "num_notes",
        (F.col("pos_note") / F.col("num_notes")).alias("mean"),
        "pos_note",
        ((F.col("pos_note") == 0) | (F.col("pos_note") == F.col("num_notes"))).alias("agree"),
    )


def agreement_share(agreement: DataFrame) -> DataFrame:
    """Notes compared, and the share in full agreement, per feature."""
    return agreement.groupBy("feature").agg(
        F.count("*").alias("n_notes"), F.avg(F.col("agree").cast("int")).alias("prop_agreed")
    )


def agreement_summary(agreement: DataFrame) -> DataFrame:
    """Agreement among notes with any positive annotation, per feature."""
    positive = F.col("pos_note") >= 1
    agreed = F.col("agree").cast("int")
    return agreement.groupBy("feature").agg(
        F.count_if(positive).alias("num_posnotes"),
        F.avg(F.when(positive, agreed)).alias("prop_agreed"),
        (F.count_if(positive) / F.count("*")).alias("prop_posnote"),
        F.count_if(~positive).alias("num_negnotes"),
        F.count("*").alias("sum_posneg"),
    )


def disagreement_matrix(
    annotations: DataFrame, features: list[str], note: str = "icu_id", least: int = 2
) -> DataFrame:
    """One row per compared note: 1 per feature in dispute, and their number.

    The features are columns already, so no pivot is needed.
    """
    sums = annotations.groupBy(note).agg(
        F.count("*").alias("_n"), *[F.sum(f).alias(f) for f in features]
    )
    disputed = [
        F.when((F.col(f) > 0) & (F.col(f) < F.col("_n")), 1).otherwise(0).alias(f)
        for f in features
    ]
    flags = sums.filter(F.col("_n") >= least).select(note, *disputed)
    return flags.withColumn(
        "sum_disagree", reduce(lambda a, b: a + b, [F.col(f) for f in features])
    )


def disagreement_rate(
    annotations: DataFrame, features: list[str], note: str = "icu_id"
) -> DataFrame:
    """Notes in dispute over any feature, as a percentage of all notes."""
    sums = annotations.groupBy(note).agg(
        F.count("*").alias("_n"), *[F.sum(f).alias(f) for f in features]
    )
    split = reduce(
        lambda a, b: a | b, [(F.col(f) > 0) & (F.col(f) < F.col("_n")) for f in features]
    )
    return sums.agg(
        F.count_if(split & (F.col("_n") >= 2)).alias("notes_disputed"),
        F.count("*").alias("notes"),
    ).withColumn(
        "percent", F.round(F.col("notes_disputed") / F.col("notes") * 100, 2)
    )
