"""Annotation files: reconciliation with note texts, pending and unsure notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecycle.operators.audit import missing_ids
from carecycle.operators.joins import members


def reconcile(
    notes: DataFrame, results: DataFrame, late: DataFrame | None = None
) -> DataFrame:
    """Results beside their note's text and cohort.

    Results join by admission and batch. ``late`` results, whose batch was never
    handed out, join by admission only and keep their own batch.
    """
    own = notes.select(
        "hadm_id",
        "batch_id",
        F.col("subject_id").alias("note_subject_id"),
        F.col("category").alias("note_category"),
        "text",
        "cohort",
    )
    merged = own.join(results, ["hadm_id", "batch_id"])
    if late is None:
        return merged
    return merged.unionByName(own.drop("batch_id").join(late, "hadm_id"))


def annotator_counts(annotations: DataFrame, note: str = "icu_id") -> DataFrame:
    """Rows, distinct notes and repeated annotations per operator."""
    per_note = annotations.groupBy("operator", note).agg(F.count("*").alias("_n"))
    return per_note.groupBy("operator").agg(
        F.sum("_n").alias("annotations"),
        F.count("*").alias("unique_notes"),
        (F.sum("_n") - F.count("*")).alias("repeated"),
    )


def annotation_totals(annotations: DataFrame, note: str = "icu_id") -> DataFrame:
    """The same over all operators: rows, distinct notes, and rows beyond one per note."""
    per_note = annotations.groupBy(note).agg(F.count("*").alias("_n")).filter(F.col(note).isNotNull())
    return per_note.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("annotations"),
        F.count("*").alias("unique_notes"),
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count("*")).alias("repeated"),
    )


def pending_notes(
    annotations: DataFrame, missing: DataFrame, key: str = "hadm_id"
) -> DataFrame:
    """Notes annotated exactly once, and whether a missing batch holds them."""
    once = annotations.groupBy(key).agg(F.count("*").alias("_n")).filter("_n = 1").select(key)
    held = missing.select(key).distinct().withColumn("_held", F.lit(True))
    return once.join(held, key, "left").select(
        key, F.col("_held").isNotNull().alias("in_missing_batch")
    )


def operators_per_note(annotations: DataFrame, note: str = "hadm_id") -> DataFrame:
    return annotations.groupBy(note).agg(
        F.count("*").alias("num_notes"),
        F.count_distinct("operator").alias("num_operators"),
    )


def unsure(annotations: DataFrame) -> DataFrame:
    return annotations.filter("unsure = 1")


def unsure_counts(annotations: DataFrame, note: str = "icu_id") -> DataFrame:
    """Unsure annotations and the notes they concern, per operator."""
    return unsure(annotations).groupBy("operator").agg(
        F.count("*").alias("unsure_annotations"),
        F.count_distinct(note).alias("unsure_notes"),
    )


def unsure_remaining(
    annotations: DataFrame, adjudicated: DataFrame, note: str = "icu_id"
) -> DataFrame:
    """Notes someone was unsure of that nobody has adjudicated."""
    return missing_ids(unsure(annotations), adjudicated, note)


def unsure_export(
    reconciled: DataFrame, remaining: DataFrame, note: str = "icu_id"
) -> DataFrame:
    """Distinct texts of the remaining notes in the annotation tool's layout.

    The tool expects three admission columns; they get distinct names.
    """
    return _tool_layout(
        members(reconciled, remaining, note).select("note_subject_id", "hadm_id", "real_time", "text")
    )


def unsure_texts(
    notes: DataFrame, results: DataFrame, remaining: DataFrame, late: Column, note: str = "icu_id"
) -> DataFrame:
    """``unsure_export`` of what ``reconcile`` gives for all results, of which ``late`` picks the late ones.

    Results are narrowed to the remaining notes and to distinct dates before
    they meet a text, and texts are joined once.
    """
    told = results.select(note, "hadm_id", "batch_id", "real_time", late.alias("_late")).filter(
        F.col("_late").isNotNull() & (F.col("_late") | F.col("batch_id").isNotNull())
    )
    batch = F.when(~F.col("_late"), F.col("batch_id")).alias("_batch")
    dates = members(told, remaining, note).select(F.col("hadm_id").alias("_hadm_id"), batch, "real_time").distinct()
    own = notes.select("hadm_id", "batch_id", F.col("subject_id").alias("note_subject_id"), "text")
    same_batch = F.col("_batch").isNull() | (F.col("batch_id") == F.col("_batch"))
    found = own.join(dates, (F.col("hadm_id") == F.col("_hadm_id")) & same_batch)
    return _tool_layout(found.select("note_subject_id", "hadm_id", "real_time", "text"))


def _tool_layout(texts: DataFrame) -> DataFrame:
    return texts.distinct().select(
        F.col("note_subject_id").alias("subject_id"),
        "hadm_id",
        F.col("hadm_id").alias("hadm_id_2"),
        F.col("hadm_id").alias("hadm_id_3"),
        F.col("real_time").alias("chartdate"),
        F.lit("Discharge").alias("category"),
        F.lit("Summary").alias("descriptions"),
        "text",
    )
