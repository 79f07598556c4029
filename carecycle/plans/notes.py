"""Clinical notes of the repeat cohort and of a sampled comparison cohort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carecycle.functions.vocab import (
    DISCHARGE_CATEGORY,
    DISCHARGE_TITLE,
    NURSING_CATEGORY,
    PHYSICIAN_CATEGORY,
)
from carecycle.operators.cohort import of_age
from carecycle.operators.joins import members, non_members, shuffled_apart
from carecycle.operators.pick import first_per
from carecycle.operators.sampling import sample_ids
from carecycle.plans.extracts import not_neonate


def is_discharge() -> Column:
    return F.col("category").like(f"%{DISCHARGE_CATEGORY}%") | F.lower("title").contains(
        DISCHARGE_TITLE
    )


def is_physician() -> Column:
    return F.col("category").like(f"%{PHYSICIAN_CATEGORY}%")


def is_nursing() -> Column:
    return F.col("category").like(f"%{NURSING_CATEGORY}%")


def note_extract(notes: DataFrame, subjects: DataFrame, kind: Column) -> DataFrame:
    """Notes of one kind; the kind is tested before the cohort join."""
    return members(notes.filter(kind), subjects)


def first_note_per_admission(
    notes: DataFrame, subjects: DataFrame, kind: Column, ts: str = "charttime"
) -> DataFrame:
    """The earliest note of the kind per admission (lowest note id on ties).

    The notes are read once: the kind is tested in the scan, the cohort is
    joined, and each task keeps one note per admission before any are moved.
    Notes without an admission are left out, so they do not pile up in one group.
    """
    wanted = members(notes.filter(kind & F.col("hadm_id").isNotNull()), subjects)
    return first_per(wanted, ["hadm_id"], [ts, "note_id"])


def negative_subjects(stays: DataFrame, cohort: DataFrame, n: int, seed: str) -> DataFrame:
    """A repeatable sample of subjects outside the cohort, not neonatal."""
    frame = not_neonate(stays).select("subject_id").distinct()
    return sample_ids(non_members(frame, cohort), "subject_id", n, seed)


def negative_subjects_adult(
    admissions: DataFrame, patients: DataFrame, cohort: DataFrame, n: int, seed: str
) -> DataFrame:
    """The same from admissions after the age of 16.

    Subjects are drawn, not admissions: no one is likelier for being admitted
    more often, and no one is drawn twice.
    """
    frame = of_age(admissions, patients).select("subject_id").distinct()
    return sample_ids(non_members(frame, cohort), "subject_id", n, seed)


def with_discharge_note(notes: DataFrame, subjects: DataFrame) -> DataFrame:
    """Subjects of the sample who have a discharge note."""
    having = notes.filter(is_discharge()).select("subject_id").distinct()
    return members(having, subjects)


def labelled_notes(
    notes: DataFrame, cohorts: dict[int, DataFrame], kinds: list[Column], label: str = "cohort"
) -> DataFrame:
    """Notes of several cohorts and kinds, a row for each cohort and kind that a note belongs to.

    The texts are read once and joined once, with the labelled subjects of all cohorts.
    """
    subjects = [df.select("subject_id", F.lit(n).alias(label)) for n, df in cohorts.items()]
    labels = shuffled_apart(reduce(DataFrame.unionByName, subjects))
    held = F.array(*[F.when(kind, F.lit(i)) for i, kind in enumerate(kinds)])
    rows = notes.filter(reduce(lambda a, b: a | b, kinds)).withColumn("_kinds", F.array_compact(held))
    rows = rows.join(labels, "subject_id")
    return rows.withColumn("_kind", F.explode("_kinds")).drop("_kinds", "_kind")


def long_notes(notes: DataFrame, subjects: DataFrame, longer_than: int = 4000) -> DataFrame:
    """How many discharge notes, and first nursing notes of an admission, exceed a number of characters.

    The texts are read once, only to be measured.
    """
    nursing = is_nursing() & F.col("hadm_id").isNotNull()
    measured = notes.filter(is_discharge() | nursing).select(
        "note_id", "subject_id", "hadm_id", "charttime", is_discharge().alias("_discharge"), nursing.alias("_nursing"),
        (F.length("text") > longer_than).alias("_long"),
    )
    rows = members(measured, subjects)
    # Nursing notes are ranked in their admission, each other note by itself.
    group = [F.col("_nursing"), F.when(F.col("_nursing"), F.col("hadm_id")).otherwise(F.col("note_id"))]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("charttime", "note_id"))
    counts = rows.withColumn("_rank", rank).agg(
        F.count_if(F.col("_discharge") & F.col("_long")).alias("discharge"),
        F.count_if(F.col("_nursing") & (F.col("_rank") == 1) & F.col("_long")).alias("nursing"),
    )
    sets = [F.struct(F.lit(c).alias("note_set"), F.col(c).alias("n_long")) for c in counts.columns]
    return counts.select(F.inline(F.array(*sets)))
