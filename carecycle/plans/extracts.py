"""Cohort extracts: stays, admissions, demographics, codes, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecycle.functions.dates import minutes_to_days
from carecycle.functions.recode import keep_prefix
from carecycle.functions.vocab import COMORBIDITIES, NEONATE
from carecycle.operators.cohort import died_soon_after
from carecycle.operators.joins import members
from carecycle.operators.pick import group_size_excess
from carecycle.operators.profile import all_positive, any_flags, counts_where, exact_mean


def not_neonate(stays: DataFrame, pattern: str = NEONATE) -> DataFrame:
    """Stays of another age group; stays without an age group are left out."""
    return stays.filter(~F.lower("icustay_age_group").like(f"%{pattern}%"))


def adult_stays(stays: DataFrame, cohort: DataFrame) -> DataFrame:
    return members(not_neonate(stays), cohort)


def cohort_subjects(stays: DataFrame, cohort: DataFrame) -> DataFrame:
    """Cohort subjects with a stay that is not neonatal."""
    return members(not_neonate(stays).select("subject_id").distinct(), cohort)


def admission_category(demographics: DataFrame, subjects: DataFrame) -> DataFrame:
    return category_columns(members(demographics, subjects))


def category_columns(demographics: DataFrame) -> DataFrame:
    return demographics.select(
        "subject_id",
        "hadm_id",
        F.col("overall_payor_group_descr").alias("overall_payor_group"),
        F.col("admission_type_descr").alias("admission_type"),
        F.col("admission_source_descr").alias("admission_source"),
    )


def admit_info(category: DataFrame, stays: DataFrame) -> DataFrame:
    """Admission category beside the first ICU stay of the admission.

    The stays are the cohort's, so the join by admission keeps its admissions.
    """
    first = stays.filter("icustay_seq = 1").select(
        "hadm_id",
        "icustay_id",
        "hospital_seq",
        "subject_icustay_seq",
        "icustay_seq",
        F.col("icustay_admit_age").alias("admit_age"),
        "icustay_first_service",
        "icustay_last_service",
        minutes_to_days(F.col("icustay_los")).alias("icustay_days"),
        minutes_to_days(F.col("hospital_los")).alias("hospital_days"),
        "expire_flg",
        "hospital_expire_flg",
        "icustay_expire_flg",
        "dod",
        "icustay_intime",
        "icustay_outtime",
    )
    return category.join(first, "hadm_id")


def demographics(
    stays: DataFrame, detail: DataFrame, first_stay_only: bool = False
) -> DataFrame:
    """Demographics per ICU stay, joined by admission."""
    if first_stay_only:
        stays = stays.filter("subject_icustay_seq = 1")
    own = stays.select(
        "hadm_id",
        "icustay_id",
        "icustay_seq",
        "subject_icustay_seq",
        F.col("icustay_admit_age").alias("admit_age"),
        "gender",
        "dod",
        "hospital_expire_flg",
        "expire_flg",
    )
    named = detail.select(
        "subject_id",
        "hadm_id",
        F.col("marital_status_descr").alias("marital_status"),
        F.col("ethnicity_descr").alias("ethnicity"),
        F.col("overall_payor_group_descr").alias("overall_payor_group"),
        F.col("religion_descr").alias("religion"),
        F.col("admission_type_descr").alias("admission_type"),
        F.col("admission_source_descr").alias("admission_source"),
    )
    return own.join(named, "hadm_id")


def comorbidity_any(comorbidities: DataFrame, subjects: DataFrame) -> DataFrame:
    """30 flags per cohort subject over all admissions.

    Flags are combined before the cohort join, which then sees one row each.
    """
    return members(any_flags(comorbidities, "subject_id", COMORBIDITIES), subjects)


def cost_table(costs: DataFrame, items: DataFrame, subjects: DataFrame) -> DataFrame:
    """Cost events with their description, dearest first (unknown cost on top).

    The ids complete the order, so equal costs can be split over sort ranges.
    """
    return (
        members(costs, subjects)
        .join(items, "itemid")
        .orderBy(F.desc_nulls_first("cost_weight"), "subject_id", "hadm_id", "itemid")
    )


def cost_summary(costs: DataFrame, items: DataFrame, subjects: DataFrame) -> DataFrame:
    """Events and mean cost per item; items are named after the aggregation."""
    per_item = members(costs, subjects).groupBy("itemid").agg(
        F.count("*").alias("hadm_count"), exact_mean(F.col("cost_weight")).alias("ave_cost_wt")
    )
    return per_item.join(items, "itemid").orderBy(F.desc("hadm_count"), "itemid")


def code_frequency(diagnoses: DataFrame, subjects: DataFrame) -> DataFrame:
    """Frequency per code with one of its descriptions (the first by name)."""
    return (
        members(diagnoses, subjects)
        .groupBy("code")
        .agg(F.count("*").alias("frequency"), F.min("description").alias("description"))
        .orderBy(F.desc("frequency"), "code")
    )


def end_of_life_duplicates(stays: DataFrame) -> DataFrame:
    """Last-stay rows of subjects with several of them."""
    cohort = died_soon_after(stays, last_stay_only=True)
    several = cohort.groupBy("subject_id").agg(F.count("*").alias("n")).filter("n > 1")
    return members(cohort, several)


def end_of_life_excess(stays: DataFrame) -> DataFrame:
    return group_size_excess(died_soon_after(stays, last_stay_only=True), "subject_id")


def cohort_rows(
    table: DataFrame, cohort: DataFrame, key: str = "subject_id", items: DataFrame | None = None
) -> DataFrame:
    """Rows of any table for a cohort, named by an item dimension if given."""
    rows = members(table, cohort.select(key).distinct(), key)
    return rows if items is None else rows.join(items, "itemid", "left")


def primary_to_tertiary(diagnoses: DataFrame, stop: str = ".") -> DataFrame:
    """The first three diagnoses of each admission, codes without decimals."""
    return diagnoses.filter("sequence < 4").select(
        "subject_id", "hadm_id", "sequence", keep_prefix(F.col("code"), stop).alias("code")
    )


def _named_counts(per_code: DataFrame, names: DataFrame, columns: list[str]) -> DataFrame:
    return (
        per_code.join(names, "code")
        .groupBy("description")
        .agg(*[F.sum(c).alias(c) for c in columns])
    )


def code_tally(
    diagnoses: DataFrame, names: DataFrame, require_all: bool = True, stop: str = "."
) -> DataFrame:
    """Times each diagnosis is primary, secondary and tertiary.

    Codes are cut at ``stop`` and counted before they are named, so the name
    join sees one row per code. By default a diagnosis has to occur at all
    three priorities.
    """
    priorities = {"primary_dx": 1, "secondary_dx": 2, "tertiary_dx": 3}
    per_code = counts_where(
        primary_to_tertiary(diagnoses, stop),
        "code",
        {name: F.col("sequence") == n for name, n in priorities.items()},
    )
    tally = _named_counts(per_code, names, list(priorities))
    if require_all:
        tally = all_positive(tally, list(priorities))
    return tally.orderBy(F.desc("primary_dx"), "description")


def code_by_admission_order(
    diagnoses: DataFrame, stays: DataFrame, names: DataFrame, require_all: bool = True
) -> DataFrame:
    """The three priorities over all, first, second and third admissions."""
    order = stays.filter("icustay_seq = 1").select("subject_id", "hadm_id", "hospital_seq")
    rows = primary_to_tertiary(diagnoses).join(order, ["subject_id", "hadm_id"])
    conditions = {}
    for name, n in {"prim": 1, "sec": 2, "ter": 3}.items():
        at = F.col("sequence") == n
        conditions[name] = at
        for nth in (1, 2, 3):
            conditions[f"{name}{nth}"] = at & (F.col("hospital_seq") == nth)
    tally = _named_counts(counts_where(rows, "code", conditions), names, list(conditions))
    if require_all:
        tally = all_positive(tally, list(conditions))
    return tally.orderBy(F.desc("prim"), "description")
