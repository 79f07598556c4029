"""Admission-level and patient-level tables over the extracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecycle.functions.dates import days_between, minutes_to_days
from carecycle.functions.recode import (
    bucket,
    cap,
    dummy,
    merge_labels,
    row_sum,
    sentinel_to_null,
)
from carecycle.functions.vocab import COMORBIDITIES, ETHNICITY_GROUPS, PAYOR_GROUPS
from carecycle.operators.joins import members, shuffled_apart
from carecycle.operators.pick import first_per
from carecycle.operators.profile import exact_mean, mean_sd_by

DEMOGRAPHIC_DUMMIES = [
    "admit_age", "male", "female", "married", "black", "white", "asian", "hispanic",
    "other_eth", "unknown_eth", "medicare_medicaid", "private", "other_payor", "died",
]

ADMISSION_BUCKETS = [
    (3, "1-3 Admissions"), (10, "4-10 Admissions"), (20, "11-20 Admissions"),
]
MOST_ADMISSIONS = "> 20 Admissions"


def admission_frequency(stays: DataFrame) -> DataFrame:
    """Patients seen at each admission order."""
    return (
        stays.filter(F.col("hospital_seq").isNotNull())
        .groupBy("hospital_seq")
        .agg(F.count_distinct("subject_id").alias("number_of_patients"))
    )


def los_days() -> dict[str, Column]:
    return {
        "icu_days": minutes_to_days(F.col("icustay_los"), None),
        "hospital_days": minutes_to_days(F.col("hospital_los"), None),
    }


def los_by_sequence(stays: DataFrame) -> DataFrame:
    return mean_sd_by(stays, "hospital_seq", los_days())


def los_overall(stays: DataFrame) -> DataFrame:
    return stays.agg(
        *[
            F.round(f(c), 2).alias(f"{stat}_{name}")
            for name, c in los_days().items()
            for stat, f in (("mean", F.avg), ("sd", F.stddev_samp))
        ]
    )


def demographic_dummies(
    demographics: DataFrame,
    ethnicity_groups: dict[str, str] = ETHNICITY_GROUPS,
    payor_groups: dict[str, str] = PAYOR_GROUPS,
    marital_missing: tuple[str, ...] = ("UNKNOWN",),
) -> DataFrame:
    """Cleaned age and 0/1 columns; an unknown marital status stays NULL."""
    ethnicity = F.coalesce(
        merge_labels(F.col("ethnicity"), ethnicity_groups), F.lit("UNKNOWN")
    )
    payor = merge_labels(F.col("overall_payor_group"), payor_groups)
    return demographics.select(
        "subject_id",
        cap(F.col("admit_age")).alias("admit_age"),
        F.when(F.col("gender") == "M", 1).when(F.col("gender") == "F", 0).alias("male"),
        F.when(F.col("gender") == "F", 1).when(F.col("gender") == "M", 0).alias("female"),
        dummy(F.col("marital_status"), "MARRIED", list(marital_missing)).alias("married"),
        *[
            dummy(ethnicity, label).alias(name)
            for name, label in {
                "black": "BLACK", "white": "WHITE", "asian": "ASIAN",
                "hispanic": "HISPANIC", "other_eth": "OTHER", "unknown_eth": "UNKNOWN",
            }.items()
        ],
        *[
            dummy(payor, label).alias(name)
            for name, label in {
                "medicare_medicaid": "MEDICARE/MEDICAID", "private": "PRIVATE",
                "other_payor": "OTHER",
            }.items()
        ],
        dummy(F.col("expire_flg"), "Y").alias("died"),
    )


def first_severity(extract: DataFrame, columns: list[str]) -> DataFrame:
    """Complete rows of each admission's first ICU stay, scores as numbers.

    The extract's scores are text with a textual null marker.
    """
    numeric = ["hospital_seq", "sofa_first", "sapsi_first"]
    return (
        sentinel_to_null(extract.select(*columns, "icustay_seq"))
        .dropna()
        .filter("icustay_seq = 1")
        .select(*[F.col(c).cast("int").alias(c) if c in numeric else c for c in columns])
    )


def severity_by_sequence(extract: DataFrame, score: str) -> DataFrame:
    rows = first_severity(extract, ["hospital_seq", score])
    return rows.groupBy("hospital_seq").agg(
        exact_mean(F.col(score)).alias("average"), F.stddev_samp(score).alias("sd")
    )


def severity_vs_total(stays: DataFrame, admissions: DataFrame) -> DataFrame:
    """Severity at a subject's first admission beside the number of admissions."""
    first = first_admission_rows(stays).select("subject_id", "sapsi_first", "sofa_first")
    totals = admissions.groupBy("subject_id").agg(F.count("*").alias("hospital_total_num"))
    return first.join(totals, "subject_id")


def severity_track(extract: DataFrame, score: str = "sapsi_first") -> DataFrame:
    """Scores along each subject's admissions, labelled by how many there were.

    The maximum is aggregated (map-side first) and joined back instead of
    windowed, so that a subject with many rows is not held in one task.
    """
    rows = first_severity(extract, ["subject_id", "hospital_seq", score])
    most = rows.groupBy("subject_id").agg(F.max("hospital_seq").alias("subject_max"))
    return rows.join(shuffled_apart(most), "subject_id").withColumn(
        "admission_group", bucket(F.col("subject_max"), ADMISSION_BUCKETS, MOST_ADMISSIONS)
    )


def first_admission_rows(stays: DataFrame) -> DataFrame:
    """The first stay row of each subject by admission order."""
    return first_per(
        stays.filter(F.col("hospital_seq").isNotNull()),
        ["subject_id"],
        ["hospital_seq", "icustay_id"],
    )


def time_to_death_first(stays: DataFrame) -> DataFrame:
    """Days from the first admission to death, and whether the subject died."""
    return first_admission_rows(stays).select(
        "subject_id",
        "gender",
        days_between(F.col("dod"), F.col("hospital_admit_dt")).alias("days"),
        F.when(F.col("expire_flg") == "Y", 1).otherwise(0).alias("event"),
    )


def discharged_alive(stays: DataFrame) -> DataFrame:
    """Last stay of the last admission, left alive; one row per subject."""
    last = stays.filter(
        "hospital_expire_flg = 'N' AND hospital_last_flg = 'Y' AND icustay_last_flg = 'Y'"
    )
    return first_per(
        last, ["subject_id"], [F.asc_nulls_last("hospital_seq"), "icustay_id"]
    )


def time_to_death_discharge(stays: DataFrame) -> DataFrame:
    return discharged_alive(stays).select(
        "subject_id",
        days_between(F.col("dod"), F.col("hospital_disch_dt")).alias("days"),
        F.when(F.col("expire_flg") == "Y", 1).otherwise(0).alias("event"),
    )


def outpatient_deaths(stays: DataFrame) -> DataFrame:
    return discharged_alive(stays).groupBy("expire_flg").agg(F.count("*").alias("n"))


def death_at_nth(stays: DataFrame) -> DataFrame:
    """Inpatient deaths per admission order."""
    return (
        stays.filter("hospital_expire_flg = 'Y'")
        .filter(F.col("hospital_seq").isNotNull())
        .groupBy("hospital_seq")
        .agg(F.count("*").alias("deaths"))
    )


def first_comorbidities(admissions: DataFrame, comorbidities: DataFrame) -> DataFrame:
    """Comorbidity flags of each subject's first admission."""
    first = first_per(
        admissions.select("subject_id", "hadm_id", "admit_dt"),
        ["subject_id"],
        ["admit_dt", "hadm_id"],
    )
    return first.select("subject_id", "hadm_id").join(
        comorbidities.drop("subject_id"), "hadm_id"
    )


def elixhauser(flags: DataFrame) -> DataFrame:
    return flags.select("subject_id", row_sum(COMORBIDITIES).alias("elixhauser_sum"))


def mean_cost_per_admission(costs: DataFrame) -> DataFrame:
    return costs.groupBy("hadm_id").agg(exact_mean(F.col("cost_weight")).alias("mean_cost_wt"))


def treated_share(treatments: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Share of subjects ever treated, per treatment.

    Each treatment gives rows of (subject, 0/1 flag); its subjects are the
    denominator.
    """
    parts = []
    for name, (df, flag) in treatments.items():
        per_subject = df.groupBy("subject_id").agg(F.max(flag).alias("_ever"))
        parts.append(
            per_subject.agg(
                F.count_if(F.col("_ever") == 1).alias("treated"),
                F.count("*").alias("subjects"),
            ).select(F.lit(name).alias("treatment"), "*")
        )
    return reduce(DataFrame.unionByName, parts).withColumn(
        "percent", F.round(F.col("treated") / F.col("subjects") * 100, 2)
    )


def procedure_flags(procedures: DataFrame, lists: dict[str, list[int]]) -> DataFrame:
    """0/1 per admission for each list of procedure items."""
    return procedures.groupBy("subject_id", "hadm_id").agg(
        *[
            F.max(F.when(F.col("itemid").isin(items), 1).otherwise(0)).alias(name)
            for name, items in lists.items()
        ]
    )


def pressor_days(durations: DataFrame) -> DataFrame:
    """Mean days on vasopressors per subject; none counts as 0."""
    return durations.groupBy("subject_id").agg(
        F.round(F.avg(F.coalesce("days_on_pressors", F.lit(0.0))), 2).alias(
            "ave_days_on_pressor"
        )
    )


def pressor_days_overall(durations: DataFrame) -> DataFrame:
    return pressor_days(durations).agg(
        F.round(F.avg("ave_days_on_pressor"), 2).alias("mean_days")
    )


def mortality_table(
    admissions: DataFrame, stays: DataFrame, subjects: DataFrame, last_by: str = "admit_dt"
) -> DataFrame:
    """In-hospital, 30-day, one-year and overall death after the last admission.

    Every input is reduced to the subjects and to one row of each before it is joined.
    ``last_by`` is ``admit_dt`` (ties by id) or ``hadm_id``.
    """
    last = first_per(
        members(admissions.select("subject_id", "hadm_id", "admit_dt", "disch_dt"), subjects),
        ["subject_id"],
        [F.desc(last_by), F.desc("hadm_id")],
    )
    in_hospital = (F.col("hospital_expire_flg") == "Y") | (F.col("icustay_expire_flg") == "Y")
    deaths = stays.groupBy("subject_id").agg(
        F.max(F.when(in_hospital, 1).otherwise(0)).alias("died_in_hosp"),
        F.max("dod").alias("dod"),
        F.max(F.when(F.col("expire_flg") == "Y", 1).otherwise(0)).alias("expire_flg"),
    )
    after = days_between(F.col("dod"), F.col("disch_dt"))
    rows = (
        last.join(deaths, "subject_id")
        .select(
            "died_in_hosp",
            F.when(after <= 30, 1).otherwise(0).alias("died_30"),
            F.when(after <= 365, 1).otherwise(0).alias("died_365"),
            "expire_flg",
        )
    )
    measures = rows.columns
    sums = rows.agg(
        F.count("*").alias("_all"),
        *[F.sum(m).alias(m) for m in measures],
        *[F.count_if(F.col(m).isNull()).alias(f"{m}_missing") for m in measures],
    )
    structs = [
        F.struct(
            F.lit(m).alias("measure"),
            F.col(m).alias("no_patients"),
            F.round(F.col(m) / F.col("_all") * 100, 2).alias("percentage"),
            F.col("_all").alias("cohort_no"),
            F.col(f"{m}_missing").alias("missing_value"),
        )
        for m in measures
    ]
    return sums.select(F.inline(F.array(*structs)))


def readmissions(admissions: DataFrame, patients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Later admissions in days since a subject's first one, and the days each subject is followed.

    Subjects are followed to their death or, at most, to the last day of any admission.
    """
    day = F.col("admit_dt").cast("date")
    first = first_per(admissions.select("subject_id", "hadm_id", "admit_dt"), ["subject_id"], ["admit_dt", "hadm_id"])
    first = first.select("subject_id", day.alias("_first"), F.col("hadm_id").alias("_first_id"))
    later = admissions.join(shuffled_apart(first), "subject_id").filter(F.col("hadm_id") != F.col("_first_id"))
    last = admissions.agg(F.max(day).alias("_last"))  # one row
    followed = first.join(patients.select("subject_id", "dod"), "subject_id").crossJoin(F.broadcast(last))
    return (
        later.select("subject_id", F.date_diff(day, "_first").alias("days")),
        followed.select("subject_id", F.date_diff(F.least("dod", "_last"), "_first").alias("days")),
    )


def care_settings(stays: DataFrame, demographics: DataFrame, flags: DataFrame) -> DataFrame:
    """Stays with their care unit, the admission's source and the first treatment flag that is set."""
    source = demographics.select("hadm_id", F.col("admission_source_descr").alias("admission_source"))
    treatment = F.lit("none")
    for name in reversed([c for c in flags.columns if c not in ("subject_id", "hadm_id")]):
        treatment = F.when(F.col(name) == 1, name).otherwise(treatment)
    return (
        stays.join(source, "hadm_id", "left")
        .join(flags.drop("subject_id"), "hadm_id", "left")
        .select(
            "subject_id", "hospital_seq", "icustay_los", "admission_source",
            F.col("icustay_first_careunit").alias("care_unit"), treatment.alias("treatment"),
        )
    )


def fitted(df: DataFrame, coefficients: DataFrame, terms: dict[str, list[str]], intercept: str) -> DataFrame:
    """Rows with the linear model's ``fitted`` value; rows must differ from each other, terms without estimate count 0.

    The products of a row's flags are joined with the coefficient table, so no
    estimate is pasted into the plan.
    """
    products = [F.struct(F.lit(intercept).alias("term"), F.lit(1.0).alias("_x"))]
    for term, factors in terms.items():
        x = reduce(lambda a, b: a * b, [F.col(f).cast("double") for f in factors])
        products.append(F.struct(F.lit(term).alias("term"), x.alias("_x")))
    known = coefficients.select("term", F.coalesce("estimate", F.lit(0.0)).alias("_estimate"))
    rows = df.select("*", F.inline(F.array(*products))).join(known, "term")
    return rows.groupBy(*df.columns).agg(F.sum(F.col("_x") * F.col("_estimate")).alias("fitted"))
