"""Every named query over one folder of tables.

Each function takes the entity views of a folder and returns a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from carecycle.functions.dates import elapsed_days
from carecycle.functions.recode import merge_labels, with_unit
from carecycle.functions.vocab import (
    ANNOTATION_FEATURES,
    ANNOTATION_IDS,
    COMORBIDITIES,
    INTERACTION_FLAGS,
    NULL_SENTINEL,
)
from carecycle.operators import agreement as ag
from carecycle.operators import audit, durations, model, pick, profile, ranges, sampling, survival
from carecycle.operators import cohort as co
from carecycle.operators.joins import bucket_members, members
from carecycle.plans import analysis as an
from carecycle.plans import annotations as ann
from carecycle.plans import extracts as ex
from carecycle.plans import notes as nt
from carecycle.session import files_dir
from carecycle.sources import files, schemas
from carecycle.sources.analogs import Analogs
from carecycle.sources.tables import own_name, replace_bucketed, replace_table

Query = Callable[[Analogs], DataFrame]
QUERIES: dict[str, Query] = {}

# Label maps and item lists that fit the test tables.
ETHNICITY = {
    "AFRICA": "BLACK", "AMERICA": "HISPANIC", "ASIA": "ASIAN", "EUROPE": "WHITE",
    "MIDDLE EAST": "OTHER",
}
PAYORS = {
    "AUTOMOBILE": "OTHER", "BUILDING": "MEDICARE/MEDICAID",
    "FURNITURE": "OTHER", "HOUSEHOLD": "PRIVATE", "MACHINERY": "MEDICARE/MEDICAID",
}
MARITAL = {"WIDOWED": "SEPARATED"}
VENTILATION = ["view", "click"]
PRESSORS = ["purchase", "error"]
PROCEDURE_LISTS = {"dialysis": [1, 2, 3], "tracheostomy": [4, 5]}

SAMPLE_SEED = "carecycle"
SHUFFLE_SEED = "blind"
FEW_REPEATS = 2
MANY_REPEATS = 5


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _cohort(a: Analogs, min_further: int = FEW_REPEATS) -> DataFrame:
    return a.shared(
        ("cohort", min_further), lambda: co.repeat_cohort(a.admissions(), min_further=min_further)
    )


def _stays(a: Analogs) -> DataFrame:
    """Stays of the cohort that are not neonatal."""
    return a.shared("cohort stays", lambda: ex.adult_stays(a.stays(), _cohort(a)))


def _subjects(a: Analogs) -> DataFrame:
    return a.shared("subjects", lambda: ex.cohort_subjects(a.stays(), _cohort(a)))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Hide the last digits, which depend on the order of summation."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _five(df: DataFrame, columns: list[str]) -> DataFrame:
    return _rounded(ranges.five_numbers(df, columns), "mean", "q1", "median", "q3")


# -- cohorts ---------------------------------------------------------------


@query
def repeat_cohort(a):
    return _cohort(a)


@query
def repeat_cohort_selective(a):
    return _cohort(a, MANY_REPEATS)


@query
def repeat_cohort_exact(a):
    return co.repeat_cohort(a.admissions(), min_further=MANY_REPEATS, upper="exact")


@query
def repeat_cohort_events(a):
    """Users with 8 further events up to midnight two days later."""
    return co.repeat_cohort(
        a.table("events"), "user_id", "event_id", "ts", days=2, min_further=8
    )


@query
def repeat_cohort_adult(a):
    return co.repeat_cohort_adult(a.admissions(), a.patients())


@query
def cohort_table(a):
    """The cohort written as a table and read back."""
    return replace_table(_cohort(a), own_name(a.spark, "carecycle_cohort"))


@query
def adult_stays(a):
    return _stays(a).orderBy(
        "subject_id", "icustay_intime", "icustay_id"
    )


# -- extracts --------------------------------------------------------------


@query
def admission_category(a):
    return ex.admission_category(a.demographics(), _subjects(a)).orderBy(
        "subject_id", "hadm_id"
    )


@query
def admit_info(a):
    return ex.admit_info(ex.category_columns(a.demographics()), _stays(a))


def _demographics(a, first_stay_only=False):
    return ex.demographics(_stays(a), a.demographics(), first_stay_only)


@query
def demographics(a):
    return _demographics(a)


@query
def demographics_first_stay(a):
    return _demographics(a, first_stay_only=True)


@query
def comorbidity_any(a):
    return ex.comorbidity_any(a.comorbidities(), _subjects(a))


@query
def drg_table(a):
    return ex.cost_table(a.cost_events(), a.cost_items(), _subjects(a))


@query
def drg_cost_summary(a):
    return ex.cost_summary(a.cost_events(), a.cost_items(), _subjects(a))


@query
def icd9_extract(a):
    return members(a.diagnoses(), _subjects(a))


@query
def icd9_frequency(a):
    return ex.code_frequency(a.diagnoses(), _subjects(a))


@query
def eol_cohort(a):
    return co.died_soon_after(a.stays())


@query
def eol_cohort_last_stay(a):
    return co.died_soon_after(a.stays(), last_stay_only=True)


@query
def eol_cohort_last_hospital_stay(a):
    return co.died_soon_after(
        a.stays(), last_stay_only=True, last_hospital_stay_only=True
    )


@query
def eol_duplicates(a):
    return ex.end_of_life_duplicates(a.stays())


@query
def eol_excess(a):
    return ex.end_of_life_excess(a.stays())


@query
def eol_comorbidities(a):
    return ex.cohort_rows(a.comorbidities(), co.died_soon_after(a.stays()))


@query
def eol_demographics(a):
    return ex.cohort_rows(a.demographics(), co.died_soon_after(a.stays()))


@query
def eol_codes(a):
    return ex.cohort_rows(a.diagnoses(), co.died_soon_after(a.stays()))


@query
def eol_procedures(a):
    return ex.cohort_rows(
        a.procedures(), co.died_soon_after(a.stays()), items=a.procedure_items()
    )


@query
def eol_costs(a):
    return ex.cohort_rows(
        a.cost_events(), co.died_soon_after(a.stays()), items=a.cost_items()
    )


@query
def eol_notes(a):
    """Notes by stay: the narrow links are matched before any text is read."""
    links = ex.cohort_rows(a.note_stays(), co.died_soon_after(a.stays()), "icustay_id")
    return links.join(a.notes().drop("icustay_id"), "note_id")


@query
def eol_admissions(a):
    return ex.cohort_rows(a.admissions(), co.died_soon_after(a.stays()))


@query
def coverage_audit(a):
    return audit.uncovered(a.admissions(), a.stays(), _cohort(a))


# -- notes -----------------------------------------------------------------


@query
def notes_discharge(a):
    return nt.note_extract(a.notes(), _subjects(a), nt.is_discharge())


@query
def notes_physician(a):
    return nt.note_extract(a.notes(), _subjects(a), nt.is_physician())


@query
def notes_nursing(a):
    return nt.note_extract(a.notes(), _subjects(a), nt.is_nursing())


@query
def first_note_per_admission(a):
    return nt.first_note_per_admission(a.notes(), _subjects(a), nt.is_nursing())


def _negatives(a):
    return nt.negative_subjects(a.stays(), _cohort(a, MANY_REPEATS), 408, SAMPLE_SEED)


@query
def negative_cohort(a):
    return _negatives(a)


@query
def negative_cohort_adult(a):
    positive = co.repeat_cohort_adult(a.admissions(), a.patients(), min_further=MANY_REPEATS)
    return nt.negative_subjects_adult(
        a.admissions(), a.patients(), positive, 400, SAMPLE_SEED
    )


@query
def negative_discharge_notes(a):
    return nt.note_extract(a.notes(), _negatives(a), nt.is_discharge())


def _negatives_with_discharge(a):
    return nt.with_discharge_note(a.notes(), _negatives(a))


@query
def negative_physician_notes(a):
    return nt.note_extract(a.notes(), _negatives_with_discharge(a), nt.is_physician())


@query
def negative_nursing_notes(a):
    return nt.first_note_per_admission(
        a.notes(), _negatives_with_discharge(a), nt.is_nursing()
    )


@query
def long_notes(a):
    return nt.long_notes(a.notes(), _negatives(a))


def _both_cohorts(a):
    return {1: _cohort(a, MANY_REPEATS), 0: _negatives(a)}


@query
def blind_shuffle(a):
    columns = ["note_id", "subject_id", "hadm_id", "icustay_id", "charttime", "text", "cohort"]
    kind = nt.is_nursing() & F.col("hadm_id").isNotNull()
    notes = nt.labelled_notes(a.notes(), _both_cohorts(a), [kind])
    return sampling.shuffled(notes.select(*columns), "note_id", SHUFFLE_SEED)


@query
def combined_notes(a):
    """Discharge and nursing notes of both cohorts, stacked in reading order."""
    columns = ["note_id", "subject_id", "hadm_id", "icustay_id", "charttime", "category", "text", "cohort"]
    kinds = [nt.is_discharge(), nt.is_nursing() & F.col("hadm_id").isNotNull()]
    notes = nt.labelled_notes(a.notes(), _both_cohorts(a), kinds)
    return notes.select(*columns).orderBy("subject_id", "charttime", "note_id")


# -- treatments ------------------------------------------------------------


def _durations(a):
    return durations.treatment_durations(
        ex.not_neonate(a.monitored_stays()), a.chart_events(), a.medication_events(),
        VENTILATION, PRESSORS,
    )


@query
def treatment_durations(a):
    return _durations(a)


@query
def treated_share(a):
    treated = _durations(a)
    flags = ex.cohort_rows(
        an.procedure_flags(a.procedures(), PROCEDURE_LISTS), _subjects(a)
    )
    return an.treated_share(
        {
            "vasopressors": (treated, "vasopressors"),
            "ventilation": (treated, "mech_vent"),
            "tracheostomy": (flags, "tracheostomy"),
            "dialysis": (flags, "dialysis"),
        }
    )


@query
def pressor_days(a):
    return an.pressor_days(_durations(a))


@query
def pressor_days_overall(a):
    return an.pressor_days_overall(_durations(a))


@query
def vent_durations(a):
    """Ventilation spans of an extract file, whose times are text."""
    spans = durations.treatment_span(a.chart_events(), VENTILATION)
    rows = spans.select(
        F.col("icustay_id").alias("index"),
        F.floor(F.col("icustay_id") / 3).alias("subject_id"),
        "icustay_id",
        F.lit(1).alias("seq"),
        *[
            F.date_format(f"{end}_time", "M/d/yyyy H:mm").alias(f"{name}_time")
            for name, end in (("begin", "start"), ("end", "stop"))
        ],
    )
    path = files.write_lines(rows, files_dir(a.spark, "ventilation"))
    read = files.good_rows(files.read_lines(a.spark, path, schemas.VENTILATION_EXTRACT))
    text = read.select("icustay_id", "begin_time", "end_time")
    return durations.parsed_durations(text, "begin_time", "end_time")


@query
def treated_percent(a):
    """Share of subjects ever treated, as a number and as text with its unit."""
    share = treated_share(a).select("treatment", "percent")
    return share.withColumn("percent_text", with_unit(F.col("percent"), "%"))


# -- annotation files ------------------------------------------------------


def _results_on_disk(a, folder):
    """Annotation results as files named by operator and batch."""
    rows = a.annotations().select(
        *ANNOTATION_IDS,
        *ANNOTATION_FEATURES,
        F.concat("operator", F.upper("batch_id"), F.lit("Results")).alias("source"),
    )
    return files.write_batches(rows, files_dir(a.spark, folder), "source")


def _notes_on_disk(a, folder):
    """Note files in two layouts, named by batch; returns their folders."""
    notes = a.annotated_notes().withColumn(
        "source", F.concat(F.lit("xx"), F.col("batch_id"), F.lit("notes"))
    )
    layouts = {
        "subject_id bigint, hadm_id bigint, category string, text string, cohort int": 0,
        "subject_id bigint, hadm_id bigint, cohort int, text string, category string, "
        "description string": 1,
    }
    wide = notes.withColumn("description", F.lit("Summary"))
    paths = []
    for schema, cohort in layouts.items():
        names = [c.split()[0] for c in schema.split(", ")]
        path = files.write_batches(
            wide.filter(F.col("cohort") == cohort).select(*names, "source"),
            files_dir(a.spark, f"{folder}/{cohort}"), "source",
        )
        paths.append(path)
    return paths


@query
def read_results(a):
    return files.read_results(a.spark, _results_on_disk(a, "results"))


@query
def read_notes(a):
    """Notes of a folder of files whose layouts their headers tell."""
    _notes_on_disk(a, "notes")
    return files.read_notes(a.spark, files_dir(a.spark, "notes"))


LATE_OPERATOR = "R-O"


def _reconciled(a):
    results = a.annotations().drop("annotation_id").distinct()
    late = F.col("operator") == LATE_OPERATOR
    return ann.reconcile(
        a.annotated_notes(), results.filter(~late), results.filter(late)
    )


@query
def reconcile(a):
    return _reconciled(a)


@query
def annotator_counts(a):
    return ann.annotator_counts(a.annotations())


@query
def annotation_completeness(a):
    rows = a.annotations()
    ids = ["hadm_id", "icu_id", "subject_id", "chart_time"]
    return audit.id_completeness({f"annotations {c}": (rows, c) for c in ids})


@query
def annotation_totals(a):
    return ann.annotation_totals(a.annotations())


@query
def repeated_annotations(a):
    """Each operator's second and later annotations of a note."""
    rows = a.annotations().select("operator", "icu_id", "annotation_id")
    return pick.repeats(rows, ["operator", "icu_id"], "annotation_id")


def _urgent_orders(a, name, factor):
    return a.table("orders").filter("o_orderpriority = '1-URGENT'").select(
        (F.col("o_orderkey") * factor).alias(name)
    )


@query
def pending_notes(a):
    return ann.pending_notes(a.annotations(), _urgent_orders(a, "hadm_id", 1))


@query
def pending_overlap(a):
    """Notes annotated once against the notes of missing batches."""
    once = ann.pending_notes(a.annotations(), _urgent_orders(a, "hadm_id", 1))
    return audit.id_overlap(once, _urgent_orders(a, "hadm_id", 1), "hadm_id")


@query
def operators_per_note(a):
    return ann.operators_per_note(a.annotations())


@query
def operators_per_note_summary(a):
    return _five(
        ann.operators_per_note(a.annotations()), ["num_notes", "num_operators"]
    )


@query
def feature_agreement(a):
    return ag.feature_agreement(a.annotations(), ANNOTATION_FEATURES)


@query
def agreement_share(a):
    return ag.agreement_share(ag.feature_agreement(a.annotations(), ANNOTATION_FEATURES))


@query
def agreement_summary(a):
    return ag.agreement_summary(ag.feature_agreement(a.annotations(), ANNOTATION_FEATURES))


@query
def disagreement_matrix(a):
    return ag.disagreement_matrix(a.annotations(), ANNOTATION_FEATURES)


@query
def disagreement_only(a):
    return ag.disagreement_matrix(a.annotations(), ANNOTATION_FEATURES).filter(
        "sum_disagree > 0"
    )


@query
def disagreement_rate(a):
    return ag.disagreement_rate(a.annotations(), ANNOTATION_FEATURES)


@query
def unsure_notes(a):
    return ann.unsure_counts(a.annotations())


def _adjudicated(a):
    return _urgent_orders(a, "icu_id", 2)


@query
def unsure_adjudication(a):
    """Unsure notes adjudicated, remaining, and adjudicated without being unsure."""
    return audit.id_overlap(ann.unsure(a.annotations()), _adjudicated(a), "icu_id")


@query
def unsure_remaining(a):
    return ann.unsure_remaining(a.annotations(), _adjudicated(a))


def _unsure_texts(a):
    remaining = ann.unsure_remaining(a.annotations(), _adjudicated(a))
    late = F.col("operator") == LATE_OPERATOR
    return ann.unsure_texts(a.annotated_notes(), a.annotations(), remaining, late)


@query
def unsure_export(a):
    return _unsure_texts(a)


@query
def annotation_batches(a):
    """Remaining unsure notes in batches of 30."""
    return pick.batches(
        ann.unsure_remaining(a.annotations(), _adjudicated(a)), "icu_id", 30
    )


@query
def annotation_batch_files(a):
    """Texts of the remaining unsure notes, written as files of 30 and read back."""
    texts = _unsure_texts(a)
    order = ["hadm_id", "subject_id", "chartdate", "text"]
    path = files.write_numbered_batches(texts, files_dir(a.spark, "unsure_batches"), order, 30)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema)
    rows = files.read_numbered_batches(a.spark, path, schema)
    sizes = rows.groupBy("file").agg(F.count("*").alias("rows_in_file"))
    return rows.join(sizes, "file").drop("file")


# -- extract files ---------------------------------------------------------


def _lines(a, name, df, schema, spoilt, sep=","):
    """Lines of an extract; some are written broken, so that there is something to part."""
    broken = {
        spoilt: F.when(F.col("hadm_id") % 89 == 5, "n/a"),
        "": F.when(F.col("hadm_id") % 97 == 3, f"{sep}?"),
    }
    path = files.write_lines(df, files_dir(a.spark, name), sep, broken)
    return files.read_lines(a.spark, path, schema, sep)


def _demographic_lines(a, name, subjects=None):
    rows = _demographics(a).withColumn("index", F.col("icustay_id"))
    columns = StructType.fromDDL(schemas.DEMOGRAPHICS_EXTRACT).names
    return _lines(a, name, rows.select(*columns), schemas.DEMOGRAPHICS_EXTRACT, "admit_age")


def _comorbidity_lines(a, name, subjects=None):
    rows = members(a.comorbidities(), subjects or _subjects(a)).withColumns(
        {"index": F.col("hadm_id"), "category": F.lit("ELIXHAUSER")}
    )
    columns = StructType.fromDDL(schemas.COMORBIDITY_EXTRACT).names
    return _lines(a, name, rows.select(*columns), schemas.COMORBIDITY_EXTRACT, "obesity")


def _code_lines(a, name, subjects=None):
    rows = members(a.diagnoses(), subjects or _subjects(a))
    columns = StructType.fromDDL(schemas.CODE_EXTRACT).names
    return _lines(a, name, rows.select(*columns), schemas.CODE_EXTRACT, "sequence", ";")


@query
def demographics_extract(a):
    return files.good_rows(_demographic_lines(a, "demographics_extract"))


@query
def comorbidity_extract(a):
    return files.good_rows(_comorbidity_lines(a, "comorbidity_extract"))


@query
def code_extract(a):
    """Diagnosis codes of a file with semicolons."""
    return files.good_rows(_code_lines(a, "code_extract"))


@query
def frequency_extract(a):
    """Admission frequencies of a file with a header in each part."""
    path = files.write_csv(an.admission_frequency(_stays(a)), files_dir(a.spark, "frequency_extract"))
    header = "HOSPITAL_SEQ,NUMBER_OF_PATIENTS"
    return files.good_rows(files.read_lines(a.spark, path, schemas.FREQUENCY_EXTRACT, header=header))


@query
def extract_quarantine(a):
    """Lines of three extracts by what they are, bad ones by reason."""
    extracts = {
        "demographics": _demographic_lines, "comorbidities": _comorbidity_lines, "codes": _code_lines,
    }
    subjects = replace_table(_subjects(a), own_name(a.spark, "carecycle_quarantine_subjects"))
    parts = [
        files.accounted(build(a, f"{name}_quarantine", subjects)).select(F.lit(name).alias("extract"), "*")
        for name, build in extracts.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def cohort_extracts(a):
    """Rows of the cohort's extracts, all joined with one cohort table in buckets."""
    name = own_name(a.spark, "carecycle_cohort_buckets")
    cohort = replace_bucketed(_cohort(a), name, "subject_id")
    tables = {
        "admissions": a.admissions(), "diagnoses": a.diagnoses(), "costs": a.cost_events(),
        "procedures": a.procedures(), "demographics": a.demographics(),
    }
    parts = [
        bucket_members(df, cohort).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("extract"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


# -- admission level -------------------------------------------------------



@query
def stays_union(a):
    """Stays written as header-less extracts by admission order, read and united."""
    stays = _stays(a)
    seq = F.col("hospital_seq")
    groups = {"first": seq == 1, "second": seq == 2, "third": seq == 3, "four_plus": seq >= 4}
    indexed = stays.select(F.col("icustay_id").alias("index"), "*")
    path = files.write_groups(indexed, files_dir(a.spark, "hadm_extracts"), groups)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in indexed.schema.fields)
    return files.read_stay_extracts(a.spark, [path], schema).drop("extract")


@query
def stays_cross_check(a):
    """Stays pulled by the subjects alone against those of the cohort: INTERSECT and EXCEPT."""
    pulled = ex.cohort_rows(a.stays(), _subjects(a))
    return audit.id_sides(_stays(a), pulled, "icustay_id")


@query
def admission_frequency(a):
    return an.admission_frequency(_stays(a))


@query
def los_by_sequence(a):
    return an.los_by_sequence(_stays(a))


@query
def los_overall(a):
    return an.los_overall(_stays(a))


def _first_demographics(a):
    """Demographics of each subject's first recorded stay."""
    return pick.first_per(_demographics(a), ["subject_id"], ["hadm_id", "icustay_id"])


def _dummies(a):
    return an.demographic_dummies(_first_demographics(a), ETHNICITY, PAYORS)


@query
def demographic_dummies(a):
    return _dummies(a)


@query
def column_profile(a):
    summary = profile.column_profile(_dummies(a), an.DEMOGRAPHIC_DUMMIES)
    return _rounded(summary, "mean", "sd", "sum", "median")


@query
def age_summary(a):
    return _five(_dummies(a), ["admit_age"])


@query
def ethnicity_by_death(a):
    """Two-way table of ethnicity and death."""
    return profile.two_way(_first_demographics(a), "ethnicity", "expire_flg")


@query
def category_proportions(a):
    columns = {
        "gender": F.col("gender"),
        "marital_status": merge_labels(F.col("marital_status"), MARITAL),
        "ethnicity": merge_labels(F.col("ethnicity"), ETHNICITY),
        "payor": F.col("overall_payor_group"),
        "religion": F.col("religion"),
        "admission_type": F.col("admission_type"),
        "admission_source": F.col("admission_source"),
    }
    return profile.proportions(_first_demographics(a), columns)


def _severity_extract(a):
    """Stays as an extract gives them: missing numbers are a textual marker."""
    marked = ["hospital_seq", "sofa_first", "sapsi_first"]
    return _stays(a).select(
        "subject_id",
        "icustay_seq",
        *[
            F.coalesce(F.col(c).cast("string"), F.lit(NULL_SENTINEL)).alias(c)
            for c in marked
        ],
    )


@query
def sofa_by_sequence(a):
    return _rounded(an.severity_by_sequence(_severity_extract(a), "sofa_first"), "sd")


@query
def saps_by_sequence(a):
    return _rounded(an.severity_by_sequence(_severity_extract(a), "sapsi_first"), "sd")


@query
def severity_ci(a):
    return profile.ci_by(_stays(a).filter("icustay_seq = 1"), "hospital_seq", "sofa_first")


@query
def severity_summary(a):
    return _five(
        _stays(a).filter("icustay_seq = 1"), ["sofa_first", "sapsi_first"]
    )


@query
def severity_vs_total(a):
    return an.severity_vs_total(_stays(a), a.admissions())


@query
def severity_track(a):
    return an.severity_track(_severity_extract(a))


@query
def severity_track_high(a):
    return an.severity_track(_severity_extract(a)).filter("subject_max > 20")


@query
def care_margins(a):
    """Stays by care unit, by admission source and by treatment, in one aggregation."""
    flags = an.procedure_flags(a.procedures(), PROCEDURE_LISTS)
    rows = an.care_settings(_stays(a), a.demographics(), flags)
    values = {"admissions": F.col("hospital_seq"), "days": F.col("icustay_los") / 1440.0}
    return profile.margins(rows, ["care_unit", "admission_source", "treatment"], values)


# -- survival and models ---------------------------------------------------


def _curve(df: DataFrame) -> DataFrame:
    return _rounded(df, "survival", "std_error", "lower", "upper")


@query
def survival_first(a):
    return _curve(survival.kaplan_meier(an.time_to_death_first(_stays(a))))


@query
def survival_by_group(a):
    curves = survival.kaplan_meier(an.time_to_death_first(_stays(a)), strata=["gender"])
    return _curve(curves)


@query
def death_at_nth(a):
    return an.death_at_nth(_stays(a))


@query
def survival_discharge(a):
    curve = survival.kaplan_meier(
        an.time_to_death_discharge(_stays(a)), positive_only=True
    )
    return _curve(curve)


@query
def survival_minutes(a):
    """The first curve with the time of day of the admission kept."""
    first = an.first_admission_rows(_stays(a))
    days = elapsed_days(F.col("hospital_admit_dt"), F.col("dod").cast("timestamp_ntz"))
    event = F.when(F.col("expire_flg") == "Y", 1).otherwise(0)
    return _curve(survival.kaplan_meier(first.select("subject_id", days.alias("days"), event.alias("event"))))


@query
def readmission_risk(a):
    """Mean number of further admissions up to each day since the first one."""
    events, followed = an.readmissions(a.admissions(), a.patients())
    return _rounded(survival.mean_cumulative(events, followed), "mean_events", "std_error")


@query
def outpatient_deaths(a):
    return an.outpatient_deaths(_stays(a))


def _mortality_rows(a):
    first = an.first_comorbidities(
        members(a.admissions(), _cohort(a)), a.comorbidities()
    )
    died = F.when(F.col("expire_flg") == "Y", 1).otherwise(0).alias("died")
    return first.join(a.patients().select("subject_id", died), "subject_id")


def _coefficients(table: DataFrame) -> DataFrame:
    names = ["estimate", "std_error", "t_value"]
    return _rounded(table, *names).withColumns({c: F.col(c) + 0.0 for c in names}).drop("p_value")


@query
def mortality_model(a):
    return _coefficients(
        model.linear_model(
            _mortality_rows(a), "died", model.main_effects(sorted(COMORBIDITIES))
        )
    )


@query
def mortality_interactions(a):
    return _coefficients(
        model.linear_model(
            _mortality_rows(a), "died", model.full_interactions(INTERACTION_FLAGS)
        )
    )


@query
def mortality_summary(a):
    """Degrees of freedom, dispersion, deviances and AIC of the main-effects model."""
    found = model.model_summary(
        _mortality_rows(a), "died", model.main_effects(sorted(COMORBIDITIES))
    )
    return _rounded(found, "dispersion", "deviance", "null_deviance", "aic")


@query
def mortality_interactions_fitted(a):
    """Fitted values of the interaction model by flag pattern; saturated, so they are means."""
    rows = _mortality_rows(a)
    terms = model.full_interactions(INTERACTION_FLAGS)
    cells = rows.groupBy(*INTERACTION_FLAGS).agg(F.count("*").alias("n"))
    found = model.linear_model(rows, "died", terms)
    return _rounded(an.fitted(cells, found, terms, model.INTERCEPT), "fitted")


# -- completeness ----------------------------------------------------------


@query
def id_completeness(a):
    return audit.id_completeness(
        {
            "admissions": (a.admissions(), "hadm_id"),
            "stays": (a.stays(), "hadm_id"),
            "diagnoses": (a.diagnoses(), "hadm_id"),
            "notes": (a.notes(), "hadm_id"),
        }
    )


@query
def separate_admissions_lost(a):
    """First ICU stays, and those without an admission id."""
    return audit.id_completeness(
        {"first stays": (a.stays().filter("icustay_seq = 1"), "hadm_id")}
    )


@query
def hadm_overlap(a):
    return audit.id_overlap(a.stays(), a.diagnoses(), "hadm_id")


@query
def missing_value_counts(a):
    return audit.missing_counts(
        a.stays(),
        ["icustay_id", "subject_id", "hadm_id", "dod", "hospital_seq", "hospital_los",
         "hospital_expire_flg", "hospital_last_flg", "sofa_first", "sapsi_first"],
    )


@query
def missing_admissions(a):
    return audit.missing_ids(a.admissions(), a.stays(), "hadm_id")


@query
def missing_subjects(a):
    return audit.missing_ids(a.patients(), a.notes(), "subject_id")


@query
def below_threshold(a):
    return audit.below_threshold(_stays(a))


# -- diagnoses and costs ---------------------------------------------------


@query
def icd9_tally(a):
    return ex.code_tally(members(a.diagnoses(), _subjects(a)), a.diagnosis_names())


@query
def icd9_by_sequence(a):
    return ex.code_by_admission_order(
        members(a.diagnoses(), _subjects(a)), a.stays(), a.diagnosis_names()
    )


@query
def icd9_tally_detailed(a):
    """The same by whole codes, of which many lack a priority."""
    names = a.diagnoses().groupBy("code").agg(F.min("description").alias("description"))
    return ex.code_tally(members(a.diagnoses(), _subjects(a)), names, stop="|")


@query
def icd9_tally_top(a):
    """The 20 most common primary diagnoses."""
    return icd9_tally(a).limit(20)


@query
def icd9_by_sequence_top(a):
    return icd9_by_sequence(a).limit(20)


@query
def drg_per_admission(a):
    return an.mean_cost_per_admission(members(a.cost_events(), _subjects(a)))


@query
def drg_summary(a):
    return _five(
        an.mean_cost_per_admission(members(a.cost_events(), _subjects(a))),
        ["mean_cost_wt"],
    )


# -- patient level ---------------------------------------------------------


@query
def elixhauser_first(a):
    first = an.first_comorbidities(
        members(a.admissions(), _cohort(a)), a.comorbidities()
    )
    return _five(an.elixhauser(first), ["elixhauser_sum"])


@query
def elixhauser_all(a):
    sums = an.elixhauser(ex.comorbidity_any(a.comorbidities(), _subjects(a)))
    return sums.agg(
        F.round(F.avg("elixhauser_sum"), 2).alias("mean"),
        F.round(F.stddev_samp("elixhauser_sum"), 2).alias("sd"),
    )


@query
def comorbidity_prevalence(a):
    flags = ex.comorbidity_any(a.comorbidities(), _subjects(a))
    return profile.flag_prevalence(flags, COMORBIDITIES, "comorbidity").orderBy(
        F.desc("n"), "comorbidity"
    )


@query
def admissions_tally(a):
    return profile.tally(
        members(a.admissions(), _subjects(a)), "subject_id", "hadm_count", "no_patients"
    )


@query
def stays_tally(a):
    return profile.tally(_stays(a), "subject_id", "icu_count", "no_patients")


@query
def mortality_table(a):
    return an.mortality_table(a.admissions(), _stays(a), _cohort(a))


@query
def mortality_table_by_id(a):
    return an.mortality_table(a.admissions(), _stays(a), _cohort(a), last_by="hadm_id")
