"""Declared schemas of the tables and extract files."""

from __future__ import annotations

from carecycle.functions.vocab import (
    ANNOTATION_FEATURES,
    ANNOTATION_IDS,
    COMORBIDITIES,
    STAY_COLUMNS,
)

# Parquet tables of the test data.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

_LONG = {"icustay_id", "subject_id", "hadm_id"}
_DATES = {"dob", "dod"}
_TIMES = {"hospital_admit_dt", "hospital_disch_dt", "icustay_intime", "icustay_outtime"}
_DOUBLES = {
    "hospital_los", "icustay_admit_age", "icustay_los", "height", "weight_first",
    "weight_min", "weight_max",
}
# Severity scores are text: extracts write missing ones as a textual marker.
_TEXTS = {
    "gender", "expire_flg", "hospital_first_flg", "hospital_last_flg",
    "hospital_expire_flg", "icustay_first_flg", "icustay_last_flg", "icustay_age_group",
    "icustay_expire_flg", "icustay_first_careunit", "icustay_last_careunit",
    "icustay_first_service", "icustay_last_service", "sapsi_first", "sapsi_min",
    "sapsi_max", "sofa_first", "sofa_min", "sofa_max",
}


def _stay_type(column: str) -> str:
    for names, kind in (
        (_LONG, "bigint"), (_DATES, "date"), (_TIMES, "timestamp_ntz"),
        (_DOUBLES, "double"), (_TEXTS, "string"),
    ):
        if column in names:
            return kind
    return "int"


STAYS = ", ".join(f"{c} {_stay_type(c)}" for c in STAY_COLUMNS)

# Header-less extracts carry a leading row index.
STAYS_EXTRACT = f"index bigint, {STAYS}"
DEMOGRAPHICS_EXTRACT = (
    "index bigint, subject_id bigint, hadm_id bigint, admit_age double, gender string, "
    "dod date, marital_status string, ethnicity string, overall_payor_group string, "
    "religion string, admission_type string, admission_source string, "
    "hospital_expire_flg string, expire_flg string"
)
COMORBIDITY_EXTRACT = (
    "index bigint, subject_id bigint, hadm_id bigint, category string, "
    + ", ".join(f"{c} int" for c in COMORBIDITIES)
)
FREQUENCY_EXTRACT = "hospital_seq int, number_of_patients bigint"
VENTILATION_EXTRACT = (
    "index bigint, subject_id bigint, icustay_id bigint, seq int, begin_time string, "
    "end_time string"
)

# Diagnosis codes, separated by semicolons.
CODE_EXTRACT = "code string, subject_id bigint, hadm_id bigint, description string, sequence int"

# Annotation results: 22 columns in the file, operator and batch in its name.
ANNOTATION_RESULTS = ", ".join(
    [f"{c} bigint" if c.endswith("_id") else f"{c} string" for c in ANNOTATION_IDS]
    + [f"{c} int" for c in ANNOTATION_FEATURES]
)
