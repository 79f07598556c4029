"""Names, code lists and labels that must equal the source data's own.

Fixed values: column names of the extracts, label sets and item codes.
"""

STAY_COLUMNS = [
    "icustay_id", "subject_id", "gender", "dob", "dod", "expire_flg",
    "subject_icustay_total_num", "subject_icustay_seq", "hadm_id",
    "hospital_total_num", "hospital_seq", "hospital_first_flg",
    "hospital_last_flg", "hospital_admit_dt", "hospital_disch_dt",
    "hospital_los", "hospital_expire_flg", "icustay_total_num", "icustay_seq",
    "icustay_first_flg", "icustay_last_flg", "icustay_intime",
    "icustay_outtime", "icustay_admit_age", "icustay_age_group", "icustay_los",
    "icustay_expire_flg", "icustay_first_careunit", "icustay_last_careunit",
    "icustay_first_service", "icustay_last_service", "height", "weight_first",
    "weight_min", "weight_max", "sapsi_first", "sapsi_min", "sapsi_max",
    "sofa_first", "sofa_min", "sofa_max", "matched_waveforms_num",
]

COMORBIDITIES = [
    "congestive_heart_failure", "cardiac_arrhythmias", "valvular_disease",
    "pulmonary_circulation", "peripheral_vascular", "hypertension",
    "paralysis", "other_neurological", "chronic_pulmonary",
    "diabetes_uncomplicated", "diabetes_complicated", "hypothyroidism",
    "renal_failure", "liver_disease", "peptic_ulcer", "aids", "lymphoma",
    "metastatic_cancer", "solid_tumor", "rheumatoid_arthritis",
    "coagulopathy", "obesity", "weight_loss", "fluid_electrolyte",
    "blood_loss_anemia", "deficiency_anemias", "alcohol_abuse", "drug_abuse",
    "psychoses", "depression",
]

# The seven flags of the full-interaction mortality model.
INTERACTION_FLAGS = [
    "aids", "alcohol_abuse", "depression", "drug_abuse", "liver_disease",
    "obesity", "psychoses",
]

ANNOTATION_FEATURES = [
    "none", "obesity", "non_adherence", "developmental_delay_retardation",
    "advanced_heart_disease", "advanced_lung_disease",
    "schizophrenia_and_other_psychiatric_disorders", "alcohol_abuse",
    "other_substance_abuse", "chronic_pain_fibromyalgia",
    "chronic_neurological_dystrophies", "advanced_cancer", "depression",
    "dementia", "unsure",
]

ANNOTATION_IDS = [
    "subject_id", "hadm_id", "icu_id", "note_type", "chart_time", "category",
    "real_time",
]

VENTILATION_ITEMS = [720, 722]
PRESSOR_ITEMS = [42, 43, 44, 46, 47, 51, 119, 120, 125, 127, 128, 306, 307, 309]

NULL_SENTINEL = "(null)"

# Category and title patterns of the note types.
DISCHARGE_CATEGORY = "DISCHARGE_SUMMARY"
DISCHARGE_TITLE = "discharge"
PHYSICIAN_CATEGORY = "MD"
NURSING_CATEGORY = "Nursing/Other"
NEONATE = "neonate"

# Label merges with known raw labels. Marital status and religion have no
# recoverable raw labels, so their maps are always the caller's.
ETHNICITY_GROUPS = {
    "HISPANIC OR LATINO": "HISPANIC",
    "HISPANIC/LATINO - GUATEMALAN": "HISPANIC",
    "BLACK/AFRICAN AMERICAN": "BLACK",
    "BLACK/CAPE VERDEAN": "BLACK",
    "MIDDLE EASTERN": "OTHER",
    "MULTI RACE ETHNICITY": "OTHER",
    "UNKNOWN/NOT SPECIFIED": "UNKNOWN",
    "PATIENT DECLINED TO ANSWER": "UNKNOWN",
}
PAYOR_GROUPS = {
    "AUTO LIABILITY": "OTHER",
    "FREE CARE": "OTHER",
    "MEDICAID": "MEDICARE/MEDICAID",
    "MEDICARE": "MEDICARE/MEDICAID",
    "MEDICARE-PRIVATE": "MEDICARE/MEDICAID",
    "SELF-PAY": "OTHER",
}
