"""The same queries as plain SQL, to check the Spark results against.

Repeat cohorts are written as the self-join they mean. Entity views and shared
relations are common table expressions; ``_sql`` puts the needed ones in front.
"""

from __future__ import annotations

import re
from itertools import combinations

from carecycle.functions.vocab import (
    ANNOTATION_FEATURES,
    ANNOTATION_IDS,
    COMORBIDITIES,
    INTERACTION_FLAGS,
)

_FLAG_CONDITIONS = [f"p_brand = 'Brand#{i}'" for i in range(1, 26)] + [
    f"p_type = '{t}'" for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL")
]
_FLAGS = ", ".join(
    f"CAST(max(CASE WHEN {c} THEN 1 ELSE 0 END) AS INTEGER) AS {name}"
    for name, c in zip(COMORBIDITIES, _FLAG_CONDITIONS)
)
_FLAG_LIST = ", ".join(COMORBIDITIES)
_FLAG_SUM = " + ".join(COMORBIDITIES)
_ANY = ", ".join(
    f"CAST(CASE WHEN sum({f}) > 0 THEN 1 ELSE 0 END AS INTEGER) AS {f}" for f in COMORBIDITIES
)
_FEATURES = ", ".join(
    f"CAST(CASE WHEN (l_partkey + {i}) % {i + 2} = 0 THEN 1 ELSE 0 END AS INTEGER) AS \"{f}\""
    for i, f in enumerate(ANNOTATION_FEATURES)
)
_FEATURE_LIST = ", ".join(f'"{f}"' for f in ANNOTATION_FEATURES)


def _cohort(min_further: int, upper: str = "CAST(a.admit_dt AS DATE) + 365") -> str:
    return f"""
        SELECT DISTINCT subject_id FROM (
          SELECT a.subject_id, a.hadm_id, count(*) AS adm_count
          FROM admissions a JOIN admissions b
            ON a.subject_id = b.subject_id AND a.hadm_id <> b.hadm_id
           AND b.admit_dt BETWEEN a.admit_dt AND {upper}
          GROUP BY 1, 2) WHERE adm_count >= {min_further}"""


def _adult_cohort(min_further: int) -> str:
    return f"""
        SELECT DISTINCT subject_id FROM (
          SELECT a.subject_id, a.hadm_id, count(*) AS adm_count
          FROM admissions a
          JOIN patients p ON a.subject_id = p.subject_id
          JOIN admissions b
            ON a.subject_id = b.subject_id AND a.hadm_id <> b.hadm_id
           AND b.admit_dt BETWEEN a.admit_dt AND a.admit_dt + INTERVAL 365 DAY
          WHERE a.admit_dt > CAST(p.dob AS TIMESTAMP) + INTERVAL 5840 DAY
          GROUP BY 1, 2) WHERE adm_count >= {min_further}"""


def _seeded(seed: str, key: str) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"


_DISCHARGE = "(category LIKE '%DISCHARGE_SUMMARY%' OR lower(title) LIKE '%discharge%')"
_PHYSICIAN = "category LIKE '%MD%'"
_NURSING = "category LIKE '%Nursing/Other%'"


def _first_note(subjects: str) -> str:
    return f"""
        SELECT * EXCLUDE (rk) FROM (
          SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY charttime, note_id) AS rk
          FROM notes
          WHERE hadm_id IS NOT NULL AND {_NURSING}
            AND subject_id IN (SELECT subject_id FROM {subjects})) WHERE rk = 1"""


_VIEWS = {
    "admissions": """
        SELECT o_custkey AS subject_id, o_orderkey AS hadm_id,
               o_orderdate + to_hours(o_orderkey % 24) AS admit_dt,
               o_orderdate + to_hours(o_orderkey % 24)
                 + to_minutes(CAST(floor(o_totalprice / 20) AS BIGINT)) AS disch_dt
        FROM orders""",
    "patients": """
        SELECT c_custkey AS subject_id,
               CASE WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
               DATE '1985-01-01' - 5 * CAST(floor(c_acctbal) AS INTEGER) AS dob,
               CASE WHEN c_acctbal < 2500
                    THEN DATE '1998-06-01' + CAST(floor(c_acctbal) AS INTEGER) END AS dod,
               CASE WHEN c_acctbal < 2500 THEN 'Y' ELSE 'N' END AS expire_flg
        FROM customer""",
    "stay_lines": """
        SELECT l_orderkey, l_linenumber, sum(l_quantity) AS qty, max(l_discount) AS disc,
               max(l_tax) AS tax,
               max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS a,
               max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS n,
               max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS f,
        FROM lineitem GROUP BY 1, 2""",
    "stays_base": """
        SELECT *, qty > 2 AS linked,
               (year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) AS qtr,
               o_orderdate + to_hours(o_orderkey % 24) AS admit,
               CAST(floor(o_totalprice / 20) AS BIGINT) AS hlos,
               o_orderdate + to_hours(o_orderkey % 24) + to_days(l_linenumber - 1) AS intime
        FROM stay_lines
        JOIN orders ON l_orderkey = o_orderkey
        JOIN patients ON o_custkey = subject_id""",
    "stays": """
        SELECT l_orderkey * 8 + l_linenumber AS icustay_id, subject_id,
               CASE WHEN linked THEN l_orderkey END AS hadm_id,
               gender, dob, dod, expire_flg,
               CAST((qtr - 1) * 7 + l_linenumber AS INTEGER) AS subject_icustay_seq,
               CASE WHEN linked THEN CAST(qtr AS INTEGER) END AS hospital_seq,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Y'
                    WHEN o_orderpriority <> '5-LOW' THEN 'N' END AS hospital_last_flg,
               CASE WHEN linked THEN admit END AS hospital_admit_dt,
               CASE WHEN linked THEN admit + to_minutes(hlos) END AS hospital_disch_dt,
               CASE WHEN linked THEN CAST(hlos AS DOUBLE) END AS hospital_los,
               CASE o_orderstatus WHEN 'F' THEN 'Y' WHEN 'O' THEN 'N' END
                 AS hospital_expire_flg,
               l_linenumber AS icustay_seq,
               CASE WHEN n = 0 THEN 'Y' ELSE 'N' END AS icustay_last_flg,
               intime AS icustay_intime,
               intime + to_minutes(CAST(qty * 100 AS BIGINT)) AS icustay_outtime,
               CAST(CAST(intime AS DATE) - dob AS DOUBLE) / CAST(365.25 AS DOUBLE)
                 AS icustay_admit_age,
               CASE WHEN CAST(intime AS DATE) - dob < 365.25 THEN 'neonate'
                    WHEN CAST(intime AS DATE) - dob < 365.25 * 16 THEN 'middle'
                    ELSE 'adult' END AS icustay_age_group,
               qty * 100 AS icustay_los,
               CASE WHEN f = 1 AND a = 1 THEN 'Y' ELSE 'N' END AS icustay_expire_flg,
               CASE WHEN a = 1 THEN 'MICU' WHEN n = 1 THEN 'SICU' ELSE 'CCU' END
                 AS icustay_first_careunit,
               CASE WHEN f = 1 THEN 'MED' ELSE 'SURG' END AS icustay_first_service,
               CASE WHEN n = 1 THEN 'MED' ELSE 'SURG' END AS icustay_last_service,
               CASE WHEN tax > 0.005 THEN CAST(round(disc * 100) AS INTEGER) END AS sofa_first,
               CASE WHEN tax < 0.075 THEN CAST(qty AS INTEGER) END AS sapsi_first
        FROM stays_base""",
    "demo": """
        SELECT o_custkey AS subject_id, o_orderkey AS hadm_id,
               c_mktsegment AS overall_payor_group_descr,
               o_orderpriority AS admission_type_descr,
               o_orderstatus AS admission_source_descr,
               CASE c_nationkey % 5 WHEN 0 THEN 'MARRIED' WHEN 1 THEN 'SINGLE'
                    WHEN 2 THEN 'WIDOWED' WHEN 3 THEN 'UNKNOWN' END AS marital_status_descr,
               r_name AS ethnicity_descr, n_name AS religion_descr
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "comorbidities": f"""
        SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, {_FLAG_LIST}
        FROM (SELECT l_orderkey, {_FLAGS}
              FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
        JOIN orders ON l_orderkey = o_orderkey""",
    "diagnoses": """
        SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, l_linenumber AS sequence,
               p_brand || '.' || CAST(p_size AS VARCHAR) AS code,
               p_type || ' ' || p_name AS description
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN part ON l_partkey = p_partkey""",
    "diagnosis_names": """
        SELECT DISTINCT p_brand AS code, 'about ' || lower(p_brand) AS description
        FROM part""",
    "cost_events": """
        SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, l_partkey AS itemid,
               CASE WHEN l_discount > 0 THEN CAST(l_extendedprice AS DECIMAL(12, 2)) END
                 AS cost_weight
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "cost_items": "SELECT p_partkey AS itemid, p_name AS description FROM part",
    "procedures": """
        SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, l_suppkey AS itemid
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "procedure_items": """
        SELECT s_suppkey AS itemid, s_name AS description FROM supplier WHERE s_acctbal > 0""",
    "monitored": """
        SELECT c_custkey AS icustay_id, c_custkey // 3 AS subject_id, c_custkey * 10 AS hadm_id
        FROM customer WHERE NOT c_acctbal < -660""",
    "med_events": """
        SELECT user_id AS icustay_id, event_type AS itemid, ts AS charttime,
               CASE WHEN value < 5 THEN 0 WHEN value < 10 THEN -value ELSE value END AS dose
        FROM events""",
    "notes": """
        SELECT doc_id AS note_id, doc_id // 8 AS subject_id,
               CASE WHEN lang <> 'fr' THEN doc_id // 4 END AS hadm_id,
               doc_id // 4 * 8 + 1 + doc_id % 7 AS icustay_id,
               TIMESTAMP '2000-01-01' + to_minutes(n_chars) AS charttime,
               CASE WHEN CAST(substr(source, 4) AS INTEGER) < 5 THEN 'DISCHARGE_SUMMARY'
                    WHEN CAST(substr(source, 4) AS INTEGER) < 10 THEN 'MD Notes'
                    ELSE 'Nursing/Other' END AS category,
               CASE WHEN lang = 'de' THEN 'Discharge Planning'
                    WHEN lang <> 'es' THEN 'Note' END AS title,
               text
        FROM documents""",
    "note_stays": """
        SELECT doc_id AS note_id, (doc_id * 15 + k) * 8 + line AS icustay_id
        FROM documents, range(15) a(k), range(1, 8) b(line)""",
    "annotations": f"""
        SELECT l_suppkey AS subject_id, l_orderkey AS hadm_id, l_orderkey * 2 AS icu_id,
               'dis' AS note_type, strftime(l_shipdate, '%Y-%m-%d') AS chart_time,
               'Discharge' AS category, strftime(l_shipdate, '%m/%d/%Y') AS real_time,
               {_FEATURES},
               l_returnflag || '-' || l_linestatus AS operator,
               'bat' || lpad(CAST(l_linenumber AS VARCHAR), 7, '0') AS batch_id,
               md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                             strftime(l_shipdate, '%Y-%m-%d'))) AS annotation_id
        FROM lineitem""",
    "annotated_notes": """
        SELECT doc_id * 3 AS subject_id, doc_id AS hadm_id, 'Discharge' AS category, text,
               CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS cohort,
               'bat000000' || CAST(doc_id % 7 + 1 AS VARCHAR) AS batch_id
        FROM documents""",
    "missing_notes": "SELECT o_orderkey AS hadm_id FROM orders WHERE o_orderpriority = '1-URGENT'",
    "adjudicated": """
        SELECT o_orderkey * 2 AS icu_id FROM orders WHERE o_orderpriority = '1-URGENT'""",
    # Shared relations.
    "cohort": _cohort(2),
    "cohort_many": _cohort(5),
    "cohort_adult_many": _adult_cohort(5),
    "adult": "SELECT * FROM stays WHERE lower(icustay_age_group) NOT LIKE '%neonate%'",
    "cohort_stays": "SELECT * FROM adult WHERE subject_id IN (SELECT subject_id FROM cohort)",
    "subjects": "SELECT DISTINCT subject_id FROM cohort_stays",
    "category": """
        SELECT subject_id, hadm_id, overall_payor_group_descr AS overall_payor_group,
               admission_type_descr AS admission_type, admission_source_descr AS admission_source
        FROM demo WHERE subject_id IN (SELECT subject_id FROM subjects)""",
    "demographics": """
        SELECT d.subject_id, d.hadm_id, s.icustay_id, s.icustay_seq, s.subject_icustay_seq,
               s.icustay_admit_age AS admit_age, s.gender, s.dod,
               d.marital_status_descr AS marital_status, d.ethnicity_descr AS ethnicity,
               d.overall_payor_group_descr AS overall_payor_group,
               d.religion_descr AS religion, d.admission_type_descr AS admission_type,
               d.admission_source_descr AS admission_source,
               s.hospital_expire_flg, s.expire_flg
        FROM cohort_stays s JOIN demo d ON s.hadm_id = d.hadm_id""",
    "first_demographics": """
        SELECT * EXCLUDE (rk) FROM (
          SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY hadm_id, icustay_id) AS rk
          FROM demographics) WHERE rk = 1""",
    "dummies": """
        SELECT subject_id,
               CASE WHEN admit_age >= 90 THEN CAST(91.4 AS DOUBLE) ELSE admit_age END AS admit_age,
               CAST(gender = 'M' AS INTEGER) AS male, CAST(gender = 'F' AS INTEGER) AS female,
               CASE WHEN marital_status = 'UNKNOWN' THEN NULL
                    ELSE CAST(marital_status = 'MARRIED' AS INTEGER) END AS married,
               CAST(ethnicity = 'AFRICA' AS INTEGER) AS black,
               CAST(ethnicity = 'EUROPE' AS INTEGER) AS white,
               CAST(ethnicity = 'ASIA' AS INTEGER) AS asian,
               CAST(ethnicity = 'AMERICA' AS INTEGER) AS hispanic,
               CAST(ethnicity = 'MIDDLE EAST' AS INTEGER) AS other_eth,
               CAST(ethnicity IS NULL AS INTEGER) AS unknown_eth,
               CAST(overall_payor_group IN ('BUILDING', 'MACHINERY') AS INTEGER)
                 AS medicare_medicaid,
               CAST(overall_payor_group = 'HOUSEHOLD' AS INTEGER) AS private,
               CAST(overall_payor_group IN ('AUTOMOBILE', 'FURNITURE') AS INTEGER) AS other_payor,
               CAST(expire_flg = 'Y' AS INTEGER) AS died
        FROM first_demographics""",
    "any_comorbidities": f"""
        SELECT subject_id, {_ANY} FROM (
          SELECT DISTINCT * FROM comorbidities
          WHERE subject_id IN (SELECT subject_id FROM subjects)) GROUP BY subject_id""",
    "mortality_rows": """
        SELECT f.*, CAST(p.expire_flg = 'Y' AS INTEGER) AS died
        FROM first_comorbidities f JOIN patients p ON f.subject_id = p.subject_id""",
    "eol": """
        SELECT * FROM stays WHERE expire_flg LIKE '%Y%'
          AND dod BETWEEN icustay_intime AND CAST(icustay_intime AS DATE) + 30""",
    "eol_last": "SELECT * FROM eol WHERE icustay_last_flg LIKE '%Y%'",
    "negatives": f"""
        SELECT subject_id FROM (SELECT DISTINCT subject_id FROM adult
          WHERE subject_id NOT IN (SELECT subject_id FROM cohort_many))
        ORDER BY {_seeded("carecycle", "subject_id")}, subject_id LIMIT 408""",
    "neg_discharge": f"""
        SELECT * FROM notes WHERE subject_id IN (SELECT subject_id FROM negatives)
          AND {_DISCHARGE}""",
    "vent": """
        SELECT user_id AS icustay_id, min(ts) AS start_time, max(ts) AS stop_time
        FROM events WHERE event_type IN ('view', 'click') GROUP BY 1""",
    "press_given": """
        SELECT DISTINCT icustay_id FROM med_events
        WHERE itemid IN ('purchase', 'error') AND dose <> 0""",
    "press": """
        SELECT icustay_id, min(charttime) AS start_time, max(charttime) AS stop_time
        FROM med_events WHERE itemid IN ('purchase', 'error') AND dose > 0 GROUP BY 1""",
    "treatments": """
        SELECT c.icustay_id, c.subject_id, c.hadm_id,
               CASE WHEN v.icustay_id IS NULL THEN 0 ELSE 1 END AS mech_vent,
               datesub('minute', v.start_time, v.stop_time) / CAST(1440 AS DOUBLE)
                 AS days_on_vent,
               v.start_time AS vent_start_dt, v.stop_time AS vent_stop_dt,
               CASE WHEN g.icustay_id IS NULL THEN 0 ELSE 1 END AS vasopressors,
               datesub('minute', p.start_time, p.stop_time) / CAST(1440 AS DOUBLE)
                 AS days_on_pressors,
               p.start_time AS press_start_dt, p.stop_time AS press_stop_dt
        FROM monitored c LEFT JOIN vent v ON v.icustay_id = c.icustay_id
        LEFT JOIN press_given g ON g.icustay_id = c.icustay_id
        LEFT JOIN press p ON p.icustay_id = c.icustay_id""",
    "results": f"""
        SELECT DISTINCT {", ".join(ANNOTATION_IDS)}, {_FEATURE_LIST}, operator, batch_id
        FROM annotations""",
    "reconciled": """
        SELECT n.subject_id AS note_subject_id, n.category AS note_category, n.text, n.cohort,
               r.*
        FROM annotated_notes n JOIN results r
          ON n.hadm_id = r.hadm_id AND n.batch_id = r.batch_id AND r.operator <> 'R-O'
        UNION ALL
        SELECT n.subject_id, n.category, n.text, n.cohort, r.*
        FROM annotated_notes n JOIN results r
          ON n.hadm_id = r.hadm_id AND r.operator = 'R-O'""",
    "feature_rows": f"""
        SELECT icu_id, feature, value FROM annotations
        UNPIVOT (value FOR feature IN ({_FEATURE_LIST}))""",
    "compared": """
        SELECT icu_id, feature, count(*) AS num_notes, CAST(avg(value) AS DOUBLE) AS mean,
               CAST(sum(value) AS BIGINT) AS pos_note,
               sum(value) = 0 OR sum(value) = count(*) AS agree
        FROM feature_rows GROUP BY 1, 2 HAVING count(*) >= 2""",
    "disputed": f"""
        SELECT icu_id,
               {", ".join(f"CAST(max(CASE WHEN feature = '{f}' AND NOT agree THEN 1 ELSE 0 END) AS INTEGER) AS {chr(34)}{f}{chr(34)}" for f in ANNOTATION_FEATURES)},
               CAST(sum(CASE WHEN agree THEN 0 ELSE 1 END) AS INTEGER) AS sum_disagree
        FROM compared GROUP BY 1""",
    "unsure_ids": "SELECT DISTINCT icu_id FROM annotations WHERE unsure = 1",
    "remaining": "SELECT icu_id FROM unsure_ids EXCEPT SELECT icu_id FROM adjudicated",
    "severity": """
        SELECT subject_id, hospital_seq, sofa_first, sapsi_first FROM cohort_stays
        WHERE icustay_seq = 1 AND hospital_seq IS NOT NULL""",
    "track": """
        SELECT subject_id, hospital_seq, sapsi_first, subject_max,
               CASE WHEN subject_max <= 3 THEN '1-3 Admissions'
                    WHEN subject_max <= 10 THEN '4-10 Admissions'
                    WHEN subject_max <= 20 THEN '11-20 Admissions'
                    ELSE '> 20 Admissions' END AS admission_group
        FROM (SELECT *, max(hospital_seq) OVER (PARTITION BY subject_id) AS subject_max
              FROM severity WHERE sapsi_first IS NOT NULL)""",
    "first_rows": """
        SELECT * EXCLUDE (rk) FROM (
          SELECT *, row_number() OVER (PARTITION BY subject_id
                                       ORDER BY hospital_seq, icustay_id) AS rk
          FROM cohort_stays WHERE hospital_seq IS NOT NULL) WHERE rk = 1""",
    "first_death": """
        SELECT subject_id, gender, CAST(expire_flg = 'Y' AS INTEGER) AS event,
               coalesce(raw_days, max(raw_days) OVER ()) AS days
        FROM (SELECT *, dod - CAST(hospital_admit_dt AS DATE) AS raw_days FROM first_rows)""",
    "first_death_minutes": """
        SELECT subject_id, CAST(expire_flg = 'Y' AS INTEGER) AS event,
               coalesce(raw_days, max(raw_days) OVER ()) AS days
        FROM (SELECT *, datesub('minute', hospital_admit_dt, CAST(dod AS TIMESTAMP)) / CAST(1440 AS DOUBLE) AS raw_days
              FROM first_rows)""",
    "admission_order": """
        SELECT subject_id, CAST(admit_dt AS DATE) AS day,
               first_value(CAST(admit_dt AS DATE)) OVER w AS first_day, row_number() OVER w AS nth
        FROM admissions WINDOW w AS (PARTITION BY subject_id ORDER BY admit_dt, hadm_id)""",
    "readmitted": "SELECT subject_id, day - first_day AS days FROM admission_order WHERE nth > 1",
    "followed": """
        SELECT subject_id, least(dod, (SELECT max(day) FROM admission_order)) - first_day AS days
        FROM admission_order JOIN patients USING (subject_id) WHERE nth = 1""",
    "left_alive": """
        SELECT * EXCLUDE (rk) FROM (
          SELECT *, row_number() OVER (PARTITION BY subject_id
                                       ORDER BY hospital_seq NULLS LAST, icustay_id) AS rk
          FROM cohort_stays
          WHERE hospital_expire_flg = 'N' AND hospital_last_flg = 'Y'
            AND icustay_last_flg = 'Y') WHERE rk = 1""",
    "discharge_death": """
        SELECT * FROM (
          SELECT subject_id, CAST(expire_flg = 'Y' AS INTEGER) AS event,
                 coalesce(raw_days, max(raw_days) OVER ()) AS days
          FROM (SELECT *, dod - CAST(hospital_disch_dt AS DATE) AS raw_days FROM left_alive))
        WHERE days > 0""",
    "cohort_diagnoses": """
        SELECT * FROM diagnoses WHERE subject_id IN (SELECT subject_id FROM subjects)""",
    "top_diagnoses": """
        SELECT d.subject_id, d.hadm_id, d.sequence, n.description
        FROM cohort_diagnoses d JOIN diagnosis_names n
          ON split_part(d.code, '.', 1) = n.code
        WHERE d.sequence < 4""",
    "cohort_costs": """
        SELECT * FROM cost_events WHERE subject_id IN (SELECT subject_id FROM subjects)""",
    "admission_costs": """
        SELECT hadm_id, CAST(sum(cost_weight) AS DOUBLE) / count(cost_weight) AS mean_cost_wt FROM cohort_costs GROUP BY 1""",
    "first_comorbidities": """
        SELECT c.* FROM comorbidities c JOIN (
          SELECT hadm_id, row_number() OVER (PARTITION BY subject_id
                                             ORDER BY admit_dt, hadm_id) AS rk
          FROM admissions WHERE subject_id IN (SELECT subject_id FROM cohort)) f
        ON c.hadm_id = f.hadm_id AND f.rk = 1""",
    "deaths": """
        SELECT subject_id,
               max(CASE WHEN hospital_expire_flg = 'Y' OR icustay_expire_flg = 'Y'
                        THEN 1 ELSE 0 END) AS died_in_hosp,
               max(dod) AS dod, max(CASE WHEN expire_flg = 'Y' THEN 1 ELSE 0 END) AS expire_flg
        FROM cohort_stays GROUP BY 1""",
}


def _sql(body: str) -> str:
    """Put the common table expressions that ``body`` needs in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"[a-z_]+", text))
        for name, view in _VIEWS.items():
            if name in words and name not in needed:
                if re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                    visit(view)
                    if name not in needed:
                        needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({_VIEWS[n]})" for n in needed) + "\n" + body


def _kaplan_meier(source: str, strata: str | None = None) -> str:
    by = f"{strata}, " if strata else ""
    part = f"PARTITION BY {strata}" if strata else ""
    return f"""
        SELECT {by}days, CAST(at_risk AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events,
               round(s, 6) AS survival,
               CASE WHEN s > 0 THEN round(s * sqrt(v), 6) END AS std_error,
               CASE WHEN s > 0 THEN round(exp(ln(s) - 1.959963984540054 * sqrt(v)), 6) END AS lower,
               CASE WHEN s > 0 THEN round(least(exp(ln(s) + 1.959963984540054 * sqrt(v)), 1), 6) END
                 AS upper
        FROM (SELECT *, product(1 - d / at_risk) OVER ({part} ORDER BY days) AS s,
                     sum(CASE WHEN at_risk > d THEN d / (at_risk * (at_risk - d)) END)
                       OVER ({part} ORDER BY days) AS v
        FROM (SELECT *, sum(n) OVER ({part}) - sum(n) OVER ({part} ORDER BY days) + n AS at_risk
              FROM (SELECT {by}days, CAST(count(*) AS DOUBLE) AS n, CAST(sum(event) AS DOUBLE) AS d
                    FROM {source} GROUP BY {by}days)))"""


def _swept(terms: dict[str, list[str]]) -> str:
    """Relations that sweep the moment matrix of (1, terms, died) one term after the other.

    A term is skipped when the earlier ones leave at most 1e-9 of its centred
    square sum. ``swept`` has the last matrix and the terms in it.
    """
    k = len(terms)
    z = ", ".join(["1.0::DOUBLE", *(" * ".join(f) + "::DOUBLE" if len(f) == 1
                                    else "(" + " * ".join(f) + ")::DOUBLE" for f in terms.values()),
                   "died::DOUBLE"])
    return f"""
        z AS (SELECT [{z}] AS z FROM mortality_rows),
        cells AS (
          SELECT i, j, sum(z[i] * z[j]) AS v
          FROM z, range(1, {k + 3}) a(i), range(1, {k + 3}) b(j) GROUP BY i, j),
        lines AS (SELECT i, list(v ORDER BY j) AS line FROM cells GROUP BY i),
        start AS (
          SELECT list(line ORDER BY i) AS m, count(*) AS c FROM lines),
        size AS (SELECT count(*) AS n FROM z),
        sweep AS (
          SELECT 0 AS step, m, [0.0::DOUBLE] AS total, [0] AS used FROM start
          UNION ALL
          SELECT step + 1,
                 CASE WHEN ok THEN
                   list_transform(m, lambda r, i:
                     CASE WHEN i = p
                       THEN list_transform(r, lambda x, j: CASE WHEN j = p THEN -1 / d ELSE x / d END)
                       ELSE list_transform(r, lambda x, j:
                         CASE WHEN j = p THEN x / d ELSE x - r[p] * top[j] / d END) END)
                   ELSE m END,
                 CASE WHEN step = 0
                   THEN list_transform(m, lambda r, i: r[i] - r[1] * r[1] / m[1][1]) ELSE total END,
                 CASE WHEN ok THEN list_append(used, p) ELSE used END
          FROM (SELECT *, step + 1 AS p, m[step + 1] AS top, m[step + 1][step + 1] AS d,
                       step = 0 OR total[step + 1] > 1e-12
                         AND m[step + 1][step + 1] > 1e-9 * total[step + 1] AS ok
                FROM sweep WHERE step < {k + 1})),
        swept AS (SELECT * FROM sweep WHERE step = {k + 1})"""


def _model(terms: dict[str, list[str]]) -> str:
    k = len(terms)
    names = ", ".join(f"'{t}'" for t in ["(Intercept)", *terms])
    return f"""
        SELECT * FROM (WITH RECURSIVE {_swept(terms)},
        found AS (
          SELECT p, [{names}][p] AS term, list_contains(used, p) AS known, m[p][{k + 2}] AS b,
                 sqrt(-m[p][p] * m[{k + 2}][{k + 2}] / (n - len(used) + 1)) AS e
          FROM swept, size, range(1, {k + 2}) r(p))
        SELECT term, CASE WHEN known THEN round(b, 6) + 0.0 END AS estimate,
               CASE WHEN known THEN round(e, 6) + 0.0 END AS std_error,
               CASE WHEN known THEN round(b / e, 6) + 0.0 END AS t_value
        FROM found)"""


def _model_summary(terms: dict[str, list[str]]) -> str:
    y = len(terms) + 2
    return f"""
        SELECT * FROM (WITH RECURSIVE {_swept(terms)},
        fit AS (SELECT n, len(used) - 1 AS p, m[{y}][{y}] AS rss, total[{y}] AS tss FROM swept, size)
        SELECT n, p AS parameters, n - p AS df_residual, round(rss / (n - p), 6) AS dispersion,
               round(rss, 6) AS deviance, round(tss, 6) AS null_deviance,
               round(n * (ln(2 * pi() * rss / n) + 1) + 2 * (p + 1), 6) AS aic
        FROM fit)"""


_MAIN = {f: [f] for f in sorted(COMORBIDITIES)}
_PRODUCTS = {
    ":".join(c): list(c)
    for size in range(1, len(INTERACTION_FLAGS) + 1)
    for c in combinations(INTERACTION_FLAGS, size)
}


def _five_numbers(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n,
                   count(*) - count({c}) AS missing, CAST(min({c}) AS DOUBLE) AS min,
                   round(CAST(avg({c}) AS DOUBLE), 6) AS mean, CAST(max({c}) AS DOUBLE) AS max,
                   round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q1,
                   round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median,
                   round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q3
            FROM {source}"""
        for c in columns
    )


def _profile(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(CAST(avg({c}) AS DOUBLE), 6) AS mean,
                   round(stddev_samp({c}), 6) AS sd, CAST(min({c}) AS DOUBLE) AS min,
                   CAST(max({c}) AS DOUBLE) AS max, count(*) AS n_rows,
                   round(CAST(sum({c}) AS DOUBLE), 6) AS sum, count(*) - count({c}) AS missing,
                   round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median
            FROM {source}"""
        for c in columns
    )


def _members(table: str, cohort: str, key: str = "subject_id") -> str:
    return f"SELECT * FROM {table} WHERE {key} IN (SELECT {key} FROM {cohort})"


def _overlap(left: str, right: str, key: str) -> str:
    """NULL counts as an id, so the flags are compared with GROUP BY."""
    return f"""
        SELECT count(*) FILTER (WHERE l = 1 AND r = 1) AS in_both,
               count(*) FILTER (WHERE l = 1 AND r = 0) AS left_only,
               count(*) FILTER (WHERE l = 0 AND r = 1) AS right_only
        FROM (SELECT {key}, max(l) AS l, max(r) AS r FROM (
                SELECT {key}, 1 AS l, 0 AS r FROM {left}
                UNION ALL SELECT {key}, 0, 1 FROM {right}) GROUP BY {key})"""


def _completeness(tables: list[tuple[str, str]], column: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{label}' AS "table", '{column}' AS id, count(*) AS n_rows,
                   count(*) - count({column}) AS null_ids,
                   count(DISTINCT {column}) AS distinct_ids FROM {source}"""
        for label, source in tables
    )


def _mortality(last_by: str) -> str:
    measures = ["died_in_hosp", "died_30", "died_365", "expire_flg"]
    rows = f"""(
        SELECT d.died_in_hosp, d.expire_flg,
               CASE WHEN d.dod - CAST(a.disch_dt AS DATE) <= 30 THEN 1 ELSE 0 END AS died_30,
               CASE WHEN d.dod - CAST(a.disch_dt AS DATE) <= 365 THEN 1 ELSE 0 END AS died_365
        FROM (SELECT *, row_number() OVER (PARTITION BY subject_id
                                           ORDER BY {last_by} DESC, hadm_id DESC) AS rk
              FROM admissions) a
        JOIN deaths d ON a.subject_id = d.subject_id AND a.rk = 1
        WHERE a.subject_id IN (SELECT subject_id FROM cohort))"""
    return " UNION ALL ".join(
        f"""SELECT '{m}' AS measure, CAST(sum({m}) AS BIGINT) AS no_patients,
                   round(CAST(sum({m}) AS DOUBLE) / count(*) * 100, 2) AS percentage,
                   count(*) AS cohort_no, count(*) - count({m}) AS missing_value
            FROM {rows}"""
        for m in measures
    )


_DUMMY_COLUMNS = [
    "admit_age", "male", "female", "married", "black", "white", "asian", "hispanic",
    "other_eth", "unknown_eth", "medicare_medicaid", "private", "other_payor", "died",
]
_CATEGORIES = {
    "gender": "gender",
    "marital_status": "CASE WHEN marital_status = 'WIDOWED' THEN 'SEPARATED' "
    "ELSE marital_status END",
    "ethnicity": "CASE ethnicity WHEN 'AFRICA' THEN 'BLACK' WHEN 'AMERICA' THEN 'HISPANIC' "
    "WHEN 'ASIA' THEN 'ASIAN' WHEN 'EUROPE' THEN 'WHITE' WHEN 'MIDDLE EAST' THEN 'OTHER' ELSE ethnicity END",
    "payor": "overall_payor_group",
    "religion": "religion",
    "admission_type": "admission_type",
    "admission_source": "admission_source",
}
_PRIORITIES = {"primary_dx": 1, "secondary_dx": 2, "tertiary_dx": 3}
_ORDERED = {
    f"{name}{nth or ''}": f"sequence = {n}" + (f" AND hospital_seq = {nth}" if nth else "")
    for name, n in {"prim": 1, "sec": 2, "ter": 3}.items()
    for nth in (None, 1, 2, 3)
}
_LOS = ", ".join(
    f"round({f}({c} / CAST(1440 AS DOUBLE)), 2) AS {stat}_{name}"
    for name, c in {"icu_days": "icustay_los", "hospital_days": "hospital_los"}.items()
    for stat, f in (("mean", "avg"), ("sd", "stddev_samp"))
)
# Lines that the extracts do not break.
_WHOLE = "coalesce(hadm_id % 97 <> 3 AND hadm_id % 89 <> 5, true)"
_STAY_NULLS = [
    "icustay_id", "subject_id", "hadm_id", "dod", "hospital_seq", "hospital_los",
    "hospital_expire_flg", "hospital_last_flg", "sofa_first", "sapsi_first",
]

_QUERIES = {
    "repeat_cohort": "SELECT * FROM cohort",
    "repeat_cohort_selective": "SELECT * FROM cohort_many",
    "repeat_cohort_exact": _cohort(5, "a.admit_dt + INTERVAL 365 DAY"),
    "repeat_cohort_events": """
        SELECT DISTINCT user_id FROM (
          SELECT a.user_id, a.event_id, count(*) AS n
          FROM events a JOIN events b
            ON a.user_id = b.user_id AND a.event_id <> b.event_id
           AND b.ts BETWEEN a.ts AND CAST(a.ts AS DATE) + 2
          GROUP BY 1, 2) WHERE n >= 8""",
    "repeat_cohort_adult": _adult_cohort(2),
    "cohort_table": "SELECT * FROM cohort",
    "adult_stays": "SELECT * FROM cohort_stays",
    "admission_category": "SELECT * FROM category",
    "admit_info": """
        SELECT c.*, s.icustay_id, s.hospital_seq, s.subject_icustay_seq, s.icustay_seq,
               s.icustay_admit_age AS admit_age, s.icustay_first_service,
               s.icustay_last_service,
               floor(s.icustay_los * 100 / CAST(1440 AS DOUBLE) + 0.5) / 100 AS icustay_days,
               floor(s.hospital_los * 100 / CAST(1440 AS DOUBLE) + 0.5) / 100 AS hospital_days,
               s.expire_flg, s.hospital_expire_flg, s.icustay_expire_flg, s.dod,
               s.icustay_intime, s.icustay_outtime
        FROM category c JOIN cohort_stays s ON c.hadm_id = s.hadm_id AND s.icustay_seq = 1""",
    "demographics": "SELECT * FROM demographics",
    "demographics_first_stay": "SELECT * FROM demographics WHERE subject_icustay_seq = 1",
    "comorbidity_any": "SELECT * FROM any_comorbidities",
    "drg_table": """
        SELECT c.*, i.description FROM cohort_costs c JOIN cost_items i ON c.itemid = i.itemid""",
    "drg_cost_summary": """
        SELECT c.itemid, i.description, count(*) AS hadm_count, CAST(sum(cost_weight) AS DOUBLE) / count(cost_weight) AS ave_cost_wt
        FROM cohort_costs c JOIN cost_items i ON c.itemid = i.itemid GROUP BY 1, 2""",
    "icd9_extract": "SELECT * FROM cohort_diagnoses",
    "icd9_frequency": """
        SELECT code, count(*) AS frequency, min(description) AS description
        FROM cohort_diagnoses GROUP BY code""",
    "eol_cohort": "SELECT * FROM eol",
    "eol_cohort_last_stay": "SELECT * FROM eol_last",
    "eol_cohort_last_hospital_stay":
        "SELECT * FROM eol_last WHERE hospital_last_flg NOT LIKE '%N%'",
    "eol_duplicates": """
        SELECT * FROM eol_last WHERE subject_id IN (
          SELECT subject_id FROM eol_last GROUP BY 1 HAVING count(*) > 1)""",
    "eol_excess": """
        SELECT count(*) AS duplicated_keys,
               CAST(coalesce(sum(n), 0) AS BIGINT) - count(*) AS excess_rows
        FROM (SELECT subject_id, count(*) AS n FROM eol_last GROUP BY 1 HAVING count(*) > 1)""",
    "eol_comorbidities": _members("comorbidities", "eol"),
    "eol_demographics": _members("demo", "eol"),
    "eol_codes": _members("diagnoses", "eol"),
    "eol_procedures": """
        SELECT p.*, i.description FROM procedures p
        LEFT JOIN procedure_items i ON p.itemid = i.itemid
        WHERE p.subject_id IN (SELECT subject_id FROM eol)""",
    "eol_costs": """
        SELECT p.*, i.description FROM cost_events p LEFT JOIN cost_items i ON p.itemid = i.itemid
        WHERE p.subject_id IN (SELECT subject_id FROM eol)""",
    "eol_notes": """
        SELECT n.* REPLACE (s.icustay_id AS icustay_id)
        FROM note_stays s JOIN notes n ON s.note_id = n.note_id
        WHERE s.icustay_id IN (SELECT icustay_id FROM eol)""",
    "eol_admissions": _members("admissions", "eol"),
    "coverage_audit": """
        SELECT DISTINCT hadm_id, subject_id FROM admissions
        WHERE subject_id IN (SELECT subject_id FROM cohort)
          AND subject_id NOT IN (
            SELECT subject_id FROM stays WHERE lower(icustay_age_group) LIKE '%neonate%')
        EXCEPT
        (SELECT hadm_id, subject_id FROM adult WHERE hadm_id IN (
           SELECT hadm_id FROM admissions WHERE subject_id IN (SELECT subject_id FROM cohort))
         UNION
         SELECT hadm_id, subject_id FROM adult
         WHERE subject_id IN (SELECT subject_id FROM cohort))""",
    "notes_discharge": _members("notes", "subjects") + f" AND {_DISCHARGE}",
    "notes_physician": _members("notes", "subjects") + f" AND {_PHYSICIAN}",
    "notes_nursing": _members("notes", "subjects") + f" AND {_NURSING}",
    "first_note_per_admission": _first_note("subjects"),
    "negative_cohort": "SELECT * FROM negatives",
    "negative_cohort_adult": f"""
        SELECT subject_id FROM (
          SELECT DISTINCT a.subject_id FROM admissions a
          JOIN patients p ON a.subject_id = p.subject_id
          WHERE a.admit_dt > CAST(p.dob AS TIMESTAMP) + INTERVAL 5840 DAY
            AND a.subject_id NOT IN (SELECT subject_id FROM cohort_adult_many))
        ORDER BY {_seeded("carecycle", "subject_id")}, subject_id LIMIT 400""",
    "negative_discharge_notes": "SELECT * FROM neg_discharge",
    "negative_physician_notes": _members("notes", "neg_discharge") + f" AND {_PHYSICIAN}",
    "negative_nursing_notes": _first_note("neg_discharge"),
    "long_notes": f"""
        SELECT 'discharge' AS note_set, count(*) FILTER (WHERE length(text) > 4000) AS n_long
        FROM neg_discharge
        UNION ALL
        SELECT 'nursing', count(*) FILTER (WHERE length(text) > 4000)
        FROM ({_first_note("negatives")})""",
    "blind_shuffle": f"""
        SELECT note_id, subject_id, hadm_id, icustay_id, charttime, text, cohort,
               {_seeded("blind", "note_id")} AS shuffle_key
        FROM (SELECT *, 1 AS cohort FROM notes
              WHERE subject_id IN (SELECT subject_id FROM cohort_many) AND {_NURSING}
              UNION ALL
              SELECT *, 0 AS cohort FROM notes
              WHERE subject_id IN (SELECT subject_id FROM negatives) AND {_NURSING})
        WHERE hadm_id IS NOT NULL""",
    "combined_notes": " UNION ALL ".join(
        f"""SELECT note_id, subject_id, hadm_id, icustay_id, charttime, category, text,
                   {label} AS cohort
            FROM notes WHERE subject_id IN (SELECT subject_id FROM {subjects}) AND {kind}"""
        for subjects, label in (("cohort_many", 1), ("negatives", 0))
        for kind in (_DISCHARGE, f"{_NURSING} AND hadm_id IS NOT NULL")
    ),
    "treatment_durations": "SELECT * FROM treatments",
    "treated_share": """
        SELECT treatment, count(*) FILTER (WHERE ever = 1) AS treated, count(*) AS subjects,
               round(CAST(count(*) FILTER (WHERE ever = 1) AS DOUBLE) / count(*) * 100, 2)
                 AS percent
        FROM (SELECT 'vasopressors' AS treatment, subject_id, max(vasopressors) AS ever
              FROM treatments GROUP BY 2
              UNION ALL SELECT 'ventilation', subject_id, max(mech_vent)
              FROM treatments GROUP BY 2
              UNION ALL SELECT 'tracheostomy', subject_id,
                max(CASE WHEN itemid IN (4, 5) THEN 1 ELSE 0 END)
              FROM procedures WHERE subject_id IN (SELECT subject_id FROM subjects) GROUP BY 2
              UNION ALL SELECT 'dialysis', subject_id,
                max(CASE WHEN itemid IN (1, 2, 3) THEN 1 ELSE 0 END)
              FROM procedures WHERE subject_id IN (SELECT subject_id FROM subjects) GROUP BY 2)
        GROUP BY 1""",
    "pressor_days": """
        SELECT subject_id, round(avg(coalesce(days_on_pressors, 0)), 2) AS ave_days_on_pressor
        FROM treatments GROUP BY 1""",
    "pressor_days_overall": """
        SELECT round(avg(d), 2) AS mean_days FROM (
          SELECT round(avg(coalesce(days_on_pressors, 0)), 2) AS d
          FROM treatments GROUP BY subject_id)""",
    "vent_durations": """
        SELECT icustay_id, strftime(start_time, '%-m/%-d/%Y %-H:%M') AS begin_time,
               strftime(stop_time, '%-m/%-d/%Y %-H:%M') AS end_time,
               datesub('minute', date_trunc('minute', start_time),
                       date_trunc('minute', stop_time)) / CAST(1440 AS DOUBLE) AS duration
        FROM vent""",
    "treated_percent": f"""
        SELECT treatment, percent, printf('%.2f%%', percent) AS percent_text FROM ({{treated_share}})""",
    "read_results": "SELECT * FROM results",
    "read_notes": "SELECT DISTINCT * FROM annotated_notes",
    "reconcile": "SELECT * FROM reconciled",
    "annotator_counts": """
        SELECT operator, count(*) AS annotations, count(DISTINCT icu_id) AS unique_notes,
               count(*) - count(DISTINCT icu_id) AS repeated
        FROM annotations GROUP BY 1""",
    "annotation_totals": """
        SELECT count(*) AS annotations, count(DISTINCT icu_id) AS unique_notes,
               count(*) - count(DISTINCT icu_id) AS repeated
        FROM annotations WHERE icu_id IS NOT NULL""",
    "annotation_completeness": " UNION ALL ".join(
        _completeness([(f"annotations {c}", "annotations")], c)
        for c in ("hadm_id", "icu_id", "subject_id", "chart_time")
    ),
    "repeated_annotations": """
        SELECT operator, icu_id, annotation_id FROM (
          SELECT *, row_number() OVER (PARTITION BY operator, icu_id
                                       ORDER BY annotation_id) AS rk FROM annotations)
        WHERE rk > 1""",
    "pending_notes": """
        SELECT hadm_id, hadm_id IN (SELECT hadm_id FROM missing_notes) AS in_missing_batch
        FROM (SELECT hadm_id FROM annotations GROUP BY 1 HAVING count(*) = 1)""",
    "pending_overlap": _overlap(
        "(SELECT hadm_id FROM annotations GROUP BY 1 HAVING count(*) = 1)",
        "missing_notes", "hadm_id",
    ),
    "operators_per_note": """
        SELECT hadm_id, count(*) AS num_notes, count(DISTINCT operator) AS num_operators
        FROM annotations GROUP BY 1""",
    "operators_per_note_summary": _five_numbers(
        """(SELECT hadm_id, count(*) AS num_notes, count(DISTINCT operator) AS num_operators
            FROM annotations GROUP BY 1)""",
        ["num_notes", "num_operators"],
    ),
    "feature_agreement": "SELECT * FROM compared",
    "agreement_share": """
        SELECT feature, count(*) AS n_notes,
               CAST(avg(CASE WHEN agree THEN 1 ELSE 0 END) AS DOUBLE) AS prop_agreed
        FROM compared GROUP BY 1""",
    "agreement_summary": """
        SELECT feature, count(*) FILTER (WHERE pos_note >= 1) AS num_posnotes,
               CAST(avg(CASE WHEN agree THEN 1 ELSE 0 END) FILTER (WHERE pos_note >= 1)
                    AS DOUBLE) AS prop_agreed,
               CAST(count(*) FILTER (WHERE pos_note >= 1) AS DOUBLE) / count(*) AS prop_posnote,
               count(*) FILTER (WHERE pos_note < 1) AS num_negnotes, count(*) AS sum_posneg
        FROM compared GROUP BY 1""",
    "disagreement_matrix": "SELECT * FROM disputed",
    "disagreement_only": "SELECT * FROM disputed WHERE sum_disagree > 0",
    "disagreement_rate": """
        SELECT d AS notes_disputed, n AS notes,
               round(CAST(d AS DOUBLE) / n * 100, 2) AS percent
        FROM (SELECT (SELECT count(*) FROM disputed WHERE sum_disagree > 0) AS d,
                     (SELECT count(DISTINCT icu_id) FROM annotations) AS n)""",
    "unsure_notes": """
        SELECT operator, count(*) AS unsure_annotations, count(DISTINCT icu_id) AS unsure_notes
        FROM annotations WHERE unsure = 1 GROUP BY 1""",
    "unsure_adjudication": _overlap("unsure_ids", "adjudicated", "icu_id"),
    "unsure_remaining": "SELECT * FROM remaining",
    "unsure_export": """
        SELECT DISTINCT note_subject_id AS subject_id, hadm_id, hadm_id AS hadm_id_2,
               hadm_id AS hadm_id_3, real_time AS chartdate, 'Discharge' AS category,
               'Summary' AS descriptions, text
        FROM reconciled WHERE icu_id IN (SELECT icu_id FROM remaining)""",
    "annotation_batches": """
        SELECT icu_id, CAST(ceil(row_number() OVER (ORDER BY icu_id) / 30) AS BIGINT) AS batch
        FROM remaining""",
    "annotation_batch_files": """
        SELECT *, count(*) OVER (PARTITION BY batch) AS rows_in_file
        FROM (SELECT *, CAST(ceil(row_number() OVER (ORDER BY hadm_id, subject_id, chartdate, text) / 30) AS BIGINT) AS batch
              FROM ({unsure_export}))""",
    "demographics_extract": f"""
        SELECT icustay_id AS "index", subject_id, hadm_id, admit_age, gender, dod, marital_status, ethnicity,
               overall_payor_group, religion, admission_type, admission_source, hospital_expire_flg, expire_flg
        FROM demographics WHERE {_WHOLE}""",
    "comorbidity_extract": f"""
        SELECT hadm_id AS "index", subject_id, hadm_id, 'ELIXHAUSER' AS category, {_FLAG_LIST}
        FROM comorbidities WHERE subject_id IN (SELECT subject_id FROM subjects) AND {_WHOLE}""",
    "code_extract": f"SELECT code, subject_id, hadm_id, description, sequence FROM cohort_diagnoses WHERE {_WHOLE}",
    "frequency_extract": """
        SELECT hospital_seq, count(DISTINCT subject_id) AS number_of_patients
        FROM cohort_stays WHERE hospital_seq IS NOT NULL GROUP BY 1""",
    "extract_quarantine": " UNION ALL ".join(
        f"""SELECT '{name}' AS extract, CASE WHEN {_WHOLE} THEN 'row' ELSE 'bad' END AS kind,
                   CASE WHEN hadm_id % 97 = 3 THEN 'not {columns} columns'
                        WHEN hadm_id % 89 = 5 THEN '{spoilt}' END AS reason, count(*) AS n_lines
            FROM {source} GROUP BY 1, 2, 3"""
        for name, columns, spoilt, source in (
            ("demographics", 14, "admit_age is not of type double", "demographics"),
            ("comorbidities", 34, "obesity is not of type int",
             "(SELECT * FROM comorbidities WHERE subject_id IN (SELECT subject_id FROM subjects))"),
            ("codes", 5, "sequence is not of type int", "cohort_diagnoses"),
        )
    ),
    "cohort_extracts": " UNION ALL ".join(
        f"""SELECT '{name}' AS extract, count(*) AS n_rows
            FROM {source} WHERE subject_id IN (SELECT subject_id FROM cohort)"""
        for name, source in (
            ("admissions", "admissions"), ("diagnoses", "diagnoses"), ("costs", "cost_events"),
            ("procedures", "procedures"), ("demographics", "demo"),
        )
    ),
    "stays_cross_check": """
        SELECT icustay_id, 'in_both' AS side FROM (
          SELECT icustay_id FROM cohort_stays INTERSECT SELECT icustay_id FROM stays
          WHERE subject_id IN (SELECT subject_id FROM subjects))
        UNION ALL
        SELECT icustay_id, 'left_only' FROM (
          SELECT icustay_id FROM cohort_stays EXCEPT SELECT icustay_id FROM stays
          WHERE subject_id IN (SELECT subject_id FROM subjects))
        UNION ALL
        SELECT icustay_id, 'right_only' FROM (
          SELECT icustay_id FROM stays WHERE subject_id IN (SELECT subject_id FROM subjects)
          EXCEPT SELECT icustay_id FROM cohort_stays)""",
    "care_margins": """
        SELECT CASE WHEN grouping(care_unit) = 0 THEN 'care_unit' WHEN grouping(admission_source) = 0 THEN 'admission_source'
                    ELSE 'treatment' END AS margin,
               CASE WHEN grouping(care_unit) = 0 THEN care_unit WHEN grouping(admission_source) = 0 THEN admission_source
                    ELSE treatment END AS level,
               count(*) AS n_rows, round(avg(hospital_seq), 2) AS mean_admissions,
               round(stddev_samp(hospital_seq), 2) AS sd_admissions, count(*) - count(hospital_seq) AS missing_admissions,
               round(avg(icustay_los / CAST(1440 AS DOUBLE)), 2) AS mean_days,
               round(stddev_samp(icustay_los / CAST(1440 AS DOUBLE)), 2) AS sd_days,
               count(*) - count(icustay_los) AS missing_days
        FROM (SELECT s.hospital_seq, s.icustay_los, s.icustay_first_careunit AS care_unit,
                     d.admission_source_descr AS admission_source,
                     CASE WHEN p.dialysis = 1 THEN 'dialysis' WHEN p.tracheostomy = 1 THEN 'tracheostomy' ELSE 'none' END
                       AS treatment
              FROM cohort_stays s LEFT JOIN demo d ON s.hadm_id = d.hadm_id
              LEFT JOIN (SELECT hadm_id, max(CASE WHEN itemid IN (1, 2, 3) THEN 1 ELSE 0 END) AS dialysis,
                                max(CASE WHEN itemid IN (4, 5) THEN 1 ELSE 0 END) AS tracheostomy
                         FROM procedures GROUP BY 1) p ON s.hadm_id = p.hadm_id)
        GROUP BY GROUPING SETS ((care_unit), (admission_source), (treatment))""",
    "stays_union": """
        SELECT icustay_id AS "index", * FROM cohort_stays WHERE hospital_seq >= 1""",
    "admission_frequency": """
        SELECT hospital_seq, count(DISTINCT subject_id) AS number_of_patients
        FROM cohort_stays WHERE hospital_seq IS NOT NULL GROUP BY 1""",
    "los_by_sequence": f"""
        SELECT hospital_seq, {_LOS} FROM cohort_stays
        WHERE hospital_seq IS NOT NULL GROUP BY 1""",
    "los_overall": f"SELECT {_LOS} FROM cohort_stays",
    "demographic_dummies": "SELECT * FROM dummies",
    "column_profile": _profile("dummies", _DUMMY_COLUMNS),
    "age_summary": _five_numbers("dummies", ["admit_age"]),
    "ethnicity_by_death": """
        SELECT ethnicity, expire_flg, n,
               round(n / sum(n) OVER (PARTITION BY ethnicity), 3) AS row_share,
               round(n / sum(n) OVER (PARTITION BY expire_flg), 3) AS column_share
        FROM (SELECT ethnicity, expire_flg, count(*) AS n FROM first_demographics GROUP BY 1, 2)""",
    "category_proportions": " UNION ALL ".join(
        f"""SELECT '{name}' AS variable, category, count(*) AS n,
                   round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 3) AS share
            FROM (SELECT {expr} AS category FROM first_demographics)
            WHERE category IS NOT NULL GROUP BY category"""
        for name, expr in _CATEGORIES.items()
    ),
    "sofa_by_sequence": """
        SELECT hospital_seq, avg(sofa_first) AS average, round(stddev_samp(sofa_first), 6) AS sd
        FROM severity WHERE sofa_first IS NOT NULL GROUP BY 1""",
    "saps_by_sequence": """
        SELECT hospital_seq, avg(sapsi_first) AS average, round(stddev_samp(sapsi_first), 6) AS sd
        FROM severity WHERE sapsi_first IS NOT NULL GROUP BY 1""",
    "severity_ci": """
        SELECT hospital_seq, round(m, 2) AS mean, round(s, 2) AS sd,
               CAST(lo AS DOUBLE) AS min, CAST(hi AS DOUBLE) AS max, n,
               round(m - CAST(1.959963984540054 AS DOUBLE) * s / sqrt(n), 2) AS ci_low,
               round(m + CAST(1.959963984540054 AS DOUBLE) * s / sqrt(n), 2) AS ci_high
        FROM (SELECT hospital_seq, avg(sofa_first) AS m, stddev_samp(sofa_first) AS s,
                     min(sofa_first) AS lo, max(sofa_first) AS hi, count(*) AS n
              FROM severity WHERE sofa_first IS NOT NULL GROUP BY 1)""",
    "severity_summary": _five_numbers(
        "(SELECT * FROM cohort_stays WHERE icustay_seq = 1)", ["sofa_first", "sapsi_first"]
    ),
    "severity_vs_total": """
        SELECT f.subject_id, f.sapsi_first, f.sofa_first, t.hospital_total_num
        FROM first_rows f JOIN (SELECT subject_id, count(*) AS hospital_total_num
                                FROM admissions GROUP BY 1) t ON f.subject_id = t.subject_id""",
    "severity_track": "SELECT * FROM track",
    "severity_track_high": "SELECT * FROM track WHERE subject_max > 20",
    "survival_first": _kaplan_meier("first_death"),
    "survival_by_group": _kaplan_meier("first_death", "gender"),
    "survival_minutes": _kaplan_meier("first_death_minutes"),
    "readmission_risk": """
        SELECT days, at_risk, events, round(sum(events / at_risk) OVER w, 6) AS mean_events,
               round(sqrt(sum(events / CAST(at_risk AS DOUBLE) ** 2) OVER w), 6) AS std_error
        FROM (SELECT days, events, (SELECT count(*) FROM followed f WHERE f.days >= e.days) AS at_risk
              FROM (SELECT e.days, count(*) AS events FROM readmitted e JOIN followed f
                      ON e.subject_id = f.subject_id AND e.days <= f.days GROUP BY 1) e)
        WINDOW w AS (ORDER BY days)""",
    "death_at_nth": """
        SELECT hospital_seq, count(*) AS deaths FROM cohort_stays
        WHERE hospital_expire_flg = 'Y' AND hospital_seq IS NOT NULL GROUP BY 1""",
    "survival_discharge": _kaplan_meier("discharge_death"),
    "outpatient_deaths": "SELECT expire_flg, count(*) AS n FROM left_alive GROUP BY 1",
    "id_completeness": _completeness(
        [("admissions", "admissions"), ("stays", "stays"), ("diagnoses", "diagnoses"),
         ("notes", "notes")], "hadm_id",
    ),
    "separate_admissions_lost": _completeness(
        [("first stays", "(SELECT * FROM stays WHERE icustay_seq = 1)")], "hadm_id"
    ),
    "hadm_overlap": _overlap("stays", "diagnoses", "hadm_id"),
    "missing_value_counts": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing FROM stays"""
        for c in _STAY_NULLS
    ),
    "missing_admissions": "SELECT hadm_id FROM admissions EXCEPT SELECT hadm_id FROM stays",
    "missing_subjects": "SELECT subject_id FROM patients EXCEPT SELECT subject_id FROM notes",
    "below_threshold": """
        SELECT subject_id, count(*) AS n_stays, max(hospital_seq) AS max_seq
        FROM cohort_stays GROUP BY 1
        HAVING count(*) < 3 OR coalesce(max(hospital_seq), 0) < 3""",
    "icd9_tally": "SELECT * FROM (SELECT description, "
    + ", ".join(f"count(*) FILTER (WHERE sequence = {n}) AS {c}" for c, n in _PRIORITIES.items())
    + " FROM top_diagnoses GROUP BY 1) WHERE "
    + " AND ".join(f"{c} > 0" for c in _PRIORITIES),
    "icd9_tally_detailed": "SELECT * FROM (SELECT n.description, "
    + ", ".join(f"count(*) FILTER (WHERE sequence = {n}) AS {c}" for c, n in _PRIORITIES.items())
    + """ FROM cohort_diagnoses d
          JOIN (SELECT code, min(description) AS description FROM diagnoses GROUP BY 1) n ON d.code = n.code
          WHERE sequence < 4 GROUP BY 1) WHERE """
    + " AND ".join(f"{c} > 0" for c in _PRIORITIES),
    "icd9_by_sequence": "SELECT * FROM (SELECT description, "
    + ", ".join(f"count(*) FILTER (WHERE {cond}) AS {c}" for c, cond in _ORDERED.items())
    + """ FROM top_diagnoses t JOIN stays s ON t.subject_id = s.subject_id
              AND t.hadm_id = s.hadm_id AND s.icustay_seq = 1
          GROUP BY 1) WHERE """
    + " AND ".join(f"{c} > 0" for c in _ORDERED),
    "drg_per_admission": "SELECT * FROM admission_costs",
    "drg_summary": _five_numbers("admission_costs", ["mean_cost_wt"]),
    "elixhauser_first": _five_numbers(
        f"(SELECT {_FLAG_SUM} AS elixhauser_sum FROM first_comorbidities)", ["elixhauser_sum"]
    ),
    "elixhauser_all": f"""
        SELECT round(avg(e), 2) AS mean, round(stddev_samp(e), 2) AS sd
        FROM (SELECT {_FLAG_SUM} AS e FROM any_comorbidities)""",
    "comorbidity_prevalence": " UNION ALL ".join(
        f"""SELECT '{f}' AS comorbidity, CAST(sum({f}) AS BIGINT) AS n,
                   round(CAST(sum({f}) AS DOUBLE) / count(*), 2) AS share
            FROM any_comorbidities"""
        for f in COMORBIDITIES
    ),
    "admissions_tally": """
        SELECT hadm_count, count(*) AS no_patients FROM (
          SELECT subject_id, count(*) AS hadm_count FROM admissions
          WHERE subject_id IN (SELECT subject_id FROM subjects) GROUP BY 1) GROUP BY 1""",
    "stays_tally": """
        SELECT icu_count, count(*) AS no_patients FROM (
          SELECT subject_id, count(*) AS icu_count FROM cohort_stays GROUP BY 1) GROUP BY 1""",
    "mortality_model": _model(_MAIN),
    "mortality_interactions": _model(_PRODUCTS),
    "mortality_summary": _model_summary(_MAIN),
    "mortality_interactions_fitted": f"""
        SELECT {', '.join(INTERACTION_FLAGS)}, count(*) AS n, round(avg(died), 6) AS fitted
        FROM mortality_rows GROUP BY ALL""",
    "mortality_table": _mortality("admit_dt"),
    "mortality_table_by_id": _mortality("hadm_id"),
}

_QUERIES["icd9_tally_top"] = (
    _QUERIES["icd9_tally"] + " ORDER BY primary_dx DESC, description LIMIT 20"
)
_QUERIES["icd9_by_sequence_top"] = (
    _QUERIES["icd9_by_sequence"] + " ORDER BY prim DESC, description LIMIT 20"
)



def _filled(body: str) -> str:
    """Puts the query that a name in braces stands for in its place."""
    return re.sub(r"\{(\w+)\}", lambda m: _QUERIES[m[1]], body)


ORACLE: dict[str, str] = {name: _sql(_filled(body)) for name, body in _QUERIES.items()}
