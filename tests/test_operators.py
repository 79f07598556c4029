"""Hand-made fixtures for the shared operators."""

import decimal
import math
import random
import statistics
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from carecycle.functions.dates import elapsed_days
from carecycle.functions.recode import bucket, cap, sentinel_to_null, with_unit
from carecycle.operators import agreement, audit, durations, model, pick, profile, ranges
from carecycle.operators import sampling, survival
from carecycle.plans import analysis, extracts


def test_agreement_of_repeated_annotations(spark):
    rows = [(1, 1), (1, 0), (1, 1), (2, 0), (2, 0), (3, 1), (3, 0), (4, 1)]
    df = spark.createDataFrame(rows, "icu_id long, f int")
    got = {r.icu_id: r for r in agreement.feature_agreement(df, ["f"]).collect()}
    assert {k: r.agree for k, r in got.items()} == {1: False, 2: True, 3: False}
    assert got[1].num_notes == 3 and got[1].pos_note == 2
    share = agreement.agreement_share(agreement.feature_agreement(df, ["f"])).first()
    assert share.n_notes == 3 and math.isclose(share.prop_agreed, 1 / 3)
    summary = agreement.agreement_summary(agreement.feature_agreement(df, ["f"])).first()
    assert (summary.num_posnotes, summary.num_negnotes, summary.prop_agreed) == (2, 1, 0.0)
    rate = agreement.disagreement_rate(df, ["f"]).first()
    assert (rate.notes_disputed, rate.notes, rate.percent) == (2, 4, 50.0)


def test_first_per_skips_null_keys_and_breaks_ties(spark):
    t = datetime(2020, 1, 1)
    rows = [(None, t, 1), (None, t, 2), (7, t, 4), (7, t, 3), (8, t, 5)]
    df = spark.createDataFrame(rows, "hadm_id long, charttime timestamp_ntz, note_id long")
    got = pick.first_per(df, ["hadm_id"], ["charttime", "note_id"])
    assert {(r.hadm_id, r.note_id) for r in got.collect()} == {(7, 3), (8, 5)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_repeats_and_excess(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), (None, 4), (None, 5), ("b", 6)],
                               "k string, id long")
    assert {r.id for r in pick.repeats(df, ["k"], "id").collect()} == {2, 3, 5}
    excess = pick.group_size_excess(df.filter("k IS NOT NULL"), "k").first()
    assert (excess.duplicated_keys, excess.excess_rows) == (1, 2)


def test_row_numbers_and_batches(spark):
    rng = random.Random(3)
    keys = rng.sample(range(-10_000, 10**9), 3000) + [10**15]
    df = spark.createDataFrame([(k,) for k in keys], "key long").repartition(7)
    got = {r.key: r.row_num for r in ranges.number_rows(df, "key").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}
    sizes = pick.batches(df, "key", 250).groupBy("batch").count().collect()
    assert sorted((r.batch, r["count"]) for r in sizes) == [
        (b, 250) for b in range(1, 13)
    ] + [(13, 1)]


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 5001])
def test_quantiles_are_exact(spark, n):
    rng = random.Random(n)
    x = [rng.choice([rng.gauss(0, 1), rng.lognormvariate(3, 2), 5.0]) for _ in range(n)]
    flags = [rng.randrange(2) for _ in range(n)]
    rows = [(a, b, None) for a, b in zip(x, flags)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "x double, flag int, nothing double")
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}
    got = {r.column: r for r in
           ranges.column_summary(df, ["x", "flag", "nothing"], probs).collect()}
    for name, values in (("x", x), ("flag", flags)):
        r = got[name]
        for q, p in probs.items():
            assert math.isclose(r[q], np.quantile(values, p), rel_tol=1e-12, abs_tol=1e-12)
        assert (r.n, r.missing, r.n_rows) == (n, 1, n + 1)
        assert math.isclose(r["mean"], statistics.fmean(values), rel_tol=1e-9, abs_tol=1e-9)
        if n > 1:
            assert math.isclose(r.sd, statistics.stdev(values), rel_tol=1e-9)
        else:
            assert r.sd is None
    assert got["nothing"].n == 0 and got["nothing"].median is None
    assert got["nothing"].missing == n + 1


def test_confidence_bounds_of_a_single_row(spark):
    rows = [(1, 4.0), (2, 1.0), (2, 3.0), (None, 9.0), (3, None)]
    df = spark.createDataFrame(rows, "hospital_seq int, score double")
    got = {r.hospital_seq: r for r in profile.ci_by(df, "hospital_seq", "score").collect()}
    assert set(got) == {1, 2}
    assert got[1].sd is None and got[1].ci_low is None and got[1].n == 1
    half = 1.959963984540054 * math.sqrt(2) / math.sqrt(2)
    assert got[2].ci_low == round(2 - half, 2) and got[2].ci_high == round(2 + half, 2)


def test_treatment_flags_and_spans(spark):
    t0, t1 = datetime(2020, 1, 1, 0, 0, 50), datetime(2020, 1, 2, 12, 0, 10)
    doses = [
        (1, 42, t0, 0.0),
        (2, 42, t0, -1.0),
        (3, 42, t0, 2.0),
        (4, 42, t0, 1.0), (4, 43, t1, 5.0),
        (5, 99, t0, 1.0),
        (6, 42, t0, None),
    ]
    meds = spark.createDataFrame(
        doses, "icustay_id long, itemid long, charttime timestamp_ntz, dose double"
    )
    stays = spark.createDataFrame(
        [(i, i, i) for i in range(1, 8)], "icustay_id long, subject_id long, hadm_id long"
    )
    got = {r.icustay_id: r for r in durations.treatment_durations(
        stays, meds.drop("dose").limit(0), meds, [720], [42, 43]).collect()}
    assert len(got) == 7
    assert {k: r.vasopressors for k, r in got.items()} == {
        1: 0, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0}
    assert {k: r.days_on_pressors for k, r in got.items() if k in (1, 2, 3)} == {
        1: None, 2: None, 3: 0.0}
    # 35 hours, 59 minutes and 20 seconds; seconds are dropped.
    assert math.isclose(got[4].days_on_pressors, (35 * 60 + 59) / 1440)
    assert all(r.mech_vent == 0 for r in got.values())
    shares = analysis.treated_share({"p": (meds.selectExpr(
        "icustay_id AS subject_id", "int(dose > 0) AS f"), "f")}).first()
    assert (shares.treated, shares.subjects, shares.percent) == (3, 6, 50.0)


def test_parsed_durations(spark):
    df = spark.createDataFrame([("1/31/2010 9:05", "2/1/2010 21:05")], "b string, e string")
    assert durations.parsed_durations(df, "b", "e").first().duration == 1.5


def test_recoding(spark):
    df = spark.createDataFrame([(89.9,), (90.0,), (200.0,), (None,)], "age double")
    assert [r[0] for r in df.select(cap(F.col("age"))).collect()] == [89.9, 91.4, 91.4, None]
    other = [r[0] for r in df.select(cap(F.col("age"), 199, 92.0, strict=True)).collect()]
    assert other == [89.9, 90.0, 92.0, None]
    labels = df.select(bucket(F.col("age") - 80, [(3, "low"), (10, "mid")], "high")).collect()
    assert [r[0] for r in labels] == ["mid", "mid", "high", None]
    text = spark.createDataFrame([("(null)", 1), ("x", 2)], "a string, b int")
    assert [tuple(r) for r in sentinel_to_null(text).collect()] == [(None, 1), ("x", 2)]


def test_dummies_keep_missing_visible(spark):
    schema = ("subject_id long, admit_age double, gender string, marital_status string, "
              "ethnicity string, overall_payor_group string, expire_flg string")
    rows = [
        (1, 95.0, "M", "MARRIED", "BLACK/CAPE VERDEAN", "MEDICARE-PRIVATE", "Y"),
        (2, 50.0, "F", "UNKNOWN", "UNKNOWN/NOT SPECIFIED", "SELF-PAY", "N"),
        (3, 50.0, None, None, None, "PRIVATE", "N"),
        (4, 50.0, "F", "SINGLE", "ASIAN", "OTHER", "N"),
    ]
    got = {r.subject_id: r for r in
           analysis.demographic_dummies(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].admit_age, got[1].black, got[1].medicare_medicaid, got[1].died) == (91.4, 1, 1, 1)
    assert [got[i].married for i in (1, 2, 3, 4)] == [1, None, None, 0]
    assert [got[i].unknown_eth for i in (1, 2, 3, 4)] == [0, 1, 1, 0]
    assert (got[2].other_payor, got[3].private, got[4].other_payor) == (1, 1, 1)
    assert got[3].male is None and got[4].asian == 1


def test_kaplan_meier(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0)], "days int, event int")
    rows = survival.kaplan_meier(df).orderBy("days").collect()
    assert [tuple(r)[:4] for r in rows] == [(1, 4, 1, 0.75), (2, 3, 1, 0.5), (3, 1, 0, 0.5)]
    errors = [0.75 * math.sqrt(1 / 12), 0.25, 0.25]
    np.testing.assert_allclose([r.std_error for r in rows], errors)
    np.testing.assert_allclose([r.lower for r in rows[1:]], [0.5 * math.exp(-1.959963984540054 * 0.5)] * 2)
    assert rows[0].upper == 1.0
    gone = survival.kaplan_meier(df.filter("days = 1")).first()
    assert (gone.survival, gone.std_error, gone.lower, gone.upper) == (0, None, None, None)


def test_kaplan_meier_censoring(spark):
    df = spark.createDataFrame([(5, 1, "F"), (None, 0, "M"), (9, 1, "M"), (-3, 1, "F")],
                               "days int, event int, gender string")
    imputed = {(r.gender, r.days): r for r in
               survival.kaplan_meier(df, strata=["gender"]).collect()}
    assert imputed["M", 9].at_risk == 2 and imputed["M", 9].events == 1
    assert ("F", -3) in imputed
    positive = survival.kaplan_meier(df, positive_only=True).orderBy("days").collect()
    assert [(r.days, r.at_risk) for r in positive] == [(5, 3), (9, 2)]
    dropped = survival.kaplan_meier(df, impute=None).agg(F.max("at_risk")).first()[0]
    assert dropped == 3
    alive = df.filter("days IS NULL")
    assert survival.kaplan_meier(alive).count() == 0
    with pytest.raises(ValueError):
        survival.kaplan_meier(df, impute="mean")


def test_linear_model_exact_fit_and_aliases(spark):
    rows = [(x, z, 2.0 * x + 1 + 0.5 * z) for x, z in [(0, 0), (1, 0), (0, 1), (1, 1), (1, 1)]]
    df = spark.createDataFrame(rows, "x int, z int, y double").selectExpr(
        "*", "x AS same", "1 AS fixed"
    )
    got = {r.term: r for r in
           model.linear_model(df, "y", model.main_effects(["x", "same", "fixed", "z"])).collect()}
    assert math.isclose(got["x"].estimate, 2, abs_tol=1e-9)
    assert math.isclose(got["z"].estimate, 0.5, abs_tol=1e-9)
    assert math.isclose(got["(Intercept)"].estimate, 1, abs_tol=1e-9)
    assert got["same"].estimate is None and got["fixed"].std_error is None


def test_linear_model_against_normal_equations(spark):
    rng = np.random.default_rng(7)
    flags = rng.integers(0, 2, size=(400, 3))
    y = 0.2 + flags @ [0.5, -0.3, 0.1] + rng.normal(0, 0.4, 400)
    rows = [(*map(int, f), float(v)) for f, v in zip(flags, y)]
    df = spark.createDataFrame(rows, "a int, b int, c int, y double")
    terms = model.full_interactions(["a", "b", "c"])
    assert list(terms) == ["a", "b", "c", "a:b", "a:c", "b:c", "a:b:c"]
    design = np.column_stack(
        [np.ones(400)] + [np.prod(flags[:, ["abc".index(f) for f in t]], axis=1)
                          for t in terms.values()]
    )
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    residual = y - design @ beta
    sigma2 = residual @ residual / (400 - design.shape[1])
    errors = np.sqrt(sigma2 * np.diag(np.linalg.inv(design.T @ design)))
    got = model.linear_model(df, "y", terms).collect()
    assert [r.term for r in got] == ["(Intercept)", *terms]
    np.testing.assert_allclose([r.estimate for r in got], beta, rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose([r.std_error for r in got], errors, rtol=1e-7)
    np.testing.assert_allclose([r.t_value for r in got], beta / errors, rtol=1e-6)
    assert all(0 <= r.p_value <= 1 for r in got)


def test_linear_model_without_errors_terms_or_rows(spark):
    """As many rows as parameters; constant terms alone; no row at all."""
    df = spark.createDataFrame([(0, 1.0), (1, 3.0)], "x int, y double")
    got = model.linear_model(df, "y", {"x": ["x"]}).collect()
    assert [(r.term, round(r.estimate, 9)) for r in got] == [("(Intercept)", 1), ("x", 2)]
    assert all(r.std_error is None and r.t_value is None and r.p_value is None for r in got)
    flat = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 6.0)], "x int, y double")
    intercept, x = model.linear_model(flat, "y", {"x": ["x"]}).collect()
    assert math.isclose(intercept.estimate, 3) and math.isclose(intercept.std_error, math.sqrt(7 / 3))
    t = intercept.t_value
    assert math.isclose(intercept.p_value, 1 - t / math.sqrt(2 + t * t)) and x.estimate is None
    none = model.linear_model(df.filter("false"), "y", {"x": ["x"]}).collect()
    assert [tuple(r)[1:] for r in none] == [(None,) * 4] * 2
    summary = model.model_summary(flat, "y", {"x": ["x"]}).first()
    assert (summary.n, summary.parameters, summary.df_residual) == (3, 1, 2)
    assert math.isclose(summary.dispersion, 7) and math.isclose(summary.deviance, 14)
    assert model.model_summary(df.filter("false"), "y", {"x": ["x"]}).first().n == 0


def test_t_tail_has_known_values():
    for t, free, p in [(12.7062, 1, 0.05), (2.22814, 10, 0.05), (0, 5, 1), (1.96234, 1000, 0.05), (3.0, 2, 0.095466)]:
        assert math.isclose(model.t_tail(t, free), p, abs_tol=2e-5)


def test_sample_is_repeatable_without_replacement(spark):
    ids = spark.createDataFrame([(i % 50,) for i in range(200)] + [(None,)], "subject_id long")
    first = [r[0] for r in sampling.sample_ids(ids, "subject_id", 20, "s").collect()]
    again = [r[0] for r in sampling.sample_ids(ids.repartition(5), "subject_id", 20, "s").collect()]
    other = [r[0] for r in sampling.sample_ids(ids, "subject_id", 20, "t").collect()]
    assert first == again and len(set(first)) == 20 and set(first) != set(other)
    assert sampling.sample_ids(ids, "subject_id", 99, "s").count() == 50


def test_blind_shuffle_drops_unlinked_rows(spark):
    df = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "note_id long, hadm_id long")
    got = sampling.blind_shuffle([(df, 1), (df.selectExpr("note_id + 9 AS note_id", "hadm_id"), 0)],
                                 "note_id", "hadm_id", "x").collect()
    assert sorted((r.note_id, r.cohort) for r in got) == [(1, 1), (3, 1), (10, 0), (12, 0)]
    assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)


def test_coverage_audit(spark):
    admissions = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)],
                                       "subject_id long, hadm_id long")
    stays = spark.createDataFrame(
        [(1, 10, "adult"), (1, None, "adult"), (2, 20, "Neonate"), (2, 21, "adult")],
        "subject_id long, hadm_id long, icustay_age_group string")
    cohort = admissions.select("subject_id").distinct()
    got = audit.uncovered(admissions, stays, cohort).collect()
    assert {(r.hadm_id, r.subject_id) for r in got} == {(11, 1), (30, 3)}


def test_null_is_an_id_in_set_differences(spark):
    a = spark.createDataFrame([(1,), (None,), (2,), (2,)], "k long")
    b = spark.createDataFrame([(None,), (2,), (3,)], "k long")
    assert [r.k for r in audit.missing_ids(a, b, "k").collect()] == [1]
    assert tuple(audit.id_overlap(a, b, "k").first()) == (2, 1, 1)
    got = audit.id_completeness({"a": (a, "k")}).first()
    assert (got.n_rows, got.null_ids, got.distinct_ids) == (4, 1, 2)


def test_tally_requires_every_priority_unless_told_otherwise(spark):
    diagnoses = spark.createDataFrame(
        [(1, 1, 1, "428.0"), (1, 1, 2, "428.1"), (1, 2, 3, "428"), (1, 2, 2, "500.9"),
         (1, 2, 4, "428.0")],
        "subject_id long, hadm_id long, sequence int, code string")
    names = spark.createDataFrame([("428", "heart"), ("500", "lung")],
                                  "code string, description string")
    assert [tuple(r) for r in extracts.code_tally(diagnoses, names).collect()] == [
        ("heart", 1, 1, 1)]
    everything = extracts.code_tally(diagnoses, names, require_all=False).collect()
    assert {tuple(r) for r in everything} == {("heart", 1, 1, 1), ("lung", 0, 1, 0)}


def test_mortality_after_the_last_admission(spark):
    admissions = spark.createDataFrame(
        [(1, 9, datetime(2020, 1, 1), datetime(2020, 1, 5)),
         (1, 2, datetime(2020, 6, 1), datetime(2020, 6, 5)),
         (2, 3, datetime(2020, 1, 1), datetime(2020, 1, 9))],
        "subject_id long, hadm_id long, admit_dt timestamp_ntz, disch_dt timestamp_ntz")
    stays = spark.createDataFrame(
        [(1, date(2020, 6, 20), "Y", None, "N"), (1, date(2020, 6, 20), "Y", "N", "N"),
         (2, date(2020, 1, 8), "Y", None, "Y")],
        "subject_id long, dod date, expire_flg string, hospital_expire_flg string, "
        "icustay_expire_flg string")
    subjects = admissions.select("subject_id").distinct()

    def table(last_by):
        rows = analysis.mortality_table(admissions, stays, subjects, last_by).collect()
        return {r.measure: r.no_patients for r in rows}

    # A death before discharge counts for every bound.
    assert table("admit_dt") == {
        "died_in_hosp": 1, "died_30": 2, "died_365": 2, "expire_flg": 2}
    assert table("hadm_id")["died_30"] == 1


def test_elapsed_days_uses_whole_minutes(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 1, 0, 0, 59), datetime(2020, 1, 1, 0, 1, 58))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert df.select(elapsed_days(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    got = ranges.five_numbers(df, ["x"]).first()
    assert (got.n, got.missing, got.min, got.max, got.mean, got.median) == (2, 2, 1, 3, 2, 2)
    assert ranges.five_numbers(df.filter("false"), ["x"]).count() == 0


@pytest.mark.parametrize("kind, values", [
    ("string", [None, "", "a", "aa", "b", "é", "zz"]),
    ("timestamp_ntz", [datetime(2000, 1, d, 3, d) for d in range(1, 9)]),
    ("date", [None, date(2000, 1, 1), date(2000, 1, 2)]),
    ("decimal(20,2)", [1, 2, 3]),
])
def test_row_numbers_of_any_key(spark, kind, values):
    """Ties are numbered without gaps, NULL first, whatever share of the rows a key holds."""
    rng = random.Random(kind)
    rows = [(rng.choice(values[: 1 + i % len(values)]), i) for i in range(2000)]
    if kind.startswith("decimal"):
        rows = [(decimal.Decimal(a), i) for a, i in rows]
    df = spark.createDataFrame(rows, f"k {kind}, id long").withColumn("m", F.create_map("id", F.lit(1))).repartition(5)
    got = sorted((r.n, r.k, r.id) for r in ranges.number_rows(df, "k", "n").collect())
    assert [n for n, _, _ in got] == list(range(1, 2001)) and {i for _, _, i in got} == set(range(2000))
    keys = [(k is not None, k) for _, k, _ in got]
    assert all(a[0] < b[0] or a[1] is None or a[1] <= b[1] for a, b in zip(keys, keys[1:]))
    both = sorted((r.n, r.k, r.id) for r in ranges.number_rows(df, ["k", "id"], "n", ranges=3).collect())
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]))
    assert [(k, i) for _, k, i in both] == want
    assert ranges.number_rows(df.filter("false"), "k").count() == 0


def test_ranges_read_their_input_once(spark, tmp_path):
    """One scan in the plan as it is made, no join, no window over a single partition."""
    spark.range(1000).selectExpr("id", "id % 7 AS x").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    for found in (ranges.number_rows(df, "x"), ranges.five_numbers(df, ["id", "x"]), pick.batches(df, "id", 30)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1
        assert "Join" not in plan and "SinglePartition" not in plan


def _plain_curve(rows):
    """Survival at each distinct time, straight from the definition."""
    out, alive = [], 1.0
    for t in sorted({d for d, _ in rows}):
        n = sum(d >= t for d, _ in rows)
        dead = sum(e for d, e in rows if d == t)
        alive *= 1 - dead / n
        out.append((t, n, dead, alive))
    return out


def test_survival_over_seconds(spark):
    """Times with fractions, as many as subjects, give the curve of the definition and that of whole days."""
    rng = random.Random(9)
    rows = [(g, rng.choice([rng.random() * 9, 2.5, 4.0]), rng.randrange(2)) for g in ("a", "b", None) for _ in range(200)]
    df = spark.createDataFrame([*rows, ("a", None, 0)], "g string, days double, event int")
    got = survival.kaplan_meier(df, strata=["g"]).collect()
    last = max(d for _, d, _ in rows)
    for g in ("a", "b", None):
        mine = [(d, e) for x, d, e in rows if x == g] + ([(last, 0)] if g == "a" else [])
        curve = sorted((r.days, r.at_risk, r.events, r.survival) for r in got if r.g == g)
        for have, want in zip(curve, _plain_curve(mine), strict=True):
            assert have[:3] == want[:3] and math.isclose(have[3], want[3], rel_tol=1e-9, abs_tol=1e-12)
    plan = survival.kaplan_meier(df, impute=None)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    whole = spark.createDataFrame([(rng.randrange(9), rng.randrange(2)) for _ in range(99)], "days int, event int")
    a = survival.kaplan_meier(whole).collect()
    b = survival.kaplan_meier(whole.withColumn("days", F.col("days").cast("double"))).collect()
    for x, y in zip(sorted(a, key=lambda r: r.days), sorted(b, key=lambda r: r.days), strict=True):
        assert (x.days, x.at_risk, x.events) == (y.days, y.at_risk, y.events)
        for c in ("survival", "std_error", "lower", "upper"):
            assert x[c] is y[c] or math.isclose(x[c], y[c], rel_tol=1e-9)


def test_mean_cumulative_events(spark):
    """Three subjects followed for 10, 4 and 2 days: 2/3 on day 1, 1/2 on day 3, 1/1 on day 9."""
    followed = spark.createDataFrame([(1, 10), (2, 4), (3, 2), (4, None)], "subject_id long, days int")
    events = [(1, 1), (2, 1), (2, 3), (1, 9), (3, 3), (2, 5), (1, None), (4, 1), (5, 1)]
    df = spark.createDataFrame(events, "subject_id long, days int")
    got = sorted((r.days, r.at_risk, r.events, r.mean_events) for r in survival.mean_cumulative(df, followed).collect())
    want = [(1, 3, 2, 2 / 3), (3, 2, 1, 2 / 3 + 1 / 2), (9, 1, 1, 2 / 3 + 1 / 2 + 1)]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(math.isclose(g[3], w[3]) for g, w in zip(got, want))


def test_margins(spark):
    rows = [("a", "x", 1.0), ("a", None, 3.0), ("b", "x", None)]
    got = profile.margins(spark.createDataFrame(rows, "u string, v string, n double"), ["u", "v"], {"n": F.col("n")})
    assert {(r.margin, r.level): (r.n_rows, r.mean_n, r.sd_n, r.missing_n) for r in got.collect()} == {
        ("u", "a"): (2, 2.0, 1.41, 0), ("u", "b"): (1, None, None, 1),
        ("v", "x"): (2, 1.0, None, 1), ("v", None): (1, 3.0, None, 0)}


def test_sides_and_units(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    b = spark.createDataFrame([(2,), (3,), (None,)], "k long")
    assert {(r.k, r.side) for r in audit.id_sides(a, b, "k").collect()} == {
        (1, "left_only"), (2, "in_both"), (None, "in_both"), (3, "right_only")}
    rows = spark.createDataFrame([(67.666,), (None,)], "x double").select(with_unit(F.col("x"), "%").alias("t"))
    assert [r.t for r in rows.collect()] == ["67.67%", None]


def test_completeness_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k long, j long")
    got = audit.id_completeness({"a": (df, "k"), "b": (df, "j")}).collect()
    assert sorted(map(tuple, got)) == [("a", "k", 0, 0, 0), ("b", "j", 0, 0, 0)]


def test_moments_by_pattern(spark):
    """Weighted patterns give the regression of the rows, continuous factors included."""
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 2, 500), rng.integers(0, 3, 500), rng.standard_normal(500)])
    y = x @ [1.0, -2.0, 0.5] + x[:, 0] * x[:, 1] + rng.standard_normal(500) + 1e6
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)] + [(None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    terms = {"a": ["a"], "b": ["b"], "c": ["c"], "a:b": ["a", "b"]}
    got = {r.term: r for r in model.linear_model(df, "y", terms).collect()}
    z = np.column_stack([np.ones(500), x, x[:, 0] * x[:, 1]])
    want, *_ = np.linalg.lstsq(z, y, rcond=None)
    assert np.allclose([got[t].estimate for t in [model.INTERCEPT, *terms]], want, rtol=1e-7)
    errors = np.sqrt(np.diag(np.linalg.inv(z.T @ z)) * ((y - z @ want) ** 2).sum() / 495)
    assert np.allclose([got[t].std_error for t in [model.INTERCEPT, *terms]], errors, rtol=1e-6)
    cells = spark.createDataFrame([(1.0, 2.0, 0.0), (0.0, 0.0, 1.0)], "a double, b double, c double")
    table = model.linear_model(df, "y", terms)
    fitted = {r.a: r.fitted for r in analysis.fitted(cells, table, terms, model.INTERCEPT).collect()}
    assert np.allclose([fitted[1.0], fitted[0.0]], [want @ [1, 1, 2, 0, 2], want @ [1, 0, 0, 1, 0]])
