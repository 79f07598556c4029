"""Repeat-event cohorts against their plain definition, and hand-made traps."""

import random
from datetime import date, datetime, timedelta

import pytest

from carecycle.operators.cohort import died_soon_after, repeat_cohort, repeat_cohort_adult

SCHEMA = "subject_id long, hadm_id long, admit_dt timestamp_ntz"


def brute_force(rows, days, min_further, upper):
    found = set()
    for s, e, t in rows:
        if upper == "midnight":
            end = datetime.combine(t.date(), datetime.min.time()) + timedelta(days=days)
        else:
            end = t + timedelta(days=days)
        n = sum(1 for s2, e2, t2 in rows if s2 == s and e2 != e and t <= t2 <= end)
        if n >= min_further:
            found.add(s)
    return found


def random_rows(seed, subjects=60, events=400, span=80):
    rng = random.Random(seed)
    rows = []
    for event in range(events):
        # A third of all events belongs to one subject.
        subject = 0 if rng.random() < 0.33 else rng.randrange(subjects)
        t = datetime(2020, 1, 1) + timedelta(days=rng.randrange(span))
        if rng.random() < 0.6:
            t += timedelta(hours=rng.randrange(24), minutes=rng.choice([0, 30]))
        rows.append((subject, event, t))
    return rows


@pytest.mark.parametrize("upper", ["midnight", "exact"])
@pytest.mark.parametrize("seed,days,min_further", [(1, 7, 2), (2, 3, 1), (3, 1, 3), (4, 15, 4)])
def test_equals_definition(spark, upper, seed, days, min_further):
    rows = random_rows(seed)
    got = repeat_cohort(
        spark.createDataFrame(rows, SCHEMA), days=days, min_further=min_further, upper=upper
    ).collect()
    assert len(got) == len({r[0] for r in got})
    assert {r[0] for r in got} == brute_force(rows, days, min_further, upper)


@pytest.mark.parametrize(
    "minute,upper,kept", [(0, "midnight", True), (1, "midnight", False), (1, "exact", True)]
)
def test_upper_bound(spark, minute, upper, kept):
    start = datetime(2020, 1, 1, 9)
    last = datetime(2020, 12, 31, 0, minute)  # day of the start + 365
    rows = [(1, 1, start), (1, 2, start + timedelta(days=364, hours=1)), (1, 3, last)]
    got = repeat_cohort(spark.createDataFrame(rows, SCHEMA), upper=upper).count()
    assert got == int(kept)


def test_ties_count_each_other(spark):
    t = datetime(2020, 5, 5, 12)
    rows = [(1, 1, t), (1, 2, t), (2, 3, t)]
    for upper in ("midnight", "exact"):
        df = spark.createDataFrame(rows, SCHEMA)
        assert [r[0] for r in repeat_cohort(df, min_further=1, upper=upper).collect()] == [1]


def test_null_ids_and_bad_arguments(spark):
    t = datetime(2020, 5, 5)
    df = spark.createDataFrame([(None, 1, t), (None, 2, t), (1, 3, None)], SCHEMA)
    assert repeat_cohort(df, min_further=1).count() == 0
    for bad in ({"days": 0}, {"min_further": 0}, {"upper": "noon"}):
        with pytest.raises(ValueError):
            repeat_cohort(df, **bad)


def test_adult_counts_only_events_after_the_age(spark):
    birth = date(2000, 1, 1)
    of_age = datetime(2000, 1, 1) + timedelta(days=365 * 16)
    times = [of_age - timedelta(days=2), of_age - timedelta(days=1), of_age + timedelta(days=1)]
    rows = [(1, i, t) for i, t in enumerate(times)]
    rows += [(2, 10 + i, of_age + timedelta(days=i + 1)) for i in range(3)]
    patients = spark.createDataFrame([(1, birth), (2, birth)], "subject_id long, dob date")
    got = repeat_cohort_adult(spark.createDataFrame(rows, SCHEMA), patients)
    assert [r[0] for r in got.collect()] == [2]


def test_death_window(spark):
    schema = (
        "subject_id long, icustay_intime timestamp_ntz, dod date, expire_flg string, "
        "icustay_last_flg string, hospital_last_flg string"
    )
    t = datetime(2020, 3, 1, 8)
    rows = [
        (1, t, date(2020, 3, 1), "Y", "Y", "Y"),   # midnight of the day precedes the start
        (2, t, date(2020, 3, 31), "Y", "Y", "N"),
        (3, t, date(2020, 4, 1), "Y", "Y", "Y"),
        (4, t, date(2020, 3, 5), "N", "Y", "Y"),
        (5, t, date(2020, 3, 5), "Y", "N", "Y"),
        (6, t, date(2020, 3, 5), "Y", "Y", None),
    ]
    df = spark.createDataFrame(rows, schema)

    def ids(**options):
        return {r.subject_id for r in died_soon_after(df, **options).collect()}

    assert ids() == {2, 5, 6}
    assert ids(last_stay_only=True) == {2, 6}
    # NOT LIKE drops a missing flag as well.
    assert ids(last_stay_only=True, last_hospital_stay_only=True) == set()


def test_no_pairs_and_no_whole_subject_windows(spark):
    """The plan aggregates (or trims) by day before it orders by subject."""
    rows = spark.createDataFrame(random_rows(5), SCHEMA)
    plan = repeat_cohort(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "partial_count" in plan
    plan = repeat_cohort(rows, upper="exact")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "WindowGroupLimit" in plan
