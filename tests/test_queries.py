"""Every named query against its SQL, and relations that hold on any data."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "checks")]
import __spark_entry__ as entry  # noqa: E402
import parity  # noqa: E402
from carecycle.plans.catalog import QUERIES  # noqa: E402
from carecycle.plans.oracle import ORACLE  # noqa: E402
from carecycle.sources.analogs import Analogs  # noqa: E402
from carecycle.sources.tables import own_name  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return parity.connect(FOLDER)


def rows(spark, name):
    return entry.queries()[name](spark, FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, db, name):
    assert parity.compare(spark, db, FOLDER, name) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["subject_id"] and df.count() > 0


def test_every_query_has_sql():
    own = {name for name in entry.queries() if name in QUERIES}
    assert own == set(QUERIES) and own <= set(entry.oracle_sql()) <= set(entry.queries())


def test_models_list_every_term(spark):
    main = rows(spark, "mortality_model").collect()
    assert len(main) == 31 and main[0].term == "(Intercept)"
    full = rows(spark, "mortality_interactions").collect()
    assert len(full) == 128
    assert any(r.estimate is None for r in full)  # rare combinations are aliased
    assert all((r.estimate is None) == (r.std_error is None) for r in full)


def test_relations(spark):
    stays = rows(spark, "adult_stays")
    n = stays.count()
    assert stays.select("icustay_id").distinct().count() == n
    cohort = rows(spark, "repeat_cohort")
    assert stays.join(cohort, "subject_id", "left_anti").count() == 0
    category = rows(spark, "admission_category")
    assert category.select("hadm_id").distinct().count() == category.count()
    flags = rows(spark, "comorbidity_any")
    assert flags.select("subject_id").distinct().count() == flags.count()
    sample = rows(spark, "negative_cohort")
    assert sample.join(rows(spark, "repeat_cohort_selective"), "subject_id").count() == 0
    assert all(0 <= r.percent <= 100 for r in rows(spark, "treated_share").collect())
    tally = rows(spark, "stays_tally").selectExpr("sum(icu_count * no_patients)").first()[0]
    assert tally == n
    matrix = rows(spark, "disagreement_matrix").filter("sum_disagree > 0").count()
    assert rows(spark, "disagreement_rate").first().notes_disputed == matrix


def test_quarantine_shares_the_subjects(spark):
    """Two of the three extracts read the subjects that were written once."""
    name = own_name(spark, "carecycle_quarantine_subjects")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    a = Analogs(spark, FOLDER)
    kinds = {(r.extract, r.kind) for r in QUERIES["extract_quarantine"](a).collect()}
    assert {(e, "row") for e in ("demographics", "comorbidities", "codes")} <= kinds
    assert spark.table(name).columns == ["subject_id"]
    spark.sql(f"DROP TABLE {name}")
