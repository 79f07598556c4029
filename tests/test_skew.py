"""A subject with a third of all rows is split, not read by one task."""

import pytest
from pyspark.sql import functions as F

from carecycle.operators.cohort import repeat_cohort
from carecycle.operators.joins import members, non_members
from carecycle.operators.pick import repeats

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
}


@pytest.fixture()
def small_partitions(spark):
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k in SMALL:
        spark.conf.unset(k)


@pytest.fixture()
def events(spark, tmp_path):
    hot = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 20000)
    rows = spark.range(600_000).select(
        hot.alias("subject_id"),
        F.col("id").alias("hadm_id"),
        (
            F.lit("2000-01-01").cast("timestamp_ntz")
            + F.make_dt_interval((F.col("id") * 7919 % 9000).cast("int"))
        ).alias("admit_dt"),
    )
    rows.write.parquet(str(tmp_path / "events"))
    return spark.read.parquet(str(tmp_path / "events"))


def executed(df):
    df.toArrow()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def test_members_split_the_hot_subject(events, small_partitions):
    cohort = repeat_cohort(events)
    kept = members(events, cohort)
    assert "skew=true" in executed(kept)
    assert kept.filter("subject_id = 7").count() > 199_000
    assert kept.count() + non_members(events, cohort).count() == 600_000


def test_repeats_split_the_hot_key(events, small_partitions):
    rest = repeats(events, ["subject_id"], "hadm_id")
    assert "skew=true" in executed(rest)
    assert rest.count() == 600_000 - events.select("subject_id").distinct().count()


def test_cohort_sends_days_not_rows_of_the_hot_subject(events, small_partitions):
    """A hot subject's window holds one row per day of the calendar."""
    daily = events.filter("subject_id = 7").select(F.to_date("admit_dt")).distinct().count()
    assert daily <= 9000
    assert repeat_cohort(events).filter("subject_id = 7").count() == 1


def test_many_followers_of_a_hot_subject(spark, events, small_partitions):
    """Beyond Spark's window group limit no subject's rows are sorted whole, and the answer stays exact."""
    found = repeat_cohort(events, min_further=5000, upper="exact", days=365)
    plan = executed(found)
    assert "WindowGroupLimit" not in plan
    assert [r.subject_id for r in found.collect()] == [7]
    few = events.filter("subject_id < 40").repartition(4)
    limit = "spark.sql.optimizer.windowGroupLimitThreshold"
    for k in (1, 2, 3):
        want = {r.subject_id for r in repeat_cohort(few, min_further=k, upper="exact", days=2500).collect()}
        spark.conf.set(limit, "1")
        got = [r.subject_id for r in repeat_cohort(few, min_further=k, upper="exact", days=2500).collect()]
        spark.conf.unset(limit)
        assert len(got) == len(set(got)) and set(got) == want
