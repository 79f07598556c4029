"""Subjects with repeated events inside a moving time window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carecycle.functions.dates import midnight_after, plus_days
from carecycle.operators.joins import members


def repeat_cohort(
    events: DataFrame,
    subject: str = "subject_id",
    event: str = "hadm_id",
    ts: str = "admit_dt",
    days: int = 365,
    min_further: int = 2,
    upper: str = "midnight",
) -> DataFrame:
    """Subjects with an event followed by at least ``min_further`` other events.

    The window starts at the event (ties count) and ends, inclusively, at
    midnight of its day + ``days`` (``upper="midnight"``) or at the same time
    of day (``upper="exact"``). ``event`` identifies an event and is unique.

    No pairs of events are built, and no subject is ever gathered whole: rows
    are first reduced per subject and day, on the map side as well, so that one
    subject reaches the final window with a calendar-bounded number of rows.
    """
    if days < 1 or min_further < 1:
        raise ValueError("days and min_further must be at least 1")
    columns = [subject, event, ts]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    rows = events.select(*columns).filter(known)
    if upper == "midnight":
        return _by_daily_counts(rows, subject, ts, days, min_further)
    if upper == "exact":
        limit = int(events.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
        if min_further + 1 > limit:  # beyond it Spark trims no group before the shuffle
            return _by_instants(rows, subject, ts, days, min_further)
        return _by_nth_follower(rows, subject, event, ts, days, min_further)
    raise ValueError("upper must be 'midnight' or 'exact'")


def _by_daily_counts(rows, subject, ts, days, min_further):
    # All events of a day share the upper bound, so the day's earliest event has
    # the most followers; counts per day decide the question.
    midnight = F.col(ts).cast("date").cast(rows.schema[ts].dataType)
    daily = (
        rows.withColumn("_day", F.unix_date(F.col(ts).cast("date")))
        .groupBy(subject, "_day")
        .agg(
            F.count("*").alias("_n"),
            F.count_if(F.col(ts) == midnight).alias("_at_midnight"),
        )
    )
    w = Window.partitionBy(subject).orderBy("_day")
    until = F.sum("_n").over(w.rangeBetween(Window.unboundedPreceding, days - 1))
    before = F.coalesce(
        F.sum("_n").over(w.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    on_bound = F.coalesce(F.sum("_at_midnight").over(w.rangeBetween(days, days)), F.lit(0))
    further = until - before + on_bound - 1
    return (
        daily.select(subject, further.alias("_further"))
        .filter(F.col("_further") >= min_further)
        .select(subject)
        .distinct()
    )


def _by_nth_follower(rows, subject, event, ts, days, min_further):
    # A day's first min_further + 1 events are enough: either they qualify the
    # subject by themselves, or they are all events of that day.
    within_day = Window.partitionBy(subject, "_day").orderBy(ts, event)
    kept = (
        rows.withColumn("_day", F.col(ts).cast("date"))
        .withColumn("_rank", F.row_number().over(within_day))
        .filter(F.col("_rank") <= min_further + 1)
    )
    along = Window.partitionBy(subject).orderBy(ts, event)
    nth = F.lead(ts, min_further).over(along)
    return (
        kept.select(subject, ts, nth.alias("_nth"))
        .filter(F.col("_nth") <= plus_days(F.col(ts), days))
        .select(subject)
        .distinct()
    )


def _by_instants(rows, subject, ts, days, min_further):
    # Counts per day settle most subjects: the days fully inside an event's
    # window are enough, or all days it touches are too few. In what is left no
    # day holds more than min_further events, or that day alone would have been
    # enough, so a subject's rows are bounded by the calendar once more.
    daily = rows.groupBy(subject, F.unix_date(F.col(ts).cast("date")).alias("_day")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(subject).orderBy("_day")
    inside = F.sum("_n").over(w.rangeBetween(0, days - 1)) - 1
    touched = F.sum("_n").over(w.rangeBetween(0, days)) - 1
    bounds = daily.select(subject, inside.alias("_inside"), touched.alias("_touched")).groupBy(subject)
    bounds = bounds.agg(F.max("_inside").alias("_inside"), F.max("_touched").alias("_touched"))
    bounds = bounds.filter(F.col("_touched") >= min_further)
    enough = F.col("_inside") >= min_further
    open_rows = members(rows, bounds.filter(~enough), subject)
    instants = open_rows.groupBy(subject, ts).agg(F.count("*").alias("_n"))
    further = F.expr(
        f"sum(_n) OVER (PARTITION BY `{subject}` ORDER BY `{ts}` "
        f"RANGE BETWEEN CURRENT ROW AND INTERVAL '{days}' DAY FOLLOWING) - 1"
    )
    found = instants.select(subject, further.alias("_further")).filter(F.col("_further") >= min_further)
    return bounds.filter(enough).select(subject).union(found.select(subject).distinct())


def repeat_cohort_adult(
    events: DataFrame,
    patients: DataFrame,
    subject: str = "subject_id",
    event: str = "hadm_id",
    ts: str = "admit_dt",
    dob: str = "dob",
    min_age_days: int = 365 * 16,
    days: int = 365,
    min_further: int = 2,
) -> DataFrame:
    """The same with the exact bound, over events after the minimum age.

    A follower is never younger than the event it follows, so filtering all
    events by age is the same as asking it of the first one.
    """
    return repeat_cohort(
        of_age(events, patients, subject, ts, dob, min_age_days),
        subject, event, ts, days, min_further, upper="exact",
    )


def of_age(
    events: DataFrame,
    patients: DataFrame,
    subject: str = "subject_id",
    ts: str = "admit_dt",
    dob: str = "dob",
    min_age_days: int = 365 * 16,
) -> DataFrame:
    """Events later than ``min_age_days`` after birth."""
    born = patients.select(subject, F.col(dob).cast("timestamp_ntz").alias("_born"))
    return (
        events.join(born, subject)
        .filter(F.col(ts) > plus_days(F.col("_born"), min_age_days))
        .drop("_born")
    )


def died_soon_after(
    stays: DataFrame,
    start: str = "icustay_intime",
    death: str = "dod",
    expired: str = "expire_flg",
    days: int = 30,
    last_stay_only: bool = False,
    last_hospital_stay_only: bool = False,
) -> DataFrame:
    """Stays of subjects who died from the stay's start up to ``days`` later.

    A death date without time of day counts as midnight, so a death on the
    starting day precedes the start and is left out.
    """
    died = F.col(death).cast("timestamp_ntz")
    kept = stays.filter(
        F.col(expired).like("%Y%")
        & died.between(F.col(start), midnight_after(F.col(start), days))
    )
    if last_stay_only:
        kept = kept.filter(F.col("icustay_last_flg").like("%Y%"))
    if last_hospital_stay_only:
        kept = kept.filter(~F.col("hospital_last_flg").like("%N%"))
    return kept
