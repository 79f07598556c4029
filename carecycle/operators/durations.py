"""First and last use of treatments, and how long they lasted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecycle.functions.dates import elapsed_days


def treatment_span(
    events: DataFrame,
    items: list,
    given: Column | None = None,
    timed: Column | None = None,
    stay: str = "icustay_id",
    item: str = "itemid",
    ts: str = "charttime",
) -> DataFrame:
    """Per stay: whether an item was given, first and last time, days between.

    ``given`` decides the flag and ``timed`` the span; both look at the same
    filtered rows in one aggregation.
    """
    given = F.lit(True) if given is None else given
    timed = F.lit(True) if timed is None else timed
    at = F.when(timed, F.col(ts))
    used = (
        events.filter(F.col(item).isin(items))
        .groupBy(stay)
        .agg(
            F.max(F.when(given & F.col(ts).isNotNull(), 1).otherwise(0)).alias("given"),
            F.min(at).alias("start_time"),
            F.max(at).alias("stop_time"),
        )
    )
    return used.withColumn("days", elapsed_days(F.col("start_time"), F.col("stop_time")))


def treatment_durations(
    stays: DataFrame,
    chart: DataFrame,
    meds: DataFrame,
    ventilation_items: list,
    pressor_items: list,
    dose: str = "dose",
) -> DataFrame:
    """Ventilation and vasopressor use of every stay, untreated ones included."""
    vent = treatment_span(chart, ventilation_items).select(
        "icustay_id",
        F.col("given").alias("mech_vent"),
        F.col("days").alias("days_on_vent"),
        F.col("start_time").alias("vent_start_dt"),
        F.col("stop_time").alias("vent_stop_dt"),
    )
    press = treatment_span(
        meds, pressor_items, given=F.col(dose) != 0, timed=F.col(dose) > 0
    ).select(
        "icustay_id",
        F.col("given").alias("vasopressors"),
        F.col("days").alias("days_on_pressors"),
        F.col("start_time").alias("press_start_dt"),
        F.col("stop_time").alias("press_stop_dt"),
    )
    return (
        stays.select("icustay_id", "subject_id", "hadm_id")
        .join(vent, "icustay_id", "left")
        .join(press, "icustay_id", "left")
        .fillna(0, ["mech_vent", "vasopressors"])
    )


def parsed_durations(
    df: DataFrame, begin: str, end: str, fmt: str = "M/d/yyyy H:mm"
) -> DataFrame:
    """Add ``duration`` in days between two textual times."""
    start, stop = (F.to_timestamp_ntz(F.col(c), F.lit(fmt)) for c in (begin, end))
    return df.withColumn("duration", elapsed_days(start, stop))
