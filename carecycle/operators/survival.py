"""Time to event and the Kaplan-Meier estimate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from carecycle.operators.ranges import running_sums

Z95 = 1.959963984540054


def kaplan_meier(
    df: DataFrame,
    days: str = "days",
    event: str = "event",
    strata: list[str] | None = None,
    impute: str | None = "max",
    positive_only: bool = False,
) -> DataFrame:
    """Kaplan-Meier curve per stratum: one row per distinct time.

    Missing times are censored at the largest observed time of all strata
    (``impute="max"``) or dropped (``None``). ``positive_only`` then drops times
    up to 0. The standard error is Greenwood's, the 95 % limits are taken on the
    logarithm of survival and capped at 1; all three are NULL once survival is
    0.

    Subjects are counted per time first. Whole numbers are days, of which a
    calendar bounds the ordered part, whatever the number of subjects. Times
    of other types, such as fractions of a day, may be as many as the subjects;
    they are ordered in ranges that know each other's totals.
    """
    by = list(strata or [])
    counts = df.groupBy(*by, F.col(days).alias("days")).agg(
        F.count("*").alias("_n"), F.sum(event).alias("_d")
    )
    whole = isinstance(df.schema[days].dataType, IntegralType)
    if impute == "max" and whole:
        largest = F.max("days").over(Window.partitionBy(F.lit(0)))
        counts = counts.withColumn("days", F.coalesce("days", largest))
    elif impute == "max":
        largest = counts.agg(F.max("days").alias("_largest"))  # one row
        counts = counts.crossJoin(F.broadcast(largest)).withColumn("days", F.coalesce("days", "_largest"))
    elif impute is not None:
        raise ValueError("impute must be 'max' or None")
    counts = counts.filter(F.col("days") > 0 if positive_only else F.col("days").isNotNull())
    steps = counts.groupBy(*by, "days").agg(F.sum("_n").alias("_n"), F.sum("_d").alias("events"))
    curve = _along_days(steps, by) if whole else _along_times(steps, by)
    return _with_limits(curve, by)


def _along_days(steps: DataFrame, by: list[str]) -> DataFrame:
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    along = whole.orderBy("days")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_risk = F.sum("_n").over(whole) - F.sum("_n").over(upto) + F.col("_n")
    d, n = F.col("events"), F.col("at_risk")
    return steps.withColumn("at_risk", at_risk).select(
        *by,
        "days",
        "at_risk",
        "events",
        F.product(1 - d / n).over(upto).alias("survival"),
        F.sqrt(F.sum(F.when(n > d, d / (n * (n - d)))).over(upto)).alias("_e"),
    )


def _along_times(steps: DataFrame, by: list[str]) -> DataFrame:
    """The same over ranges of times: numbers at risk first, then the logarithms of the factors are summed."""
    key = None
    if by:
        key = "_stratum"
        steps = steps.withColumn(key, F.to_json(F.struct(*by), {"ignoreNullFields": "false"}))
    counted = running_sums(steps, ["days"], {"_upto": "_n"}, key)
    counted = counted.withColumn("at_risk", F.col("_upto_all") - F.col("_upto") + F.col("_n"))
    d, n = F.col("events"), F.col("at_risk")
    counted = counted.withColumns({
        "_log": F.when(n > d, F.log(1 - d / n)).otherwise(0.0),
        "_ended": (n <= d).cast("long"),  # from here on nobody survives
        "_g": F.when(n > d, d / (n * (n - d))).otherwise(0.0),
    }).drop("_upto", "_upto_all")
    summed = running_sums(counted, ["days"], {"_logs": "_log", "_gone": "_ended", "_greenwood": "_g"}, key)
    survival = F.when(F.col("_gone") > 0, 0.0).otherwise(F.exp("_logs"))
    return summed.select(*by, "days", "at_risk", "events", survival.alias("survival"), F.sqrt("_greenwood").alias("_e"))


def _with_limits(curve: DataFrame, by: list[str]) -> DataFrame:
    alive = F.col("survival") > 0
    spread = Z95 * F.col("_e")
    return curve.select(
        *by,
        "days",
        "at_risk",
        "events",
        "survival",
        F.when(alive, F.col("survival") * F.col("_e")).alias("std_error"),
        F.when(alive, F.exp(F.log("survival") - spread)).alias("lower"),
        F.when(alive, F.least(F.exp(F.log("survival") + spread), F.lit(1.0))).alias("upper"),
    )


def mean_cumulative(
    events: DataFrame, followed: DataFrame, subject: str = "subject_id", time: str = "days", until: str = "days"
) -> DataFrame:
    """Expected number of recurrent events of a subject up to each time (mean cumulative function).

    ``events`` has a row for each event (subject, time since entry),
    ``followed`` one for each subject with the time until which it is observed.
    At a time with events, the mean rises by their number divided by the
    subjects still under observation; an event at or before a subject's end
    counts, later ones and those of unknown time or subject are left out. The
    standard error takes the counts as Poisson. Events and ends are counted
    per time first; the ordered part sees one row for each distinct time.
    """
    ends = followed.select(subject, F.col(until).alias("_until")).dropna()
    known = events.select(subject, F.col(time).alias("days")).dropna().join(ends, subject)
    happened = known.filter(F.col("days") <= F.col("_until")).groupBy("days").agg(F.count("*").alias("events"))
    left = ends.groupBy(F.col("_until").alias("days")).agg(F.count("*").alias("_left"))
    steps = happened.join(left, "days", "full_outer").fillna(0, ["events", "_left"])
    counted = running_sums(steps, ["days"], {"_gone": "_left"})
    at_risk = F.col("_gone_all") - F.col("_gone") + F.col("_left")
    counted = counted.withColumn("at_risk", at_risk).drop("_gone", "_gone_all")
    counted = counted.withColumns({
        "_rise": F.col("events") / F.col("at_risk"), "_spread": F.col("events") / F.col("at_risk") ** 2,
    })
    summed = running_sums(counted, ["days"], {"mean_events": "_rise", "_variance": "_spread"}).filter("events > 0")
    return summed.select("days", "at_risk", "events", "mean_events", F.sqrt("_variance").alias("std_error"))
