"""Seconds of the repeat cohort as windows and as the self-join it means.

Usage: python checks/baseline.py FOLDER [cpus]. Each value is the median of
three warm runs into a sink that discards rows; ``hot`` gives one subject a
tenth of all admissions. The self-join is Spark's, with the same settings.
"""

from __future__ import annotations

import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from carecycle.functions.dates import midnight_after  # noqa: E402
from carecycle.operators.cohort import repeat_cohort  # noqa: E402
from carecycle.session import configure  # noqa: E402
from carecycle.sources.analogs import Analogs  # noqa: E402


def self_join(events: DataFrame, min_further: int = 2, days: int = 365) -> DataFrame:
    a, b = events.alias("a"), events.alias("b")
    inside = F.col("b.admit_dt").between(F.col("a.admit_dt"), midnight_after(F.col("a.admit_dt"), days))
    pairs = a.join(b, (F.col("a.subject_id") == F.col("b.subject_id")) & (F.col("a.hadm_id") != F.col("b.hadm_id")) & inside)
    counts = pairs.groupBy("a.subject_id", "a.hadm_id").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= min_further).select("subject_id").distinct()


def main(folder: str, cpus: str = "8") -> None:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    plain = Analogs(configure(spark), folder).admissions()
    hot = plain.withColumn("subject_id", F.when(F.col("hadm_id") % 10 == 0, 7).otherwise(F.col("subject_id")))
    for rows, events in (("plain", plain), ("hot", hot)):
        for form, build in (("windows", repeat_cohort), ("self-join", self_join)):
            times = []
            for _ in range(4):
                start = time.perf_counter()
                build(events).write.format("noop").mode("overwrite").save()
                times.append(time.perf_counter() - start)
            print(rows, form, f"{statistics.median(times[1:]):.2f} s", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
