"""Column profiles, category shares, tallies and confidence bounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carecycle.operators.ranges import column_summary

NORMAL_975 = 1.959963984540054


def exact_mean(value: Column) -> Column:
    """Mean as one division: exact sums (integers, decimals) give one result in any order."""
    return F.sum(value).cast("double") / F.count(value)


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, sd, median, min, max, rows, sum and missing, one row per column."""
    return column_summary(df, columns, {"median": 0.5}).drop("n")


def proportions(df: DataFrame, columns: dict[str, Column], digits: int = 3) -> DataFrame:
    """Count and share of every category of every column, NULLs left out."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("variable"), c.cast("string").alias("category"))
            for name, c in columns.items()
        ]
    )
    counts = (
        df.select(F.inline(pairs))
        .filter(F.col("category").isNotNull())
        .groupBy("variable", "category")
        .agg(F.count("*").alias("n"))
    )
    # One row per category is left, so the totals' window is small.
    whole = F.sum("n").over(Window.partitionBy("variable"))
    return counts.withColumn("share", F.round(F.col("n") / whole, digits))


def tally(df: DataFrame, key: str, size: str = "group_size", n: str = "n_keys") -> DataFrame:
    """How many keys have each number of rows."""
    sizes = df.groupBy(key).agg(F.count("*").alias(size))
    return sizes.groupBy(size).agg(F.count("*").alias(n))


def mean_sd_by(
    df: DataFrame, by: str, values: dict[str, Column], digits: int = 2
) -> DataFrame:
    """Mean and sd of each value per group; rows without a group are left out."""
    stats = [
        F.round(f(c), digits).alias(f"{stat}_{name}")
        for name, c in values.items()
        for stat, f in (("mean", F.avg), ("sd", F.stddev_samp))
    ]
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(*stats)


def ci_by(df: DataFrame, by: str, value: str, digits: int = 2) -> DataFrame:
    """Mean, sd, min, max, n and normal 95 % bounds of complete rows per group."""
    stats = (
        df.select(by, F.col(value).cast("double").alias("_x"))
        .dropna()
        .groupBy(by)
        .agg(
            F.avg("_x").alias("_mean"),
            F.stddev_samp("_x").alias("_sd"),
            F.min("_x").alias("min"),
            F.max("_x").alias("max"),
            F.count("*").alias("n"),
        )
    )
    half = F.lit(NORMAL_975) * F.col("_sd") / F.sqrt("n")
    return stats.select(
        by,
        F.round("_mean", digits).alias("mean"),
        F.round("_sd", digits).alias("sd"),
        "min",
        "max",
        "n",
        F.round(F.col("_mean") - half, digits).alias("ci_low"),
        F.round(F.col("_mean") + half, digits).alias("ci_high"),
    )


def any_flags(df: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """1 where a flag is set in any row of the key, else 0."""
    return df.groupBy(key).agg(
        *[F.when(F.sum(f) > 0, 1).otherwise(0).alias(f) for f in flags]
    )


def flag_prevalence(
    df: DataFrame, flags: list[str], name: str = "flag", digits: int = 2
) -> DataFrame:
    """Rows with each flag set and their share of all rows."""
    sums = df.agg(F.count("*").alias("_all"), *[F.sum(f).alias(f) for f in flags])
    rows = [F.struct(F.lit(f).alias(name), F.col(f).alias("n")) for f in flags]
    return sums.select("_all", F.inline(F.array(*rows))).select(
        name,
        F.coalesce("n", F.lit(0)).alias("n"),
        F.round(F.col("n") / F.col("_all"), digits).alias("share"),
    )


def counts_where(df: DataFrame, key: str, conditions: dict[str, Column]) -> DataFrame:
    """One count per condition and key, in one aggregation."""
    return df.groupBy(key).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def all_positive(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(c) > 0 for c in columns]))


def two_way(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Contingency table in long form: count of each pair, and its shares of row and column.

    NULL is a value of its own. Only the counts, a row for each pair, are windowed.
    """
    cells = df.groupBy(rows, columns).agg(F.count("*").alias("n"))
    row, column = Window.partitionBy(rows), Window.partitionBy(columns)
    return cells.withColumns(
        {
            "row_share": F.round(F.col("n") / F.sum("n").over(row), 3),
            "column_share": F.round(F.col("n") / F.sum("n").over(column), 3),
        }
    )


def margins(df: DataFrame, by: list[str], values: dict[str, Column], digits: int = 2) -> DataFrame:
    """Rows, and mean, sd and missing of each value, for the levels of every column of ``by``.

    One aggregation by grouping sets gives all margins: a row is (margin,
    level), with a NULL level of its own. Values are reduced on the map side.
    """
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in by], *[v.cast("double").alias(n) for n, v in values.items()])
    stats = [F.count("*").alias("n_rows")]
    for name in values:
        stats += [
            F.round(F.avg(name), digits).alias(f"mean_{name}"),
            F.round(F.stddev_samp(name), digits).alias(f"sd_{name}"),
            F.count_if(F.col(name).isNull()).alias(f"missing_{name}"),
        ]
    found = rows.groupingSets([[F.col(c)] for c in by], *by).agg(F.grouping_id().alias("_set"), *stats)
    margin = level = F.lit(None).cast("string")
    for i, c in enumerate(by):
        this = F.col("_set") == (1 << len(by)) - 1 - (1 << (len(by) - 1 - i))
        margin, level = F.when(this, c).otherwise(margin), F.when(this, F.col(c)).otherwise(level)
    return found.select(margin.alias("margin"), level.alias("level"), *[c for c in found.columns if c not in (*by, "_set")])
