"""Row numbers, exact quantiles and column summaries, spread over value ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, MapType, StructField, StructType, VariantType

# Columns that ranged rows carry: the row's range, and for rows of totals the range they come from.
RANGE, SENT_BY = "_range", "_sent_by"


def _share(ranges: int, by: str | None, weights: list[str]):
    """Passes a range's rows on and ends with its totals, one row of them for each range."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()
        totals: dict[object, list] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([own] * n, pa.int32()), pa.nulls(n, pa.int32())],
                [*schema.names, RANGE, SENT_BY],
            )
            part = pa.table(batch.select([by, *weights] if by else weights))
            part = part.group_by([by] if by else []).aggregate([(w, "sum") for w in weights])
            for row in part.to_pylist():
                so_far = totals.setdefault(row[by] if by else None, [0] * len(weights))
                for i, w in enumerate(weights):
                    so_far[i] += row[f"{w}_sum"] or 0
        for key, sums in totals.items():
            sent = {w: pa.array([s] * ranges, schema.field(w).type) for w, s in zip(weights, sums)}
            if by:
                sent[by] = pa.array([key] * ranges, schema.field(by).type)
            columns = [sent[f.name] if f.name in sent else pa.nulls(ranges, f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(range(ranges), pa.int32()), pa.array([own] * ranges, pa.int32())],
                [*schema.names, RANGE, SENT_BY],
            )

    return rows


def _ranged(
    df: DataFrame, order: list[str], weights: list[str], by: str | None = None, ranges: int | None = None
) -> DataFrame:
    """Rows cut into ranges of ``order``, and in every range a row with each range's totals.

    Adds RANGE, and SENT_BY, which is null for rows of ``df`` and the sender's
    range for totals: those hold the sums of ``weights`` there, for each value
    of ``by``, and NULL elsewhere. A window over a range then knows what lies
    before it without a join and without reading ``df`` again. Ranges are as
    many as the session's shuffle partitions, cut by Spark's own sample; the
    totals are that number squared, small rows all.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = [StructField(f.name, f.dataType) for f in df.schema]
    schema = StructType([*fields, StructField(RANGE, IntegerType()), StructField(SENT_BY, IntegerType())])
    return df.repartitionByRange(ranges, *order).mapInArrow(_share(ranges, by, weights), schema)


def _is_row() -> Column:
    return F.col(SENT_BY).isNull()


def _upto(weight: str, order: list[str], by: list[str]) -> Column:
    """Sum of a weight over all ranges before and over the rows up to this one."""
    along = Window.partitionBy(RANGE, *by).orderBy(_is_row(), *order)
    counts = _is_row() | (F.col(SENT_BY) < F.col(RANGE))
    return F.sum(F.when(counts, F.col(weight)).otherwise(0)).over(
        along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def running_sums(
    df: DataFrame, order: list[str], sums: dict[str, str], by: str | None = None, ranges: int | None = None
) -> DataFrame:
    """Adds for each ``name: weight`` of ``sums`` the sum of the weight over the rows up to each row, and ``<name>_all``, that over all rows.

    Rows are taken in the order of columns that together are unique, each
    value of ``by`` by itself. No task sees more than a range of them.
    """
    key = [by] if by else []
    shared = _ranged(df, [*key, *order], list(dict.fromkeys(sums.values())), by, ranges)
    whole = Window.partitionBy(RANGE, *key)
    found = {name: _upto(weight, order, key) for name, weight in sums.items()}
    found |= {f"{name}_all": F.sum(F.when(~_is_row(), F.col(w))).over(whole) for name, w in sums.items()}
    return shared.withColumns(found).filter(_is_row()).drop(RANGE, SENT_BY)


def _hashable(kind: DataType) -> bool:
    """Whether Spark hashes values of the type; it does not hash maps, wherever they stand."""
    if isinstance(kind, (MapType, VariantType)):
        return False
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind)
    return _hashable(kind.elementType) if hasattr(kind, "elementType") else True


def number_rows(df: DataFrame, key: str | list[str], out: str = "row_num", ranges: int | None = None) -> DataFrame:
    """Number rows 1..n in the order of one or more columns of any orderable type, in parallel.

    NULL comes first. Rows with equal keys stand in the order of a hash of the
    whole row, by which a key that many rows share is cut into ranges too; rows
    equal in every column are numbered in any order.
    """
    keys = [key] if isinstance(key, str) else list(key)
    hashed = [F.col(f"`{f.name}`") for f in df.schema if _hashable(f.dataType)]
    order = [*(f"`{k}`" for k in keys), "_tie"]
    rows = df.withColumn("_tie", F.xxhash64(*hashed)).withColumn("_one", F.lit(1).cast(LongType()))
    numbered = _ranged(rows, order, ["_one"], ranges=ranges).withColumn(out, _upto("_one", order, []))
    return numbered.filter(_is_row()).drop("_tie", "_one", RANGE, SENT_BY)


def column_summary(df: DataFrame, columns: list[str], probs: dict[str, float]) -> DataFrame:
    """Counts, moments and exact quantiles, one row per column.

    ``probs`` maps output names to probabilities; quantiles interpolate
    linearly between neighbours. NaN counts as missing, like NULL. Rows are
    counted per value once (map-side first); the counted values of all columns
    are cut into ranges together, and each range knows the totals of the
    others, so it knows the ranks its values have. ``df`` is read once.
    """
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value"),
            )
            for c in columns
        ]
    )
    counted = df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("_n"))
    known = F.when(F.col("value").isNotNull(), F.col("_n")).otherwise(0)
    counted = counted.withColumn("_known", known).withColumn("_sum", F.col("value") * known)
    rows = running_sums(counted, ["value"], {"_upto": "_known", "_total": "_sum"}, by="column")

    spread = F.col("_known") * (F.col("value") - F.col("_total_all") / F.nullif("_upto_all", F.lit(0))) ** 2
    picks = []
    for name, p in probs.items():
        x = (F.col("_upto_all") - 1) * F.lit(float(p))
        picks += [
            F.min(F.when(F.col("_upto") > rank, F.col("value"))).alias(f"_{name}_{end}")
            for end, rank in (("lo", F.floor(x)), ("hi", F.ceil(x)))
        ]
        picks.append(F.first(x - F.floor(x)).alias(f"_{name}_w"))
    found = rows.groupBy("column").agg(
        F.sum("_n").alias("n_rows"), F.sum("_known").alias("n"), F.sum("_sum").alias("sum"),
        F.sum(spread).alias("_spread"), F.min("value").alias("min"), F.max("value").alias("max"), *picks,
    )
    n = F.col("n")
    return found.select(
        "column",
        "n_rows",
        "n",
        (F.col("n_rows") - n).alias("missing"),
        "sum",
        (F.col("sum") / F.nullif(n, F.lit(0))).alias("mean"),
        F.sqrt(F.when(n > 1, F.col("_spread") / (n - 1))).alias("sd"),
        "min",
        "max",
        *[
            (
                F.col(f"_{q}_lo") + (F.col(f"_{q}_hi") - F.col(f"_{q}_lo")) * F.col(f"_{q}_w")
            ).alias(q)
            for q in probs
        ],
    )


def five_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, missing, min, quartiles, mean and max, one row per column."""
    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    return column_summary(df, columns, quartiles).drop("n_rows", "sum", "sd")
