"""Column recoding: sentinels, caps, label merges, dummies, buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carecycle.functions.vocab import NULL_SENTINEL


def sentinel_to_null(df: DataFrame, sentinel: str = NULL_SENTINEL) -> DataFrame:
    """Replace the textual null marker by NULL in every string column."""
    return df.select(
        *[
            F.nullif(F.col(f.name), F.lit(sentinel)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def cap(value: Column, at: float = 90.0, to: float = 91.4, strict: bool = False) -> Column:
    """Replace values from ``at`` on (above it if ``strict``) by ``to``."""
    beyond = value > at if strict else value >= at
    return F.when(beyond, F.lit(to)).otherwise(value)


def merge_labels(label: Column, groups: dict[str, str]) -> Column:
    """Map raw labels to merged ones; unlisted labels stay as they are."""
    if not groups:
        return label
    pairs = [F.lit(x) for kv in groups.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), label), label)


def dummy(column: Column, value: str, missing: list[str] | None = None) -> Column:
    """1 where the label equals ``value``, else 0.

    With ``missing`` given, NULL and those labels give NULL, so that they are
    counted as missing instead of as 0.
    """
    flag = F.when(column == value, 1).otherwise(0)
    if missing is None:
        return flag
    return F.when(column.isNotNull() & ~column.isin(missing), flag)


def bucket(value: Column, bounds: list[tuple[float, str]], above: str) -> Column:
    """Label by the first inclusive upper bound reached, else ``above``."""
    if not bounds:
        return F.lit(above)
    chain = F.when(value <= bounds[0][0], bounds[0][1])
    for limit, label in bounds[1:]:
        chain = chain.when(value <= limit, label)
    return F.when(value.isNotNull(), chain.otherwise(above))


def row_sum(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])


def keep_prefix(text: Column, stop: str) -> Column:
    """The text up to (not including) the first ``stop`` character."""
    return F.substring_index(text, stop, 1)


def between_chars(text: Column, first: int, last: int) -> Column:
    """Characters ``first`` to ``last``, both 1-based and inclusive."""
    return F.substring(text, first, last - first + 1)


def with_unit(value: Column, unit: str, digits: int = 2) -> Column:
    """The rounded number and its unit as text; NULL stays NULL. Keep the number as a column beside it."""
    text = F.concat(F.format_string(f"%.{digits}f", F.round(value, digits)), F.lit(unit))
    return F.when(value.isNotNull(), text)
