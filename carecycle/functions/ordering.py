"""Reproducible pseudo-random order from a seed and a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: str, *keys: Column) -> Column:
    """md5 of ``seed:key:...``; sorting by it is a uniform, repeatable shuffle."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys]))
