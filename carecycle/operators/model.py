"""Gaussian linear models with aliased terms reported as NULL."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTERCEPT = "(Intercept)"
COEFFICIENTS = "term string, estimate double, std_error double, t_value double, p_value double"
SUMMARY = (
    "n long, parameters long, df_residual long, dispersion double, deviance double, "
    "null_deviance double, aic double"
)


def main_effects(flags: list[str]) -> dict[str, list[str]]:
    return {f: [f] for f in flags}


def full_interactions(flags: list[str]) -> dict[str, list[str]]:
    """Every product of one or more flags, lower orders first."""
    return {
        ":".join(combo): list(combo)
        for size in range(1, len(flags) + 1)
        for combo in combinations(flags, size)
    }


def linear_model(df: DataFrame, response: str, terms: dict[str, list[str]]) -> DataFrame:
    """Coefficient table of the least-squares fit of ``response`` on ``terms``.

    A term is a product of columns. Terms that are constant or linear
    combinations of earlier ones are left out of the fit and listed with NULLs.
    Rows with a NULL are left out. With as many parameters as rows the
    estimates have no errors (NULL); if no term is left, the intercept is the
    mean; without a row every number is NULL. Only matrices of the size of the
    model reach the driver, MERGED of them at most.
    """
    return _table(df, _fit(df, response, terms), list(terms))


def _table(df: DataFrame, found: dict, terms: list[str]) -> DataFrame:
    rows = [(t, *found.get(t, (None,) * 4)) for t in [INTERCEPT, *terms]]
    return df.sparkSession.createDataFrame(rows, COEFFICIENTS)


def model_summary(df: DataFrame, response: str, terms: dict[str, list[str]]) -> DataFrame:
    """One row on the fit: rows, parameters, residual degrees of freedom, dispersion, deviances, AIC.

    Dispersion is NULL without degrees of freedom, AIC without a residual.
    """
    found = _fit(df, response, terms)
    n, deviance, null_deviance = found["size"]
    used = sum(e[0] is not None for e in (found.get(t, (None,)) for t in [INTERCEPT, *terms]))
    free = n - used
    aic = None
    if n and deviance > 0:
        aic = n * (math.log(2 * math.pi * deviance / n) + 1) + 2 * (used + 1)
    row = (n, used, free, deviance / free if free > 0 else None, deviance, null_deviance, aic)
    return df.sparkSession.createDataFrame([row], SUMMARY)


def _fit(df: DataFrame, response: str, terms: dict[str, list[str]]) -> dict:
    """(estimate, error, t, p) by term, and under "size" the rows and both deviances."""
    n, mean, scatter = _moments(df, response, terms)
    if not n:
        return {"size": (0, 0.0, 0.0)}
    y = len(terms)
    size = np.sqrt(np.maximum(np.diag(scatter), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        correlation = np.nan_to_num(scatter / np.outer(size, size))
    kept, swept = _sweep(correlation, size[:y])
    inverse = -swept[np.ix_(kept, kept)] / np.outer(size[kept], size[kept])
    slope = swept[kept, y] * size[y] / size[kept]
    null_deviance = float(scatter[y, y])
    deviance = max(0.0, null_deviance * float(swept[y, y]))
    free = n - len(kept) - 1
    centre = mean[kept]
    estimates = [mean[y] - (centre * slope).sum(), *slope]
    leverage = [1 / n + (np.outer(centre, centre) * inverse).sum(), *np.diag(inverse)]
    found: dict = {"size": (n, deviance, null_deviance)}
    labels = [INTERCEPT, *(list(terms)[k] for k in kept)]
    for label, estimate, lever in zip(labels, estimates, leverage):
        error = t = p = None
        if free > 0:
            error = math.sqrt(deviance / free * max(0.0, float(lever)))
            if error > 0:
                t = float(estimate) / error
                p = t_tail(abs(t), free)
        found[label] = (float(estimate), error, t, p)
    return found


MERGED = 64  # matrices of moments that reach the driver at most
_MOMENTS = "n double, mean array<double>, scatter array<double>"


def _moments(df: DataFrame, response: str, terms: dict[str, list[str]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means, and square sums about the means, of the terms and the response.

    Rows are counted by the values of the terms' factors first (map-side), with
    the response's mean and square sum in each; the products are formed once
    for each of these patterns, weighted by its rows. With flags as factors
    there are few patterns, whatever the number of rows. Each task reduces its
    patterns to one matrix, and at most MERGED merged ones reach the driver.
    """
    factors = list(dict.fromkeys(f for parts in terms.values() for f in parts))
    rows = df.select(*[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(factors)],
                     F.col(response).cast("double").alias("_y")).dropna()
    by = [f"_f{i}" for i in range(len(factors))]
    patterns = rows.groupBy(*by).agg(
        F.count("*").cast("double").alias("_n"), F.avg("_y").alias("_mean"), F.var_pop("_y").alias("_spread")
    )
    at = [[factors.index(f) for f in parts] for parts in terms.values()]
    k = len(terms) + 1

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            x, n = batch[by].to_numpy(float).reshape(len(batch), len(by)), batch["_n"].to_numpy()
            if not len(n):
                continue
            z = np.column_stack([*[x[:, i].prod(1) for i in at], batch["_mean"]])
            mean = (n @ z) / n.sum()
            scatter = (z - mean).T @ ((z - mean) * n[:, None])
            scatter[-1, -1] += (n * batch["_spread"]).sum()
            total = _merged(total, (n.sum(), mean, scatter))
        if total:
            yield pd.DataFrame({"n": [total[0]], "mean": [total[1]], "scatter": [total[2].ravel()]})

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for r in rows.itertuples():
            total = _merged(total, (r.n, np.array(r.mean), np.array(r.scatter).reshape(k, k)))
        return pd.DataFrame({"n": [total[0]], "mean": [total[1]], "scatter": [total[2].ravel()]})

    total = None
    parts = patterns.mapInPandas(reduced, _MOMENTS).withColumn("part", F.spark_partition_id() % MERGED)
    parts = parts.groupBy("part").applyInPandas(merged, _MOMENTS)
    for r in parts.collect():
        total = _merged(total, (r.n, np.array(r.mean), np.array(r.scatter).reshape(k, k)))
    return (int(total[0]), *total[1:]) if total else (0, np.zeros(k), np.zeros((k, k)))


def _merged(a: tuple | None, b: tuple) -> tuple:
    """Moments of two sets of rows together."""
    if a is None:
        return b
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def t_tail(t: float, free: int) -> float:
    """Probability that Student's t with ``free`` degrees of freedom lies beyond t on either side.

    That is the regularised incomplete beta function at free / (free + t^2),
    summed as its continued fraction by the modified method of Lentz.
    """
    x = free / (free + t * t)
    a, b = free / 2, 0.5
    if x <= 0 or x >= 1:
        return float(x >= 1)
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    total = d
    for m in range(1, 400):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    value = front * total
    return min(1.0, max(0.0, 1 - value if swap else value))


def _sweep(
    correlation: np.ndarray, spread: np.ndarray, tolerance: float = 1e-9
) -> tuple[list[int], np.ndarray]:
    """Sweeps the columns with a part that earlier ones do not explain, one after the other.

    A constant column is explained by the intercept. Returns the swept columns
    and the matrix: minus their inverse, their slopes in the last column, and
    the share of the response that is left in the last corner.
    """
    left = correlation.copy()
    kept = []
    for j in range(len(spread)):
        pivot = left[j, j]
        if spread[j] > 0 and pivot > tolerance:
            kept.append(j)
            column, row = left[:, j].copy(), left[j, :].copy()
            left -= np.outer(column, row) / pivot
            left[:, j], left[j, :] = column / pivot, row / pivot
            left[j, j] = -1 / pivot
    return kept, left
