"""Two-sample Kolmogorov-Smirnov p-values."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NEGLIGIBLE = 1e-18


def exact_p_value(h: int, n: int) -> float:
    """P(n D >= h) for two samples of n values without ties: alternating sum over reflected paths.

    The terms fall; the sum ends where one can no longer change it.
    """
    if h <= 0:
        return 1.0
    centre = 2 * math.lgamma(n + 1)
    p = 0.0
    for k in range(1, n // h + 1):
        path = math.exp(centre - math.lgamma(n - k * h + 1) - math.lgamma(n + k * h + 1))
        p += path if k % 2 else -path
        if path < _NEGLIGIBLE:
            break
    return min(1.0, 2 * p)


def exact_p_value_unequal(gap: int, n: int, m: int) -> float:
    """P(max |m F - n G| >= gap) for two samples of n and m values without ties.

    All orders of the n + m values are equally likely: the paths from (0, 0) to (n, m). The chance of being at each point of a
    diagonal is carried to the next one, and what reaches a point as far off as `gap` is taken out and added up, so that small
    values keep their digits. Work is n * m, a diagonal at a time.
    """
    if gap <= 0:
        return 1.0
    here, low, outside = np.ones(1), 0, 0.0  # chances at i = low, low + 1, ... of the diagonal
    for k in range(n + m):
        i = low + np.arange(len(here))
        right = here * (n - i) / (n + m - k)
        here = np.append(here - right, 0.0)
        here[1:] += right
        i = np.append(i, i[-1] + 1)
        far = np.abs(i * m - (k + 1 - i) * n) >= gap
        outside += float(here[far].sum())
        inside = np.flatnonzero(~far & (here > 0))
        if not len(inside):
            return 1.0
        here, low = here[inside[0] : inside[-1] + 1], int(i[inside[0]])
    return min(1.0, outside)


def asymptotic_p_value(d, n, m) -> np.ndarray:
    """Kolmogorov's limit for samples of n and m values."""
    x = np.asarray(d * np.sqrt(n * m / (n + m)))
    k = np.arange(1, 101)
    series = 2 * ((-1.0) ** (k + 1) * np.exp(-2 * (k * x[..., None]) ** 2)).sum(axis=-1)
    return np.where(x < 0.2, 1.0, np.clip(series, 0.0, 1.0))  # below 0.2 the value is 1 to 12 digits


@lru_cache
def critical_h(n: int, alpha: float) -> int:
    """Smallest h = n D that counts as drift, n + 1 if none does."""
    return next((h for h in range(1, n + 1) if exact_p_value(h, n) < alpha), n + 1)


def p_value_of(h: Column, n: int) -> Column:
    """p-value of h = n D as a lookup in the n + 1 possible values."""
    return F.element_at(F.array(*[F.lit(exact_p_value(i, n)) for i in range(n + 1)]), h + 1)


def _p_values(gap: pd.Series, n: pd.Series, m: pd.Series, exact_up_to: int) -> pd.Series:
    g, a, b = (x.astype(float).to_numpy() for x in (gap, n, m))
    known = (a > 0) & (b > 0)
    out = np.full(len(g), np.nan)
    out[known] = asymptotic_p_value(g[known] / (a[known] * b[known]), a[known], b[known])
    for i in np.flatnonzero(known & ((a == b) | (np.maximum(a, b) <= exact_up_to))):
        equal = a[i] == b[i]
        out[i] = exact_p_value(round(g[i] / a[i]), int(a[i])) if equal else exact_p_value_unequal(round(g[i]), int(a[i]), int(b[i]))
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def p_value(gap: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """p-value from max |m F - n G| of counts: exact for equal sizes, else asymptotic."""
    return _p_values(gap, n, m, 0)


def p_value_up_to(size: int):
    """As `p_value`, but exact also for unequal sizes up to `size`."""

    @F.pandas_udf(DoubleType())
    def exact(gap: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return _p_values(gap, n, m, size)

    return exact
