"""Tail probabilities for summary rows (vectorised, one value per test)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (valid for small x)."""
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x < (a + 1.0) / (a + b + 2.0):
        return _beta_fraction(a, b, x)
    return 1.0 - _beta_fraction(b, a, 1.0 - x)


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t))


def f_two_sided(f: float, d1: float, d2: float) -> float:
    lower = beta_cdf(d1 / 2.0, d2 / 2.0, d1 * f / (d1 * f + d2))
    upper = beta_cdf(d2 / 2.0, d1 / 2.0, d2 / (d1 * f + d2))
    return 2.0 * min(lower, upper)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _map(function, *columns: pd.Series) -> pd.Series:
    known = ~np.logical_or.reduce([c.isna().to_numpy() for c in columns])
    values = [function(*row) if ok else None for ok, *row in zip(known, *columns)]
    return pd.Series(values, dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _map(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _map(f_two_sided, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def z_p(z: pd.Series) -> pd.Series:
    return _map(normal_two_sided, z)
