"""Tail probabilities for small aggregated tables; Spark has no such functions built in."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STEPS = 400


def gamma_tail(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Upper regularised incomplete gamma function Q(a, x), elementwise."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    with np.errstate(all="ignore"):
        scale = np.exp(a * np.log(x) - x - np.vectorize(math.lgamma)(a))
        term = 1.0 / a
        series = term.copy()
        for n in range(1, _STEPS):
            term = term * x / (a + n)
            series = series + term
        fraction = np.zeros_like(x)
        for n in range(_STEPS, 0, -1):
            fraction = n * (n - a) / (x + 2 * n + 1 - a - fraction)
        upper = scale / (x + 1 - a - fraction)
    out = np.where(x < a + 1, 1.0 - scale * series, upper)
    return np.where(x <= 0, 1.0, np.clip(out, 0.0, 1.0))


def beta_ratio(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b), elementwise, by its continued fraction."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    lbeta = np.vectorize(lambda v: math.lgamma(v) + math.lgamma(b) - math.lgamma(v + b))

    def fraction(p: np.ndarray, q: np.ndarray, z: np.ndarray) -> np.ndarray:
        tail = np.zeros_like(z)
        for m in range(_STEPS, 0, -1):
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m - 1) * (p + q + m - 1) * z / ((p + 2 * m - 2) * (p + 2 * m - 1))
            tail = odd / (1.0 + even / (1.0 + tail))
        return 1.0 / (1.0 + tail)

    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) - lbeta(a))
        direct = front * fraction(a, np.full_like(a, b), x) / a
        mirror = 1.0 - front * fraction(np.full_like(a, b), a, 1.0 - x) / b
    out = np.where(x < (a + 1) / (a + b + 2), direct, mirror)
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))
    return np.clip(out, 0.0, 1.0)


@F.pandas_udf(T.DoubleType())
def chi_square_tail(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    """P(chi-square with ``dof`` degrees exceeds ``statistic``)."""
    return pd.Series(gamma_tail(dof.to_numpy(float) / 2.0, statistic.to_numpy(float) / 2.0))


@F.pandas_udf(T.DoubleType())
def correlation_p(rho: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation under the t distribution with ``dof`` degrees."""
    r, v = rho.to_numpy(float), dof.to_numpy(float)
    return pd.Series(np.where(np.isnan(r), np.nan, beta_ratio(v / 2.0, 0.5, 1.0 - r * r)))
