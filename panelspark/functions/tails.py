"""Tail probabilities of the t, chi-square and normal distributions for test statistics.

They run on a handful of statistics per group, never on data rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_TINY = 1e-300
NORMAL_FROM = 1e6  # degrees of freedom from which the t tail is the normal tail with its first correction


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    total = d
    for m in range(1, 500):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + numerator / c
            c = c if abs(c) > _TINY else _TINY
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return total
    return math.nan  # no convergence


def _log_gamma_ratio(a: float, b: float) -> float:
    """log of gamma(a + b) / gamma(a); the difference of two large logarithms would lose its digits."""
    if b != 0.5 or a < 100:
        return math.lgamma(a + b) - math.lgamma(a)
    return 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a ** 3)


def beta_regularized(a: float, b: float, x: float, complement: float) -> float:
    """I_x(a, b); ``complement`` is 1 - x, given apart so that it keeps its digits near x = 1."""
    if x <= 0.0:
        return 0.0
    if complement <= 0.0:
        return 1.0
    log_x = math.log1p(-complement) if complement < 0.5 else math.log(x)
    log_front = _log_gamma_ratio(a, b) - math.lgamma(b) + a * log_x + b * math.log(complement)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, complement) / b


def t_two_sided(t, df):
    """P(|T| >= |t|) with ``df`` degrees of freedom; NaN where undefined."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    for i in np.ndindex(t.shape):
        if df[i] > 0 and np.isinf(t[i]):
            out[i] = 0.0
        elif df[i] > NORMAL_FROM and np.isfinite(t[i]):
            z = abs(t[i]) * (1 - 1 / (4 * df[i])) / math.sqrt(1 + t[i] * t[i] / (2 * df[i]))
            out[i] = math.erfc(z / math.sqrt(2))
        elif df[i] > 0 and np.isfinite(t[i]):
            square = t[i] * t[i]
            out[i] = beta_regularized(df[i] / 2, 0.5, df[i] / (df[i] + square), square / (df[i] + square))
    return out


def chi2_upper(x, df):
    """P(X >= x) of a chi-square variable, by series below the mean and continued fraction above."""
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df, float))
    out = np.full(x.shape, np.nan)
    for i in np.ndindex(x.shape):
        if not (df[i] > 0 and np.isfinite(x[i])):
            continue
        a, z = df[i] / 2, max(x[i], 0.0) / 2
        if z == 0.0:
            out[i] = 1.0
            continue
        front = math.exp(a * math.log(z) - z - math.lgamma(a))
        if z < a + 1.0:
            term = total = 1.0 / a
            k = a
            while abs(term) > abs(total) * 1e-16:
                k += 1.0
                term *= z / k
                total += term
            out[i] = 1.0 - front * total
        else:
            b = z + 1.0 - a
            c, d = 1.0 / _TINY, 1.0 / b
            h = d
            for m in range(1, 1000):
                an = -m * (m - a)
                b += 2.0
                d = an * d + b
                d = 1.0 / (d if abs(d) > _TINY else _TINY)
                c = b + an / c
                c = c if abs(c) > _TINY else _TINY
                h *= c * d
                if abs(c * d - 1.0) < 1e-15:
                    break
            else:
                h = math.nan  # no convergence
            out[i] = front * h
    return out


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def t_pvalue(t, df):
    """Two-sided p-value as a column."""
    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(t_two_sided(a.to_numpy(float), b.to_numpy(float)))

    return tail(t, df)


def chi2_pvalue(x, df):
    """Upper-tail p-value as a column."""
    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(chi2_upper(a.to_numpy(float), b.to_numpy(float)))

    return tail(x, df)
