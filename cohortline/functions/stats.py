"""Tail probabilities for test statistics, evaluated on the few rows of a summary table."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

_EPS = 1e-15
_TINY = 1e-300
_STEPS = 500


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    c, out = 1.0, d
    for m in range(1, _STEPS):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + top / c
            c = c if abs(c) > _TINY else _TINY
            out *= d * c
        if abs(d * c - 1.0) < _EPS:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def upper_gamma(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = np.exp(a * np.log(x) - x - lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        for n in range(1, 10 * _STEPS):
            term *= x / (a + n)
            total += term
            if term < total * _EPS:
                break
        return 1.0 - front * total
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    out = d
    for n in range(1, 10 * _STEPS):
        top = -n * (n - a)
        b += 2.0
        d = 1.0 / (top * d + b)
        c = b + top / c
        out *= d * c
        if abs(d * c - 1.0) < _EPS:
            break
    return front * out


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    """P(|T| >= |t|) for Student's t."""
    return pd.Series([None if pd.isna(x) or pd.isna(v) or v <= 0 else float(incomplete_beta(v / 2, 0.5, v / (v + x * x)))
                      for x, v in zip(t, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi_square_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    """P(X >= x) for chi-square."""
    return pd.Series([None if pd.isna(v) or pd.isna(k) or k <= 0 else float(upper_gamma(k / 2, v / 2))
                      for v, k in zip(x, dof)], dtype="float64")
