"""Tail probabilities of the chi-square and Student t distributions.

No scipy in the environment, so these are closed forms / continued
fractions. They run as Arrow-batched pandas UDFs over rows that are
already reduced to one row per test, never over data rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chi2_sf(x: float, k: int) -> float:
    """P(X > x) for X ~ chi-square with integer ``k`` degrees of freedom."""
    if x is None or k is None or k <= 0 or math.isnan(x):
        return float("nan")
    if x <= 0:
        return 1.0
    if k % 2 == 0:
        # exp(-x/2) * sum_{i < k/2} (x/2)^i / i!
        term, total = 1.0, 1.0
        for i in range(1, k // 2):
            term *= (x / 2.0) / i
            total += term
        return min(1.0, math.exp(-x / 2.0) * total)
    # odd k: erfc(sqrt(x/2)) + sqrt(2x/pi) exp(-x/2) sum_{i=1..(k-1)/2} x^(i-1) / (1*3*...*(2i-1))
    s = math.erfc(math.sqrt(x / 2.0))
    if k > 1:
        term = math.sqrt(2.0 * x / math.pi) * math.exp(-x / 2.0)
        total = term
        for i in range(2, (k + 1) // 2):
            term *= x / (2 * i - 1)
            total += term
        s += total
    return min(1.0, max(0.0, s))


def _betacf(a: float, b: float, x: float) -> float:
    eps, tiny = 3e-16, 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = tiny if abs(d) < tiny else d
    d = 1.0 / d
    h = d
    for m in range(1, 500):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    bt = math.exp(lbt)
    if x < (a + 1) / (a + b + 2):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    """Two-sided p-value of Student t with ``dof`` degrees of freedom."""
    if t is None or dof is None or dof <= 0 or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


@F.pandas_udf(T.DoubleType())
def _chi2_sf_udf(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([None if (pd.isna(a) or pd.isna(b)) else chi2_sf(float(a), int(b))
                      for a, b in zip(x, k)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _t_two_sided_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if (pd.isna(a) or pd.isna(b)) else t_two_sided(float(a), float(b))
                      for a, b in zip(t, dof)], dtype="float64")


def chi2_sf_col(x: Column, k: Column) -> Column:
    return _chi2_sf_udf(x, k)


def t_two_sided_col(t: Column, dof: Column) -> Column:
    return _t_two_sided_udf(t, dof)
