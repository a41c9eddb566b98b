"""Student t distribution as column expressions-by-batch, for the few rows of a report.

The regularised incomplete beta function is evaluated by its continued fraction (modified
Lentz); quantiles by bisection.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    guard = lambda v: v if abs(v) > tiny else tiny
    c, d = 1.0, 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    value = d
    for m in range(1, 500):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / guard(1.0 + numerator * d)
            c = guard(1.0 + numerator / c)
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def two_sided_p(t: float, df: float) -> float:
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def quantile(p: float, df: float) -> float:
    """t with P(T <= t) = p, for p >= 0.5."""
    low, high = 0.0, 1.0
    while 1.0 - two_sided_p(high, df) / 2.0 < p:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if 1.0 - two_sided_p(mid, df) / 2.0 < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


@F.pandas_udf(DoubleType())
def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([two_sided_p(a, b) for a, b in zip(t, df)])


@F.pandas_udf(DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    known = {pair: quantile(*pair) for pair in set(zip(p, df))}  # degrees of freedom repeat
    return pd.Series([known[pair] for pair in zip(p, df)])
