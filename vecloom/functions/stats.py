"""p-values without SciPy: the regularised incomplete beta function and Student's t."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def incomplete_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b) by the continued fraction in Lentz's form."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def spearman_p(rho: float, n: float) -> float | None:
    """Two-sided p of a rank correlation by t with n - 2 degrees of freedom."""
    if n is None or rho is None or n < 3 or rho != rho:
        return None
    if abs(rho) >= 1:
        return 0.0
    df = n - 2
    return incomplete_beta(df / 2, 0.5, df / (df + rho * rho * df / (1 - rho * rho)))


@F.pandas_udf(T.DoubleType())
def spearman_p_udf(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([spearman_p(r, k) for r, k in zip(rho, n, strict=True)], dtype="float64")
