"""Tail probabilities of test statistics, by Arrow UDFs: frames of statistics have a row a test."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: a series below a + 1, a continued fraction (Lentz) above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        b += 2
        k = i * (a - i)
        d = 1 / (k * d + b)
        c = b + k / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            k = 1.0
        elif i % 2 == 0:
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + k * d)
        c = 1 + k / c
        f *= c * d
        if i and abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1)


def chi_square_p(x: Column, dof: Column) -> Column:
    """P(X >= x) for so many degrees of freedom; null for a null or no degree."""

    @F.pandas_udf("double")
    def p(x_: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else upper_gamma(b / 2, a / 2) for a, b in zip(x_, k)], dtype=float)

    return p(x.cast("double"), dof.cast("double"))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs by Student's t; null under three pairs."""

    @F.pandas_udf("double")
    def p(r_: pd.Series, n_: pd.Series) -> pd.Series:
        out = []
        for a, k in zip(r_, n_):
            if pd.isna(a) or pd.isna(k) or k < 3:
                out.append(None)
            else:
                out.append(beta_share(max(0.0, 1 - a * a), (k - 2) / 2, 0.5))
        return pd.Series(out, dtype=float)

    return p(r.cast("double"), n.cast("double"))
