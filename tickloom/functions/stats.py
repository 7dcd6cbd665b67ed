"""Distribution functions as vectorised UDFs over columns, from published series and continued fractions.

Spark has no Student, beta or normal tail function; these run on group-level rows (one a test), never on data rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + num * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + num / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float | None, df: float | None) -> float | None:
    """P(|T| >= |t|) for Student's distribution."""
    if t is None or df is None or t != t or df != df or df <= 0:
        return None
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float | None) -> float | None:
    return None if z is None or z != z else math.erfc(abs(z) / math.sqrt(2))


def beta_quantile(q: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if incomplete_beta(a, b, mid) < q else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    return pd.Series([normal_two_sided(a) for a in z], dtype="float64")


@F.pandas_udf(T.DoubleType())
def beta_ppf(q: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x != x or y != y else beta_quantile(p, x, y) for p, x, y in zip(q, a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def binomial_bayes_factor(wins: pd.Series, n: pd.Series, base: pd.Series) -> pd.Series:
    """Evidence of a free win rate (flat prior) over the base rate."""
    out = []
    for w, m, p in zip(wins, n, base, strict=True):
        if w != w or m != m or p != p or not 0 < p < 1:
            out.append(None)
            continue
        log = math.lgamma(1 + w) + math.lgamma(1 + m - w) - math.lgamma(2 + m) - w * math.log(p) - (m - w) * math.log1p(-p)
        out.append(math.exp(min(log, 700)))
    return pd.Series(out, dtype="float64")
