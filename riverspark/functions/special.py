"""Distribution functions without SciPy: incomplete beta and gamma by continued fractions, and what follows from them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(500):  # Lentz
        m = i // 2
        if i == 0:
            t = 1.0
        elif i % 2 == 0:
            t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            t = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + t * d) or tiny)
        c = 1 + t / (c or tiny)
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def student_p(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t; NaN where it is undefined."""
    if not (math.isfinite(t) and dof > 0):
        return math.nan
    return betainc(dof / 2, 0.5, dof / (dof + t * t))


def chi2_p(x: float, dof: float) -> float:
    """Upper tail of the chi-squared distribution."""
    return gammaincc(dof / 2, x / 2) if x == x and dof > 0 else math.nan


def normal_p(z: float) -> float:
    """Two-sided p-value of the normal distribution."""
    return math.erfc(abs(z) / math.sqrt(2)) if z == z else math.nan


def poisson_quantile(mean: float, u: float) -> int:
    """The smallest k whose cumulated Poisson probability reaches u; for a large mean by the normal approximation's neighbourhood."""
    if not mean > 0:
        return 0
    k = max(0, int(mean + _normal_quantile(u) * math.sqrt(mean) - 6)) if mean > 30 else 0
    cum = gammaincc(k + 1, mean)  # P(X <= k)
    while k > 0 and cum >= u:
        k -= 1
        cum = gammaincc(k + 1, mean)
    while cum < u and k < mean + 60 * math.sqrt(mean) + 60:
        k += 1
        cum += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
    return k


def _normal_quantile(u: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(min(max(u, 1e-12), 1 - 1e-12))


def _over(f, *series: pd.Series) -> pd.Series:
    return pd.Series([f(*map(float, row)) if not any(x is None or x != x for x in row) else math.nan for row in zip(*series)], dtype="float64")


@F.pandas_udf(DoubleType())
def student_p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _over(student_p, t, dof)


@F.pandas_udf(DoubleType())
def chi2_p_value(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _over(chi2_p, x, dof)


@F.pandas_udf(DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    return _over(normal_p, z)


@F.pandas_udf(DoubleType())
def poisson_draw(mean: pd.Series, u: pd.Series) -> pd.Series:
    """Poisson draws by inversion of uniforms; a mean that is null or not positive gives 0."""
    return pd.Series([float(poisson_quantile(m, x)) if m == m and x == x else 0.0 for m, x in zip(mean.fillna(0.0), u.fillna(0.5))], dtype="float64")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Weights of a Gaussian filter, summing to 1."""
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()
