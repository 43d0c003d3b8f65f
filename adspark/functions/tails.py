"""Upper tail probabilities that Spark SQL does not have.

Both are meant for result rows (one per tested column, one per comparison) and
work on plain numbers; the ``*_column`` forms wrap them for DataFrames.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def normal_sf(z: float) -> float:
    """P(Z > z) for a standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def chi2_sf(x: float, dof: int) -> float:
    """P(X > x) for a chi-squared variable.

    The regularised upper incomplete gamma function at ``a = dof/2``: its power
    series left of ``a + 1``, its continued fraction (Lentz) right of it.
    """
    if dof <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    a, h = dof / 2.0, x / 2.0
    log_front = a * math.log(h) - h - math.lgamma(a)
    if h < a + 1.0:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-17:
            k += 1.0
            term *= h / k
            total += term
        return min(1.0, max(0.0, 1.0 - total * math.exp(log_front)))
    tiny = 1e-300
    b = h + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    frac, i = d, 0
    while True:
        i += 1
        num = -i * (i - a)
        b += 2.0
        d = num * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + num / c
        c = c if abs(c) > tiny else tiny
        step = c * d
        frac *= step
        if abs(step - 1.0) < 1e-16:
            return min(1.0, frac * math.exp(log_front))


@F.pandas_udf(DoubleType())
def _chi2_sf_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([
        None if pd.isna(v) or pd.isna(k) else chi2_sf(float(v), int(k))
        for v, k in zip(x, dof)
    ], dtype="float64")


@F.pandas_udf(DoubleType())
def _two_sided_udf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else 2.0 * normal_sf(abs(v))).astype("float64")


def chi2_sf_column(x: Column, dof: Column) -> Column:
    """``chi2_sf`` for a small result table."""
    return _chi2_sf_udf(x, dof)


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value for a small result table."""
    return _two_sided_udf(z)
