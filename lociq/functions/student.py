"""Tail of Student's t distribution."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def two_sided_p(t: Column | str, df: Column | str) -> Column:
    """P(|T| >= |t|); exact zero only where the tail underflows. NULL stays NULL."""
    return _p_batch(t, df)


@F.pandas_udf(DoubleType())
def _p_batch(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else _tail(float(a), float(b)) for a, b in zip(t, df)], dtype="float64")


def _tail(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Evaluated from the far end; the terms settle long before this depth.
    depth = 200 + int(math.sqrt(max(a, b)) * 10)
    m = np.arange(1, depth + 1)
    even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
    odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
    first = -(a + b) * x / (a + 1)
    tail = 1.0
    for e, o in zip(even[::-1], odd[::-1]):
        tail = 1.0 + e / (1.0 + o / tail)
    return front / (1.0 + first / tail)
