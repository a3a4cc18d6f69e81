"""Gamma functions: a closed form in SQL, and exact ones as vectorised functions over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


# Fixed value: the constant of the one-term formula.
STIRLING = -0.0810614667


def approx_lgamma(x: Column) -> Column:
    """ln Γ(x) for x > 0 by a one-term Stirling formula at x + 1."""
    return F.lit(STIRLING) - x - F.log(x) + (x + 0.5) * F.log(1 + x)


def _shifted(x: np.ndarray, least: float, term) -> tuple[np.ndarray, np.ndarray]:
    """x raised to `least` by steps of one, and the sum of `term` over the steps."""
    x, out = x.astype(float).copy(), np.zeros(len(x))
    while (low := x < least).any():
        out[low] += term(x[low])
        x[low] += 1
    return x, out


def np_digamma(x: np.ndarray) -> np.ndarray:
    x, shift = _shifted(x, 8.0, lambda y: -1 / y)
    r = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def np_trigamma(x: np.ndarray) -> np.ndarray:
    x, shift = _shifted(x, 8.0, lambda y: 1 / (y * y))
    r = 1 / (x * x)
    return shift + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66))))


@F.pandas_udf(DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    return x.map(math.lgamma, na_action="ignore")


@F.pandas_udf(DoubleType())
def digamma(x: pd.Series) -> pd.Series:
    return pd.Series(np_digamma(x.to_numpy()))


@F.pandas_udf(DoubleType())
def trigamma(x: pd.Series) -> pd.Series:
    return pd.Series(np_trigamma(x.to_numpy()))


def ln_gamma_increment(x: Column, y: Column) -> Column:
    """ln Γ(x + y) − ln Γ(x)."""
    return lgamma(x + y) - lgamma(x)
