"""Tail probabilities for result rows. Spark has no erf, so these are small Arrow helpers
applied to tables of a few rows (one per band, covariate or KPI)."""

from __future__ import annotations

import math
import sys
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# the helpers travel with the query, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_one_df(x: float) -> float:
    return math.erfc(math.sqrt(x / 2.0))


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) as the regularised incomplete beta I_x(df/2, 1/2), x = df / (df + t^2)."""
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    if x <= 0.0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta, evaluated from the front."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 1000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def rank_two_sided(u: float, n: float, m: float) -> float:
    """Exact two-sided p of a Mann-Whitney U between arms of ``n`` and ``m`` values without ties.

    The arrangements with a statistic of at most k are the coefficient of q^k in
    prod(1 - q^(large + i)) / ((1 - q) prod(1 - q^i)), i = 1 .. small. The product above has
    one term per subset of 1 .. small; the coefficients of the rest repeat with the least
    common multiple of 1 .. small, up to binomials. So time and memory depend on the smaller
    arm alone, which should be small (8: 256 terms); the numbers are exact integers.
    """
    small, large = sorted((round(n), round(m)))
    at_most = min(round(u), small * large - round(u))
    ways = 0
    for k in range(small + 1):
        for some in combinations(range(1, small + 1), k):
            rest = at_most - k * large - sum(some)
            if rest >= 0:
                ways += (-1) ** k * _restricted_sums(rest, small)
    return min(1.0, 2 * ways / math.comb(small + large, small))


def _restricted_sums(total: int, parts: int) -> int:
    """Coefficient of q^total in 1 / ((1 - q) prod(1 - q^i)), i = 1 .. parts."""
    period, top = _sums_above(parts)
    first = range(total % period, min(total + 1, len(top)), period)
    return sum(top[j] * math.comb((total - j) // period + parts, parts) for j in first)


@lru_cache(maxsize=None)
def _sums_above(parts: int) -> tuple[int, list[int]]:
    """The polynomial above (1 - q^period)^(parts + 1) in that fraction, and the period."""
    period = math.lcm(*range(1, parts + 1))
    top = [1] + [0] * ((parts + 1) * period - 1)
    for i in (1, *range(1, parts + 1)):
        for j in range(i, len(top)):
            top[j] += top[j - i]
        for j in range(len(top) - 1, period - 1, -1):
            top[j] -= top[j - period]
    return period, top


def _each(fn, *columns):
    out = []
    for row in zip(*columns):
        known = all(v is not None and not math.isnan(v) for v in row)
        out.append(fn(*row) if known else None)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _each(normal_two_sided, z)


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series) -> pd.Series:
    return _each(chi2_one_df, x)


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(student_two_sided, t, df)


@F.pandas_udf(DoubleType())
def rank_p(u: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return _each(rank_two_sided, u, n, m)
