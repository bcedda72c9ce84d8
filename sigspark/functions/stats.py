"""Small numeric helpers applied to result rows."""
from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _poisson_at_most(count: int, mean: float) -> tuple[float, float]:
    """(P(N <= count), P(N = count)) for a Poisson mean above ``count``, by the continued fraction of the upper incomplete
    gamma function: as many steps as the root of the count, whatever the count is."""
    a, tiny = count + 1.0, 1e-300
    last = math.exp(count * math.log(mean) - mean - math.lgamma(a))
    b = mean + 1 - a
    c, d = 1 / tiny, 1 / b
    h, k = d, 0
    while True:
        k += 1
        step = -k * (k - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-14:
            return last * mean * h, last


def poisson_upper(count: int, confidence: float = 0.95) -> float:
    """One-sided upper bound of a Poisson mean after ``count`` events: the mean at which that few events or fewer
    have probability 1 - confidence. Equals half the chi-squared quantile with 2 (count + 1) degrees of freedom.

    Newton's method from the Wilson-Hilferty value; counts of any size.
    """
    goal = 1 - confidence
    if count == 0:
        return -math.log(goal)
    a, z = count + 1.0, NormalDist().inv_cdf(confidence)
    mean = a * (1 - 1 / (9 * a) + z / (3 * math.sqrt(a))) ** 3
    for _ in range(50):
        tail, last = _poisson_at_most(count, mean)
        change = tail / last * math.log(tail / goal)             # Newton on the logarithm; the tail's slope is -last
        mean = max(mean + change, count + 1.0)
        if abs(change) < 1e-12 * mean:
            break
    return mean


@F.pandas_udf(T.DoubleType())
def poisson_upper_95(counts: pd.Series) -> pd.Series:
    distinct = {int(c): poisson_upper(int(c)) for c in counts.dropna().unique()}
    return counts.map(lambda c: distinct.get(int(c)) if c == c else None).astype(float)
