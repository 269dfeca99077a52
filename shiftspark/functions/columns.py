"""Scalar and array functions as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN_2PI = math.log(2 * math.pi)


def cents(value: str | Column) -> Column:
    """A two-decimal amount as an exact integer, so that sums don't depend on their order."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(c * 100).cast("long")


def not_nan(value: str | Column) -> Column:
    """NaN and null are both missing: null."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(c), c)


def logsumexp(values: Column) -> Column:
    """ln of the sum of exp over an array, shifted by its maximum; all -inf stays -inf."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.when(top == float("-inf"), F.lit(float("-inf"))).otherwise(top + F.log(total))


def softmax(values: Column) -> Column:
    """exp(x - logsumexp) of an array."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.transform(values, lambda x: F.exp(x - top) / total)


def normalised(values: Column) -> Column:
    """An array divided by its sum; all zero becomes uniform."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(values, lambda x: F.when(total > 0, x / total).otherwise(1.0 / F.size(values)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


#: Lanczos coefficients for g = 7, n = 9 (fixed, published values).
_LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 0.5, in built-in functions (relative error about 1e-14)."""
    z = x.cast("double") - 1
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + i)
    t = z + 7.5
    return 0.5 * LN_2PI + (z + 0.5) * F.log(t) - t + F.log(total)


def log_beta(a: Column, b: Column) -> Column:
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def rotate_left(values: Column, by: Column) -> Column:
    """An array rotated left on its own length."""
    n = F.size(values)
    k = F.pmod(by, n)
    return F.concat(F.slice(values, k + 1, n - k), F.slice(values, 1, k))


def circular_distance(a: Column, b: Column, period: int) -> Column:
    """The shorter way round between two phases."""
    d = F.pmod(a - b, F.lit(period))
    return F.least(d, period - d)


def exp_or_inf(x: Column) -> Column:
    """exp, infinite where it overflows; a missing or NaN exponent ends the job with an error."""
    return F.when(x.isNull() | F.isnan(x), F.raise_error(F.lit("exp of a missing number")).cast("double")).otherwise(F.exp(x))


def squared_mahalanobis(x: Column, mean: list[float], precision: list[list[float]]) -> Column:
    """(x - mean)' precision (x - mean) in built-in functions, for a small matrix of literals."""
    d = [F.get(x, i) - float(m) for i, m in enumerate(mean)]
    out = F.lit(0.0)
    for i, row in enumerate(precision):
        for j, p in enumerate(row):
            if p:
                out = out + float(p) * d[i] * d[j]
    return out
