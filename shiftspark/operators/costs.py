"""Segment costs over prefix sums.

A series is (series_id, t, value) with t = 0, 1, ...; a prefix row (series_id, k)
holds the sums over t < k, so a segment [a, b) costs one expression of two rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftspark.functions.columns import LN_2PI, log_beta


def prefix(series: DataFrame, value: str = "value") -> DataFrame:
    """series_id, k, s1, s2: sums and sums of squares of the first k values, k = 0..n."""
    w = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    kind = dict(series.dtypes)[value]
    v = F.col(value) if kind in ("bigint", "int") else F.col(value).cast("double")
    zero = F.lit(0).cast("long" if kind in ("bigint", "int") else "double")
    sums = series.select("series_id", (F.col("t") + 1).cast("long").alias("k"), F.sum(v).over(w).alias("s1"), F.sum(v * v).over(w).alias("s2"))
    return sums.union(series.select("series_id").distinct().select("series_id", F.lit(0).cast("long"), zero, zero))


def centred(series: DataFrame, value: str = "value") -> DataFrame:
    """value less its series' mean, against cancellation in sums of squares."""
    return series.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy("series_id")))


def pairs(prefixes: DataFrame, min_length: int = 1) -> DataFrame:
    """All segments [a, b) of each series with L, s1, s2. Quadratic in a series' length: for short series."""
    p = prefixes
    a = p.select("series_id", F.col("k").alias("a"), F.col("s1").alias("a1"), F.col("s2").alias("a2"))
    b = p.select("series_id", F.col("k").alias("b"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    both = a.join(b, "series_id").where(F.col("b") - F.col("a") >= min_length)
    return both.select("series_id", "a", "b", (F.col("b") - F.col("a")).alias("L"), (F.col("b1") - F.col("a1")).alias("s1"), (F.col("b2") - F.col("a2")).alias("s2"))


def _some(n: Column) -> Column:
    """n, or null for an empty segment."""
    return F.when(n != 0, n)


def sse(L: Column, s1: Column, s2: Column) -> Column:
    return F.greatest(s2.cast("double") - s1.cast("double") * s1.cast("double") / _some(L), F.lit(0.0))


def known_variance(L: Column, s1: Column, s2: Column, sigma2: float = 1.0) -> Column:
    """Normal, own mean, variance sigma2."""
    return sse(L, s1, s2) / sigma2 + L * (LN_2PI + math.log(sigma2))


def unknown_variance(L: Column, s1: Column, s2: Column, eps: float = 1e-12) -> Column:
    """Normal, own mean and variance; a segment of one value costs infinity."""
    cost = L * (LN_2PI + F.log(F.greatest(sse(L, s1, s2), F.lit(eps)) / _some(L)) + 1)
    return F.when(L <= 1, F.lit(float("inf"))).otherwise(cost)


def beta_binomial(L: Column, s1: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """Binary values under a Beta prior: the negative log evidence."""
    prior = math.lgamma(alpha) + math.lgamma(beta) - math.lgamma(alpha + beta)
    return prior - log_beta(s1 + alpha, L - s1 + beta)


def poisson_constant(events: Column, exposure: Column) -> Column:
    """Events at one rate over an exposure: twice the negative log likelihood at its maximum."""
    return F.when(exposure <= 0, F.lit(float("inf"))).otherwise(2 * (events - F.when(events > 0, events * F.log(events / _some(exposure))).otherwise(0.0)))


def bic_penalty(parameters: int, n: Column) -> Column:
    return parameters * F.log(F.greatest(n, F.lit(2)))


def aic_penalty(parameters: int) -> Column:
    return F.lit(2.0 * parameters)


def vector_prefix(series: DataFrame, x: str = "x") -> DataFrame:
    """series_id, k, feature, s1, and the running sum of squared norms s2: prefix sums of vector series."""
    long = series.select("series_id", (F.col("t") + 1).cast("long").alias("k"), F.posexplode(x).alias("feature", "v"))
    w = Window.partitionBy("series_id", "feature").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return long.select("series_id", "k", "feature", F.sum("v").over(w).alias("s1"), F.sum(F.col("v") * F.col("v")).over(w).alias("s2"))


def prefix_2d(cells: DataFrame, value: str = "value") -> DataFrame:
    """series_id, i, j, s: sums over the first i rows and j columns of a dense table (series_id, i, j, value from 0), by two window passes.

    Row 0 and column 0 are zero.
    """
    across = Window.partitionBy("series_id", "i").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("series_id", "j").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = cells.select("series_id", (F.col("i") + 1).cast("long").alias("i"), (F.col("j") + 1).cast("long").alias("j"), F.sum(F.col(value).cast("double")).over(across).alias("s"))
    inner = rows.withColumn("s", F.sum("s").over(down))
    edge = lambda own, other: inner.select("series_id", own).distinct().select("series_id", *[F.col(own) if c == own else F.lit(0).cast("long").alias(other) for c in ("i", "j")], F.lit(0.0).alias("s"))
    corner = inner.select("series_id").distinct().select("series_id", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0.0).alias("s"))
    return inner.unionByName(edge("i", "j")).unionByName(edge("j", "i")).unionByName(corner)


def range_sums_2d(prefixes: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (series_id, i0, i1, j0, j1, half open) with ``total``: four prefix rows each; null where a range leaves the table."""
    out = ranges
    for name, i, j in (("_a", "i1", "j1"), ("_b", "i0", "j1"), ("_c", "i1", "j0"), ("_d", "i0", "j0")):
        corner = prefixes.select(F.col("series_id").alias("_s"), F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("s").alias(name))
        out = out.join(corner, (F.col("series_id") == F.col("_s")) & (F.col(i) == F.col("_i")) & (F.col(j) == F.col("_j")), "left").drop("_s", "_i", "_j")
    whole = (F.col("i0") <= F.col("i1")) & (F.col("j0") <= F.col("j1"))
    return out.select(*ranges.columns, F.when(whole, F.col("_a") - F.col("_b") - F.col("_c") + F.col("_d")).alias("total"))
