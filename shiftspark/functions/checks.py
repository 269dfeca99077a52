"""Input contracts, each checked in one aggregate over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """An input breaks its contract; the message names the rules and counts rows."""


def require(df: DataFrame, **bad: Column) -> DataFrame:
    """df itself, or a ContractError that counts the rows for which a rule's column is true."""
    found = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in bad.items()]).first()
    broken = {k: found[k] for k in bad if found[k]}
    if broken:
        raise ContractError(", ".join(f"{k}: {n} rows" for k, n in broken.items()))
    return df


def real(df: DataFrame, value: str = "value") -> DataFrame:
    c = F.col(value).cast("double")
    return require(df, missing=c.isNull(), not_finite=F.isnan(c) | (F.abs(c) == float("inf")))


def binary(df: DataFrame, value: str = "value") -> DataFrame:
    return require(df, not_binary=~F.col(value).cast("double").isin(0.0, 1.0) | F.col(value).isNull())


def counts(df: DataFrame, value: str = "value") -> DataFrame:
    c = F.col(value).cast("double")
    return require(df, not_count=c.isNull() | (c < 0) | (c != F.floor(c)))


def probabilities(df: DataFrame, value: str, tolerance: float = 1e-9) -> DataFrame:
    """An array column of non-negative numbers that sum to 1."""
    total = F.aggregate(value, F.lit(0.0), lambda acc, x: acc + x)
    return require(df, negative=F.exists(value, lambda x: x < 0), not_one=F.abs(total - 1) > tolerance)


def increasing(df: DataFrame, key: str = "series_id", t: str = "t") -> DataFrame:
    """Times are unique within a key, so their order is strict."""
    same = df.groupBy(key, t).count()
    return require(same, repeated=F.col("count") > 1) and df


def lengths_at_least(df: DataFrame, least: int, key: str = "series_id") -> DataFrame:
    return require(df.groupBy(key).count(), short=F.col("count") < least) and df


def changepoints(cps: DataFrame, lengths: DataFrame, min_length: int = 1) -> DataFrame:
    """cps (series_id, cp) against lengths (series_id, n): in 1..n-1, unique, segments long enough."""
    w = Window.partitionBy("series_id").orderBy("cp")
    seen = cps.join(lengths, "series_id", "left").withColumn("before", F.lag("cp", 1, 0).over(w)).withColumn("after", F.coalesce(F.lead("cp").over(w), F.col("n")))
    require(
        seen,
        unknown_series=F.col("n").isNull(),
        out_of_range=(F.col("cp") < 1) | (F.col("cp") > F.col("n") - 1),
        short_segment=(F.col("cp") - F.col("before") < min_length) | (F.col("after") - F.col("cp") < min_length),
    )
    return cps


def circular(boundaries: DataFrame, period: int, cp: str = "cp") -> DataFrame:
    """boundaries (series_id, cp): whole phases of the period, each once in a series, none alone."""
    found = boundaries.groupBy("series_id", cp).agg(F.count("*").alias("n")).withColumn("of", F.count("*").over(Window.partitionBy("series_id")))
    require(found, out_of_range=F.col(cp).isNull() | (F.col(cp) < 0) | (F.col(cp) >= period), repeated=F.col("n") > 1, alone=F.col("of") == 1)
    return boundaries


def matrix(df: DataFrame, value: str, size: int) -> DataFrame:
    """An array column of arrays: ``size`` rows of ``size`` finite numbers, symmetric."""
    rows = F.sequence(F.lit(0), F.lit(size - 1))
    number = lambda i, j: F.get(F.get(value, i), j)
    wrong = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return require(
        df,
        not_square=(F.size(value) != size) | F.exists(value, lambda r: F.size(r) != size),
        not_finite=F.exists(value, lambda r: F.exists(r, wrong)),
        not_symmetric=F.exists(rows, lambda i: F.exists(rows, lambda j: F.abs(number(i, j) - number(j, i)) > 1e-8)),
    )
