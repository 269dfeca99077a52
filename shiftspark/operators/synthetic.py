"""Seeded synthetic series, one task a series, with their true changepoints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES = "series_id string, t long, value double, label int"


def gaussian_segments(spark: SparkSession, series: int, lengths: list[int], means: list[float], sds: list[float], phi: float = 0.0, seed: int = 0) -> DataFrame:
    """Independent or AR(1) segments (stationary, starting afresh at each boundary)."""

    def run(batches):
        for frame in batches:
            for i in frame["id"]:
                rng, out = np.random.default_rng([seed, int(i)]), []
                for k, (n, m, sd) in enumerate(zip(lengths, means, sds)):
                    e = rng.normal(size=n)
                    y = np.empty(n)
                    for t in range(n):
                        y[t] = e[t] if t == 0 else phi * y[t - 1] + np.sqrt(1 - phi**2) * e[t]
                    out.append(pd.DataFrame({"value": m + sd * y, "label": k}))
                one = pd.concat(out, ignore_index=True)
                yield one.assign(series_id=str(i), t=np.arange(len(one)))[["series_id", "t", "value", "label"]]

    return spark.range(series).repartition(min(series, 8)).mapInPandas(run, SERIES)


def contaminate(series: DataFrame, rate: float, sd: float, seed: int = 0) -> DataFrame:
    """Impulses on a share of the points, chosen by a hash of the place, so any partitioning gives the same."""
    u = lambda salt: (F.pmod(F.xxhash64("series_id", "t", F.lit(seed), F.lit(salt)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * np.pi * u(2))
    hit = u(0) < rate
    return series.withColumn("outlier", hit).withColumn("value", F.when(hit, F.col("value") + sd * normal).otherwise(F.col("value")))


def add_drift(series: DataFrame, slope: float) -> DataFrame:
    return series.withColumn("value", F.col("value") + slope * F.col("t"))


def periodic_bernoulli(spark: SparkSession, series: int, grid: list[float], periods: int, seed: int = 0) -> DataFrame:
    """series_id, t, value: bits with the success rate of their phase."""
    p = len(grid)

    def run(batches):
        for frame in batches:
            for i in frame["id"]:
                bits = np.random.default_rng([seed, int(i)]).uniform(size=p * periods) < np.tile(grid, periods)
                yield pd.DataFrame({"series_id": str(i), "t": np.arange(len(bits)), "value": bits})

    return spark.range(series).mapInPandas(run, "series_id string, t long, value boolean")


def any_of(series: DataFrame) -> DataFrame:
    """t, value: whether any sensor was active."""
    return series.groupBy("t").agg(F.bool_or("value").alias("value"))


def autoregressive(spark: SparkSession, series: int, states: list[int], intercepts: list[float], coefficients: list[float], sds: list[float], seed: int = 0) -> DataFrame:
    """AR(1) by state along a given path."""

    def run(batches):
        for frame in batches:
            for i in frame["id"]:
                rng, y = np.random.default_rng([seed, int(i)]), np.zeros(len(states))
                for t, k in enumerate(states):
                    y[t] = intercepts[k] + coefficients[k] * (y[t - 1] if t else 0.0) + sds[k] * rng.normal()
                yield pd.DataFrame({"series_id": str(i), "t": np.arange(len(y)), "value": y, "label": states})

    return spark.range(series).mapInPandas(run, SERIES)


#: Published periodic scenarios (period, days, min_length, boundaries, success rates of the segments that end there).
SCENARIOS = {
    "paper_monte_carlo_n24": (24, 30, 4, (7, 15, 23), (0.25, 0.50, 0.60)),
    "no_change": (96, 35, 4, (), (0.50,)),
    "one_activity_window": (96, 35, 4, (31, 79), (0.70, 0.30)),
    "weak_signal": (96, 35, 4, (31, 79), (0.55, 0.45)),
    "multiple_activity_windows": (96, 35, 4, (23, 39, 55, 83), (0.25, 0.75, 0.45, 0.10)),
    "boundary_crossing_sleep": (96, 35, 4, (27, 87), (0.80, 0.08)),
}
#: Five sensors of a home over a day of 96 bins (boundaries, success rates).
SENSORS = {
    "chair": ((31, 39, 55, 83), (0.04, 0.42, 0.20, 0.03)),
    "doors": ((27, 35, 71, 87), (0.05, 0.16, 0.10, 0.02)),
    "kettle": ((27, 35, 43, 51, 75, 83), (0.02, 0.30, 0.03, 0.22, 0.04, 0.01)),
    "tap": ((27, 39, 67, 83), (0.03, 0.24, 0.18, 0.02)),
    "toilet": ((23, 31, 83, 91), (0.03, 0.10, 0.04, 0.08)),
}


def probability_grid(period: int, boundaries: tuple[int, ...], rates: tuple[float, ...]) -> list[float]:
    """The success rate of every phase: a phase belongs to the first boundary at or after it, round the end."""
    if len(rates) != max(1, len(boundaries)) or not all(0 <= p <= 1 for p in rates):
        raise ValueError("one rate from 0 to 1 for each segment")
    at = np.searchsorted(boundaries, np.arange(period)) % len(rates) if boundaries else np.zeros(period, int)
    return [float(rates[i]) for i in at]


def scenario_bits(spark: SparkSession, scenarios: dict[str, tuple[int, list[float]]], seed: int = 0) -> DataFrame:
    """series_id (a scenario's name), t, value for {name: (days, grid)}: a phase's success is a hash of its place, so any partitioning gives the same."""
    rows = spark.createDataFrame([(name, days, grid) for name, (days, grid) in scenarios.items()], "series_id string, days int, grid array<double>")
    t = F.explode(F.sequence(F.lit(0).cast("long"), F.col("days") * F.size("grid").cast("long") - 1))
    u = (F.pmod(F.xxhash64("series_id", "t", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    placed = rows.select("series_id", "grid", t.alias("t"))
    return placed.select("series_id", "t", (u < F.get("grid", F.pmod("t", F.size("grid")).cast("int"))).alias("value"))


def periodic_scenarios(spark: SparkSession, names: list[str] | None = None, seed: int = 0) -> DataFrame:
    """scenario_bits() of the published scenarios."""
    chosen = {n: SCENARIOS[n] for n in names or SCENARIOS}
    return scenario_bits(spark, {n: (days, probability_grid(period, b, p)) for n, (period, days, _, b, p) in chosen.items()}, seed)


def sensor_home(spark: SparkSession, days: int = 56, period: int = 96, seed: int = 0) -> DataFrame:
    """scenario_bits() of five sensors; any_of() gives the home's activity."""
    return scenario_bits(spark, {n: (days, probability_grid(period, b, p)) for n, (b, p) in SENSORS.items()}, seed)
