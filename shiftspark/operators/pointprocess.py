"""Sliced Poisson processes: periods of events under exposure, cut where the intensity changes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftspark.operators import costs
from shiftspark.operators import segmentation as seg


def exposure_union(intervals: DataFrame) -> DataFrame:
    """key columns, start, stop of merged intervals (overlapping or touching), by gaps and islands."""
    keys = [c for c in intervals.columns if c not in ("start", "stop")]
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("fresh", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    numbered = marked.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def outside_exposure(events: DataFrame, exposure: DataFrame, keys: list[str]) -> DataFrame:
    """Events that no interval [start, stop) holds."""
    e = exposure.select(*[F.col(k).alias(f"_{k}") for k in keys], "start", "stop")
    same = (F.col("time") >= F.col("start")) & (F.col("time") < F.col("stop"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return events.join(e, same, "left_anti")


def checked_periods(periods: DataFrame, period: float) -> DataFrame:
    """periods (series_id, t, event_times, exposure) with times in order; an event outside the period or its exposure is an error."""
    inside = F.forall("event_times", lambda e: (e >= 0) & (e < period) & F.exists("exposure", lambda s: (e >= s["start"]) & (e < s["stop"])))
    spans = F.forall("exposure", lambda s: (s["start"] >= 0) & (s["stop"] <= period) & (s["start"] < s["stop"]))
    full = F.array(F.struct(F.lit(0.0).alias("start"), F.lit(float(period)).alias("stop")))
    filled = periods.withColumn("event_times", F.coalesce(F.col("event_times").cast("array<double>"), F.array().cast("array<double>"))).withColumn("exposure", F.coalesce("exposure", full))
    wrong = F.raise_error(F.lit("events lie within the exposure of their period")).cast("array<double>")
    return filled.withColumn("event_times", F.when(inside & spans, F.array_sort("event_times")).otherwise(wrong))


def constant_costs(periods: DataFrame, min_length: int = 1) -> DataFrame:
    """series_id, a, b, cost of every run of periods at one rate; periods: series_id, t, value (events), exposure.

    Quadratic in periods of a series: for short ones.
    """
    w = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    p = periods.select("series_id", (F.col("t") + 1).cast("long").alias("k"), F.sum("value").over(w).alias("s1"), F.sum("exposure").over(w).alias("s2"))
    p = p.union(periods.select("series_id").distinct().select("series_id", F.lit(0).cast("long"), F.lit(0), F.lit(0)))
    both = costs.pairs(p, min_length)
    return both.select("series_id", "a", "b", costs.poisson_constant(F.col("s1"), F.col("s2")).alias("cost"))


# --- B-spline intensities ---------------------------------------------------------


def knots(n_basis: int, degree: int, period: float) -> np.ndarray:
    inner = np.linspace(0, period, n_basis - degree + 1)
    return np.concatenate(([0.0] * degree, inner, [period] * degree))


def basis(times: np.ndarray, n_basis: int, degree: int, period: float) -> np.ndarray:
    """Cox-de Boor on clamped uniform knots; the right end belongs to the last function."""
    k, x = knots(n_basis, degree, period), np.asarray(times, float)
    b = np.array([(x >= k[i]) & (x < k[i + 1]) for i in range(len(k) - 1)], float).T.reshape(len(x), -1)
    b[x >= period, n_basis - 1] = 1.0
    for d in range(1, degree + 1):
        new = np.zeros((len(x), len(k) - 1 - d))
        for i in range(new.shape[1]):
            left, right = k[i + d] - k[i], k[i + d + 1] - k[i + 1]
            if left > 0:
                new[:, i] += (x - k[i]) / left * b[:, i]
            if right > 0:
                new[:, i] += (k[i + d + 1] - x) / right * b[:, i + 1]
        b = new
    return b


def design(intervals: list[tuple[float, float]], n_basis: int, degree: int, period: float, nodes: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(basis rows, weights) of Gauss-Legendre nodes over the exposure."""
    x, w = np.polynomial.legendre.leggauss(nodes)
    rows, weights = [], []
    inner = np.unique(knots(n_basis, degree, period))
    for a, b in intervals:
        cuts = [a, *inner[(inner > a) & (inner < b)], b]
        for lo, hi in zip(cuts, cuts[1:]):
            rows.append(basis((lo + hi) / 2 + (hi - lo) / 2 * x, n_basis, degree, period))
            weights.append((hi - lo) / 2 * w)
    return (np.vstack(rows), np.concatenate(weights)) if rows else (np.zeros((0, n_basis)), np.zeros(0))


def fit_intensity(B: np.ndarray, weights: np.ndarray, event_sum: np.ndarray, ridge: float = 1e-8, steps: int = 50) -> tuple[np.ndarray, float]:
    """(log intensity's weights, cost): damped Newton on the concave likelihood, halving its steps."""
    events = event_sum.sum()
    exposure = weights.sum()
    if exposure <= 0:
        return np.zeros(B.shape[1]), math.inf
    w = np.full(B.shape[1], math.log(max(events, 1e-3) / exposure))
    value = lambda v: float(weights @ np.exp(np.clip(B @ v, -50, 50)) - v @ event_sum) + ridge * float(v @ v)
    now = value(w)
    for _ in range(steps):
        rate = weights * np.exp(np.clip(B @ w, -50, 50))
        gradient = B.T @ rate - event_sum + 2 * ridge * w
        hessian = (B * rate[:, None]).T @ B + (2 * ridge + 1e-10) * np.eye(len(w))
        move = np.linalg.solve(hessian, gradient)
        size = 1.0
        for _ in range(20):
            if (new := value(w - size * move)) <= now:
                break
            size /= 2
        else:
            break
        w, done, now = w - size * move, now - new < 1e-10 * (1 + abs(now)), new
        if done:
            break
    return w, 2 * (float(weights @ np.exp(np.clip(B @ w, -50, 50))) - float(w @ event_sum))


SLICES = "series_id string, segment int, start long, stop long, cost double, score double, status string, events long, exposure double, weights array<double>"


def sliced_poisson(periods: DataFrame, period: float, n_basis: int = 6, degree: int = 2, penalty: float | str = "bic", min_length: int = 1) -> DataFrame:
    """Segments of periods with one intensity shape each.

    periods: series_id, t (0..n-1), event_times array, exposure array of
    struct(start, stop). One task a series: a segment's fit needs only sums over its
    periods, and a weight for each exposure that they have.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        sid, n = str(frame["series_id"].iloc[0]), len(frame)
        event_sums, counts, own, designs = [], [], [], []
        known: dict[tuple, int] = {}  # periods of one exposure share its design
        for times, spans in zip(frame["event_times"], frame["exposure"]):
            times = np.asarray(times if times is not None else [], float)
            event_sums.append(basis(times, n_basis, degree, period).sum(axis=0) if len(times) else np.zeros(n_basis))
            counts.append(len(times))
            key = tuple((s["start"], s["stop"]) for s in spans)
            if key not in known:
                known[key] = len(designs)
                designs.append(design(list(key), n_basis, degree, period))
            own.append(known[key])
        sums = np.vstack([np.zeros(n_basis), np.cumsum(event_sums, axis=0)])
        times_each = np.vstack([np.zeros(len(designs)), np.cumsum(np.eye(len(designs))[own], axis=0)])
        cache: dict[tuple[int, int], tuple[np.ndarray, float]] = {}

        def fit(a: int, b: int) -> tuple[np.ndarray, float]:
            if (a, b) not in cache:
                repeated = times_each[b] - times_each[a]
                held = np.flatnonzero(repeated)
                cache[a, b] = fit_intensity(np.vstack([designs[k][0] for k in held]), np.concatenate([designs[k][1] * repeated[k] for k in held]), sums[b] - sums[a])
            return cache[a, b]

        cost = lambda starts, t: np.array([fit(int(a), int(t))[1] for a in starts])
        p = {"bic": (n_basis + 1) * math.log(max(2, n)), "sic": (n_basis + 1) * math.log(max(2, n)), "aic": 2.0 * (n_basis + 1)}.get(penalty, penalty)
        score, cps = seg.optimal_partition(cost, n, p, min_length)
        out = []
        for row in seg.segment_rows(sid, cost, n, score, cps):
            a, b = row[2], row[3]
            out.append((*row, int(sum(counts[a:b])), float(sum(designs[own[k]][1].sum() for k in range(a, b))), fit(a, b)[0].tolist()))
        return pd.DataFrame(out, columns=[f.split()[0] for f in SLICES.split(", ")])

    good = checked_periods(periods, period)
    return good.select(F.col("series_id").cast("string"), "t", "event_times", "exposure").groupBy("series_id").applyInPandas(run, SLICES)


def marked(periods: DataFrame, **options) -> DataFrame:
    """The same for each mark by itself: a column ``mark`` joins the key."""
    keyed = periods.withColumn("series_id", F.concat_ws("\u0001", F.col("series_id").cast("string"), "mark"))
    found = sliced_poisson(keyed, **options)
    parts = F.split("series_id", "\u0001")
    return found.withColumn("mark", parts[1]).withColumn("series_id", parts[0])


def intensities(slices: DataFrame, period: float, n_basis: int, degree: int, grid: int = 24) -> DataFrame:
    """series_id, segment, time, rate at midpoints of a grid; the grid's basis is a small literal table."""
    mid = (np.arange(grid) + 0.5) * period / grid
    b = basis(mid, n_basis, degree, period)
    rows = slices.sparkSession.createDataFrame([(float(t), v.tolist()) for t, v in zip(mid, b)], "time double, b array<double>")
    from shiftspark.functions.columns import dot, exp_or_inf

    rate = exp_or_inf(dot(F.col("weights"), F.col("b")))
    whole = F.when(rate < float("inf"), rate).otherwise(F.raise_error(F.lit("an intensity overflows")).cast("double"))
    return slices.crossJoin(F.broadcast(rows)).select("series_id", "segment", "time", whole.alias("rate"))


def simulate_periods(frame: DataFrame, period: float, top: float, rate, seed: int = 0) -> DataFrame:
    """Thinned events for rows (series_id, t): rate(t, times) up to ``top``; seeded by row."""

    def run(batches):
        for f in batches:
            out = []
            for sid, t in zip(f["series_id"], f["t"]):
                rng = np.random.default_rng([seed, int(t), *str(sid).encode()])
                times = np.sort(rng.uniform(0, period, rng.poisson(top * period)))
                keep = rng.uniform(size=len(times)) < rate(int(t), times) / top
                out.append((str(sid), int(t), times[keep].tolist(), [{"start": 0.0, "stop": period}]))
            yield pd.DataFrame(out, columns=["series_id", "t", "event_times", "exposure"])

    return frame.select(F.col("series_id").cast("string"), F.col("t").cast("long")).mapInPandas(run, "series_id string, t long, event_times array<double>, exposure array<struct<start: double, stop: double>>")


def simulate_segments(spark: SparkSession, series: int, lengths: list[int], rates: list[float], period: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(periods, true changepoints): ``lengths`` periods each at a constant rate, in every one of ``series`` series."""
    ends = np.cumsum(lengths)
    places = spark.range(series).select(F.col("id").cast("string").alias("series_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(ends[-1]) - 1).cast("long"))).alias("t"))
    made = simulate_periods(places, period, max(rates), lambda t, h: np.full(len(h), rates[int(np.searchsorted(ends, t, "right"))]), seed)
    cps = spark.range(series).select(F.col("id").cast("string").alias("series_id"), F.explode(F.array(*[F.lit(int(e)) for e in ends[:-1]]).cast("array<bigint>")).alias("cp"))
    return made, cps
