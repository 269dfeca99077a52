"""Bayesian online changepoint detection: one step, shared by batch and stream.

State of a series: t, the run-length distribution R, and two arrays of sufficient
statistics, one entry for each run length. Missing values (null or NaN) move the
state on without evidence.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ONLINE = "series_id string, t long, cp_prob double, map_run_length int, pred_mean double, log_evidence double, error double"

EPS = 1e-12


# --- hazards --------------------------------------------------------------------


@dataclass(frozen=True)
class ConstantHazard:
    mean_run_length: float = 96.0

    def __call__(self, r: np.ndarray, t: int) -> np.ndarray:
        return np.full(len(r), min(max(1 / self.mean_run_length, EPS), 1 - EPS))


@dataclass(frozen=True)
class ScheduledHazard:
    schedule: tuple[float, ...]

    def __call__(self, r: np.ndarray, t: int) -> np.ndarray:
        return np.full(len(r), self.schedule[t % len(self.schedule)])


@dataclass(frozen=True)
class BoostedHazard:
    """A base hazard times ``boost`` at the phases where changes are expected."""

    base: Callable[[np.ndarray, int], np.ndarray]
    period: int
    phases: tuple[int, ...]
    boost: float = 10.0

    def __call__(self, r: np.ndarray, t: int) -> np.ndarray:
        h = self.base(r, t)
        return np.clip(h * self.boost, EPS, 1 - EPS) if t % self.period in self.phases else h


def constant_hazard(mean_run_length: float) -> Column:
    return F.lit(min(max(1 / mean_run_length, EPS), 1 - EPS))


def scheduled_hazard(schedule: list[float], t: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(h)) for h in schedule]), (F.pmod(t, F.lit(len(schedule))) + 1).cast("int"))


def boosted_hazard(base: Column, period: int, phases: list[int], t: Column, boost: float = 10.0) -> Column:
    return F.when(F.pmod(t, F.lit(period)).isin(phases), F.least(F.greatest(base * boost, F.lit(EPS)), F.lit(1 - EPS))).otherwise(base)


# --- likelihoods ----------------------------------------------------------------


class Likelihood(Protocol):
    """What a detector asks of a conjugate likelihood; a caller's own class that has these is one.

    Two numbers a run length hold what it has seen. Arrays a and b are those numbers, one
    entry for each run length, and results have the same shape. Instances travel to the workers, so they pickle.
    """

    def prior(self) -> tuple[float, float]:
        """(a, b) before any value."""

    def mean(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The expected next value."""

    def log_predictive(self, x: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The log probability or density of the next value."""

    def update(self, x: float, a: np.ndarray | float, b: np.ndarray | float) -> tuple:
        """(a, b) after a value."""


def checked_likelihood(likelihood: Likelihood) -> Likelihood:
    """The likelihood, if it has all that a detector asks, with results of the right shapes at its prior."""
    lacking = [n for n in ("prior", "mean", "log_predictive", "update") if not callable(getattr(likelihood, n, None))]
    if lacking:
        raise TypeError(f"a likelihood has {', '.join(lacking)}")
    a, b = (np.full(2, float(v)) for v in likelihood.prior())
    if np.shape(likelihood.mean(a, b)) != (2,) or not np.isfinite([*likelihood.prior()]).all():
        raise TypeError("a likelihood's prior is two finite numbers, and its mean has a value for each run length")
    return likelihood


@dataclass(frozen=True)
class BetaBernoulli:
    alpha: float = 1.0
    beta: float = 1.0

    def prior(self) -> tuple[float, float]:
        return self.alpha, self.beta

    def mean(self, a, b):
        return a / (a + b)

    def log_predictive(self, x, a, b):
        return np.log(a if x else b) - np.log(a + b)

    def update(self, x, a, b):
        return a + (1.0 if x else 0.0), b + (0.0 if x else 1.0)


_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


@dataclass(frozen=True)
class PoissonGamma:
    shape: float = 1.0
    rate: float = 1.0

    def prior(self) -> tuple[float, float]:
        return self.shape, self.rate

    def mean(self, a, b):
        return a / b

    def log_predictive(self, x, a, b):
        if x < 0 or x != int(x):
            raise ValueError("counts must be non-negative whole numbers")
        return _LGAMMA(a + x) - _LGAMMA(a) - math.lgamma(x + 1) + a * np.log(b / (b + 1)) - x * np.log(b + 1)

    def update(self, x, a, b):
        return a + x, b + 1.0


# --- the recursion --------------------------------------------------------------


@dataclass(frozen=True)
class Detector:
    likelihood: Likelihood = field(default_factory=BetaBernoulli)
    hazard: Callable[[np.ndarray, int], np.ndarray] = field(default_factory=ConstantHazard)
    max_run_length: int = 512
    prune: float = 0.0  # probabilities under this share of the largest go
    top_k: int | None = None  # keep so many run lengths (and 0)
    epsilon: float = 0.0  # probabilities under this go

    def __post_init__(self):
        checked_likelihood(self.likelihood)

    def start(self) -> dict:
        a, b = self.likelihood.prior()
        return {"t": 0, "R": np.ones(1), "a": np.array([a]), "b": np.array([b])}

    def step(self, state: dict, x: float | None) -> tuple[dict, tuple]:
        """(next state, (cp_prob, map_run_length, pred_mean, log_evidence, error))"""
        R, a, b, t = state["R"], state["a"], state["b"], state["t"]
        a0, b0 = self.likelihood.prior()
        missing = x is None or (isinstance(x, float) and math.isnan(x))
        means, likeliest = self.likelihood.mean(a, b), int(R.argmax())
        # from the likeliest one's on, so that the rounding of a sum of probabilities of about 1 does not shift it
        mean = float(means[likeliest] + R @ (means - means[likeliest]))
        h = self.hazard(np.arange(len(R)), t)
        if missing:
            lp, lp0 = np.zeros(len(R)), 0.0
        else:
            lp, lp0 = self.likelihood.log_predictive(x, a, b), float(self.likelihood.log_predictive(x, np.array([a0]), np.array([b0]))[0])
        with np.errstate(divide="ignore"):
            logs = np.concatenate(([np.log(R @ h) + lp0], np.log(R) + np.log1p(-h) + lp))
        top = logs.max()
        weights = np.exp(logs - top)
        evidence = 0.0 if missing else float(top + np.log(weights.sum()))
        R = weights / weights.sum()
        if missing:
            a, b = np.concatenate(([a0], a)), np.concatenate(([b0], b))
        else:
            grown, reset = self.likelihood.update(x, a, b), self.likelihood.update(x, a0, b0)
            a, b = np.concatenate(([reset[0]], grown[0])), np.concatenate(([reset[1]], grown[1]))
        lost = 0.0
        if len(R) > self.max_run_length + 1:
            lost = float(R[self.max_run_length + 1 :].sum())
            R, a, b = (v[: self.max_run_length + 1] for v in (R, a, b))
        keep = (R >= self.prune * R.max()) & (R >= self.epsilon)
        if self.top_k is not None and len(R) > self.top_k:
            keep &= R >= np.sort(R)[-self.top_k]
            keep[0] = True
        pruned = float(R[~keep].sum())
        R = np.where(keep, R, 0.0)
        total = R.sum()
        R = R / total if total > 0 else np.eye(1, len(R))[0]
        out = (float(R[0]), int(R.argmax()), mean, evidence, lost + (1 - lost) * pruned)
        return {"t": t + 1, "R": R, "a": a, "b": b}, out


def detect(series: DataFrame, detector: Detector) -> DataFrame:
    """Every step of every series: series_id, t, value -> ONLINE rows; one task a series."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        state, rows = detector.start(), []
        for t, x in zip(frame["t"], frame["value"]):
            state, out = detector.step(state, None if pd.isna(x) else float(x))
            rows.append((frame["series_id"].iloc[0], t, *out))
        return pd.DataFrame(rows, columns=["series_id", "t", "cp_prob", "map_run_length", "pred_mean", "log_evidence", "error"])

    return series.select(F.col("series_id").cast("string"), F.col("t").cast("long"), F.col("value").cast("double")).groupBy("series_id").applyInPandas(run, ONLINE)


RUN_LENGTHS = "series_id string, t long, run_length int, probability double"


def run_lengths(series: DataFrame, detector: Detector, least: float = 1e-12) -> DataFrame:
    """series_id, t, run_length, probability: the posterior over run lengths after every step, without those under ``least``."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        state, parts = detector.start(), []
        for t, x in zip(frame["t"], frame["value"]):
            state, _ = detector.step(state, None if pd.isna(x) else float(x))
            at = np.flatnonzero(state["R"] >= least)
            parts.append(pd.DataFrame({"t": t, "run_length": at, "probability": state["R"][at]}))
        return pd.concat(parts).assign(series_id=frame["series_id"].iloc[0])[["series_id", "t", "run_length", "probability"]]

    return series.select(F.col("series_id").cast("string"), F.col("t").cast("long"), F.col("value").cast("double")).groupBy("series_id").applyInPandas(run, RUN_LENGTHS)


def alerts(online: DataFrame, threshold: float | None = 0.6, reset: bool = False, min_spacing: int = 1) -> DataFrame:
    """series_id, t of alerts: local peaks of cp_prob over the threshold, or drops of the run length.

    The first step is a peak if it is at least the next, the last if it is over
    the one before, others if at least the one before and over the next. An alert
    within ``min_spacing`` of the last kept one is left out.
    """
    w = Window.partitionBy("series_id").orderBy("t")
    p = F.col("cp_prob")
    before, after = F.lag("cp_prob").over(w), F.lead("cp_prob").over(w)
    peak = F.when(before.isNull() & after.isNull(), True).when(before.isNull(), p >= after).when(after.isNull(), p > before).otherwise((p >= before) & (p > after))
    hit = F.lit(False) if threshold is None else (p >= threshold) & peak
    if reset:
        hit = hit | F.coalesce(F.col("map_run_length") < F.lag("map_run_length").over(w), F.lit(False))
    found = online.withColumn("hit", hit).where("hit").select("series_id", "t")
    if min_spacing <= 1:
        return found
    spaced = F.aggregate(F.array_sort(F.collect_list("t")), F.array().cast("array<bigint>"), lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) >= min_spacing), F.concat(acc, F.array(t))).otherwise(acc))
    # a series' alerts, a small part of its steps
    return found.groupBy("series_id").agg(spaced.alias("ts")).select("series_id", F.explode("ts").alias("t"))
