"""Hidden Markov and semi-Markov segmentation of many series.

Log-likelihood rows (series_id, t, loglik array) come from native emissions; the
recursions over time run one series a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = "series_id string, t long, state int, duration int"


def _lse(x: np.ndarray, axis=None) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        out = np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top
    return out.squeeze(axis) if axis is not None else out.item()


def _log(x) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(np.asarray(x, float))


# --- duration tables --------------------------------------------------------------


def poisson_durations(rate: float, longest: int, least: int = 1) -> np.ndarray:
    """Log probabilities of 1..longest, normalised over least..longest."""
    d = np.arange(1, longest + 1)
    p = d * math.log(rate) - rate - np.array([math.lgamma(k + 1) for k in d])
    p = np.where(d >= least, p, -np.inf)
    return p - _lse(p)


def negative_binomial_durations(r: float, p: float, longest: int, least: int = 1) -> np.ndarray:
    d = np.arange(1, longest + 1)
    out = np.array([math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) for k in d]) + r * math.log(1 - p) + d * math.log(p)
    out = np.where(d >= least, out, -np.inf)
    return out - _lse(out)


def duration_table(family: str, parameters: list, longest: int, least: int = 1) -> np.ndarray:
    """States x 1..longest of log probabilities: poisson (a rate a state) or negative_binomial (r and p a state)."""
    if family not in ("poisson", "negative_binomial"):
        raise ValueError(f"{family}: neither poisson nor negative_binomial")
    if not 1 <= least <= longest:
        raise ValueError("the least duration is from 1 to the longest")
    if family == "poisson":
        return np.array([poisson_durations(rate, longest, least) for rate in parameters])
    return np.array([negative_binomial_durations(r, p, longest, least) for r, p in parameters])


def negative_binomial_rows(r: Column, p: Column, longest: int) -> Column:
    """array(struct(d, log_p)) of the truncated negative binomial, natively."""
    from shiftspark.functions.columns import lgamma

    raw = F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda d: F.struct(d.alias("d"), (lgamma(d + r) - lgamma(r) - lgamma(d + 1.0) + r * F.log(1 - p) + d * F.log(p)).alias("v")))
    total = F.log(F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + F.exp(x["v"])))
    return F.transform(raw, lambda x: F.struct(x["d"].alias("d"), (x["v"] - total).alias("log_p")))


def duration_rows(rate: Column, longest: int) -> Column:
    """array(struct(d, log_p)) of the truncated Poisson, natively."""
    from shiftspark.functions.columns import lgamma

    raw = F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda d: F.struct(d.alias("d"), (d * F.log(rate) - rate - lgamma(d + 1)).alias("v")))
    total = F.log(F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + F.exp(x["v"])))
    return F.transform(raw, lambda x: F.struct(x["d"].alias("d"), (x["v"] - total).alias("log_p")))


# --- HMM --------------------------------------------------------------------------


def forward_backward(ll: np.ndarray, log_pi: np.ndarray, log_a: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(gamma T x K, summed xi K x K, log likelihood)"""
    T, K = ll.shape
    alpha, beta = np.empty((T, K)), np.zeros((T, K))
    alpha[0] = log_pi + ll[0]
    for t in range(1, T):
        alpha[t] = _lse(alpha[t - 1][:, None] + log_a, 0) + ll[t]
    for t in range(T - 2, -1, -1):
        beta[t] = _lse(log_a + ll[t + 1] + beta[t + 1], 1)
    z = _lse(alpha[-1])
    xi = np.zeros((K, K))
    for t in range(1, T):
        xi += np.exp(alpha[t - 1][:, None] + log_a + ll[t] + beta[t] - z)
    return np.exp(alpha + beta - z), xi, float(z)


def viterbi(ll: np.ndarray, log_pi: np.ndarray, log_a: np.ndarray) -> np.ndarray:
    """The likeliest path; the first state on ties."""
    best, back = log_pi + ll[0], []
    for row in ll[1:]:
        paths = best[:, None] + log_a
        back.append(paths.argmax(axis=0))
        best = paths.max(axis=0) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return np.array(path[::-1])


def fold_viterbi_scores(rows: Column, log_pi: list[float], log_a: list[list[float]]) -> Column:
    """The best path's log score after every step, as a Catalyst fold over an array of loglik arrays."""
    k = len(log_pi)

    def step(acc: Column, row: Column) -> Column:
        last = F.element_at(acc, -1)
        new = F.array(*[F.greatest(*[F.get(last, i) + float(log_a[i][j]) for i in range(k)]) + F.get(row, j) for j in range(k)])
        return F.concat(acc, F.array(new))

    first = F.array(F.array(*[F.get(F.element_at(rows, 1), j) + float(log_pi[j]) for j in range(k)]))
    return F.aggregate(F.slice(rows, 2, F.size(rows) - 1), first, step)


# --- HSMM -------------------------------------------------------------------------


class Hsmm:
    """Explicit durations 1..D; no self transitions. durations: log table K x D."""

    def __init__(self, pi, a, durations: np.ndarray):
        a = np.array(a, float)
        np.fill_diagonal(a, 0)
        a = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-300)
        self.log_pi, self.log_a, self.durations = _log(np.array(pi, float) / np.sum(pi)), _log(a), durations

    def viterbi(self, ll: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(states, duration at each segment's last index, score)"""
        T, K = ll.shape
        D = self.durations.shape[1]
        cum = np.vstack([np.zeros(K), ll.cumsum(axis=0)])
        best = np.full((T + 1, K), -np.inf)
        length, source = np.zeros((T + 1, K), int), np.full((T + 1, K), -1)
        enter = np.full((T + 1, K), -np.inf)  # best score of entering each state at t
        enter[0] = self.log_pi
        came = np.full((T + 1, K), -1)
        for t in range(1, T + 1):
            d = np.arange(1, min(D, t) + 1)
            options = enter[t - d] + self.durations[:, : len(d)].T + cum[t] - cum[t - d]
            length[t] = d[options.argmax(axis=0)]
            best[t] = options.max(axis=0)
            source[t] = came[t - length[t], np.arange(K)]
            paths = best[t][:, None] + self.log_a
            came[t], enter[t] = paths.argmax(axis=0), paths.max(axis=0)
        states, marks, t, j = np.zeros(T, int), np.zeros(T, int), T, int(best[T].argmax())
        while t > 0:
            d = int(length[t, j])
            states[t - d : t], marks[t - 1] = j, d
            t, j = t - d, int(source[t, j])
        return states, marks, float(best[T].max())

    def expect(self, ll: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """(starts of the first segment K, transitions K x K, durations K x D, log likelihood)"""
        T, K = ll.shape
        D = self.durations.shape[1]
        cum = np.vstack([np.zeros(K), ll.cumsum(axis=0)])
        enter, end = np.full((T + 1, K), -np.inf), np.full((T + 1, K), -np.inf)
        enter[0] = self.log_pi
        for t in range(1, T + 1):
            d = np.arange(1, min(D, t) + 1)
            end[t] = _lse(enter[t - d] + self.durations[:, : len(d)].T + cum[t] - cum[t - d], 0)
            enter[t] = _lse(end[t][:, None] + self.log_a, 0)
        after_end, after_enter = np.full((T + 1, K), -np.inf), np.full((T + 1, K), -np.inf)
        after_end[T] = 0
        for t in range(T - 1, -1, -1):
            d = np.arange(1, min(D, T - t) + 1)
            after_enter[t] = _lse(self.durations[:, : len(d)].T + cum[t + d] - cum[t] + after_end[t + d], 0)
            if t:
                after_end[t] = _lse(self.log_a + after_enter[t], 1)
        z = _lse(end[T])
        counts, moves = np.zeros((K, D)), np.zeros((K, K))
        for t in range(1, T + 1):
            d = np.arange(1, min(D, t) + 1)
            counts[:, : len(d)] += np.exp(enter[t - d] + self.durations[:, : len(d)].T + cum[t] - cum[t - d] + after_end[t] - z).T
            if t < T:
                moves += np.exp(end[t][:, None] + self.log_a + after_enter[t] - z)
        return np.exp(self.log_pi + after_enter[0] - z), moves, counts, float(z)


def fit_hsmm(ll: np.ndarray, pi, a, parameters: list, longest: int, iterations: int = 50, tolerance: float = 1e-6, family: str = "poisson", least: int = 1) -> tuple[Hsmm, list, list[float]]:
    """EM for transitions and durations with fixed emissions: (model, duration parameters, log likelihoods).

    poisson: the truncated likelihood's rate by Newton. negative_binomial: (r, p) by moments.
    """
    trace: list[float] = []
    parameters = list(parameters)
    for _ in range(iterations):
        model = Hsmm(pi, a, duration_table(family, parameters, longest, least))
        first, moves, counts, z = model.expect(ll)
        done = bool(trace) and abs(z - trace[-1]) < tolerance * (1 + abs(trace[-1]))
        trace.append(z)
        if done:
            break
        pi = first / first.sum()
        sums = moves.sum(axis=1, keepdims=True)
        a = np.where(sums > 0, moves / np.maximum(sums, 1e-300), np.array(a, float))
        step = _poisson_rate if family == "poisson" else _negative_binomial_moments
        parameters = [step(c, r) for c, r in zip(counts, parameters)]
    return model, parameters, trace


def _negative_binomial_moments(counts: np.ndarray, last: tuple[float, float]) -> tuple[float, float]:
    """(r, p) of the mean and variance of durations; a variance not over the mean counts as just over it."""
    d = np.arange(1, len(counts) + 1)
    if counts.sum() <= 0:
        return last
    mean = float(counts @ d / counts.sum())
    variance = float(counts @ (d - mean) ** 2 / counts.sum())
    r = min(max(mean**2 / max(variance - mean, 1e-6), 1e-3), 1e6)
    return r, min(max(mean / (mean + r), 1e-6), 1 - 1e-6)


def _poisson_rate(counts: np.ndarray, rate: float) -> float:
    """The truncated Poisson's rate by Newton on its mean."""
    d = np.arange(1, len(counts) + 1)
    if counts.sum() <= 0:
        return rate
    wanted = float(counts @ d / counts.sum())
    for _ in range(30):
        p = np.exp(poisson_durations(rate, len(counts)))
        mean = p @ d
        variance = p @ d**2 - mean**2
        step = (mean - wanted) / max(variance / rate, 1e-9)
        rate = min(max(rate - np.clip(step, -rate / 2, rate), 1e-3), 10.0 * len(counts))
        if abs(mean - wanted) < 1e-10:
            break
    return float(rate)


# --- scaled-Dirichlet HMM -----------------------------------------------------------


def scaled_dirichlet_loglik(x: Column, alpha: list[float], beta: list[float]) -> Column:
    """Log density of a composition, in built-in functions; constants come from the driver."""
    total = sum(alpha)
    constant = math.lgamma(total) - sum(math.lgamma(v) for v in alpha) + sum(u * math.log(v) for u, v in zip(alpha, beta))
    logs, mix = F.lit(constant), F.lit(0.0)
    for i, (u, v) in enumerate(zip(alpha, beta)):
        logs, mix = logs + (u - 1) * F.log(F.get(x, i)), mix + v * F.get(x, i)
    return logs - total * F.log(mix)


def _sd_loglik(x: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """T x K"""
    g = np.vectorize(math.lgamma, otypes=[float])
    constant = g(alpha.sum(axis=1)) - g(alpha).sum(axis=1) + (alpha * np.log(beta)).sum(axis=1)
    return constant + np.log(x) @ (alpha - 1).T - np.log(x @ beta.T) * alpha.sum(axis=1)


def digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), np.zeros_like(x, float)
    while (x < 6).any():
        low = x < 6
        out, x = out - np.where(low, 1 / x, 0), np.where(low, x + 1, x)
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def _spread_labels(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """First labels: seeds drawn far apart, then a few rounds of nearest means."""
    centres = x[[int(rng.integers(len(x)))]]
    for _ in range(1, k):
        d = ((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1) + 1e-12
        centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum())]])
    for _ in range(10):
        own = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
    return own


def fit_sdhmm(
    x: np.ndarray, states: int, components: int = 1, iterations: int = 50, least: int = 5, tolerance: float = 1e-5, seed: int = 0, steps: int = 5,
    start: float = 1e-3, moving: float = 1e-2, mixing: float = 1.0, shape: float = 1.0, rate: float = 0.0, spread: float = 1.0,
) -> dict:
    """Variational fit of a scaled-Dirichlet HMM whose states are mixtures of ``components``.

    Mixture weights have a Dirichlet posterior ``eta`` (prior ``mixing``) and enter by
    their expected logs; start and moves are Dirichlet-smoothed. Components climb the
    weighted likelihood under a Gamma(shape, rate) prior on alpha and a
    Dirichlet(spread) one on beta. One component is plain EM. Returns parameters, the
    trace, the best states and, within them, the likeliest components.
    """
    if (x < 0).any() or (x.sum(axis=1) <= 0).any() or not np.isfinite(x).all():
        raise ValueError("a composition is finite, non-negative and not all zero")
    x = np.clip(x / x.sum(axis=1, keepdims=True), 1e-6, None)
    x = x / x.sum(axis=1, keepdims=True)
    rng, (T, D), KM = np.random.default_rng(seed), x.shape, states * components
    own = _spread_labels(x, states, rng)
    alpha, beta = np.ones((KM, D)), np.full((KM, D), 1.0 / D)
    for k in range(KM):
        rows = x[own == k // components] if (own == k // components).any() else x
        alpha[k] = 1 + 10 * rows.mean(axis=0) * rng.uniform(0.8, 1.2, D)
    pi, a, eta, trace = np.full(states, 1 / states), np.full((states, states), 1 / states) + np.eye(states), np.full((states, components), mixing + T / KM), []
    a = a / a.sum(axis=1, keepdims=True)

    def expected() -> tuple[np.ndarray, np.ndarray]:
        """Log densities with expected log weights, T x states x components, and their sum over components."""
        weights = digamma(eta) - digamma(eta.sum(axis=1, keepdims=True))
        parts = _sd_loglik(x, alpha, beta).reshape(T, states, components) + weights
        return parts, _lse(parts, 2)

    for it in range(iterations):
        parts, ll = expected()
        gamma, xi, z = forward_backward(ll, _log(pi), _log(a))
        trace.append(z)
        if it >= least and abs(trace[-1] - trace[-2]) < tolerance * (1 + abs(trace[-2])):
            break
        share = gamma[:, :, None] * np.exp(parts - ll[:, :, None])
        pi, a = (gamma[0] + start) / (gamma[0] + start).sum(), (xi + moving) / (xi + moving).sum(axis=1, keepdims=True)
        eta = mixing + share.sum(axis=0)
        r = share.reshape(T, KM)
        size = np.maximum(r.sum(axis=0), 1e-12)
        r = r / size
        for _ in range(steps):
            mix = x @ beta.T
            total = alpha.sum(axis=1, keepdims=True)
            g_alpha = digamma(total) - digamma(alpha) + np.log(beta) + r.T @ np.log(x) - (r * np.log(mix)).sum(axis=0)[:, None]
            g_alpha += ((shape - 1) / alpha - rate) / size[:, None]
            alpha = np.clip(alpha * np.exp(np.clip(0.2 * g_alpha, -0.5, 0.5)), 1e-2, 1e3)
            g_beta = alpha / beta - alpha.sum(axis=1, keepdims=True) * ((r / mix).T @ x) + (spread - 1) / beta / size[:, None]
            beta = beta * np.exp(np.clip(0.05 * g_beta * beta, -0.5, 0.5))
            beta = np.clip(beta / beta.sum(axis=1, keepdims=True), 1e-6, None)
            beta = beta / beta.sum(axis=1, keepdims=True)
    parts, ll = expected()
    path = viterbi(ll, _log(pi), _log(a))
    return {"alpha": alpha, "beta": beta, "pi": pi, "a": a, "eta": eta, "trace": trace, "states": path, "components": parts[np.arange(T), path].argmax(axis=1)}


# --- Spark ------------------------------------------------------------------------


def _grouped(rows: DataFrame, column: str, fit, more: str = "") -> DataFrame:
    """STATES (and ``more`` columns) from fit(values of one series)."""
    names = [f.split()[0] for f in more.split(", ") if f]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        states, marks, *others = fit(np.array(frame[column].tolist(), float))
        return pd.DataFrame({"series_id": frame["series_id"].to_numpy(), "t": frame["t"].to_numpy(), "state": states, "duration": marks, **dict(zip(names, others))})

    return rows.select(F.col("series_id").cast("string"), F.col("t").cast("long"), column).groupBy("series_id").applyInPandas(run, STATES + (f", {more}" if more else ""))


def _ends(states: np.ndarray) -> np.ndarray:
    """A segment's length at its last index, 0 elsewhere."""
    last = np.append(np.flatnonzero(np.diff(states)), len(states) - 1)
    out = np.zeros(len(states), int)
    out[last] = np.diff(np.concatenate(([-1], last)))
    return out


def decode_hmm(loglik: DataFrame, pi: list[float], a: list[list[float]]) -> DataFrame:
    def fit(ll):
        s = viterbi(ll, _log(pi), _log(a))
        return s, _ends(s)

    return _grouped(loglik, "loglik", fit)


def decode_hsmm(loglik: DataFrame, pi: list[float], a: list[list[float]], parameters: list, longest: int, learn: bool = False, iterations: int = 50, family: str = "poisson", least: int = 1) -> DataFrame:
    """States and durations of every series; with ``learn``, after EM on that series. parameters: see duration_table."""

    def fit(ll):
        model = fit_hsmm(ll, pi, a, parameters, longest, iterations, family=family, least=least)[0] if learn else Hsmm(pi, a, duration_table(family, parameters, longest, least))
        return model.viterbi(ll)[:2]

    return _grouped(loglik, "loglik", fit)


def whole_compositions(compositions: DataFrame) -> DataFrame:
    """comp as doubles; a row that is null, negative or all zero ends the job with an error."""
    whole = F.col("comp").isNotNull() & F.forall("comp", lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0)) & F.exists("comp", lambda v: v > 0)
    return compositions.withColumn("comp", F.when(whole, F.col("comp").cast("array<double>")).otherwise(F.raise_error(F.lit("a composition is finite, non-negative and not all zero")).cast("array<double>")))


def decode_sdhmm(compositions: DataFrame, states: int, components: int = 1, seed: int = 0, iterations: int = 50, **priors) -> DataFrame:
    """States of compositions (series_id, t, comp) and the likeliest component within each, fitted per series.

    A row that is null, negative or all zero is no composition and ends the job with an error.
    """
    checked = whole_compositions(compositions)

    def fit(x):
        found = fit_sdhmm(x, states, components, iterations, seed=seed, **priors)
        return found["states"], _ends(found["states"]), found["components"]

    return _grouped(checked, "comp", fit, "component int")


def state_changepoints(decoded: DataFrame) -> DataFrame:
    from shiftspark.operators.boundaries import changepoints_from_labels

    return changepoints_from_labels(decoded, "state")


def pooled_transitions(decoded: DataFrame, smoothing: float = 0.0, states: int | None = None) -> DataFrame:
    """src, dst, p over all series: the transition step as one aggregate."""
    from pyspark.sql import Window

    w = Window.partitionBy("series_id").orderBy("t")
    pairs = decoded.withColumn("dst", F.lead("state").over(w)).where("dst is not null").groupBy(F.col("state").alias("src"), "dst").count()
    return pairs.select("src", "dst", ((F.col("count") + smoothing) / (F.sum("count").over(Window.partitionBy("src")) + smoothing * (states or 0))).alias("p"))
