"""State-space models whose parameters all series share, fitted by EM over Spark.

The expectation of a series needs that series alone, so a round is one pass over the series' rows,
many series of a task at a time, and one aggregate of expected counts, whose number hangs on states and durations only.
The driver turns those few numbers into the next parameters. A series is one row and
its recursion is sequential; series spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftspark.functions.frames import keep
from shiftspark.operators.statespace import Hsmm, _ends, _grouped, _log, _lse, _negative_binomial_moments, _poisson_rate, _sd_loglik, digamma, duration_table, viterbi, whole_compositions

#: Numbers (series x steps x states) of series that are worked on together.
CELLS = 500_000


def whole_series(rows: DataFrame, value: str) -> DataFrame:
    """series_id, rows (in the order of t): a row a series, written once, as every round reads it."""
    typed = rows.select(F.col("series_id").cast("string"), F.struct(F.col("t").cast("long").alias("t"), F.col(value).cast("array<double>").alias("v")).alias("r"))
    return keep(typed.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["v"]).alias("rows")), "series")


def _matrices(lists: pa.ListArray, width: int) -> list[np.ndarray]:
    """Each row's (steps, width) matrix."""
    flat = np.asarray(lists.flatten().flatten(), dtype=float).reshape(-1, width)
    return np.split(flat, np.cumsum(np.asarray(lists.value_lengths()))[:-1]) if len(lists) else []


def _together(series: list[np.ndarray], cells: int) -> Iterator[list[np.ndarray]]:
    """Runs of series of about the same length, of bounded size when filled up to the longest."""
    series = sorted((s for s in series if len(s)), key=len, reverse=True)
    first = 0
    while first < len(series):
        n = max(1, cells // max(1, series[first].size))
        yield series[first : first + n]
        first += n


# --- HSMM -------------------------------------------------------------------------


def expect_many(model: Hsmm, series: list[np.ndarray], cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected (first states, moves, durations) and log likelihood, summed over series: Hsmm.expect of each."""
    K, D = model.durations.shape
    first, moves, counts, total = np.zeros(K), np.zeros((K, K)), np.zeros((K, D)), 0.0
    for some in _together(series, cells):
        B, T = len(some), len(some[0])
        n = np.array([len(s) for s in some])
        ll = np.zeros((B, T, K))
        for i, s in enumerate(some):
            ll[i, : len(s)] = s
        cum = np.concatenate([np.zeros((B, 1, K)), ll.cumsum(axis=1)], axis=1)
        enter, end = np.full((B, T + 1, K), -np.inf), np.full((B, T + 1, K), -np.inf)
        enter[:, 0] = model.log_pi
        for t in range(1, T + 1):
            d = np.arange(1, min(D, t) + 1)
            end[:, t] = _lse(enter[:, t - d] + model.durations[:, : len(d)].T + cum[:, t, None] - cum[:, t - d], 1)
            enter[:, t] = _lse(end[:, t, :, None] + model.log_a, 1)
        after_end, after_enter = np.full((B, T + 1, K), -np.inf), np.full((B, T + 1, K), -np.inf)
        after_end[np.arange(B), n] = 0.0
        for t in range(T - 1, -1, -1):
            d = np.arange(1, min(D, T - t) + 1)
            after_enter[:, t] = _lse(model.durations[:, : len(d)].T + cum[:, t + d] - cum[:, t, None] + after_end[:, t + d], 1)
            if t:
                inner = t < n
                after_end[inner, t] = _lse(model.log_a + after_enter[inner, t, None, :], 2)
        z = _lse(end[np.arange(B), n], 1)
        for t in range(1, T + 1):
            d = np.arange(1, min(D, t) + 1)
            live = t <= n
            here = enter[live][:, t - d] + model.durations[:, : len(d)].T + cum[live, t, None] - cum[live][:, t - d] + (after_end[live, t] - z[live, None])[:, None]
            counts[:, : len(d)] += np.exp(here).sum(axis=0).T
            inner = t < n
            moves += np.exp(end[inner, t, :, None] + model.log_a + after_enter[inner, t, None, :] - z[inner, None, None]).sum(axis=0)
        first += np.exp(model.log_pi + after_enter[:, 0] - z[:, None]).sum(axis=0)
        total += float(z.sum())
    return first, moves, counts, total


EXPECTED = "kind string, i int, j int, value double"


def expected_counts(series: DataFrame, model: Hsmm) -> DataFrame:
    """kind (loglik, start, move, duration), i, j, value: what one E-step expects of all series (whole_series)."""
    K, D = model.durations.shape
    names = [("loglik", 0, 0), *[("start", i, 0) for i in range(K)], *[("move", i, j) for i in range(K) for j in range(K)], *[("duration", i, d + 1) for i in range(K) for d in range(D)]]
    kinds, i, j = zip(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                first, moves, counts, z = expect_many(model, _matrices(batch.column(0), K))
                values = np.concatenate([[z], first, moves.ravel(), counts.ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values)], ["kind", "i", "j", "value"])

    return series.select("rows").mapInArrow(run, EXPECTED).groupBy("kind", "i", "j").agg(F.sum("value").alias("value"))


def fit_hsmm(
    loglik: DataFrame, pi, a, parameters: list, longest: int, iterations: int = 50, tolerance: float = 1e-6, family: str = "poisson", least: int = 1
) -> tuple[Hsmm, list, list[float]]:
    """EM for starts, transitions and durations that all series (series_id, t, loglik) share: (model, duration parameters, log likelihoods).

    poisson: an exact M-step, so that the log likelihood never falls. negative_binomial: moments, which may lose a little.
    The model is that of the last log likelihood. A table without series leaves the given parameters.
    """
    series = whole_series(loglik, "loglik")
    parameters, trace = list(parameters), []
    model = Hsmm(pi, a, duration_table(family, parameters, longest, least))
    for _ in range(iterations):
        model = Hsmm(pi, a, duration_table(family, parameters, longest, least))
        K = len(model.log_pi)
        first, moves, counts, z = np.zeros(K), np.zeros((K, K)), np.zeros((K, longest)), None
        for r in expected_counts(series, model).collect():  # 1 + K + K^2 + K D numbers
            if r.kind == "loglik":
                z = r.value
            elif r.kind == "start":
                first[r.i] = r.value
            elif r.kind == "move":
                moves[r.i, r.j] = r.value
            else:
                counts[r.i, r.j - 1] = r.value
        if z is None:
            break
        done = bool(trace) and abs(z - trace[-1]) < tolerance * (1 + abs(trace[-1]))
        trace.append(z)
        if done or len(trace) == iterations:
            break
        pi = first / first.sum()
        sums = moves.sum(axis=1, keepdims=True)
        a = np.where(sums > 0, moves / np.maximum(sums, 1e-300), np.array(a, float))
        step = _poisson_rate if family == "poisson" else _negative_binomial_moments
        parameters = [step(c, r) for c, r in zip(counts, parameters)]
    return model, parameters, trace


def decode_with(loglik: DataFrame, model: Hsmm) -> DataFrame:
    """States and durations of every series under a model that they share."""
    return _grouped(loglik, "loglik", lambda ll: model.viterbi(ll)[:2])


# --- scaled-Dirichlet HMM -----------------------------------------------------------


def forward_backward_many(lls: list[np.ndarray], log_pi: np.ndarray, log_a: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """(each series' T x K state shares, summed xi, summed log likelihood): forward_backward of each, step by step together."""
    B, T, K = len(lls), max(map(len, lls)), len(log_pi)
    n = np.array([len(s) for s in lls])
    ll = np.zeros((B, T, K))
    for i, s in enumerate(lls):
        ll[i, : len(s)] = s
    alpha, beta = np.empty((B, T, K)), np.zeros((B, T, K))
    alpha[:, 0] = log_pi + ll[:, 0]
    for t in range(1, T):
        alpha[:, t] = _lse(alpha[:, t - 1, :, None] + log_a, 1) + ll[:, t]
    for t in range(T - 2, -1, -1):
        inner = t < n - 1  # the last step of a series has 0
        beta[inner, t] = _lse(log_a + (ll[inner, t + 1] + beta[inner, t + 1])[:, None, :], 2)
    z = _lse(alpha[np.arange(B), n - 1], 1)
    xi = np.zeros((K, K))
    for t in range(1, T):
        inner = t < n
        xi += np.exp(alpha[inner, t - 1, :, None] + log_a + (ll[inner, t] + beta[inner, t] - z[inner, None])[:, None, :]).sum(axis=0)
    return [np.exp(alpha[i, :k] + beta[i, :k] - z[i]) for i, k in enumerate(n)], xi, float(z.sum())


_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def _on_simplex(x: np.ndarray) -> np.ndarray:
    x = np.clip(x / x.sum(axis=1, keepdims=True), 1e-6, None)
    return x / x.sum(axis=1, keepdims=True)


def _mixes(x: np.ndarray, r: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a climb needs of the points at a beta: weighted sums of log mixtures, and of points over mixtures."""
    mix = x @ beta.T
    return (r * np.log(mix)).sum(axis=0), (r / mix).T @ x


def _summed(parts: DataFrame, column: str, size: int) -> np.ndarray:
    """An array column added up over rows, place by place."""
    out = np.zeros(size)
    for r in parts.select(F.posexplode(column).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def _expected_logs(eta: np.ndarray) -> np.ndarray:
    return digamma(eta) - digamma(eta.sum(axis=1, keepdims=True))


def _parts(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Log densities with expected log weights, T x states x components, and their sum over components."""
    parts = _sd_loglik(x, model["alpha"], model["beta"]).reshape(len(x), *model["eta"].shape) + _expected_logs(model["eta"])
    return parts, _lse(parts, 2)


def _away_from_prior(eta: np.ndarray, mixing: float) -> float:
    """The divergence of the weights' posteriors from their prior, over states."""
    m, total = eta.shape[1], eta.sum(axis=1)
    own = _LGAMMA(total) - _LGAMMA(eta).sum(axis=1) - math.lgamma(m * mixing) + m * math.lgamma(mixing)
    return float((own + ((eta - mixing) * _expected_logs(eta)).sum(axis=1)).sum())


def fit_sdhmm(
    compositions: DataFrame, states: int, components: int = 1, iterations: int = 50, least: int = 5, tolerance: float = 1e-5, seed: int = 0, steps: int = 5,
    start: float = 1e-3, moving: float = 1e-2, mixing: float = 1.0, shape: float = 1.0, rate: float = 0.0, spread: float = 1.0, alpha: np.ndarray | None = None,
) -> dict:
    """Variational fit of one scaled-Dirichlet HMM to all series (series_id, t, comp): alpha, beta, pi, a, eta and the trace.

    The model and its priors are those of statespace.fit_sdhmm. A round is one pass for the expectation, which writes the
    points with their shares, and then up to ``steps`` passes over those: gradients of alpha and beta are summed over partitions,
    and a climb that does not raise the expected objective is taken back and halved. So the trace (the bound of the evidence
    with the priors) never falls. Starts: k-means over all points, unless ``alpha`` (states x components rows) is given.
    """
    series = whole_series(whole_compositions(compositions), "comp")
    sample = series.select(F.size(F.get("rows", F.lit(0)))).first()
    if sample is None:
        raise ValueError("no compositions to fit")
    D, KM = sample[0], states * components
    rng = np.random.default_rng(seed)
    if alpha is None:
        alpha = 1 + 10 * np.repeat(_start_means(compositions, states, seed, D), components, axis=0) * rng.uniform(0.8, 1.2, (KM, D))
    n = series.agg(F.sum(F.size("rows"))).first()[0]
    a = np.full((states, states), 1 / states) + np.eye(states)
    model = {"alpha": np.array(alpha, float), "beta": np.full((KM, D), 1.0 / D), "pi": np.full(states, 1 / states), "a": a / a.sum(axis=1, keepdims=True), "eta": np.full((states, components), mixing + n / KM)}
    sizes = [1, states, states * states, KM, KM * D, KM, KM * D]
    trace: list[float] = []

    def expectation(model: dict):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in _together([_on_simplex(x) for x in _matrices(batch.column(0), D) if len(x)], CELLS // states):
                    parts = [_parts(x, model) for x in some]
                    gammas, xi, z = forward_backward_many([ll for _, ll in parts], _log(model["pi"]), _log(model["a"]))
                    r = np.concatenate([(g[:, :, None] * np.exp(p - ll[:, :, None])).reshape(-1, KM) for g, (p, ll) in zip(gammas, parts)])
                    x = np.concatenate(some)
                    told = [[z], sum(g[0] for g in gammas), xi.ravel(), r.sum(axis=0), (r.T @ np.log(x)).ravel(), *(v.ravel() for v in _mixes(x, r, model["beta"]))]
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([r.tobytes()], pa.binary()), pa.array([np.concatenate(told)], pa.list_(pa.float64()))], ["x", "r", "told"])

        return run

    def mixtures(beta: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    told = _mixes(np.frombuffer(x).reshape(-1, D), np.frombuffer(r).reshape(-1, KM), beta)
                    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([v.ravel() for v in told])], pa.list_(pa.float64()))], ["told"])

        return run

    def priors(alpha: np.ndarray, beta: np.ndarray) -> float:
        return float(((shape - 1) * np.log(alpha) - rate * alpha).sum() + (spread - 1) * np.log(beta).sum())

    for it in range(iterations):
        shares = keep(series.select("rows").mapInArrow(expectation(model), "x binary, r binary, told array<double>"), "shares")
        z, first, xi, size, logs, mixed, over = np.split(_summed(shares, "told", sum(sizes)), np.cumsum(sizes)[:-1])
        bound = float(z[0] + start * _log(model["pi"]).sum() + moving * _log(model["a"]).sum()) + priors(model["alpha"], model["beta"]) - _away_from_prior(model["eta"], mixing)
        trace.append(bound)
        if it >= least and abs(trace[-1] - trace[-2]) < tolerance * (1 + abs(trace[-2])) or it == iterations - 1:
            break
        xi, logs, over = xi.reshape(states, states), logs.reshape(KM, D), over.reshape(KM, D)
        pi, a = (first + start) / (first + start).sum(), (xi + moving) / (xi + moving).sum(axis=1, keepdims=True)

        def expected(alpha, beta, mixed) -> float:
            constant = _LGAMMA(alpha.sum(axis=1)) - _LGAMMA(alpha).sum(axis=1) + (alpha * np.log(beta)).sum(axis=1)
            return float((size * constant + ((alpha - 1) * logs).sum(axis=1) - alpha.sum(axis=1) * mixed).sum()) + priors(alpha, beta)

        alpha, beta, pace = model["alpha"], model["beta"], 1.0
        value, weight = expected(alpha, beta, mixed), np.maximum(size, 1e-12)[:, None]
        for _ in range(steps):
            total = alpha.sum(axis=1, keepdims=True)
            g_alpha = digamma(total) - digamma(alpha) + np.log(beta) + (logs - mixed[:, None] + (shape - 1) / alpha - rate) / weight
            g_beta = alpha / beta + (-total * over + (spread - 1) / beta) / weight
            next_alpha = np.clip(alpha * np.exp(pace * np.clip(0.2 * g_alpha, -0.5, 0.5)), 1e-2, 1e3)
            next_beta = _on_simplex(beta * np.exp(pace * np.clip(0.05 * g_beta * beta, -0.5, 0.5)))
            told = _summed(shares.select("x", "r").mapInArrow(mixtures(next_beta), "told array<double>"), "told", KM + KM * D)
            reached = expected(next_alpha, next_beta, told[:KM])
            if reached >= value:
                alpha, beta, value, mixed, over = next_alpha, next_beta, reached, told[:KM], told[KM:].reshape(KM, D)
            else:
                pace /= 2
        model = {"alpha": alpha, "beta": beta, "pi": pi, "a": a, "eta": mixing + size.reshape(states, components)}
    return model | {"trace": trace}


def _start_means(compositions: DataFrame, states: int, seed: int, width: int) -> np.ndarray:
    """Mean compositions of k-means clusters over all points."""
    from shiftspark.operators.emissions import kmeans

    total = F.aggregate("comp", F.lit(0.0), lambda acc, v: acc + v)
    points = compositions.select(F.col("series_id").cast("string"), F.col("t").cast("long"), F.col("comp").cast("array<double>")).select("series_id", "t", F.transform("comp", lambda v: v / total).alias("x"))
    labels = kmeans(points, states, ["series_id", "t", "x"], seed=seed)
    out = np.full((states, width), 1.0 / width)
    for r in labels.groupBy("label").agg(F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(width)]).alias("m")).collect():
        out[r["label"]] = r["m"]
    return out


def decode_sdhmm(compositions: DataFrame, model: dict) -> DataFrame:
    """States of every series under a shared model, and the likeliest component within each."""

    def fit(x):
        parts, ll = _parts(_on_simplex(x), model)
        path = viterbi(ll, _log(model["pi"]), _log(model["a"]))
        return path, _ends(path), parts[np.arange(len(x)), path].argmax(axis=1)

    return _grouped(whole_compositions(compositions), "comp", fit, "component int")
