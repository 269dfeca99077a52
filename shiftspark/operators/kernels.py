"""Kernel segmentation: exact Gram costs, random features, and bandwidth choice.

A kernel is "rbf", "linear", or the caller's own: a function of two point matrices
that gives their kernel matrix. Exact costs need memory linear in a series' length
and time quadratic in it; random features are linear in both.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftspark.functions.columns import dot
from shiftspark.functions.frames import discard, keep
from shiftspark.operators import segmentation as seg
from shiftspark.operators.pairs import TILE, between, pair_median, pair_quantiles, squared_distances

#: A whole Gram matrix over so many bytes is refused. Segmentation, criteria and scores need none.
GRAM_BYTES = 1 << 30
#: Half a matrix of a series of so many bytes is what one task factors; two tasks of an executor of 3 GB hold one each.
HALF_BYTES = 768 << 20
#: Rows of a block of such a half.
HALF_TILE = 256
#: Bytes of matrices that are swept as tiles at a time, or one matrix.
WAVE_BYTES = 1 << 30
#: What criteria add to a kernel matrix's diagonal, as a share of its mean.
RIDGE = 1e-6

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


# --- Gram matrices ----------------------------------------------------------------


def median_gamma(x: np.ndarray, seed: int = 123, points: int | None = None) -> float:
    """1 / (2 m) for the exact median m of squared distances, or that of a seeded draw of ``points``; 1 where all points are equal."""
    if points is not None and len(x) > points:
        x = x[np.sort(np.random.default_rng(seed).permutation(len(x))[:points])]
    m = pair_median(x)
    return 1 / (2 * m) if m > 0 else 1.0


def kernel_function(kernel: str | Kernel, x: np.ndarray, gamma: float | None = None, sigma: float | None = None) -> Kernel:
    """The kernel as a function of two point matrices. gamma comes before sigma, and the median heuristic last."""
    if callable(kernel):
        return kernel
    if kernel == "linear":
        return lambda a, b: a @ b.T
    if kernel != "rbf":
        raise ValueError(f"{kernel}: neither rbf nor linear; a function of two point matrices is a kernel too")
    g = gamma if gamma is not None else 1 / (2 * sigma**2) if sigma is not None else median_gamma(x)
    return lambda a, b: np.exp(-g * between(a, b))


def kernel_scatter(x: np.ndarray, kernel: str | Kernel = "rbf", gamma: float | None = None, sigma: float | None = None) -> seg.Cost:
    """Segment costs of points in a kernel's feature space. A caller's kernel is checked on the first points."""
    k = kernel_function(kernel, x, gamma, sigma)
    if callable(kernel):
        validate_gram(np.asarray(k(x[:512], x[:512]), float))
    same = not callable(kernel) and kernel == "rbf"

    def values(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        out = np.asarray(k(x[rows], x[others]), float)
        if same:  # a point's distance to itself is 0, whatever rounding says
            out[rows[:, None] == others[None, :]] = 1.0
        return out

    return seg.kernel_cost(values, len(x))


def gram(x: np.ndarray, kernel: str | Kernel = "rbf", gamma: float | None = None, sigma: float | None = None) -> np.ndarray:
    """The whole matrix of one series."""
    if 8 * len(x) ** 2 > GRAM_BYTES:
        raise MemoryError(f"a Gram matrix of {len(x)} points exceeds the limit; use random features")
    out = np.asarray(kernel_function(kernel, x, gamma, sigma)(x, x), float)
    if callable(kernel):
        return validate_gram(out)
    if kernel == "rbf":
        np.fill_diagonal(out, 1.0)
    return out


def validate_gram(k: np.ndarray, tolerance: float = 1e-8) -> np.ndarray:
    if k.ndim != 2 or k.shape[0] != k.shape[1] or not np.isfinite(k).all() or not np.allclose(k, k.T, atol=tolerance) or (np.diag(k) < 0).any():
        raise ValueError("a kernel matrix is square, finite, symmetric, with a non-negative diagonal")
    if len(k) <= 512 and np.linalg.eigvalsh(k).min() < -tolerance * max(1.0, np.abs(k).max()):
        raise ValueError("a kernel matrix is positive semi-definite")
    return k


def median_heuristic(points: DataFrame, zero: bool = True) -> DataFrame:
    """series_id, gamma by the exact median of all squared distances, or of those above zero."""
    m = F.col("low") + F.col("share") * (F.col("high") - F.col("low"))
    found = pair_quantiles(points, [0.5], zero).select("series_id", F.when(m > 0, 1 / (2 * m)).alias("g"))
    return points.select("series_id").distinct().join(found, "series_id", "left").select("series_id", F.coalesce("g", F.lit(1.0)).alias("gamma"))


# --- segmentation -----------------------------------------------------------------


def kernel_partition(points: DataFrame, penalty: float, kernel: str | Kernel = "rbf", gamma: float | None = None, min_length: int = 1, jump: int = 1, longest: int | None = None) -> DataFrame:
    """Best penalised partition of vector series (series_id, t, x)."""

    def rows(series_id: str, x: np.ndarray) -> list[tuple]:
        cost = kernel_scatter(_wide(x), kernel, gamma)
        return seg.segment_rows(series_id, cost, len(x), *seg.optimal_partition(cost, len(x), penalty, min_length, jump, longest))

    return seg.by_series(points, rows, seg.SEGMENTS, "x")


def kernel_fixed(points: DataFrame, segments: int, kernel: str | Kernel = "rbf", gamma: float | None = None, min_length: int = 1, jump: int = 1) -> DataFrame:
    """Best partition into exactly that many segments; status says where they don't fit."""

    def rows(series_id: str, x: np.ndarray) -> list[tuple]:
        cost = kernel_scatter(_wide(x), kernel, gamma)
        found = seg.fixed_count(cost, len(x), segments, min_length, jump)
        if found is None:
            return [(series_id, 0, 0, len(x), None, None, "infeasible")]
        return seg.segment_rows(series_id, cost, len(x), *found)

    return seg.by_series(points, rows, seg.SEGMENTS, "x")


MODELS = "series_id string, m int, cost double, criterion double, selected boolean"


def kernel_select(points: DataFrame, most: int, beta: float = 1.0, kernel: str | Kernel = "rbf", gamma: float | None = None, min_length: int = 1) -> DataFrame:
    """cost of 1..most segments and cost + beta m ln(n); the first least one is selected."""

    def rows(series_id: str, x: np.ndarray) -> list[tuple]:
        n = len(x)
        least_costs = seg.fixed_counts(kernel_scatter(_wide(x), kernel, gamma), n, most, min_length)[0][1:, n].tolist()
        out = [(series_id, m, c, c + beta * m * math.log(max(2, n))) for m, c in enumerate(least_costs, 1) if math.isfinite(c)]
        least = min((r[3] for r in out), default=None)
        first = next((r[1] for r in out if r[3] == least), None)
        return [(*r, r[1] == first) for r in out]

    return seg.by_series(points, rows, MODELS, "x")


def _wide(x: np.ndarray) -> np.ndarray:
    return x.reshape(len(x), -1)


# --- random features ---------------------------------------------------------------


KINDS = ("gaussian", "orthogonal", "hadamard", "halton", "sobol", "latin", "compact")


def frequencies(dim: int, features: int, gamma: float, kind: str = "gaussian", seed: int = 123, radius: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(W dim x features, phases, weights) of an RBF kernel's random features; small, made once.

    gaussian; orthogonal, hadamard (blocks of orthogonal rows, by QR or by signed
    and shuffled Hadamard rows); halton, sobol, latin (low discrepancy points
    through the normal quantile; sobol is van der Corput's sequence in one prime base
    a dimension, with a random shift); compact (truncated).
    """
    if kind not in KINDS:
        raise ValueError(f"{kind}: not one of {', '.join(KINDS)}")
    rng = np.random.default_rng(seed)
    b, weight = rng.uniform(0, 2 * np.pi, features), np.ones(features)
    if kind == "orthogonal":
        blocks = []
        for _ in range(-(-features // dim)):
            q, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
            blocks.append(q * np.sqrt(rng.chisquare(dim, dim)))
        w = np.hstack(blocks)[:, :features]
    elif kind == "hadamard":
        width = 1 << max(6, (dim - 1).bit_length())  # wide enough for sums of signs to be about normal
        h = np.ones((1, 1))
        while len(h) < width:
            h = np.block([[h, h], [h, -h]])
        blocks = []
        for _ in range(-(-features // width)):
            q = np.eye(width)
            for _ in range(3):  # each a Hadamard matrix of signed columns
                q = (h * rng.choice([-1.0, 1.0], width) / math.sqrt(width)) @ q
            blocks.append(q[rng.permutation(width)][:, :dim].T * math.sqrt(width))
        w = np.hstack(blocks)[:, :features]
    elif kind in ("halton", "sobol", "latin"):
        if kind != "latin":
            u = np.column_stack([_radical(features, p) for p in _primes(dim)])
            if kind == "sobol":
                u = (u + rng.uniform(size=dim)) % 1
        else:
            u = np.column_stack([(rng.permutation(features) + rng.uniform(size=features)) / features for _ in range(dim)])
        quantile = np.vectorize(NormalDist().inv_cdf)
        w = quantile(np.clip(u, 1e-9, 1 - 1e-9)).T
    else:
        w = rng.normal(size=(dim, features))
        if kind == "compact":
            limit = 3 / radius / math.sqrt(2 * gamma)
            for _ in range(100):
                far = np.linalg.norm(w, axis=0) > limit
                if not far.any():
                    break
                w[:, far] = rng.normal(size=(dim, far.sum()))
            weight = np.maximum(0, 1 - np.linalg.norm(w, axis=0) * math.sqrt(2 * gamma) * radius / 3) ** 2
            weight = weight * features / max(weight.sum(), 1e-12)
    return w * math.sqrt(2 * gamma), b, weight


def _radical(n: int, base: int) -> np.ndarray:
    out, i, f = np.zeros(n), np.arange(1, n + 1), 1 / base
    while i.any():
        out += f * (i % base)
        i, f = i // base, f / base
    return out


def _primes(n: int) -> list[int]:
    found, k = [], 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def feature_map(x: np.ndarray, w: np.ndarray, b: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    z = np.sqrt(2 / w.shape[1]) * np.cos(x @ w + b)
    return z if weight is None else z * np.sqrt(weight)


def feature_column(x: Column, w: np.ndarray, b: np.ndarray) -> Column:
    """The same map in built-in functions, for a handful of features."""
    scale = math.sqrt(2 / w.shape[1])
    return F.array(*[scale * F.cos(dot(x, F.array(*[F.lit(float(v)) for v in w[:, k]])) + float(b[k])) for k in range(w.shape[1])])


def rff_partition(
    points: DataFrame, penalty: float, gamma: float | None = None, features: int | None = 256, kind: str = "gaussian", seed: int = 123,
    min_length: int = 1, segments: int | None = None, sigma: float | None = None, subsample: int = 2_000, given: tuple[np.ndarray, ...] | None = None,
) -> DataFrame:
    """Penalised (or fixed-count) partition in feature space: linear memory in a series' length.

    gamma comes before sigma; with neither, each series has its median heuristic over
    a draw of ``subsample`` points. features=None grows their number by the error. ``given``: the
    caller's own frequencies and phases, as feature_map takes them.
    """

    def rows(series_id: str, x: np.ndarray) -> list[tuple]:
        x = _wide(x)
        w = given
        if w is None:
            g = gamma if gamma is not None else 1 / (2 * sigma**2) if sigma is not None else median_gamma(x, seed, subsample)
            count = features if features is not None else adaptive_features(x, g, seed=seed, kind=kind)
            w = frequencies(x.shape[1], count, g, kind, seed)
        cost = seg.feature_cost(feature_map(x, *w))
        found = seg.optimal_partition(cost, len(x), penalty, min_length) if segments is None else seg.fixed_count(cost, len(x), segments, min_length)
        return [(series_id, 0, 0, len(x), None, None, "infeasible")] if found is None else seg.segment_rows(series_id, cost, len(x), *found)

    return seg.by_series(points, rows, seg.SEGMENTS, "x")


def compare_features(points: DataFrame, gamma: float, features: int = 256, kinds: tuple[str, ...] = KINDS, most: int = 300, seed: int = 123) -> DataFrame:
    """series_id, kind, mse, relative, worst, spectral: errors against the exact kernel.

    The errors of values are over all pairs of points, blocks of rows at a time. The
    spectral one is of a seeded draw of ``most`` points where a series has more.
    """

    def rows(series_id: str, x: np.ndarray) -> list[tuple]:
        x, out = _wide(x), []
        drawn = x if len(x) <= most else x[np.sort(np.random.default_rng(seed).permutation(len(x))[:most])]
        top = np.linalg.eigvalsh(gram(drawn, "rbf", gamma))[::-1][:50]
        k = kernel_function("rbf", x, gamma)
        for kind in kinds:
            w = frequencies(x.shape[1], features, gamma, kind, seed)
            z, total, size, worst = feature_map(x, *w), 0.0, 0.0, 0.0
            for a in range(0, len(x), TILE):
                exact = k(x[a : a + TILE], x)
                e = z[a : a + TILE] @ z.T - exact
                total, size, worst = total + float((e * e).sum()), size + float((exact * exact).sum()), max(worst, float(np.abs(e).max()))
            zd = feature_map(drawn, *w)
            spectral = np.linalg.norm(np.linalg.eigvalsh(zd @ zd.T)[::-1][:50] - top) / np.linalg.norm(top)
            out.append((series_id, kind, total / len(x) ** 2, math.sqrt(total / size), worst, float(spectral)))
        return out

    return seg.by_series(points, rows, "series_id string, kind string, mse double, relative double, worst double, spectral double", "x")


def adaptive_features(x: np.ndarray, gamma: float, tolerance: float = 1e-3, first: int = 256, last: int = 2048, patience: int = 3, seed: int = 123, kind: str = "gaussian") -> int:
    """The number of features, grown by half, at which the error on a sample meets the tolerance."""
    x = x[np.random.default_rng(seed).permutation(len(x))[:200]]
    exact, k, good = gram(x, "rbf", gamma), first, 0
    while True:
        z = feature_map(x, *frequencies(x.shape[1], k, gamma, kind, seed))
        good = good + 1 if ((z @ z.T - exact) ** 2).mean() < tolerance else 0
        if good >= patience or k >= last:
            return k
        k = min(last, int(k * 1.5))


# --- bandwidths --------------------------------------------------------------------


def candidate_sigmas(spark: SparkSession, low: float, high: float, n: int, log: bool = True, search: str = "grid", seed: int = 42) -> DataFrame:
    """sigma_id, sigma as rows, on a grid or at random places (``search``: grid, random)."""
    if search not in ("grid", "random"):
        raise ValueError(f"{search}: neither grid nor random")
    # a hash of the row, so that the draw is the same on any partitioning
    i = F.col("id") / max(1, n - 1) if search == "grid" else F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    sigma = F.exp(math.log(low) + i * (math.log(high) - math.log(low))) if log else low + i * (high - low)
    return spark.range(n).select(F.col("id").cast("int").alias("sigma_id"), sigma.alias("sigma"))


def adaptive_sigmas(medians: DataFrame, n: int) -> DataFrame:
    """series_id, sigma_id, sigma round each series' median (series_id, sigma): half coarse (0.1 to 10 medians), half fine (0.5 to 2)."""
    spark, coarse = medians.sparkSession, n // 2
    fine = candidate_sigmas(spark, 0.5, 2.0, n - coarse).withColumn("sigma_id", F.col("sigma_id") + coarse)
    factors = candidate_sigmas(spark, 0.1, 10.0, coarse).union(fine).withColumnRenamed("sigma", "factor")
    return medians.crossJoin(F.broadcast(factors)).select("series_id", "sigma_id", (F.col("sigma") * F.col("factor")).alias("sigma"))


def median_sigmas(points: DataFrame) -> DataFrame:
    """series_id, sigma: the exact median of the distances above zero, 1 where there is none."""
    low, high = F.sqrt("low"), F.sqrt("high")
    found = pair_quantiles(points, [0.5], zero=False).select("series_id", (low + F.col("share") * (high - low)).alias("m"))
    return points.select("series_id").distinct().join(found, "series_id", "left").select("series_id", F.coalesce("m", F.lit(1.0)).alias("sigma"))


def time_splits(n: int, folds: int) -> list[tuple[int, int]]:
    """(train end, test end): growing windows from 30 % with tests of 20 %."""
    test = max(1, n // 5)
    first = max(1, (3 * n) // 10)
    ends = np.linspace(first, n - test, folds).astype(int)
    return [(int(e), int(min(n, e + test))) for e in ends]


def fold_ids(n: int, folds: int, seed: int) -> np.ndarray:
    out = np.empty(n, int)
    for k, own in enumerate(np.array_split(np.random.default_rng(seed).permutation(n), folds)):
        out[own] = k
    return out


class HalfFactor:
    """The Cholesky factor L of a rbf kernel matrix with ``ridge`` on its diagonal, in the memory of half the matrix.

    ``rows`` are L's blocks of rows up to the diagonal, ``roots`` the inverses of its diagonal blocks. Blocks of the
    matrix are computed where they are needed, from points about their mean.
    """

    def __init__(self, x: np.ndarray, sigma: float, ridge: float, tile: int = HALF_TILE):
        x = x - x.mean(axis=0)
        self.n, self.tile, self.rows, self.roots = len(x), tile, [], []
        for a in range(0, self.n, tile):
            p = x[a : a + tile]
            row = np.empty((len(p), a))
            for b, upper, root in zip(range(0, a, tile), self.rows, self.roots):
                k = rbf(p, x[b : b + tile], sigma)
                k -= row[:, :b] @ upper.T
                np.matmul(k, root.T, out=row[:, b : b + tile])
            k = rbf(p, p, sigma)
            np.fill_diagonal(k, 1 + ridge)
            k -= row @ row.T
            self.roots.append(np.tril(np.linalg.inv(np.linalg.cholesky(k))))
            self.rows.append(row)

    def solve(self, y: np.ndarray) -> np.ndarray:
        y, starts = y.astype(float), range(0, self.n, self.tile)
        for row, root, a in zip(self.rows, self.roots, starts):
            y[a : a + self.tile] = root @ (y[a : a + self.tile] - row @ y[:a])
        for row, root, a in zip(self.rows[::-1], self.roots[::-1], starts[::-1]):
            y[a : a + self.tile] = root.T @ y[a : a + self.tile]
            y[:a] -= row.T @ y[a : a + self.tile]
        return y

    def inverse_diagonal(self) -> np.ndarray:
        """The diagonal of the matrix's inverse. The rows of L^-1 take the place of those of L, which is used up."""
        out = np.zeros(self.n)
        for i, a in enumerate(range(0, self.n, self.tile)):
            row, own = self.rows[i], np.zeros_like(self.rows[i])
            for upper, root, b in zip(self.rows[:i], self.roots, range(0, a, self.tile)):
                left = row[:, b : b + self.tile]
                own[:, :b] -= left @ upper
                own[:, b : b + self.tile] -= left @ root
            np.matmul(self.roots[i], own, out=row)
            out[:a] += np.einsum("ij,ij->j", row, row)
            out[a : a + self.tile] += np.einsum("ij,ij->j", self.roots[i], self.roots[i])
        return out


def rbf(x: np.ndarray, y: np.ndarray, sigma: float) -> np.ndarray:
    k = between(x, y)
    k /= -2 * sigma**2
    return np.exp(k, out=k)


def density_score(train: np.ndarray, test: np.ndarray, sigma: float) -> float:
    """Log density of test points under kernel weights K^-1 1 of the train points, less half ln trace."""
    ones = np.ones(len(train))
    try:
        w = HalfFactor(train, sigma, 1e-10).solve(ones)
    except np.linalg.LinAlgError:  # not positive definite by rounding, or not finite
        try:
            w = np.linalg.solve(gram(train, sigma=sigma) + 1e-10 * np.eye(len(train)), ones)
        except np.linalg.LinAlgError:
            return -math.inf
    w = np.abs(w) / max(np.abs(w).sum(), 1e-300)
    centre, total = train.mean(axis=0), 0.0
    for a in range(0, len(test), TILE):
        near = rbf(test[a : a + TILE] - centre, train - centre, sigma) @ w
        total += float(np.log(np.maximum(near, 1e-12)).sum())
    return total - 0.5 * math.log(len(train))  # the diagonal is 1


def changepoint_score(train: np.ndarray, test: np.ndarray, sigma: float) -> float:
    """Minus the penalised cost a point of the best partition of the test part; -inf if the train part has no finite one."""
    penalty = math.log(max(2, len(train)))
    fit = lambda x: seg.optimal_partition(kernel_scatter(x, "rbf", sigma=sigma), len(x), penalty, min(5, max(1, len(x))))
    if not math.isfinite(fit(train)[0]):
        return -math.inf
    _, cps = fit(test)
    n, cost, e = len(test), kernel_scatter(test, "rbf", sigma=sigma), [0, *cps, len(test)]
    return -sum(float(cost(np.array([a]), b)[0]) for a, b in zip(e, e[1:])) / n


Scorer = Callable[[np.ndarray, np.ndarray, float], float]
SCORERS: dict[str, Scorer] = {"density": density_score, "changepoint": changepoint_score}


def _tasks(points: DataFrame, sigmas: DataFrame) -> DataFrame:
    """points beside every candidate; candidates are of all series, or of one each if they have a series_id."""
    named = points.select(F.col("series_id").cast("string"), "t", "x")
    if "series_id" in sigmas.columns:
        return named.join(sigmas.withColumn("series_id", F.col("series_id").cast("string")), "series_id")
    return named.crossJoin(F.broadcast(sigmas))


def select_bandwidth(points: DataFrame, sigmas: DataFrame, folds: int = 5, method: str = "kfold", scoring: str | Scorer = "density", seed: int = 42) -> DataFrame:
    """series_id, sigma, score, selected: one task for each (series, sigma), folds averaged.

    The candidates are rows (sigma_id, sigma, and series_id if each series has its
    own), so the search spreads over tasks. scoring: a name, or a function of (train,
    test, sigma). The first best finite mean is selected; a series without one gets
    the median heuristic, with a null score.
    """
    score = scoring if callable(scoring) else SCORERS[scoring]
    if method not in ("kfold", "timeseries", "loo"):
        raise ValueError(f"{method}: not one of kfold, timeseries, loo")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        x, sigma = np.array(frame["x"].tolist(), float), float(frame["sigma"].iloc[0])
        x = x.reshape(len(x), -1)
        if method == "timeseries":
            parts = [(x[:a], x[a:b]) for a, b in time_splits(len(x), folds)]
        else:
            k = len(x) if method == "loo" else folds
            ids = np.arange(len(x)) if method == "loo" else fold_ids(len(x), k, seed)
            parts = [(x[ids != f], x[ids == f]) for f in range(k)]
        values = [score(a, b, sigma) for a, b in parts if len(a) and len(b)]
        return pd.DataFrame([(frame["series_id"].iloc[0], frame["sigma_id"].iloc[0], sigma, float(np.mean(values)) if values else -math.inf)], columns=["series_id", "sigma_id", "sigma", "score"])

    scored = _tasks(points, sigmas).groupBy("series_id", "sigma_id").applyInPandas(run, "series_id string, sigma_id int, sigma double, score double")
    # written, as each task is dear and the choice reads it twice
    scored = keep(scored, "bandwidths")
    fine = (F.abs("score") < float("inf")) & ~F.isnan("score")
    best = scored.groupBy("series_id").agg(F.max_by("sigma_id", F.when(fine, F.struct("score", -F.col("sigma_id")))).alias("best"), F.count_if(fine).alias("fine"))
    chosen = scored.join(best, "series_id").select("series_id", "sigma", "score", F.coalesce((F.col("fine") > 0) & (F.col("sigma_id") == F.col("best")), F.lit(False)).alias("selected"))
    none = best.where("fine = 0").select("series_id")
    if none.isEmpty():
        return chosen
    medians = median_sigmas(points.withColumn("series_id", F.col("series_id").cast("string")).join(none, "series_id"))
    return chosen.union(medians.select("series_id", "sigma", F.lit(None).cast("double"), F.lit(True)))


def select_bandwidth_simple(points: DataFrame, candidates: int = 20, folds: int = 5, **options) -> DataFrame:
    """select_bandwidth() over an adaptive grid round each series' median distance."""
    return select_bandwidth(points, adaptive_sigmas(median_sigmas(points), candidates), folds, **options)


def inverse_diagonals(points: DataFrame, sigmas: DataFrame, ridge: float = RIDGE, tile: int = TILE, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """series_id, sigma_id, sigma, n, logs, trace: of the diagonal of each rbf kernel matrix's inverse, the sum of its logs and its sum.

    The matrix, with ``ridge`` on its diagonal, is tiles as rows, its lower half. Sweeping a block of pivots changes each tile by
    the two tiles of the pivots' panel that lie in its row and column, so a sweep is two joins and a product a tile, and no task holds
    more than four tiles. After as many sweeps as blocks the tiles hold the inverse with its sign turned. Sweeps are written, which cuts lineage.
    Matrices go in waves of ``wave_bytes``, and a sweep is deleted when the next is written, so that disk holds two sweeps of a wave.
    """
    key = ["series_id", "sigma_id", "sigma"]
    own = points.select(F.col("series_id").cast("string"), F.col("t").cast("long").alias("t"), F.col("x").cast("array<double>").alias("x"))
    blocks = own.groupBy("series_id", F.floor(F.col("t") / tile).cast("int").alias("i")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda r: r["x"])).alias("p"), F.count("*").alias("size"))
    other = blocks.select(F.col("series_id").alias("_s"), F.col("i").alias("j"), F.col("p").alias("q"), F.col("size").alias("others"))
    grid = sigmas.withColumn("series_id", F.col("series_id").cast("string")) if "series_id" in sigmas.columns else None
    pairs = blocks.join(other, (F.col("series_id") == F.col("_s")) & (F.col("i") >= F.col("j"))).drop("_s")
    pairs = pairs.join(grid, "series_id") if grid is not None else pairs.crossJoin(F.broadcast(sigmas))
    # one row a matrix
    jobs = blocks.groupBy("series_id").agg(F.sum("size").cast("double").alias("n"))
    jobs = jobs.join(grid, "series_id") if grid is not None else jobs.crossJoin(F.broadcast(sigmas))
    before = Window.orderBy("series_id", "sigma_id").rowsBetween(Window.unboundedPreceding, -1)
    jobs = keep(jobs.select("series_id", "sigma_id", F.floor(F.coalesce(F.sum(4 * F.col("n") * F.col("n")).over(before), F.lit(0.0)) / wave_bytes).alias("wave")), "waves")
    here = ["series_id", "sigma_id"]

    def filled(batches):
        for frame in batches:
            out = []
            for p, m, q, n, i, j, sigma in zip(frame["p"], frame["size"], frame["q"], frame["others"], frame["i"], frame["j"], frame["sigma"]):
                k = np.exp(-between(np.asarray(p).reshape(m, -1), np.asarray(q).reshape(n, -1)) / (2 * sigma**2))
                if i == j:
                    np.fill_diagonal(k, 1 + ridge)
                out.append(k.tobytes())
            yield frame[[*key, "i", "j", "size", "others"]].assign(m=out)

    shape = "series_id string, sigma_id int, sigma double, i int, j int, size long, others long, m binary"

    def diagonal(batches):
        for frame in batches:
            d = [np.diag(-np.frombuffer(blob).reshape(n, n)) for blob, n in zip(frame["m"], frame["size"])]
            yield frame[[*key]].assign(n=[len(v) for v in d], logs=[float(np.log(np.maximum(v, 1e-12)).sum()) for v in d], trace=[float(v.sum()) for v in d])

    told = "series_id string, sigma_id int, sigma double, n long, logs double, trace double"
    out = [points.sparkSession.createDataFrame([], told)]
    for (wave,) in sorted(jobs.select("wave").distinct().collect()):
        inverse = _swept(keep(pairs.join(jobs.where(F.col("wave") == wave).drop("wave"), here, "left_semi").mapInPandas(filled, shape), "tiles"), key, shape)
        out.append(keep(inverse.where("i = j").mapInPandas(diagonal, told), "diagonals"))
        discard(inverse)
    found = functools.reduce(DataFrame.unionByName, out)
    return found.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("logs").alias("logs"), F.sum("trace").alias("trace"))


def _swept(now: DataFrame, key: list[str], shape: str) -> DataFrame:
    """Tiles (written by keep) after a sweep of each block of pivots; the tiles before are deleted."""
    here, last = key[:2], now.agg(F.max("i")).first()[0]
    for k in range(last + 1):

        def turned(batches):  # the panel: a tile of rows i and the pivots' columns
            for frame in batches:
                m = [blob if j == k else np.frombuffer(blob).reshape(a, b).T.tobytes() for blob, a, b, j in zip(frame["m"], frame["size"], frame["others"], frame["j"])]
                yield pd.DataFrame({"series_id": frame["series_id"], "sigma_id": frame["sigma_id"], "at": np.where(frame["j"] == k, frame["i"], frame["j"]), "c": m})

        panel = keep(now.where((F.col("i") == k) | (F.col("j") == k)).mapInPandas(turned, "series_id string, sigma_id int, at int, c binary"), "panel")
        side = lambda at, name: panel.select(*here, F.col("at").alias(at), F.col("c").alias(name))
        pivot = panel.where(F.col("at") == k).select(*here, F.col("c").alias("pivot"))

        def swept(batches):
            for frame in batches:
                out = []
                for blob, a, b, i, j, left, right, pivot in zip(frame["m"], frame["size"], frame["others"], frame["i"], frame["j"], frame["left"], frame["right"], frame["pivot"]):
                    inverse = np.linalg.inv(np.frombuffer(pivot).reshape(math.isqrt(len(pivot) // 8), -1))
                    c, d = np.frombuffer(left).reshape(a, -1), np.frombuffer(right).reshape(b, -1)
                    if i == k and j == k:
                        m = -inverse
                    elif j == k:
                        m = c @ inverse
                    elif i == k:
                        m = inverse @ d.T
                    else:
                        m = np.frombuffer(blob).reshape(a, b) - c @ inverse @ d.T
                    out.append(np.ascontiguousarray(m).tobytes())
                yield frame[[*key, "i", "j", "size", "others"]].assign(m=out)

        # series with fewer blocks than this are done, and stay as they are
        touched = now.join(side("i", "left"), [*here, "i"]).join(side("j", "right"), [*here, "j"]).join(pivot, here)
        done = now.join(pivot.select(*here), here, "left_anti")
        then = keep(touched.select(*key, "i", "j", "size", "others", "m", "left", "right", "pivot").mapInPandas(swept, shape).unionByName(done), "tiles")
        discard(now)
        discard(panel)
        now = then
    return now


def information_criterion(points: DataFrame, sigmas: DataFrame, kind: str = "bic", freedom: str = "kernel_ridge", long: int = math.isqrt(HALF_BYTES // 4), tile: int = TILE) -> DataFrame:
    """series_id, sigma, criterion, selected (the highest, the first on ties).

    The log likelihood of left-out points under a Gaussian process of that kernel,
    less its degrees of freedom: kernel_ridge (the trace of the smoother), eigenvalue
    (the same from its eigenvalues), n (as many as points). A task holds half a matrix. Series of over ``long`` points, whose
    half one task should not hold, go by tiles (inverse_diagonals).
    """
    if kind not in ("aic", "bic") or freedom not in ("kernel_ridge", "eigenvalue", "n"):
        raise ValueError(f"{kind}, {freedom}: aic or bic, and kernel_ridge, eigenvalue or n")
    sizes = points.groupBy(F.col("series_id").cast("string").alias("_s")).agg(F.count("*").alias("_n"))
    far = sizes.where(F.col("_n") > long).select("_s")
    named = points.withColumn("series_id", F.col("series_id").cast("string"))
    some = not far.isEmpty()
    if some:
        points = named.join(far, F.col("series_id") == F.col("_s"), "left_anti")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        x = np.array(frame["x"].tolist(), float).reshape(len(frame), -1)
        n, sigma = len(x), float(frame["sigma"].iloc[0])
        try:
            diagonal = HalfFactor(x, sigma, RIDGE).inverse_diagonal()
            loglik = -0.5 * float(np.log(2 * np.pi / np.maximum(diagonal, 1e-12)).sum())
            # the trace of K (K + r)^-1, from its eigenvalues too, is n - r trace of the inverse
            dof = float(n) if freedom == "n" else n - RIDGE * float(diagonal.sum())
            value = loglik - (0.5 * math.log(n) if kind == "bic" else 1.0) * dof
        except np.linalg.LinAlgError:
            value = -math.inf
        return pd.DataFrame([(frame["series_id"].iloc[0], frame["sigma_id"].iloc[0], sigma, value)], columns=["series_id", "sigma_id", "sigma", "criterion"])

    scored = _tasks(points, sigmas).groupBy("series_id", "sigma_id").applyInPandas(run, "series_id string, sigma_id int, sigma double, criterion double")
    if some:
        found = inverse_diagonals(named.join(far, F.col("series_id") == F.col("_s"), "left_semi"), sigmas, tile=tile)
        loglik = -0.5 * (F.col("n") * math.log(2 * math.pi) - F.col("logs"))
        dof = F.col("n").cast("double") if freedom == "n" else F.col("n") - RIDGE * F.col("trace")
        weight = 0.5 * F.log("n") if kind == "bic" else F.lit(1.0)
        scored = scored.unionByName(found.select("series_id", "sigma_id", "sigma", (loglik - weight * dof).alias("criterion")))
    scored = keep(scored, "criteria")
    best = scored.groupBy("series_id").agg(F.max_by("sigma_id", F.struct("criterion", -F.col("sigma_id"))).alias("best"))
    return scored.join(best, "series_id").select("series_id", "sigma", "criterion", (F.col("sigma_id") == F.col("best")).alias("selected"))


def bandwidth_stability(points: DataFrame, replicates: int = 20, share: float = 0.8, seed: int = 42) -> DataFrame:
    """series_id and mean, spread and quartiles of the median-heuristic sigma over bootstrap replicates (rows)."""
    spark = points.sparkSession

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        x = np.array(frame["x"].tolist(), float).reshape(len(frame), -1)
        rng = np.random.default_rng([seed, int(frame["replicate"].iloc[0])])
        own = x[rng.integers(0, len(x), max(2, int(share * len(x))))]
        d = np.sqrt(squared_distances(own)[np.triu_indices(len(own), 1)])
        d = d[d > 0]
        return pd.DataFrame([(frame["series_id"].iloc[0], float(np.median(d)) if len(d) else 1.0)], columns=["series_id", "sigma"])

    tasks = points.select(F.col("series_id").cast("string"), "t", "x").crossJoin(F.broadcast(spark.range(replicates).withColumnRenamed("id", "replicate")))
    drawn = tasks.groupBy("series_id", "replicate").applyInPandas(run, "series_id string, sigma double")
    return drawn.groupBy("series_id").agg(
        F.avg("sigma").alias("mean"), F.stddev_pop("sigma").alias("sd"), F.median("sigma").alias("median"),
        F.percentile("sigma", 0.25).alias("q25"), F.percentile("sigma", 0.75).alias("q75"), (F.stddev_pop("sigma") / F.avg("sigma")).alias("cv"),
    )


def multiscale_sigmas(points: DataFrame, scales: int = 5) -> DataFrame:
    """series_id, scale, sigma: percentiles from 10 to 90 of all distances above zero, exactly."""
    low, high = F.sqrt("low"), F.sqrt("high")
    found = pair_quantiles(points, [0.1 + 0.8 * i / max(1, scales - 1) for i in range(scales)], zero=False)
    return found.select("series_id", F.col("quantile").alias("scale"), (low + F.col("share") * (high - low)).alias("sigma"))


def multiscale_bandwidths(points: DataFrame, scales: int = 5, candidates: int = 15, base: str = "cv", **options) -> DataFrame:
    """series_id, scale, sigma: the selected bandwidth of a search from 0.2 to 5 times each scale; ``base``: cv or ic."""
    if base not in ("cv", "ic"):
        raise ValueError(f"{base}: neither cv nor ic")
    factors = candidate_sigmas(points.sparkSession, 0.2, 5.0, candidates).withColumnRenamed("sigma", "factor")
    # a scale of a series is searched like a series of its own
    own = keep(multiscale_sigmas(points, scales).withColumn("series_id", F.concat_ws("\x1f", F.col("series_id").cast("string"), "scale")), "scales")
    grid = own.crossJoin(F.broadcast(factors)).select("series_id", "sigma_id", (F.col("sigma") * F.col("factor")).alias("sigma"))
    keys = own.select(F.substring_index("series_id", "\x1f", 1).alias("_s"), F.col("series_id").alias("_key"))
    spread = points.select(F.col("series_id").cast("string").alias("_s"), "t", "x").join(keys, "_s").select(F.col("_key").alias("series_id"), "t", "x")
    found = (select_bandwidth if base == "cv" else information_criterion)(spread, grid, **options).where("selected")
    return found.select(F.substring_index("series_id", "\x1f", 1).alias("series_id"), F.substring_index("series_id", "\x1f", -1).cast("int").alias("scale"), "sigma")
