"""Exact penalised and fixed-count segmentation of many series at once.

Each series is one group: its costs come from prefix sums, and the recursion over
end points is one NumPy minimum a step. The earliest last boundary wins ties. For
short series ``fold_known_variance`` does the same recursion inside Catalyst.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftspark.functions.columns import LN_2PI

SEGMENTS = "series_id string, segment int, start long, stop long, cost double, score double, status string"

Cost = Callable[[np.ndarray, int], np.ndarray]  # starts, end -> cost of [start, end)


# --- costs of one series ------------------------------------------------------


def _sums(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(([0.0], np.cumsum(y))), np.concatenate(([0.0], np.cumsum(y * y)))


def known_variance(y: np.ndarray, sigma2: float = 1.0) -> Cost:
    s, q = _sums(y - y.mean() if len(y) else y)
    def cost(a, b):
        L = b - a
        return np.maximum(q[b] - q[a] - (s[b] - s[a]) ** 2 / L, 0) / sigma2 + L * (LN_2PI + math.log(sigma2))
    return cost


def unknown_variance(y: np.ndarray, eps: float = 1e-12) -> Cost:
    s, q = _sums(y - y.mean() if len(y) else y)
    def cost(a, b):
        L = b - a
        sse = np.maximum(np.maximum(q[b] - q[a] - (s[b] - s[a]) ** 2 / L, 0), eps)
        return np.where(L <= 1, np.inf, L * (LN_2PI + np.log(sse / L) + 1))
    return cost


def beta_binomial(y: np.ndarray, alpha: float = 1.0, beta: float = 1.0) -> Cost:
    s, _ = _sums(y)
    n = len(y)
    ga, gb, gab = (np.array([math.lgamma(k + p) for k in range(n + 1)]) for p in (alpha, beta, alpha + beta))
    prior = math.lgamma(alpha) + math.lgamma(beta) - math.lgamma(alpha + beta)
    def cost(a, b):
        hit = np.rint(s[b] - s[a]).astype(int)
        return prior - (ga[hit] + gb[b - a - hit] - gab[b - a])
    return cost


def gram_cost(gram: np.ndarray) -> Cost:
    """Within-segment scatter in a kernel's feature space, of a matrix that is there."""
    return kernel_cost(lambda rows, others: gram[np.ix_(rows, others)], len(gram))


#: Kernel values computed at a time.
KERNEL_CELLS = 1 << 20


class kernel_cost:  # noqa: N801  (a cost like the functions beside it)
    """The same without the square matrix: sums of every start's block grow with the end.

    kernel(rows, others) gives kernel values of positions. The sum over [a, b) is
    the sum over [a, b - 1) and twice the new row's values from a on, so memory is
    linear in a series' length when ends come in order. A segment that ends earlier is
    summed anew.
    """

    def __init__(self, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int):
        self.kernel, self.end = kernel, 0
        self.block, self.diagonal = np.zeros(n + 1), np.zeros(n + 1)

    def _grow(self, end: int) -> None:
        while self.end < end:
            width = max(1, min(end - self.end, KERNEL_CELLS // max(1, end)))
            rows = np.arange(self.end, self.end + width)
            values = self.kernel(rows, np.arange(rows[-1] + 1))
            for t, row in zip(rows.tolist(), values):
                own = float(row[t])
                self.block[: t + 1] += 2 * np.append(np.cumsum(row[:t][::-1])[::-1], 0) + own
                self.diagonal[t + 1] = self.diagonal[t] + own
            self.end += width

    def _inside(self, a: int, b: int) -> float:
        width = max(1, KERNEL_CELLS // max(1, b - a))
        return sum(float(self.kernel(np.arange(k, min(b, k + width)), np.arange(a, b)).sum()) for k in range(a, b, width))

    def __call__(self, a: np.ndarray, b: int) -> np.ndarray:
        self._grow(b)
        inside = self.block[a] if b == self.end else np.array([self._inside(k, b) for k in np.atleast_1d(a).tolist()])
        return self.diagonal[b] - self.diagonal[a] - inside / (b - a)


def feature_cost(z: np.ndarray) -> Cost:
    """The same for explicit features, without the square matrix."""
    s = np.vstack([np.zeros(z.shape[1]), z.cumsum(axis=0)])
    q = np.concatenate(([0.0], np.cumsum((z * z).sum(axis=1))))
    def cost(a, b):
        return q[b] - q[a] - ((s[b] - s[a]) ** 2).sum(axis=1) / (b - a)
    return cost


COSTS: dict[str, Callable[..., Cost]] = {"known_variance": known_variance, "unknown_variance": unknown_variance, "beta_binomial": beta_binomial}


# --- recursions ---------------------------------------------------------------


def optimal_partition(cost: Cost, n: int, penalty: float, min_length: int = 1, jump: int = 1, longest: int | None = None) -> tuple[float, list[int]]:
    """(least penalised cost, changepoints): sum of costs + penalty * changepoints.

    End points are jump, 2 jump, .. and n. If nothing fits, one segment.
    """
    if n == 0:
        return 0.0, []
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    best[0] = -penalty
    for t in sorted({*range(jump, n + 1, jump), n}):
        first = max(0, t - longest) if longest is not None else 0
        starts = first + np.flatnonzero(np.isfinite(best[first : max(first, t - min_length + 1)]))
        if len(starts):
            value = best[starts] + cost(starts, t) + penalty
            k = int(np.argmin(value))
            best[t], back[t] = value[k], starts[k]
    if not np.isfinite(best[n]):
        return float(cost(np.array([0]), n)[0]), []
    cps, t = [], n
    while back[t] > 0:
        t = int(back[t])
        cps.append(t)
    return float(best[n]), cps[::-1]


def fixed_counts(cost: Cost, n: int, most: int, min_length: int = 1, jump: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(least costs, last starts) of 0..most segments up to every end; each segment's cost is asked for once, ends in order."""
    ends = sorted({*range(jump, n + 1, jump), n})
    best, back = np.full((most + 1, n + 1), np.inf), np.zeros((most + 1, n + 1), np.int64)
    best[0, 0] = 0.0
    for t in ends:
        starts = np.flatnonzero(np.isfinite(best[:most, : max(0, t - min_length + 1)]).any(axis=0))
        if len(starts):
            value = best[:most, starts] + cost(starts, t)
            k = value.argmin(axis=1)
            least = value[np.arange(most), k]
            best[1:, t], back[1:, t] = least, np.where(np.isfinite(least), starts[k], 0)
    return best, back


def fixed_count(cost: Cost, n: int, count: int, min_length: int = 1, jump: int = 1) -> tuple[float, list[int]] | None:
    """(least cost, changepoints) of exactly ``count`` segments; None if they don't fit."""
    best, back = fixed_counts(cost, n, count, min_length, jump)
    if not np.isfinite(best[count, n]):
        return None
    cps, t = [], n
    for m in range(count, 1, -1):
        t = int(back[m, t])
        cps.append(t)
    return float(best[count, n]), cps[::-1]


def segment_rows(series_id: str, cost: Cost, n: int, score: float, cps: list[int], status: str = "ok") -> list[tuple]:
    e = [0, *cps, n]
    rows = []
    for i, (a, b) in enumerate(zip(e, e[1:])):
        own = float(cost(np.array([a]), b)[0])
        rows.append((series_id, i, a, b, own if math.isfinite(own) else None, score if math.isfinite(score) else None, status if math.isfinite(score) else "infinite cost"))
    return rows


def by_series(series: DataFrame, rows: Callable[[str, np.ndarray], list[tuple]], schema: str, value: str = "value") -> DataFrame:
    """rows(series_id, values in the order of t) for every series, one task a series."""
    names = [f.split()[0] for f in schema.split(", ")]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        found = rows(str(frame["series_id"].iloc[0]), np.array(frame["v"].tolist(), float))
        return pd.DataFrame(found, columns=names)

    return series.select(F.col("series_id").cast("string"), "t", F.col(value).alias("v")).groupBy("series_id").applyInPandas(one, schema)


def _maker(cost: str | Callable[..., Cost]) -> Callable[..., Cost]:
    """A cost by its name, or the caller's own: a function of one series' values (and options) that gives a Cost."""
    if callable(cost):
        return cost
    if cost not in COSTS:
        raise ValueError(f"{cost}: not one of {', '.join(COSTS)}; a function of a series' values is a cost too")
    return COSTS[cost]


def partition(series: DataFrame, cost: str | Callable[..., Cost] = "known_variance", penalty: float | str = "bic", min_length: int = 1, jump: int = 1, longest: int | None = None, value: str = "value", parameters: int | None = None, **options) -> DataFrame:
    """Segments of the best penalised partition of every series.

    cost: a name, or a function of a series' values (arrays, if ``value`` names an
    array column) that gives a Cost. penalty: a number for each changepoint, or bic /
    aic of a segment's ``parameters`` (known for the named costs, else 1).
    """
    make = _maker(cost)
    count = parameters if parameters is not None else {"unknown_variance": 2}.get(cost, 1) if isinstance(cost, str) else 1

    def rows(series_id: str, y: np.ndarray) -> list[tuple]:
        own, n = make(y, **options), len(y)
        p = {"bic": (count + 1) * math.log(max(2, n)), "aic": 2.0 * (count + 1)}.get(penalty, penalty)
        return segment_rows(series_id, own, n, *optimal_partition(own, n, p, min_length, jump, longest))

    return by_series(series, rows, SEGMENTS, value)


def concave_partition(series: DataFrame, slope: Callable[[int], float], cost: str | Callable[..., Cost] = "known_variance", min_length: int = 1, max_iter: int = 20, **options) -> DataFrame:
    """A concave penalty f of the changepoint count, by its slope at the last count until it repeats."""
    make = _maker(cost)

    def rows(series_id: str, y: np.ndarray) -> list[tuple]:
        own, n, count = make(y, **options), len(y), None
        for _ in range(max_iter):
            score, cps = optimal_partition(own, n, slope(max(1, count or 1)), min_length)
            if len(cps) == count:
                break
            count = len(cps)
        return segment_rows(series_id, own, n, score, cps)

    return by_series(series, rows, SEGMENTS)


def changepoints(found: DataFrame) -> DataFrame:
    """series_id, cp of segments."""
    return found.where("start > 0").select("series_id", F.col("start").alias("cp"))


# --- the recursion as one Catalyst fold ------------------------------------------


def fold_known_variance(values: Column, penalty: float, min_length: int = 1, sigma2: float = 1.0) -> Column:
    """struct(f, prev) of an array of numbers: for short series, no Python worker.

    f[k] is the least cost of the first k values (f[0] = -penalty), prev[k] the
    start of the last segment.
    """
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / n
    zero = F.array(F.lit(0.0))
    running = lambda f: F.aggregate(values, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + f(x - mean))))
    sums = F.struct(running(lambda z: z).alias("s"), running(lambda z: z * z).alias("q"))
    inf = float("inf")

    def step(acc: Column, t: Column) -> Column:
        def option(k: Column) -> Column:
            L = t - k
            d = F.get(acc["s"], t) - F.get(acc["s"], k)
            c = F.greatest(F.get(acc["q"], t) - F.get(acc["q"], k) - d * d / L, F.lit(0.0)) / sigma2 + L * (LN_2PI + math.log(sigma2))
            return F.struct((F.get(acc["f"], k) + c + penalty).alias("v"), k.alias("k"))

        best = F.array_min(F.transform(F.sequence(F.lit(0), t - min_length), option))
        short = t < min_length
        return F.struct(
            acc["s"].alias("s"), acc["q"].alias("q"),
            F.concat(acc["f"], F.array(F.when(short, inf).otherwise(best["v"]))).alias("f"),
            F.concat(acc["prev"], F.array(F.when(short, 0).otherwise(best["k"]))).alias("prev"),
        )

    start = F.struct(sums["s"].alias("s"), sums["q"].alias("q"), F.array(F.lit(-float(penalty))).alias("f"), F.array(F.lit(0)).alias("prev"))
    done = F.aggregate(F.sequence(F.lit(1), n), start, step)
    return F.struct(done["f"].alias("f"), done["prev"].alias("prev"))
