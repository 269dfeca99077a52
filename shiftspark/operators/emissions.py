"""Emission families as aggregates and expressions: diagonal and full Gaussians, autoregressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftspark.functions.columns import LN_2PI
from shiftspark.functions.frames import keep


def diag_loglik(x: Column, mean: Column, var: Column, floor: float = 1e-6) -> Column:
    """Sum of normal log densities over the dimensions that are there (null or NaN ones are left out)."""
    parts = F.arrays_zip(x.alias("x"), mean.alias("m"), var.alias("v"))

    def one(acc, p):
        v = F.greatest(p["v"], F.lit(floor))
        d = p["x"] - p["m"]
        return acc + F.when(p["x"].isNull() | F.isnan(p["x"]), 0.0).otherwise(-0.5 * (LN_2PI + F.log(v) + d * d / v))

    return F.aggregate(parts, F.lit(0.0), one)


def diag_from_labels(rows: DataFrame, label: str = "label", x: str = "x", floor: float = 1e-6, states: int | None = None) -> DataFrame:
    """label, dim, mean, var (population, floored): one aggregate over exploded dimensions.

    With ``states``, labels 0 to states - 1 are all there: one without a row gets those of all rows.
    """
    long = rows.select(label, F.posexplode(x).alias("dim", "v")).where(~F.isnan("v"))
    own = long.groupBy(label, "dim").agg(F.avg("v").alias("mean"), F.greatest(F.var_pop("v"), F.lit(floor)).alias("var"))
    if states is None:
        return own
    whole = long.groupBy("dim").agg(F.avg("v").alias("_mean"), F.greatest(F.var_pop("v"), F.lit(floor)).alias("_var"))
    every = rows.sparkSession.range(states).select(F.col("id").cast(dict(rows.dtypes)[label]).alias(label)).crossJoin(F.broadcast(whole))
    return every.join(own, [label, "dim"], "left").select(label, "dim", F.coalesce("mean", "_mean").alias("mean"), F.coalesce("var", "_var").alias("var"))


def diag_from_responsibilities(rows: DataFrame, x: str = "x", r: str = "r", floor: float = 1e-6) -> DataFrame:
    """state, dim, mean, var from weights (array r, normalised by row)."""
    total = F.aggregate(r, F.lit(0.0), lambda acc, v: acc + v)
    weighted = rows.select(F.col(x).alias("_x"), F.posexplode(F.transform(r, lambda v: v / total)).alias("state", "w"))
    long = weighted.select("state", "w", F.posexplode("_x").alias("dim", "v")).where(~F.isnan("v"))
    sums = long.groupBy("state", "dim").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("v")).alias("s1"), F.sum(F.col("w") * F.col("v") * F.col("v")).alias("s2"))
    mean = F.col("s1") / F.col("w")
    return sums.select("state", "dim", mean.alias("mean"), F.greatest(F.col("s2") / F.col("w") - mean * mean, F.lit(floor)).alias("var"))


def label_loglik(rows: DataFrame, parameters: DataFrame, key: list[str], label: str = "label", x: str = "x") -> DataFrame:
    """key columns and loglik: array over labels in order. The parameters are one small row a label."""
    wide = parameters.groupBy(label).agg(*[F.array_sort(F.collect_list(F.struct("dim", F.col(c).alias("v")))).alias(c) for c in ("mean", "var")])
    wide = wide.select(label, *[F.transform(c, lambda p: p["v"]).alias(c) for c in ("mean", "var")])
    one = F.broadcast(wide.agg(F.array_sort(F.collect_list(F.struct(label, "mean", "var"))).alias("states")))
    return rows.crossJoin(one).select(*key, F.transform("states", lambda s: diag_loglik(F.col(x), s["mean"], s["var"])).alias("loglik"))


def _outer(rows: DataFrame, group: list[str], weight: str, x: str) -> DataFrame:
    """group columns, i, j, w, si, sj, sij: sums over i <= j of weighted products.

    A worker adds up each Arrow batch's products as matrices and gives one array a
    group, so a vector of d dimensions is never d * d rows of a shuffle.
    """
    types = dict(rows.dtypes)

    def run(batches):
        for frame in batches:
            out = []
            for key, own in frame.groupby(group, dropna=False, sort=False):
                X, w = np.array(own["_x"].tolist(), float), own["_w"].to_numpy(float)
                out.append((*key, X.shape[1], float(w.sum()), (w @ X).tolist(), ((X * w[:, None]).T @ X).ravel().tolist()))
            yield pd.DataFrame(out, columns=[*group, "d", "w", "s", "ss"])

    sent = rows.select(*group, F.col(weight).cast("double").alias("_w"), F.col(x).cast("array<double>").alias("_x"))
    fields = ", ".join(f"{g} {types[g]}" for g in group)
    parts = sent.mapInPandas(run, f"{fields}, d int, w double, s array<double>, ss array<double>")
    totals = parts.select(*group, "d", "w", F.posexplode("ss").alias("at", "sij"), "s").select(
        *group, "w", F.expr("CAST(at div d AS INT)").alias("i"), F.expr("CAST(at % d AS INT)").alias("j"), "sij", F.expr("s[CAST(at div d AS INT)]").alias("si"), F.expr("s[CAST(at % d AS INT)]").alias("sj")
    )
    return totals.where("i <= j").groupBy(*group, "i", "j").agg(*[F.sum(c).alias(c) for c in ("w", "si", "sj", "sij")])


def full_from_labels(rows: DataFrame, label: str = "label", x: str = "x", ridge: float = 0.0) -> DataFrame:
    """label, i, j, cov (sample) of dimensions i <= j; rows are shifted by the means of all rows first, against cancellation."""
    sums = _outer(_centred(rows, x).withColumn("_one", F.lit(1.0)), [label], "_one", x)
    cov = (F.col("sij") - F.col("si") * F.col("sj") / F.col("w")) / F.when(F.col("w") > 1, F.col("w") - 1)
    return sums.select(label, "i", "j", (cov + F.when(F.col("i") == F.col("j"), ridge).otherwise(0.0)).alias("cov"))


def full_from_responsibilities(rows: DataFrame, x: str = "x", r: str = "r", ridge: float = 0.0) -> DataFrame:
    """state, i, j, cov (weighted, population) of dimensions i <= j from weights (array r, normalised by row)."""
    total = F.aggregate(r, F.lit(0.0), lambda acc, v: acc + v)
    spread = _centred(rows, x).select(F.col(x), F.posexplode(F.transform(r, lambda v: v / total)).alias("state", "w"))
    sums = _outer(spread, ["state"], "w", x)
    cov = F.col("sij") / F.col("w") - F.col("si") / F.col("w") * F.col("sj") / F.col("w")
    return sums.select("state", "i", "j", (cov + F.when(F.col("i") == F.col("j"), ridge).otherwise(0.0)).alias("cov"))


def _centred(rows: DataFrame, x: str) -> DataFrame:
    """rows with the mean of all rows taken off ``x``: covariances stay, sums of products lose less."""
    means = rows.select(F.posexplode(x).alias("dim", "v")).groupBy("dim").agg(F.avg("v").alias("m"))
    one = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda p: p["m"]).alias("_means"))
    return rows.crossJoin(F.broadcast(one)).withColumn(x, F.zip_with(F.col(x).cast("array<double>"), "_means", lambda v, m: v - m)).drop("_means")


@dataclass(frozen=True)
class FullGaussians:
    """Gaussians of full covariance, one a state: small parameters on the driver, rows in Spark."""

    means: dict[int, list[float]]
    covariances: dict[int, list[list[float]]]

    @classmethod
    def from_labels(cls, rows: DataFrame, label: str = "label", x: str = "x", ridge: float = 1e-6) -> FullGaussians:
        """Means and covariances of labelled rows: a label's numbers, whatever the rows."""
        means = {r[label]: r["m"] for r in diag_from_labels(rows, label, x).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda p: p["mean"]).alias("m")).collect()}
        d = len(next(iter(means.values()), []))
        covariances = {k: np.zeros((d, d)) for k in means}
        for r in full_from_labels(rows, label, x, ridge).collect():
            covariances[r[label]][r["i"], r["j"]] = covariances[r[label]][r["j"], r["i"]] = r["cov"] if r["cov"] is not None else float(r["i"] == r["j"])
        return cls(means, {k: v.tolist() for k, v in covariances.items()})

    @classmethod
    def from_kmeans(cls, rows: DataFrame, k: int, key: list[str], x: str = "x", ridge: float = 1e-6, seed: int = 0) -> FullGaussians:
        labelled = rows.join(kmeans(rows, k, key, x, seed), key)
        return cls.from_labels(labelled, "label", x, ridge)

    def loglik(self, rows: DataFrame, key: list[str], x: str = "x") -> DataFrame:
        return full_loglik(rows, self.means, self.covariances, key, x)

    def n_parameters(self) -> int:
        return sum(len(m) + len(m) * (len(m) + 1) // 2 for m in self.means.values())

    def sample(self, rows: DataFrame, state: str = "state", seed: int = 0) -> DataFrame:
        """rows with x drawn from each row's state; a row's draw hangs on its own columns alone."""
        roots = {}
        for k, cov in self.covariances.items():
            values, vectors = np.linalg.eigh(np.array(cov, float))
            roots[k] = vectors * np.sqrt(np.maximum(values, 0))
        means = {k: np.array(m, float) for k, m in self.means.items()}

        def run(batches):
            for frame in batches:
                drawn = [(means[k] + roots[k] @ np.random.default_rng([seed, h % (1 << 63)]).normal(size=len(means[k]))).tolist() for k, h in zip(frame[state], frame["_h"])]
                yield frame.drop(columns="_h").assign(x=drawn)

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        return rows.withColumn("_h", F.xxhash64(*rows.columns).bitwiseAND(F.lit((1 << 63) - 1))).mapInPandas(run, f"{fields}, x array<double>")


def full_loglik(rows: DataFrame, means: dict[int, list[float]], covariances: dict[int, list[list[float]]], key: list[str], x: str = "x", floor: float = 1e-9) -> DataFrame:
    """key and loglik array: Cholesky on the driver, then one triangular product a row.

    A row with a missing value tells nothing: 0 for every state.
    """
    parts = []
    for k in sorted(means):
        values, vectors = np.linalg.eigh(np.array(covariances[k], float))
        values = np.maximum(values, floor)
        root = (vectors / np.sqrt(values)).T
        parts.append((np.array(means[k], float), root, -0.5 * (len(values) * LN_2PI + float(np.log(values).sum()))))

    def run(batches):
        for frame in batches:
            X = np.array(frame["_x"].tolist(), float)
            out = np.column_stack([c - 0.5 * (((X - m) @ r.T) ** 2).sum(axis=1) for m, r, c in parts]) if len(frame) else np.zeros((0, len(parts)))
            out[np.isnan(out).any(axis=1)] = 0
            yield frame.drop(columns="_x").assign(loglik=list(out))

    kept = rows.select(*key, F.col(x).alias("_x"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*key).schema)
    return kept.mapInPandas(run, f"{fields}, loglik array<double>")


def ar_design(series: DataFrame, order: int, value: str = "value") -> DataFrame:
    """series_id, t, y, lags array (most recent first); the first ``order`` rows have no lags and are left out."""
    w = Window.partitionBy("series_id").orderBy("t")
    lags = [F.lag(value, k).over(w) for k in range(1, order + 1)]
    return series.select("series_id", "t", F.col(value).alias("y"), F.array(*lags).alias("lags")).where(F.size(F.filter("lags", lambda v: v.isNull())) == 0)


def ar_loglik(design: DataFrame, intercept: float, coefficients: list[float], variance: float) -> Column:
    fit = F.lit(float(intercept))
    for k, c in enumerate(coefficients):
        fit = fit + c * F.get("lags", k)
    e = F.col("y") - fit
    return -0.5 * (LN_2PI + math.log(variance) + e * e / variance)


def ar_from_labels(series: DataFrame, order: int, value: str = "value", label: str = "label", ridge: float = 1e-8) -> DataFrame:
    """label, intercept, coefficients, variance: ridge least squares on runs of one label.

    Gaps and islands number the runs, lags stay within one, and each label's
    normal equations are an aggregate; the small systems are solved per label.
    """
    w = Window.partitionBy("series_id").orderBy("t")
    runs = series.withColumn("fresh", F.coalesce((F.lag(label).over(w) != F.col(label)).cast("int"), F.lit(0))).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("series_id", "run").orderBy("t")
    row = F.array(F.lit(1.0), *[F.lag(value, k).over(own) for k in range(1, order + 1)])
    d = runs.select(label, F.col(value).cast("double").alias("y"), row.alias("z")).where(F.size(F.filter("z", lambda v: v.isNull())) == 0)
    n = order + 1
    sums = [F.sum(F.get("z", i) * F.get("z", j)).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(F.get("z", i) * F.col("y")).alias(f"b{i}") for i in range(n)]
    totals = d.groupBy(label).agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), *sums)

    return _solved(totals, label, dict(series.dtypes)[label], n, ridge)


def ar_from_responsibilities(series: DataFrame, order: int, value: str = "value", r: str = "r", ridge: float = 1e-8) -> DataFrame:
    """state, intercept, coefficients, variance: ridge least squares, each row weighted by its state's share (array r, normalised by row)."""
    w = Window.partitionBy("series_id").orderBy("t")
    row = F.array(F.lit(1.0), *[F.lag(value, k).over(w) for k in range(1, order + 1)])
    total = F.aggregate(r, F.lit(0.0), lambda acc, v: acc + v)
    d = series.select(F.col(value).cast("double").alias("y"), row.alias("z"), F.transform(r, lambda v: v / total).alias("r")).where(F.size(F.filter("z", lambda v: v.isNull())) == 0)
    d = d.select("y", "z", F.posexplode("r").alias("state", "w"))
    n = order + 1
    sums = [F.sum(F.col("w") * F.get("z", i) * F.get("z", j)).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(F.col("w") * F.get("z", i) * F.col("y")).alias(f"b{i}") for i in range(n)]
    totals = d.groupBy("state").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("yy"), *sums)
    return _solved(totals, "state", "int", n, ridge)


def _solved(totals: DataFrame, label: str, kind: str, n: int, ridge: float) -> DataFrame:
    """The small system of each label's normal equations."""

    def solve(batches):
        for frame in batches:
            out = []
            for r in frame.to_dict("records"):
                A = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
                b = np.array([r[f"b{i}"] for i in range(n)])
                c = np.linalg.solve(A + ridge * np.eye(n), b)
                out.append((r[label], float(c[0]), c[1:].tolist(), max(float(r["yy"] - 2 * c @ b + c @ A @ c) / r["n"], 1e-9)))
            yield pd.DataFrame(out, columns=[label, "intercept", "coefficients", "variance"])

    return totals.mapInPandas(solve, f"{label} {kind}, intercept double, coefficients array<double>, variance double")


def simulate_ar(states: DataFrame, intercepts: list[float], coefficients: list[list[float]], deviations: list[float], seed: int = 0) -> DataFrame:
    """series_id, t, state, value: an autoregression that follows each series' state path, its own seed a series."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        rng, past = np.random.default_rng([seed, *str(frame["series_id"].iloc[0]).encode()]), []
        for k in frame["state"].tolist():
            lags = sum(c * v for c, v in zip(coefficients[k], reversed(past)))
            past.append(intercepts[k] + lags + deviations[k] * rng.normal())
        return frame.assign(value=past)

    named = states.select(F.col("series_id").cast("string"), F.col("t").cast("long"), F.col("state").cast("int"))
    return named.groupBy("series_id").applyInPandas(run, "series_id string, t long, state int, value double")


def ar_parameters(states: int, order: int) -> int:
    """Free parameters of ``states`` autoregressions: intercept, coefficients and variance each."""
    return states * (order + 2)


#: Rounds of oversampling, and points drawn in each for every centre.
SEED_ROUNDS, OVERSAMPLE = 3, 4


def kmeans(rows: DataFrame, k: int, key: list[str], x: str = "x", seed: int = 0, iterations: int = 30, starts: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """key columns and label: Lloyd's steps over all rows, from oversampled seeds (k-means||).

    Seeding takes SEED_ROUNDS scans; each draws OVERSAMPLE k rows, with chances in proportion to the squared distance from
    those drawn before. A scan weighs the drawn rows by the rows nearest to them, and the best of several weighted k-means++
    starts among them goes on over all rows. A step there sends k
    centres to the workers and gets back one partial sum a partition, so it is one scan
    and an aggregate. A distance is over the dimensions that are there (null and NaN
    are not), times all by those there; a row without any is in cluster 0. A cluster
    that loses all rows starts again at the row farthest from its centre. Ties go to
    the first centre.
    """
    data = keep(rows.select(*key, F.transform(F.col(x).cast("array<double>"), lambda v: F.coalesce(v, F.lit(float("nan")))).alias("_x")).withColumn("_h", F.xxhash64(*key)), "points")
    if data.isEmpty():
        return data.select(*key, F.lit(0).alias("label"))
    seeds, weights = oversampled(data, k, seed)
    centres = min((_settled(lambda c: _sums(seeds, c, weights), _seeds(seeds, k, np.random.default_rng([seed, i]), weights), lambda c: seeds[_spans(seeds, c).min(axis=1).argmax()], iterations, tolerance) for i in range(starts)), key=lambda found: found[0])[1]
    centres = _settled(lambda c: _lloyd(data, c), centres, lambda c: _farthest(data, c), iterations, tolerance)[1]

    def label(batches):
        for frame in batches:
            X = np.array(frame["_x"].tolist(), float).reshape(len(frame), -1)
            yield frame.drop(columns=["_x", "_h"]).assign(label=_spans(X, centres).argmin(axis=1))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in data.select(*key).schema)
    return data.mapInPandas(label, f"{fields}, label int")


def _settled(step, centres: np.ndarray, lost, iterations: int, tolerance: float) -> tuple[float, np.ndarray]:
    """(inertia, centres) of Lloyd's steps until they gain no more."""
    last = math.inf
    for _ in range(iterations):
        counts, sums, inertia = step(centres)
        if math.isfinite(last) and last - inertia <= tolerance * max(1.0, abs(last)):
            break
        last, before = inertia, centres
        centres = np.where(counts > 0, sums / np.maximum(counts, 1e-300), centres)
        empty = np.flatnonzero(counts.sum(axis=1) == 0)
        if len(empty):
            far = lost(before)
            centres[empty] = np.where(np.isnan(far), centres[empty], far)
    return last, centres


def oversampled(data: DataFrame, k: int, seed: int = 0, rounds: int = SEED_ROUNDS, each: int = OVERSAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(1 + rounds x each x k points at most, how many rows of _x are nearest to each): seeds of k-means||.

    A round takes the rows of least e / d^2, with e exponential by the row's hash _h: a draw by weight, without
    replacement, of a fixed size. Dimensions that are missing are filled by their means.
    """
    first = np.array(data.agg(F.min_by("_x", "_h").alias("x")).first()["x"], float)[None]
    counts, sums, _ = _lloyd(data, np.zeros((1, first.shape[1])))
    means = np.where(counts[0] > 0, sums[0] / np.maximum(counts[0], 1), 0.0)
    filled = lambda found: np.where(np.isnan(found), means, found)
    seeds = filled(first)
    for r in range(rounds):

        def draw(batches, seeds=seeds, salt=np.uint64(seed * 1_000_003 + r + 1)):
            for frame in batches:
                if len(frame):
                    X = _points(frame)
                    h = (frame["_h"].to_numpy(np.int64).view(np.uint64) ^ (salt * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
                    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                    e = -np.log(((h >> np.uint64(11)).astype(float) + 1) / 2.0**53)
                    d = _spans(X, seeds).min(axis=1)
                    rank = np.where(d > 0, e / np.maximum(d, 1e-300), np.inf)
                    best = np.argsort(rank, kind="stable")[: each * k]
                    best = best[np.isfinite(rank[best])]
                    if len(best):
                        yield pd.DataFrame({"rank": rank[best], "x": [X[i].tolist() for i in best]})

        drawn = data.select("_x", "_h").mapInPandas(draw, "rank double, x array<double>").orderBy("rank", "x").limit(each * k).collect()
        if not drawn:
            break
        seeds = np.vstack([seeds, filled(np.array([r["x"] for r in drawn], float))])
    n = len(seeds)

    def nearest(batches):
        total = np.zeros(n)
        for frame in batches:
            if len(frame):
                total += np.bincount(_spans(_points(frame), seeds).argmin(axis=1), minlength=n)
        yield pd.DataFrame({"total": [total.tolist()]})

    weights = np.zeros(n)
    for r in data.select("_x").mapInPandas(nearest, "total array<double>").select(F.posexplode("total").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():
        weights[r["at"]] = r["v"]
    return seeds, weights


def _spans(X: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances over the dimensions that are there, scaled up to all."""
    there = ~np.isnan(X)
    filled = np.where(there, X, 0.0)
    d = (filled**2).sum(axis=1)[:, None] - 2 * filled @ centres.T + there.astype(float) @ (centres**2).T
    return np.maximum(d, 0) * (X.shape[1] / np.maximum(there.sum(axis=1), 1))[:, None]


def _spans_in_order(X: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """_spans() by differences, added in the order of dimensions, which rounds as a plain sum in SQL does."""
    out, there = np.zeros((len(X), len(centres))), ~np.isnan(X)
    for own, present, c in zip(X.T, there.T, centres.T):
        step = np.where(present, own, 0.0)[:, None] - np.where(present[:, None], c, 0.0)
        out += step * step
    return out * (X.shape[1] / np.maximum(there.sum(axis=1), 1))[:, None]


def _seeds(pool: np.ndarray, k: int, rng: np.random.Generator, weights: np.ndarray) -> np.ndarray:
    """k points by k-means++ among weighted ones."""
    centres = pool[[int(rng.choice(len(pool), p=weights / weights.sum()))]]
    while len(centres) < k:
        d = _spans(pool, centres).min(axis=1) * weights
        centres = np.vstack([centres, pool[rng.choice(len(pool), p=d / d.sum()) if d.sum() > 0 else int(rng.integers(len(pool)))]])
    return centres


def _sums(X: np.ndarray, centres: np.ndarray, weights: np.ndarray | None = None, spans=_spans) -> tuple[np.ndarray, np.ndarray, float]:
    """(counts and sums of each centre and dimension, inertia)"""
    counts, sums = np.zeros(centres.shape), np.zeros(centres.shape)
    own = spans(X, centres)
    at, there = own.argmin(axis=1), ~np.isnan(X)
    by = np.ones(len(X)) if weights is None else weights
    np.add.at(counts, at, there * by[:, None])
    np.add.at(sums, at, np.where(there, X, 0.0) * by[:, None])
    return counts, sums, float((own.min(axis=1) * by).sum())


def _points(frame: pd.DataFrame) -> np.ndarray:
    return np.array(frame["_x"].tolist(), float).reshape(len(frame), -1)


def _lloyd(data: DataFrame, centres: np.ndarray, spans=_spans) -> tuple[np.ndarray, np.ndarray, float]:
    """_sums() of all rows, in one scan and an aggregate of 2 k d + 1 numbers."""
    k, d = centres.shape

    def run(batches):
        total = np.zeros(2 * k * d + 1)
        for frame in batches:
            if len(frame):
                counts, sums, inertia = _sums(_points(frame), centres, spans=spans)
                total += np.concatenate([counts.ravel(), sums.ravel(), [inertia]])
        yield pd.DataFrame({"total": [total.tolist()]})

    parts = data.select("_x").mapInPandas(run, "total array<double>").select(F.posexplode("total").alias("at", "v"))
    got = np.zeros(2 * k * d + 1)
    for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect():
        got[r["at"]] = r["v"]
    return got[: k * d].reshape(k, d), got[k * d : -1].reshape(k, d), float(got[-1])


def kmeans_step(rows: DataFrame, centres: np.ndarray, x: str = "x") -> DataFrame:
    """cluster, dim, n, mean of the rows nearest to each given centre; a cluster or dimension without any keeps its centre.

    A row as near to two centres goes to the one that differences summed in the order of dimensions, as SQL sums them, put first.
    """
    data = rows.select(F.transform(F.col(x).cast("array<double>"), lambda v: F.coalesce(v, F.lit(float("nan")))).alias("_x"))
    counts, sums, _ = _lloyd(data, centres, _spans_in_order)
    means = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    k, d = centres.shape  # so many numbers, whatever the rows
    return rows.sparkSession.createDataFrame([(i, j, int(counts[i, j]), float(means[i, j])) for i in range(k) for j in range(d)], "cluster int, dim int, n long, mean double")


def _farthest(data: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The row farthest from its centre."""

    def run(batches):
        for frame in batches:
            if len(frame):
                X = _points(frame)
                least = _spans(X, centres).min(axis=1)
                yield pd.DataFrame({"span": [float(least.max())], "far": [X[int(least.argmax())].tolist()]})

    parts = data.select("_x").mapInPandas(run, "span double, far array<double>")
    return np.array(parts.agg(F.max_by("far", "span").alias("far")).first()["far"], float)
