"""Kernel systems by half a matrix against the whole one, and what they hold."""

import math
import tracemalloc
from pathlib import Path

import numpy as np
import pytest

from shiftspark.operators import kernels


def dense(x, sigma, ridge):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    return np.exp(-d / (2 * sigma**2)) + ridge * np.eye(len(x))


def peak(call):
    tracemalloc.start()
    try:
        return call(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("n, tile", [(1, 8), (7, 8), (8, 8), (61, 8), (61, 64)])
def test_half_factor_equals_the_whole_matrix(n, tile):
    x = np.random.default_rng(n).normal(size=(n, 3)) + 50
    for sigma in (0.3, 1.5):
        k = dense(x, sigma, 1e-6)
        y = np.arange(n) - 2.5
        assert kernels.HalfFactor(x, sigma, 1e-6, tile).solve(y) == pytest.approx(np.linalg.solve(k, y), rel=1e-6, abs=1e-8)
        assert kernels.HalfFactor(x, sigma, 1e-6, tile).inverse_diagonal() == pytest.approx(np.diag(np.linalg.inv(k)), rel=1e-6)


def test_a_fold_is_scored_in_less_than_one_matrix():
    x = np.random.default_rng(3).normal(size=(2_400, 6))
    train, test = x[:1_800], x[1_800:]
    score, most = peak(lambda: kernels.density_score(train, test, 0.9))
    assert most < 8 * 1_800**2
    w = np.abs(np.linalg.solve(dense(train, 0.9, 1e-10), np.ones(1_800)))
    d = ((test[:, None, :] - train[None, :, :]) ** 2).sum(axis=2)
    want = np.log(np.maximum(np.exp(-d / (2 * 0.9**2)) @ (w / w.sum()), 1e-12)).sum() - 0.5 * math.log(1_800)
    assert score == pytest.approx(want, rel=1e-9)


def test_a_fold_with_copies_and_one_that_rounding_makes_indefinite_have_scores():
    x = np.repeat(np.random.default_rng(4).normal(size=(40, 2)), 10, axis=0)
    assert math.isfinite(kernels.density_score(x, x[::7], 1.0))
    assert math.isfinite(kernels.density_score(np.linspace(0, 1e-3, 600)[:, None], np.zeros((3, 1)), 1e6))


def test_tiles_go_in_waves_and_leave_no_sweep_behind(spark):
    x = {"a": np.random.default_rng(6).normal(size=(21, 2)), "b": np.random.default_rng(7).normal(size=(11, 2))}
    points = spark.createDataFrame([(s, i, v.tolist()) for s, p in x.items() for i, v in enumerate(p)], "series_id string, t long, x array<double>")
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    kept = lambda: {p.name for what in ("tiles", "panel") for p in shared.glob(f"{what}-*")}
    before = kept()
    rows = kernels.inverse_diagonals(points, kernels.candidate_sigmas(spark, 0.3, 0.9, 2), tile=8, wave_bytes=2_000).collect()
    assert kept() == before and len(rows) == 4
    for r in rows:
        d = np.diag(np.linalg.inv(dense(x[r.series_id], r.sigma, 1e-6)))
        assert r.n == len(d) and r.logs == pytest.approx(np.log(d).sum(), rel=1e-8) and r.trace == pytest.approx(d.sum(), rel=1e-8)
