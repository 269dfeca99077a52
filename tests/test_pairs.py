"""Exact order statistics of pair distances, by counting over tiles and within a task."""

import numpy as np
import pytest

from shiftspark.operators import kernels, pairs


def points(spark, **series):
    rows = [(name, i, np.atleast_1d(v).tolist()) for name, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, t long, x array<double>")


def plain(x, zero=True):
    d = np.concatenate([((x[i] - x[i + 1 :]) ** 2).sum(axis=1) for i in range(len(x))])
    return d if zero else d[d > 0]


def quantiles(df):
    return {(r.series_id, r["quantile"]): r.low + r.share * (r.high - r.low) for r in df.collect()}


@pytest.mark.parametrize("few", [0, 40, 50_000])
def test_quantiles_equal_all_pairs(spark, few):
    rng = np.random.default_rng(1)
    series = {
        "normal": rng.normal(size=(61, 3)), "ties": rng.integers(0, 3, (50, 2)).astype(float), "same": np.ones((20, 2)), "two": np.array([[0.0], [3.0]]),
        "wide": 10.0 ** rng.integers(-150, 150, (40, 1)), "one": np.zeros((1, 2)),
    }
    at = [0.0, 0.1, 0.5, 0.9, 1.0]
    for zero in (True, False):
        got = quantiles(pairs.pair_quantiles(points(spark, **series), at, zero, few, 16))
        want = {(k, i): float(np.quantile(plain(x, zero), a)) for k, x in series.items() if len(plain(x, zero)) for i, a in enumerate(at)}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k], rel=1e-12), k


def test_medians_of_long_series_are_exact_on_both_paths(spark):
    rng = np.random.default_rng(2)
    long = np.concatenate([rng.normal(size=(2_000, 4)), np.repeat(rng.normal(size=(1, 4)), 1_000, axis=0)])
    series = {"long": long, "short": rng.normal(size=(1_500, 2)), "single": np.zeros((1, 2))}
    got = {r.series_id: r.gamma for r in kernels.median_heuristic(points(spark, **series)).collect()}
    for k, x in series.items():
        m = float(np.median(plain(x))) if len(x) > 1 else 0
        assert got[k] == pytest.approx(1 / (2 * m) if m else 1.0, rel=1e-12)
        assert kernels.median_gamma(x) == pytest.approx(got[k], rel=1e-12)
    above = {r.series_id: r.sigma for r in kernels.median_sigmas(points(spark, **series)).collect()}
    assert above["long"] == pytest.approx(float(np.median(np.sqrt(plain(long, zero=False)))), rel=1e-12) and above["single"] == 1.0
    assert pairs.pair_median(long, few=1_000) == float(np.median(plain(long)))


def test_medians_within_a_task_by_counting():
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=(70, 2)), rng.integers(0, 2, (60, 2)).astype(float), np.ones((30, 1)), np.array([[1.0], [2.0]])):
        for few in (0, 10, 10_000):
            assert pairs.pair_median(x, few, 16) == pytest.approx(float(np.median(plain(x))), rel=1e-12)
    assert np.isnan(pairs.pair_median(np.zeros((1, 1))))


def test_no_points(spark):
    none = spark.createDataFrame([], "series_id string, t long, x array<double>")
    assert pairs.pair_quantiles(none, [0.5]).count() == 0 and kernels.median_heuristic(none).count() == 0
