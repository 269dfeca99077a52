"""Best paths by blocks against step-by-step ones, and shared models against plain EM."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shiftspark.operators import longpaths, pooled, statespace


def loglik(spark, series, parts=3):
    rows = [(k, t, [float(v) for v in row]) for k, ll in series.items() for t, row in enumerate(ll)]
    return spark.createDataFrame(rows, "series_id string, t long, loglik array<double>").repartition(parts)


def rounded(x):
    return np.where(np.isneginf(x), x, np.rint(np.where(np.isneginf(x), 0, x) / longpaths.QUANTUM) * longpaths.QUANTUM)


def by_series(df, *columns):
    frame = df.toPandas().sort_values(["series_id", "t"])
    return {k: [g[c].tolist() for c in columns] for k, g in frame.groupby("series_id")}


@pytest.mark.parametrize("block, fan", [(7, 3), (16, 2), (64, 256), (1, 4)])
def test_blocks_give_the_path_of_the_plain_recursion(spark, block, fan):
    rng = np.random.default_rng(block)
    series = {"long": rng.normal(size=(200, 3)) * 2, "ties": rng.integers(-2, 1, (150, 3)).astype(float), "one": np.zeros((1, 3)), "exact": rng.integers(-3, 1, (block * 4, 3)) / 2}
    series["impossible"] = np.where(rng.random((60, 3)) < 0.2, -np.inf, rng.normal(size=(60, 3)))
    for pi, a in (([0.5, 0.3, 0.2], [[0.8, 0.1, 0.1], [0.2, 0.6, 0.2], [0.3, 0.3, 0.4]]), ([1 / 3] * 3, [[0.5, 0.25, 0.25], [0.25, 0.5, 0.25], [0.25, 0.25, 0.5]])):
        got = by_series(longpaths.decode_hmm(loglik(spark, series), pi, a, block, fan), "t", "state")
        for k, ll in series.items():
            want = statespace.viterbi(rounded(ll), rounded(np.log(pi)), rounded(np.log(a)))
            assert got[k] == [list(range(len(ll))), want.tolist()], k


@pytest.mark.parametrize("block, fan, longest", [(5, 2, 4), (13, 256, 6), (40, 3, 1)])
def test_blocks_give_the_segments_of_the_plain_semi_markov_recursion(spark, block, fan, longest):
    rng = np.random.default_rng(block)
    series = {"long": rng.normal(size=(120, 2)) * 2, "ties": rng.integers(-1, 1, (90, 2)).astype(float), "short": rng.normal(size=(2, 2))}
    pi, a, rates = [0.6, 0.4], [[0, 1], [1, 0]], [2.0, 3.0]
    model = statespace.Hsmm(pi, a, rounded(statespace.duration_table("poisson", rates, longest)))
    model.log_pi, model.log_a = rounded(model.log_pi), rounded(model.log_a)
    got = by_series(longpaths.decode_hsmm(loglik(spark, series), pi, a, rates, longest, block=block, fan=fan), "state", "duration")
    for k, ll in series.items():
        states, marks, _ = model.viterbi(rounded(ll))
        assert got[k] == [states.tolist(), marks.tolist()], k


def test_long_paths_refuse_what_is_no_score_and_take_no_rows(spark):
    with pytest.raises(Exception, match="bounded size"):
        longpaths.decode_hmm(loglik(spark, {"a": [[0.0, float("nan")]]}), [0.5, 0.5], [[0.5, 0.5]] * 2).collect()
    none = spark.createDataFrame([], "series_id string, t long, loglik array<double>")
    assert longpaths.decode_hmm(none, [0.5, 0.5], [[0.5, 0.5]] * 2).collect() == []


# --- shared models ----------------------------------------------------------------


def plain_em(series, pi, a, rates, longest, rounds):
    trace = []
    for _ in range(rounds):
        model = statespace.Hsmm(pi, a, statespace.duration_table("poisson", rates, longest))
        first, moves, counts, z = (sum(x) for x in zip(*(model.expect(ll) for ll in series)))
        trace.append(z)
        pi, a = first / first.sum(), moves / moves.sum(axis=1, keepdims=True)
        rates = [statespace._poisson_rate(c, r) for c, r in zip(counts, rates)]
    return model, trace


def test_shared_semi_markov_model_equals_plain_em_and_never_falls(spark):
    rng = np.random.default_rng(3)
    series = {}
    for i in range(12):
        states = np.repeat(rng.integers(0, 3, 9), rng.poisson(3, 9) + 1)
        x = states + rng.normal(size=len(states)) * 0.5
        series[f"s{i}"] = -2 * (x[:, None] - np.arange(3)) ** 2
    series["one"] = np.zeros((1, 3))
    a = [[0, 0.5, 0.5], [0.5, 0, 0.5], [0.5, 0.5, 0]]
    rows = loglik(spark, series)
    model, rates, trace = pooled.fit_hsmm(rows, [0.4, 0.3, 0.3], a, [2.0, 2.0, 2.0], 8, iterations=6, tolerance=0)
    want, plain = plain_em(series.values(), [0.4, 0.3, 0.3], a, [2.0, 2.0, 2.0], 8, 6)
    assert trace == pytest.approx(plain) and all(b >= a - 1e-9 for a, b in zip(trace, trace[1:])) and trace[-1] > trace[0] + 1
    assert np.exp(model.log_a) == pytest.approx(np.exp(want.log_a)) and model.durations == pytest.approx(want.durations)
    got = by_series(pooled.decode_with(rows, model), "state", "duration")
    for k, ll in series.items():
        states, marks, _ = want.viterbi(ll)
        assert got[k] == [states.tolist(), marks.tolist()]
    some = [*series.values()]
    for cells in (1, 40, 10**6):
        for x, y in zip(pooled.expect_many(want, some, cells), (sum(v) for v in zip(*(want.expect(s) for s in some)))):
            assert x == pytest.approx(y)
    none = rows.where("false")
    assert pooled.fit_hsmm(none, [0.5, 0.5], [[0, 1], [1, 0]], [2.0, 2.0], 4)[2] == []


def compositions(spark, seed, states=2, n=8):
    rng, rows = np.random.default_rng(seed), []
    alphas = np.array([[8.0, 2.0, 1.0], [1.0, 3.0, 9.0]])
    for i in range(n):
        own = np.repeat(rng.integers(0, states, 5), rng.integers(3, 9, 5))
        for t, k in enumerate(own):
            rows.append((f"s{i}", t, rng.dirichlet(alphas[k]).tolist(), int(k)))
    return spark.createDataFrame(rows, "series_id string, t long, comp array<double>, truth int").repartition(4)


@pytest.mark.parametrize("components", [1, 2])
def test_shared_scaled_dirichlet_model_climbs_and_equals_a_single_task(spark, components):
    df = compositions(spark, components)
    alpha = np.repeat([[4.0, 2.0, 2.0], [2.0, 2.0, 4.0]], components, axis=0) * np.linspace(0.9, 1.1, 2 * components)[:, None]
    found = pooled.fit_sdhmm(df, 2, components, iterations=6, alpha=alpha, least=6)
    assert all(b >= a - 1e-9 * abs(a) for a, b in zip(found["trace"], found["trace"][1:])) and len(found["trace"]) == 6
    alone = pooled.fit_sdhmm(df.coalesce(1), 2, components, iterations=6, alpha=alpha, least=6)
    for k in ("alpha", "beta", "pi", "a", "eta", "trace"):
        assert np.asarray(found[k]) == pytest.approx(np.asarray(alone[k]), rel=1e-6)
    decoded = pooled.decode_sdhmm(df, found).toPandas()
    truth = df.select("series_id", "t", "truth").toPandas().merge(decoded, on=["series_id", "t"])
    right = (truth["truth"] == truth["state"]).mean()
    assert max(right, 1 - right) > 0.9 and set(decoded["component"]) <= set(range(components))


def test_shared_expectation_equals_that_of_each_series(spark):
    rng = np.random.default_rng(8)
    lls = [rng.normal(size=(n, 3)) for n in (1, 5, 9, 5)]
    pi, a = np.log([0.5, 0.3, 0.2]), np.log(rng.dirichlet(np.ones(3), 3))
    gammas, xi, z = pooled.forward_backward_many(lls, pi, a)
    each = [statespace.forward_backward(ll, pi, a) for ll in lls]
    assert xi == pytest.approx(sum(e[1] for e in each)) and z == pytest.approx(sum(e[2] for e in each))
    for g, e in zip(gammas, each):
        assert g == pytest.approx(e[0])


def test_shared_model_of_plain_start(spark):
    """Without given shapes, starts come from clusters of all points."""
    found = pooled.fit_sdhmm(compositions(spark, 5), 2, iterations=3)
    assert found["alpha"].shape == (2, 3) and abs(found["alpha"][0] - found["alpha"][1]).max() > 1
    with pytest.raises(ValueError):
        pooled.fit_sdhmm(compositions(spark, 5).where("false"), 2)
