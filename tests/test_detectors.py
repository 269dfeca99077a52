"""Golden numbers, exhaustive search on small series, and batch against stream."""

import itertools
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shiftspark.operators import bocpd, boundaries, emissions, energy, kernels, pairs, pointprocess, scoring, statespace, synthetic
from shiftspark.operators import periodic as wp
from shiftspark.operators import segmentation as seg
from shiftspark.plans import registry


def frame(spark, values, kind="double", sid="a"):
    cast = float if kind == "double" else bool
    return spark.createDataFrame([(sid, i, v if v is None else cast(v)) for i, v in enumerate(values)], f"series_id string, t long, value {kind}")


def test_known_and_unknown_variance_golden(spark):
    s = frame(spark, [0.0, 0, 0, 4, 4, 4])
    got = seg.partition(s, "known_variance", 1.0, 2).orderBy("start").collect()
    assert [(r.start, r.stop) for r in got] == [(0, 3), (3, 6)]
    assert got[0].score == pytest.approx(12.0272623985)
    got = seg.partition(s, "unknown_variance", 1.0, 2).collect()
    assert got[0].score == pytest.approx(-154.3505380291)


def test_fold_equals_grouped(spark):
    rng = np.random.default_rng(1)
    v = [float(x) for x in np.round(np.r_[rng.normal(0, 1, 20), rng.normal(3, 1, 15)], 2)]
    df = spark.createDataFrame([(v,)], "v array<double>").select(seg.fold_known_variance(F.col("v"), 2.0, 3).alias("d"))
    d = df.first()["d"]
    score, cps = seg.optimal_partition(seg.known_variance(np.array(v)), len(v), 2.0, 3)
    assert d["f"][-1] == pytest.approx(score)
    back, t = [], len(v)
    while d["prev"][t] > 0:
        t = d["prev"][t]
        back.append(t)
    assert back[::-1] == cps


@pytest.mark.parametrize("make", [seg.known_variance, seg.unknown_variance, seg.beta_binomial])
def test_partition_is_exhaustive_minimum(make):
    rng = np.random.default_rng(3)
    for n in range(2, 9):
        y = (rng.uniform(size=n) < 0.5).astype(float) if make is seg.beta_binomial else rng.normal(size=n)
        cost, penalty, least = make(y), 0.7, 2 if make is seg.unknown_variance else 1
        options = []
        for k in range(n):
            for cps in itertools.combinations(range(1, n), k):
                e = [0, *cps, n]
                if all(b - a >= least for a, b in zip(e, e[1:])):
                    options.append(sum(float(cost(np.array([a]), b)[0]) for a, b in zip(e, e[1:])) + penalty * k)
        if options:
            assert seg.optimal_partition(cost, n, penalty, least)[0] == pytest.approx(min(options))


def test_infinite_cost_is_a_status_and_empty_is_empty(spark):
    r = seg.partition(frame(spark, [1.0]), "unknown_variance", 1.0).first()
    assert r.status == "infinite cost" and r.score is None
    assert seg.partition(frame(spark, []), "known_variance", 1.0).count() == 0


def test_kernel_golden_and_fixed_counts(spark):
    p = spark.createDataFrame([("a", i, [float(v)]) for i, v in enumerate([0, 0, 2, 2])], "series_id string, t long, x array<double>")
    got = kernels.kernel_partition(p, 0.1, "linear").orderBy("start").collect()
    assert [(r.start, r.stop) for r in got] == [(0, 2), (2, 4)] and got[0].score == pytest.approx(0.1)
    assert [r.start for r in kernels.kernel_fixed(p, 2, "linear").orderBy("start").collect()] == [0, 2]
    assert kernels.kernel_fixed(p, 3, "linear", min_length=2).first().status == "infeasible"
    assert {r.m for r in kernels.kernel_select(p, 3, 1.0, "linear").where("selected").collect()} == {2}


def test_random_features_approach_the_kernel():
    x = np.random.default_rng(0).normal(size=(30, 3))
    exact = kernels.gram(x, "rbf", 0.3)
    for kind in ("gaussian", "orthogonal", "hadamard", "halton", "sobol", "latin"):
        z = kernels.feature_map(x, *kernels.frequencies(3, 2048, 0.3, kind))
        assert np.abs(z @ z.T - exact).max() < 0.12, kind
    with pytest.raises(ValueError):
        kernels.validate_gram(np.array([[1.0, 2], [2, 1]]))
    for call in (lambda: kernels.frequencies(3, 8, 0.3, "mersenne"), lambda: kernels.gram(x, "laplace"), lambda: kernels.select_bandwidth(None, None, method="x")):
        with pytest.raises(ValueError):
            call()


def test_kernel_costs_need_no_matrix(monkeypatch):
    x = np.random.default_rng(0).normal(size=(40, 2))
    k = kernels.gram(x, "rbf", 0.4)
    plain = lambda a, b: np.trace(k[a:b, a:b]) - k[a:b, a:b].sum() / (b - a)
    for cells in (30, 1 << 20):
        monkeypatch.setattr(seg, "KERNEL_CELLS", cells)
        cost = kernels.kernel_scatter(x, "rbf", 0.4)
        for b in (1, 2, 7, 8, 30, 40, 12):  # ends in order, then an earlier one
            assert np.allclose(cost(np.arange(b), b), [plain(a, b) for a in range(b)])


def test_fixed_counts_are_the_best_of_all():
    y = np.random.default_rng(3).normal(size=9)
    cost = seg.known_variance(y)
    for count in (1, 2, 3, 4):
        options = [sum(float(cost(np.array([a]), b)[0]) for a, b in zip((0, *c), (*c, 9))) for c in itertools.combinations(range(1, 9), count - 1) if all(b - a >= 2 for a, b in zip((0, *c), (*c, 9)))]
        assert seg.fixed_count(cost, 9, count, 2)[0] == pytest.approx(min(options))
    assert seg.fixed_count(cost, 9, 5, 2) is None


def test_own_costs_and_kernels(spark):
    values = frame(spark, [0.0, 0, 0, 0, 9, 9, 9, 9])

    def absolute(y):
        return lambda a, b: np.array([np.abs(y[i:b] - np.median(y[i:b])).sum() for i in a])

    assert [r.start for r in seg.partition(values, absolute, 1.0).orderBy("start").collect()] == [0, 4]
    with pytest.raises(ValueError):
        seg.partition(values, "huber", 1.0)
    p = values.select("series_id", "t", F.array("value").alias("x"))
    laplace = lambda a, b: np.exp(-np.abs(a[:, None, 0] - b[None, :, 0]))
    assert [r.start for r in kernels.kernel_partition(p, 0.5, laplace).orderBy("start").collect()] == [0, 4]
    with pytest.raises(Exception, match="symmetric"):
        kernels.kernel_partition(p, 0.5, lambda a, b: a - b.T + 2 * a).collect()


def test_bandwidth_choice_falls_back_and_takes_scorers(spark):
    x = np.random.default_rng(1).normal(size=(30, 2))
    p = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "series_id string, t long, x array<double>")
    grid = kernels.candidate_sigmas(spark, 0.5, 4.0, 4)
    best = kernels.select_bandwidth(p, grid, 3, scoring=lambda train, test, sigma: -abs(sigma - 2)).where("selected").first()
    assert best.sigma == pytest.approx(2.0)
    none = kernels.select_bandwidth(p, grid, 3, scoring=lambda train, test, sigma: -math.inf).where("selected").collect()
    median = np.median(np.sqrt(pairs.squared_distances(x)[np.triu_indices(30, 1)]))
    assert len(none) == 1 and none[0].sigma == pytest.approx(median) and none[0].score is None
    drawn = kernels.candidate_sigmas(spark, 0.5, 4.0, 6, search="random").collect()
    assert drawn == kernels.candidate_sigmas(spark, 0.5, 4.0, 6, search="random").repartition(3).orderBy("sigma_id").collect() and all(0.5 <= r.sigma <= 4 for r in drawn)
    for freedom in ("kernel_ridge", "eigenvalue", "n"):
        assert kernels.information_criterion(p, grid, "aic", freedom).where("selected").count() == 1
    many = kernels.multiscale_bandwidths(p, 2, 3, folds=3).collect()
    assert sorted(r.scale for r in many) == [0, 1] and {r.series_id for r in many} == {"a"}
    sd = kernels.bandwidth_stability(p, 5).first()
    assert sd.cv == pytest.approx(sd.sd / sd["mean"])


def test_pair_sums_by_tiles_equal_plain_ones(spark):
    x = np.random.default_rng(4).normal(size=(23, 2))
    p = spark.createDataFrame([(k, i, v.tolist()) for k in (1, 2) for i, v in enumerate(x)], "series_id int, t long, x array<double>")
    d = np.sqrt(pairs.squared_distances(x)) ** 1.5
    assert {r.own for r in pairs.tiles(p, 5).collect()} == {True, False}
    for r in pairs.pair_sums(p, 1.5).collect():
        assert r.ends == pytest.approx(d[: r.t, r.t].sum()) and r.begins == pytest.approx(d[r.t, r.t :].sum())


def test_energy_native_equals_matrix(spark):
    x = np.random.default_rng(2).normal(size=(14, 2))
    p = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "series_id string, t long, x array<double>")
    best = energy.best_split(energy.split_statistics(p), spark.createDataFrame([("a", 14)], "series_id string, n long"), 3).first()
    stat, split = energy.scan(energy.Distances(x), np.arange(14), 3)
    assert best.split == split and best.stat == pytest.approx(stat)


@pytest.mark.parametrize("kind", ["iid", "block", "circular"])
def test_energy_scans_without_a_matrix_and_resamples(monkeypatch, kind):
    x = np.random.default_rng(3).normal(size=(31, 2))
    order = energy.reorder(31, kind, np.random.default_rng(1), 4)
    assert len(order) == 31 and set(order) <= set(range(31)) and (kind == "circular" or sorted(order) == list(range(31)))
    kept = energy.scan(energy.Distances(x, 1.2), order, 4)
    d = np.sqrt(pairs.squared_distances(x[order])) ** 1.2
    stat = lambda k: k * (31 - k) / 31 * (2 * d[:k, k:].mean() - d[:k, :k].mean() - d[k:, k:].mean())
    assert kept[0] == pytest.approx(max(stat(k) for k in range(4, 28)))
    monkeypatch.setattr(energy, "DISTANCE_BYTES", 0)
    monkeypatch.setattr(energy, "CELLS", 100)
    assert energy.scan(energy.Distances(x, 1.2), order, 4)[0] == pytest.approx(kept[0], rel=1e-6)
    assert [energy.block_size(m) for m in (1, 2, 8, 1000)] == [1, 2, 3, 15]


def test_divisive_stops_at_a_number_of_changepoints(spark):
    p = spark.createDataFrame([(k, i, [10.0 ** (i // 5)]) for k in "ab" for i in range(40)], "series_id string, t long, x array<double>")
    found = energy.divisive(p, 5, 39, max_cps=3).where("accepted").groupBy("series_id").count().collect()
    assert {r.series_id: r["count"] for r in found} == {"a": 3, "b": 3}
    with pytest.raises(ValueError):
        energy.divisive(p, 5, 39, resampler="jackknife")


def test_divisive_goes_on_below_twelve_levels(spark):
    # every split takes the highest step off the rest
    p = spark.createDataFrame([("a", i, [10.0 ** (i // 5)]) for i in range(75)], "series_id string, t long, x array<double>")
    found = energy.divisive(p, 5, 39).where("accepted").select("cp", "level").collect()
    assert sorted(r.cp for r in found) == list(range(5, 75, 5))
    assert max(r.level for r in found) == 13


def test_divisive_finds_a_shift_and_strict_significance(spark):
    x = np.r_[np.zeros(15), np.full(15, 5.0)] + np.random.default_rng(0).normal(0, 0.1, 30)
    p = spark.createDataFrame([("a", i, [float(v)]) for i, v in enumerate(x)], "series_id string, t long, x array<double>")
    assert [r.cp for r in energy.divisive(p, 5, 99, max_levels=1).where("accepted").collect()] == [15]
    small = spark.createDataFrame([("a", i, [float(v)]) for i, v in enumerate([0] * 4 + [5] * 4)], "series_id string, t long, x array<double>")
    assert energy.divisive(small, 2, 9).where("accepted").count() == 0


GOLDEN_P = [0.25, 0.2, 0.1851851852, 0.4179566563, 0.2482705611, 0.2053855348]
GOLDEN_MEAN = [0.5, 0.3333333333, 0.2666666667, 0.2320987654, 0.5046439628, 0.6448153435]


def test_bocpd_golden(spark):
    d = bocpd.Detector(bocpd.BetaBernoulli(), bocpd.ConstantHazard(4), max_run_length=8)
    got = bocpd.detect(frame(spark, [0.0, 0, 0, 1, 1, 1]), d).orderBy("t").toPandas()
    assert np.allclose(got["cp_prob"], GOLDEN_P) and np.allclose(got["pred_mean"], GOLDEN_MEAN)
    assert got["map_run_length"].tolist() == [1, 2, 3, 0, 1, 2]
    got = bocpd.detect(frame(spark, [1.0, 0]), d).orderBy("t").toPandas()
    assert np.allclose(got["cp_prob"], [0.25, 1 / 3]) and np.allclose(got["log_evidence"], [math.log(0.5), math.log(0.375)])


def test_bocpd_missing_truncation_and_pruning():
    d = bocpd.Detector(bocpd.PoissonGamma(2.0, 1.0), bocpd.ConstantHazard(10), max_run_length=3)
    state, out = d.step(d.start(), None)
    assert out[3] == 0.0 and out[0] == pytest.approx(0.1) and state["a"].tolist() == [2.0, 2.0]
    for x in (3, 2, 4, 3, 5):
        state, out = d.step(state, x)
    assert len(state["R"]) == 4 and out[4] > 0 and state["R"].sum() == pytest.approx(1)
    pruned = bocpd.Detector(bocpd.BetaBernoulli(), bocpd.ConstantHazard(10), top_k=2)
    state = pruned.start()
    for x in (0, 0, 0, 1):
        state, out = pruned.step(state, x)
    assert (state["R"] > 0).sum() <= 3
    with pytest.raises(ValueError):
        d.step(d.start(), 1.5)
    state, out = d.step(d.start(), 1_000_000)  # far out, still finite
    assert math.isfinite(out[3])


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    from shiftspark.streaming.online import detect_stream

    values = [0.0, 0, 0, 1, None, 1, 0, 1]
    d = bocpd.Detector(bocpd.BetaBernoulli(), bocpd.ConstantHazard(4), max_run_length=8)
    batch = bocpd.detect(frame(spark, values), d).orderBy("t").toPandas()
    for part, rows in enumerate((values[:3], values[3:])):
        first = 0 if part == 0 else 3
        pdf = spark.createDataFrame([("a", first + i, v if v is None else float(v)) for i, v in enumerate(rows)], "series_id string, t long, value double")
        pdf.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("series_id string, t long, value double").parquet(str(tmp_path / "in"))
        q = detect_stream(stream, d).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("t").toPandas()
    pd.testing.assert_frame_equal(got, batch)


def test_alert_rules(spark):
    rows = [("a", i, p, m) for i, (p, m) in enumerate([(0.9, 0), (0.1, 1), (0.7, 0), (0.7, 1), (0.2, 2), (0.8, 0)])]
    o = spark.createDataFrame(rows, "series_id string, t long, cp_prob double, map_run_length int")
    at = lambda **k: sorted(r.t for r in bocpd.alerts(o, **k).collect())
    assert at(threshold=0.6) == [0, 3, 5]
    assert at(threshold=0.6, min_spacing=4) == [0, 5]
    assert at(threshold=None, reset=True) == [2, 5] and at(threshold=None) == []


def test_circular_states_and_detailed_balance(spark):
    taus = {tuple(r.tau) for r in wp.valid_taus(spark, 6, 2).collect()}
    target = wp.Target(np.array([1, 2, 3, 0, 1, 4]), np.array([5] * 6), 2, 1.0)
    every = {t for k in range(4) for t in itertools.combinations(range(6), k) if target.valid(t)}
    assert taus - {t for t in taus if len(t) == 1} == every
    assert len([t for t in every if len(t) == 2]) == 9
    for t in every:
        law = target.proposal(t)
        assert sum(law.values()) == pytest.approx(1)
        assert all(t in target.proposal(u) for u in law)


def test_chain_meets_the_exact_posterior(spark):
    bits = frame(spark, [bool(b) for b in [0, 1, 1, 0, 0, 1] * 6], "boolean")
    counts = wp.phase_counts(bits, 6)
    exact = {tuple(r.tau): r.probability for r in wp.exact_posterior(counts, wp.valid_taus(spark, 6, 2).where("size(tau) <> 1"), 6, 2).collect()}
    assert sum(exact.values()) == pytest.approx(1)
    target = wp.Target(*(np.array(x) for x in ([0, 6, 6, 0, 0, 6], [6] * 6)), 2, 1.0)
    logs = {t: target.log(t) for t in exact}
    z = math.log(sum(math.exp(v) for v in logs.values()))
    assert all(exact[t] == pytest.approx(math.exp(logs[t] - z)) for t in exact)
    draws = wp.sample(counts, 6, 2, chains=2, iterations=4000, burn=500, thin=2)
    seen = {tuple(r.tau): r.probability for r in wp.tau_frequencies(draws).collect()}
    assert max(abs(seen.get(t, 0) - p) for t, p in exact.items()) < 0.07


def test_spline_intensity_and_cut(spark):
    b = pointprocess.basis(np.linspace(0, 2, 9), 5, 2, 2.0)
    assert np.allclose(b.sum(axis=1), 1)
    B, w = pointprocess.design([(0.0, 2.0)], 1, 0, 2.0)
    weights, cost = pointprocess.fit_intensity(B, w, np.array([6.0]))
    assert weights[0] == pytest.approx(math.log(3)) and cost == pytest.approx(2 * (6 - 6 * math.log(3)))
    days = spark.range(12).select(F.lit("a").alias("series_id"), F.col("id").alias("t"))
    made = pointprocess.simulate_periods(days, 24.0, 3.0, lambda t, h: np.full(len(h), 0.3 if t < 6 else 2.5))
    assert [r.start for r in pointprocess.sliced_poisson(made, 24.0, 4, 2).orderBy("start").collect()] == [0, 6]


def test_hsmm_golden_and_em(spark):
    d = statespace.poisson_durations(2.0, 3)
    assert np.allclose(d, [-0.980829253, -0.980829253, -1.3862943611])
    ll = np.array([[-0.5 * (x - m) ** 2 / 0.2 for m in (0, 1)] for x in (0, 0, 1, 1)])
    states, marks, _ = statespace.Hsmm([1, 0], [[0, 1], [1, 0]], np.array([d, d])).viterbi(ll)
    assert states.tolist() == [0, 0, 1, 1] and marks.tolist() == [0, 2, 0, 2]
    rng = np.random.default_rng(0)
    path = np.repeat([0, 1] * 10, rng.poisson(4, 20) + 1)
    ll = np.array([[-0.5 * (y - m) ** 2 for m in (0, 3)] for y in path * 3 + rng.normal(size=len(path))])
    _, rates, trace = statespace.fit_hsmm(ll, [0.5, 0.5], [[0, 1], [1, 0]], [2.0, 9.0], 15)
    assert all(b >= a - 1e-6 for a, b in zip(trace, trace[1:])) and all(2.5 < r < 7.5 for r in rates)


def test_negative_binomial_durations_by_moments():
    d = statespace.negative_binomial_durations(3.0, 0.4, 30)
    assert np.exp(d).sum() == pytest.approx(1)
    r, p = statespace._negative_binomial_moments(1000 * np.exp(statespace.negative_binomial_durations(9.0, 0.5, 200)), (1.0, 0.5))
    assert r == pytest.approx(9, rel=0.1) and p == pytest.approx(0.5, rel=0.1)
    rng = np.random.default_rng(1)
    path = np.repeat([0, 1] * 12, rng.poisson(5, 24) + 1)
    ll = np.array([[-0.5 * (y - m) ** 2 for m in (0, 3)] for y in path * 3 + rng.normal(size=len(path))])
    _, found, trace = statespace.fit_hsmm(ll, [0.5, 0.5], [[0, 1], [1, 0]], [(2.0, 0.5), (2.0, 0.5)], 20, 15, family="negative_binomial")
    assert trace[-1] > trace[0] and all(2 < r * p / (1 - p) < 9 for r, p in found)
    with pytest.raises(ValueError):
        statespace.duration_table("geometric", [1.0], 5)


def test_compositions_are_checked_and_components_found(spark):
    bad = spark.createDataFrame([("a", 0, [0.0, 0.0]), ("a", 1, [0.5, 0.5])], "series_id string, t long, comp array<double>")
    with pytest.raises(Exception, match="composition"):
        statespace.decode_sdhmm(bad, 2).collect()
    rng = np.random.default_rng(0)
    x = np.vstack([rng.dirichlet([30, 3, 3], 20), rng.dirichlet([3, 30, 3], 20), rng.dirichlet([3, 3, 60], 40)])
    rows = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "series_id string, t long, comp array<double>")
    found = statespace.decode_sdhmm(rows, 2, components=2, iterations=40).orderBy("t").collect()
    assert len({r.state for r in found[42:]}) == 1 and all(r.component in (0, 1) for r in found)
    fit = statespace.fit_sdhmm(x, 2, 2, 40, mixing=0.5, shape=2.0, rate=0.01)
    assert fit["eta"].sum() == pytest.approx(4 * 0.5 + 80, rel=1e-6)


def test_kmeans_seeds_are_as_good_as_many_plain_starts(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(9, 3)) * 6
    x = np.concatenate([c + rng.normal(size=(n, 3)) for c, n in zip(centres, [300, 200, 150, 100, 60, 40, 20, 12, 8])])
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "t long, x array<double>").repartition(5)
    seeds, weights = emissions.oversampled(df.select(F.col("x").alias("_x"), F.xxhash64("t").alias("_h")), 9)
    assert len(seeds) == 1 + 3 * 36 and weights.sum() == len(x)
    labels = np.array([r.label for r in emissions.kmeans(df, 9, ["t"]).orderBy("t").collect()])
    inertia = sum(((x[labels == j] - x[labels == j].mean(axis=0)) ** 2).sum() for j in set(labels))
    ones = np.ones(len(x))
    plain = [emissions._settled(lambda c: emissions._sums(x, c), emissions._seeds(x, 9, np.random.default_rng(i), ones), lambda c: x[0], 30, 1e-6)[0] for i in range(10)]
    assert inertia <= 1.05 * min(plain)


def test_kmeans_with_holes_and_lost_clusters(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(m, 0.1, (30, 2)) for m in (0, 5, 10)])
    rows = [(i, [None if i % 11 == 0 else float(v[0]), float(v[1])]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "t long, x array<double>")
    got = [r.label for r in emissions.kmeans(df, 3, ["t"]).orderBy("t").collect()]
    assert all(len(set(got[a : a + 30])) == 1 for a in (0, 30, 60)) and len(set(got)) == 3
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)], "t long, x array<double>")
    assert emissions.kmeans(same, 3, ["t"]).count() == 5 and emissions.kmeans(same.where("false"), 2, ["t"]).count() == 0


def test_expected_counts_that_end_on_half_a_digit_are_not_shifted():
    """A mean over 64, 128 or 256 of a run length that is all but certain, beside its exact value."""
    detector = bocpd.Detector(bocpd.PoissonGamma(), bocpd.ConstantHazard(48), max_run_length=8192)
    for seed in range(6):
        counts, state = np.random.default_rng(seed).poisson(270, 256), detector.start()
        for n, x in enumerate(counts, 1):
            state, out = detector.step(state, float(x))
            if n in (64, 128, 256):
                assert out[2] == (1 + counts[: n - 1].sum()) / n


def test_kmeans_step_takes_ties_as_its_sql_does(spark, tmp_path):
    """Rows exactly as far from their two nearest centres, in units of 1e-8."""
    rng, rows = np.random.default_rng(1), []
    j, i = np.arange(4)[:, None], np.arange(64)[None, :]
    c = (i * 3 + j * 5) % 7 - 3
    while len(rows) < 400:
        m = np.round(rng.normal(size=64) / 8 * 1e4).astype(int)
        a, b = np.argsort(((m - 500 * c) ** 2).sum(axis=1))[:2]
        gap, step = divmod(int(((m - 500 * c[b]) ** 2).sum() - ((m - 500 * c[a]) ** 2).sum()), 1000), c[b] - c[a]
        at = np.flatnonzero(np.where(step == 0, False, gap[0] % np.where(step == 0, 1, step) == 0))
        if gap[1] or not len(at):
            continue
        m[at[0]] += gap[0] // step[at[0]]
        d = np.sort(((m - 500 * c) ** 2).sum(axis=1))
        if d[0] == d[1]:
            rows.append((len(rows), (m / 1e4).tolist(), len(rows) % 10))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duck.sql(registry.ORACLE_SQL["kmeans_step"]).fetchall()
    assert sorted(map(tuple, registry.QUERIES["kmeans_step"](spark, str(tmp_path)).collect())) == sorted(want)


def test_full_gaussians(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.multivariate_normal([0, 0], [[1, 0.5], [0.5, 2]], 200), rng.multivariate_normal([4, 4], [[1, 0], [0, 1]], 200)])
    df = spark.createDataFrame([(i, i // 200, v.tolist()) for i, v in enumerate(x)], "t long, label int, x array<double>")
    model = emissions.FullGaussians.from_labels(df, ridge=0.0)
    assert np.allclose(model.covariances[0], np.cov(x[:200].T)) and np.allclose(model.means[1], x[200:].mean(axis=0)) and model.n_parameters() == 10
    own = [r.loglik for r in model.loglik(df, ["t"]).orderBy("t").collect()]
    assert np.mean([v[0] > v[1] for v in own[:200]]) > 0.95
    drawn = model.sample(df.select("t", F.col("label").alias("state"))).orderBy("t").collect()
    assert np.allclose(np.mean([r.x for r in drawn[200:]], axis=0), model.means[1], atol=0.3)
    assert drawn == model.sample(df.select("t", F.col("label").alias("state")).repartition(3)).orderBy("t").collect()
    filled = emissions.diag_from_labels(df, states=3).where("label = 2").orderBy("dim").collect()
    assert [r["mean"] for r in filled] == pytest.approx(x.mean(axis=0).tolist())


def test_weighted_and_simulated_autoregressions(spark):
    states = spark.range(600).select(F.lit("a").alias("series_id"), F.col("id").alias("t"), F.expr("CAST(id div 300 AS INT)").alias("state"))
    made = emissions.simulate_ar(states, [0.0, 3.0], [[0.6], [0.1]], [1.0, 0.3])
    r = F.array((F.col("state") == 0).cast("double"), (F.col("state") == 1).cast("double"))
    found = {x.state: x for x in emissions.ar_from_responsibilities(made.withColumn("r", r), 1).collect()}
    assert found[0].coefficients[0] == pytest.approx(0.6, abs=0.15) and found[1].intercept == pytest.approx(3.0, abs=0.5)
    assert emissions.ar_parameters(2, 1) == 6


def test_valid_taus_are_counted_first(spark):
    for period, least in ((8, 2), (9, 3), (7, 1)):
        assert wp.count_taus(period, least) == wp.valid_taus(spark, period, least).count()
    with pytest.raises(ValueError):
        wp.valid_taus(spark, 96, 4)


def test_segment_summaries_and_scenarios(spark):
    bits = synthetic.periodic_scenarios(spark, ["paper_monte_carlo_n24", "no_change"])
    counts = wp.phase_counts(bits.where("series_id = 'paper_monte_carlo_n24'"), 24)
    found = wp.segment_summaries(wp.sample(counts, 24, 4, chains=1, iterations=600, burn=200), counts, 24).collect()
    assert sum(r.n for r in found) == 24 * 30 and all(r.lower < r["mean"] < r.upper for r in found)
    assert bits.where("series_id = 'no_change'").count() == 96 * 35
    assert synthetic.probability_grid(4, (0, 2), (0.1, 0.9)) == [0.1, 0.9, 0.9, 0.1]
    assert synthetic.any_of(synthetic.sensor_home(spark, 2)).count() == 192
    ess = wp.indicator_effective_size(wp.sample(counts, 24, 4, chains=1, iterations=400, burn=100), 7).first().ess
    assert ess > 0


def test_periods_are_checked_and_simulated_with_their_changepoints(spark):
    made, cps = pointprocess.simulate_segments(spark, 2, [8, 8], [0.3, 3.0], 24.0)
    found = pointprocess.sliced_poisson(made, 24.0, 1, 0)
    assert {(r.series_id, r.start) for r in found.where("start > 0").collect()} == {(r.series_id, r.cp) for r in cps.collect()}
    outside = made.withColumn("event_times", F.array(F.lit(25.0)))
    with pytest.raises(Exception, match="exposure"):
        pointprocess.sliced_poisson(outside, 24.0, 1, 0).collect()


def test_run_lengths_and_pipelines_of_detectors(spark):
    d = bocpd.Detector(bocpd.BetaBernoulli(), bocpd.ConstantHazard(4), max_run_length=8)
    values = frame(spark, [0.0, 0, 0, 1, 1, 1])
    steps = bocpd.run_lengths(values, d).groupBy("t").agg(F.sum("probability").alias("p"), F.max_by("run_length", "probability").alias("r")).orderBy("t").collect()
    assert [r.p for r in steps] == pytest.approx([1.0] * 6) and [r.r for r in steps] == [1, 2, 3, 0, 1, 2]
    few = bocpd.run_lengths(values, bocpd.Detector(bocpd.BetaBernoulli(), bocpd.ConstantHazard(4), 8, epsilon=0.3))
    assert few.groupBy("t").count().agg(F.max("count")).first()[0] <= 3
    w = frame(spark, [0.0] * 10 + [8.0] * 10 + [4.0] * 10)
    coarse = seg.partition(w, "known_variance", 400.0, 5)
    fine = lambda s: seg.changepoints(seg.partition(s, "known_variance", 10.0, 3))
    assert sorted(r.cp for r in scoring.two_stage(w, coarse, fine).collect()) == [10, 20]
    assert scoring.retuned_run_lengths(seg.partition(w, "known_variance", 10.0, 3), 100.0).first().mean_run_length == pytest.approx(82.0)


def test_hmm_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    ll, pi, a = rng.normal(size=(6, 2)), np.log([0.6, 0.4]), np.log([[0.7, 0.3], [0.4, 0.6]])
    def value(p):
        return pi[p[0]] + ll[0, p[0]] + sum(a[u, v] + ll[t + 1, v] for t, (u, v) in enumerate(zip(p, p[1:])))
    best = max(itertools.product(range(2), repeat=6), key=value)
    assert tuple(statespace.viterbi(ll, pi, a)) == best
    gamma, xi, z = statespace.forward_backward(ll, pi, a)
    assert z == pytest.approx(math.log(sum(math.exp(value(p)) for p in itertools.product(range(2), repeat=6))))
    assert np.allclose(gamma.sum(axis=1), 1) and xi.sum() == pytest.approx(5)


def test_sdhmm_separates_two_regimes():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.dirichlet([20, 2, 2], 40), rng.dirichlet([2, 2, 20], 40)])
    for parts in (1, 2):
        fit = statespace.fit_sdhmm(x, 2, parts, 30)
        s = fit["states"]
        assert (s[:40] == s[0]).mean() > 0.9 and (s[40:] == 1 - s[0]).mean() > 0.9


def test_scores_and_protocol(spark):
    one = lambda v: spark.createDataFrame([("a", x) for x in v], "series_id string, cp long")
    r = scoring.score(one([8, 11]), one([10, 13]), 2).first()
    assert (r.tp, r.fp, r.fn, r.f1) == (2, 0, 0, 1.0)
    r = scoring.score(one([5, 6]), one([5]), 1).first()
    assert (r.tp, r.fp, r.fn) == (1, 1, 0)
    reg = scoring.Registry()
    reg.register("x", lambda: lambda df: df)
    with pytest.raises(ValueError):
        reg.register("x", lambda: None)
    assert reg.names() == ["x"] and list(reg.build()) == ["x"]


def test_synthetic_is_seeded_and_partition_free(spark):
    a = synthetic.gaussian_segments(spark, 3, [5, 5], [0.0, 1.0], [1.0, 1.0], 0.4, seed=7)
    b = synthetic.gaussian_segments(spark, 3, [5, 5], [0.0, 1.0], [1.0, 1.0], 0.4, seed=7).repartition(3)
    key = ["series_id", "t"]
    assert a.orderBy(*key).collect() == b.orderBy(*key).collect()
    c, d = (synthetic.contaminate(x, 0.5, 3.0).orderBy(*key).collect() for x in (a, b))
    assert c == d


def test_boundary_round_trip(spark):
    for n in range(2, 6):
        for k in range(n):
            for cps in itertools.combinations(range(1, n), k):
                got = [0, *cps, n]
                df = spark.createDataFrame([(list(cps), n)], "c array<bigint>, n long") if k == 1 else None
                if df is not None:
                    e = df.select(boundaries.edges(F.col("c"), F.col("n")).alias("e"))
                    assert e.first().e == got
                    assert e.select(boundaries.edges_to_changepoints(F.col("e")).alias("c")).first().c == list(cps)
