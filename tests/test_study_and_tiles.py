"""The study of within-period changepoints, and kernel criteria by tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftspark.operators import kernels, periodic, study
from shiftspark.sources.series import write_study


@pytest.mark.parametrize("kind, freedom", [("bic", "kernel_ridge"), ("aic", "eigenvalue"), ("bic", "n")])
def test_criterion_by_tiles_equals_the_dense_form(spark, kind, freedom):
    rng = np.random.default_rng(1)
    series = {"a": rng.normal(size=(37, 2)), "b": rng.normal(size=(24, 2)), "short": rng.normal(size=(9, 2))}
    points = spark.createDataFrame([(k, i, v.tolist()) for k, x in series.items() for i, v in enumerate(x)], "series_id string, t long, x array<double>")
    grid = kernels.candidate_sigmas(spark, 0.2, 0.9, 3)
    values = lambda **o: {(r.series_id, round(r.sigma, 6)): (r.criterion, r.selected) for r in kernels.information_criterion(points, grid, kind, freedom, **o).collect()}
    dense, tiled = values(), values(long=10, tile=8)
    assert dense.keys() == tiled.keys() and len(dense) == 9
    for k, (criterion, selected) in dense.items():
        assert tiled[k][0] == pytest.approx(criterion, rel=1e-6) and tiled[k][1] == selected


def home(spark):
    rng = np.random.default_rng(4)
    rates = np.array([0.35, 0.35, 0.35, 0.65, 0.65, 0.65])
    bits = [("day", t, bool(rng.random() < rates[t % 6])) for t in range(6 * 40)] + [("flat", t, bool(rng.random() < 0.4)) for t in range(6 * 40)]
    counts = periodic.phase_counts(spark.createDataFrame(bits, "series_id string, t long, value boolean"), 6)
    scenarios = spark.createDataFrame([("day", 6, 2), ("flat", 6, 2)], "series_id string, period int, min_length int")
    return counts, scenarios


def test_study_is_resumed_by_job_and_agrees_with_exact_posteriors(spark, tmp_path):
    counts, scenarios = home(spark)
    profile = study.Profile("small", 3_000, 500, 5, 3, 100, (0.5, 2.0), 7)
    path = str(tmp_path / "draws")
    jobs = study.job_table(scenarios, profile)
    assert jobs.count() == 2 * 2 * 3
    # a study that was stopped after some jobs
    study.run_jobs(counts, jobs.where("chain = 1 and rate = 2.0"), profile).write.parquet(path)
    before = {r.chain: r.log_post for r in spark.read.parquet(path).where("series_id = 'day' and draw = 0").collect()}
    draws = study.run_study(counts, scenarios, profile, path, wave=4)
    assert draws.groupBy("series_id", "rate", "chain").count().count() == 12 and draws.count() == 12 * 500
    assert before[1] == draws.where("series_id = 'day' and draw = 0 and chain = 1 and rate = 2.0").first().log_post
    files = sorted(p.name for p in (tmp_path / "draws").glob("*.parquet"))
    assert study.run_study(counts, scenarios, profile, path).count() == 12 * 500
    assert sorted(p.name for p in (tmp_path / "draws").glob("*.parquet")) == files  # nothing was run again
    alone = study.run_jobs(counts, jobs, profile)
    assert draws.exceptAll(alone).isEmpty()
    truth = spark.createDataFrame([("day", [2, 5]), ("flat", [])], "series_id string, tau array<int>")
    fits = {(r.series_id, r.rate): r for r in study.fits(draws, truth).collect()}
    assert fits["day", 0.5].mode_tau == [2, 5] and fits["day", 0.5].truth_probability > 0.2 and fits["flat", 0.5].truth_probability > 0.3
    assert all(r.samples == 1500 and 0 < r.acceptance < 1 and r.r_hat < 1.2 and r.ess > 30 for r in fits.values())
    for r in study.exact_checks(draws, counts, scenarios, profile).collect():
        assert r.status == "evaluated" and r.l1_error < 0.25 and r.state_count == periodic.count_taus(6, 2)
        if r.series_id == "day":
            assert r.exact_mode == [2, 5]
    tables = study.study_tables(counts, scenarios, profile, truth, path)
    write_study(tables, {"profile": profile.name}, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "fits")).count() == 4
    assert tables["segments"].groupBy("series_id", "rate").agg(F.sum("probability").alias("p")).where("abs(p - 1) > 1e-9").isEmpty() and tables["masses"].where("mass > 1").isEmpty()


def test_study_skips_large_state_spaces_and_takes_no_scenarios(spark):
    counts, scenarios = home(spark)
    tiny = study.Profile("tiny", 60, 20, 10, 2, 1, (1.0,), 7)
    draws = study.run_study(counts, scenarios, tiny)
    assert {r.status for r in study.exact_checks(draws, counts, scenarios, tiny).collect()} == {"skipped"}
    none = study.run_study(counts, scenarios.where("false"), tiny)
    assert none.count() == 0 and study.exact_checks(none, counts, scenarios.where("false"), tiny).count() == 0
