"""The dispatcher, table functions and the command line."""

import numpy as np
import pytest

from shiftspark import cli
from shiftspark.plans.detect import METHODS, Detector, detect, register_table_functions


@pytest.fixture(scope="module")
def shifted(spark):
    rng = np.random.default_rng(0)
    rows = [(s, t, float(v)) for s in "ab" for t, v in enumerate(np.r_[rng.normal(0, 0.3, 20), rng.normal(4, 0.3, 20)])]
    return spark.createDataFrame(rows, "series_id string, t long, value double").cache()


@pytest.mark.parametrize("method, parameters", [
    ("partition", {"penalty": 10.0, "min_length": 3}), ("kernel", {"penalty": 3.0, "min_length": 3}), ("kernel_fixed", {"segments": 2}), ("rff", {"penalty": 3.0, "min_length": 3}),
    ("rff_fixed", {"segments": 2}), ("energy", {"min_size": 5, "replicates": 99, "max_levels": 1}), ("hsmm", {"mean_duration": 20.0, "learn": False}),
])
def test_methods_find_the_shift(shifted, method, parameters):
    got = detect(shifted, method, **parameters).collect()
    assert {(r.series_id, r.cp) for r in got} >= {("a", 20), ("b", 20)} and {r.boundary for r in got} == {"right_exclusive"}
    assert Detector(method, parameters).fit_predict(shifted).count() == len(got)


def test_online_and_periodic_methods(spark):
    bits = [(s, t, float(t % 12 >= 6)) for s in "ab" for t in range(120)]
    df = spark.createDataFrame(bits, "series_id string, t long, value double")
    got = detect(df, "within_period", period=12, min_length=2, chains=2, iterations=3000, burn=200).collect()
    assert {r.cp for r in got} == {5, 11} and {r.boundary for r in got} == {"periodic_bin_end"}
    runs = spark.createDataFrame([("a", t, float(t >= 40)) for t in range(80)], "series_id string, t long, value double")
    assert any(38 <= r.cp <= 43 for r in detect(runs, "bocpd", mean_run_length=20.0, threshold=None, reset=True).collect())
    with pytest.raises(ValueError):
        detect(df, "nothing")
    assert len(METHODS) == 11


def test_table_function(spark, shifted):
    register_table_functions(spark)
    shifted.createOrReplaceTempView("shifted")
    got = spark.sql("SELECT * FROM partition_segments(TABLE(SELECT * FROM shifted) PARTITION BY series_id ORDER BY (t), 'known_variance', 10.0)").collect()
    assert {(r.series_id, r.start, r.stop) for r in got} == {(s, a, b) for s in "ab" for a, b in ((0, 20), (20, 40))}


def test_command_line(spark, tmp_path):
    (tmp_path / "in.csv").write_text("count\n" + "\n".join(["0"] * 10 + ["9"] * 10) + "\n")
    cli.run(spark, ["partition", str(tmp_path / "in.csv"), str(tmp_path / "out"), "--column", "count", "--set", "penalty=5.0", "min_length=2"])
    assert [r.cp for r in spark.read.parquet(str(tmp_path / "out/changepoints")).collect()] == [10]
    (tmp_path / "ev.csv").write_text("ts\n" + "\n".join(f"2024-01-02 {h:02d}:05:00" for h in range(24)) + "\nbad\n")
    cli.run(spark, ["bocpd", str(tmp_path / "ev.csv"), str(tmp_path / "out2"), "--timestamp", "ts", "--bin-minutes", "60", "--set", "mean_run_length=10.0"])
    assert spark.read.parquet(str(tmp_path / "out2/changepoints")).count() >= 0


def test_commands_demo_hazards_and_saved_draws(spark, tmp_path):
    out = lambda name: str(tmp_path / name)
    cli.run(spark, ["within_period", "demo", out("wp"), "--days", "40", "--save-draws", "--set", "period=96", "min_length=4", "chains=1", "iterations=300", "burn=100"])
    cps = sorted(r.cp for r in spark.read.parquet(out("wp/changepoints")).collect())
    assert len(cps) >= 2 and all(0 <= c < 96 for c in cps)
    cli.run(spark, ["within_period", out("wp/draws"), out("again"), "--load"])
    assert sorted(r.cp for r in spark.read.parquet(out("again/changepoints")).collect()) == cps
    assert spark.read.option("header", True).csv(out("again/boundary_mass")).columns == ["series_id", "phase", "mass"]
    cli.run(spark, ["bocpd", "demo", out("steps"), "--days", "2", "--steps", "--boost-phases", "28,84", "--period", "96", "--boost-factor", "20", "--set", "threshold=0.05"])
    steps = {r.t: r for r in spark.read.parquet(out("steps/steps")).collect()}
    assert len(steps) == 192 and "is_cp" in spark.read.option("header", True).csv(out("steps/steps_csv")).columns
    # the hazard is raised at the phase: with no other evidence the change's probability is 20 times as high there
    assert steps[28].cp_prob > 3 * steps[27].cp_prob and steps[124].cp_prob > 3 * steps[123].cp_prob
    (tmp_path / "ev.csv").write_text("ts,v\n" + "".join(f"2024-01-0{1 + i // 24}T{i % 24:02d}:10:00,{i % 3}\n" for i in range(72)))
    cli.run(spark, ["bocpd", out("ev.csv"), out("ev"), "--timestamp", "ts", "--bin-minutes", "60", "--value-column", "v", "--value-threshold", "0.5", "--days-span", "2", "--schedule", "0.1,0.2", "--steps"])
    assert spark.read.parquet(out("ev/steps")).count() == 48
    with pytest.raises(SystemExit):
        cli.run(spark, ["partition", "demo", out("x"), "--steps"])
    with pytest.raises(ValueError):
        cli.run(spark, ["bocpd", "demo", out("x"), "--boost-phases", "3"])


def test_models_shared_by_all_series_through_the_dispatcher(spark):
    rows = [(f"s{i}", t, 5.0 * ((t // 8 + i) % 2) + ((t * 7 + i) % 5) / 10) for i in range(6) for t in range(48)]
    series = spark.createDataFrame(rows, "series_id string, t long, value double")
    found = detect(series, "hsmm", shared=True, mean_duration=6.0, longest=20, iterations=8)
    assert sorted(r.cp for r in found.where("series_id = 's1'").collect()) == [8, 16, 24, 32, 40]
