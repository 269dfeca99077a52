"""Reading, binning, checks and result files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shiftspark.functions import checks
from shiftspark.functions import columns as col
from shiftspark.sources import series as src


def test_read_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("when,x,y\n1,1.5,2\n2,bad,3\n3,2.5,4\n4,3.5,5\n")
    got = src.read_csv(spark, str(path), timestamp="when").orderBy("row").collect()
    assert [(r.when, r.x, r.y) for r in got] == [("1", 1.5, 2.0), ("3", 2.5, 4.0), ("4", 3.5, 5.0)]
    got = src.read_csv(spark, str(path), ["x"], skip_rows=1, max_rows=1).collect()
    assert [r.x for r in got] == [2.5]
    with pytest.raises(src.SourceError, match="no column z"):
        src.read_csv(spark, str(path), ["z"])


def test_bins_drop_a_partial_first_day(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 7, 0)), ("a", dt.datetime(2024, 1, 2, 6, 10)), ("a", dt.datetime(2024, 1, 2, 7, 0)), ("a", None)]
    e = spark.createDataFrame(rows, "series_id string, ts timestamp")
    got = src.occupied_bins(e, 30, start_hour=6).orderBy("t").collect()
    assert [(r.t, r.value) for r in got] == [(0, True), (1, False), (2, True)]
    assert src.occupied_bins(e, 30, 6, days=1).count() == 48
    with pytest.raises(ValueError):
        src.occupied_bins(e, 7)


def test_checks(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, float("nan")), ("a", 1, None)], "series_id string, t int, value double")
    with pytest.raises(checks.ContractError):
        checks.real(df)
    with pytest.raises(checks.ContractError):
        checks.increasing(df)
    with pytest.raises(checks.ContractError):
        checks.lengths_at_least(df, 4)
    assert checks.binary(df.where("t = 0")).count() == 1
    n = spark.createDataFrame([("a", 5)], "series_id string, n long")
    cps = lambda *v: spark.createDataFrame([("a", x) for x in v], "series_id string, cp long")
    assert checks.changepoints(cps(2, 4), n).count() == 2
    for bad in (cps(0), cps(5), cps(1, 2)):
        with pytest.raises(checks.ContractError):
            checks.changepoints(bad, n, 2)


def test_numerics(spark):
    inf = float("inf")
    df = spark.createDataFrame([([-inf, -inf],), ([0.0, 0.0],)], "v array<double>")
    got = [r.x for r in df.select(col.logsumexp(F.col("v")).alias("x")).collect()]
    assert got[0] == -inf and got[1] == pytest.approx(0.6931471805599453)
    df = spark.createDataFrame([([1, 2, 3, 4], 1)], "v array<int>, k int")
    assert df.select(col.rotate_left(F.col("v"), F.col("k")).alias("v")).first().v == [2, 3, 4, 1]
    assert src.clean(spark.createDataFrame([(float("nan"),)], "value double")).first().value is None


def test_draws_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a", 0, [1, 3], -2.0), ("a", 1, [], -3.0)], "series_id string, draw int, tau array<int>, log_post double")
    src.write_draws(d, {"seed": None, "burn": 10}, str(tmp_path / "d"))
    got, config = src.read_draws(spark, str(tmp_path / "d"))
    assert sorted(got.collect()) == sorted(d.collect()) and config == {"seed": "None", "burn": "10"}
    with pytest.raises(src.SourceError):
        src.read_draws(spark, str(tmp_path / "none"))


def test_online_csv(spark, tmp_path):
    from shiftspark.operators import bocpd

    s = spark.createDataFrame([("a", i, float(i >= 4)) for i in range(8)], "series_id string, t long, value double")
    online = bocpd.detect(s, bocpd.Detector(bocpd.BetaBernoulli(), bocpd.ConstantHazard(4)))
    src.write_online_csv(online, bocpd.alerts(online, 0.3), str(tmp_path / "o"))
    got = spark.read.option("header", True).csv(str(tmp_path / "o"))
    assert got.count() == 8 and set(got.columns) == {"series_id", "t", "cp_prob", "map_run_length", "pred_mean", "is_cp"}
    assert {r.t for r in got.where("is_cp = '1'").collect()} == {str(r.t) for r in bocpd.alerts(online, 0.3).collect()}


def test_compositions_and_windows(spark):
    e = spark.createDataFrame([("k", "d1", "a"), ("k", "d1", "b"), ("k", "d1", "a"), ("k", "d2", "x")], "key string, day string, kind string")
    got = src.compositions(e, ["a", "b"], F.col("day"), "kind", "key").collect()
    assert [(r.day, [round(v, 3) for v in r.comp]) for r in got] == [("d1", [0.667, 0.333])]
    s = spark.createDataFrame([("a", i, i) for i in range(6)], "series_id string, t long, value int")
    assert [(r.window, list(r["values"])) for r in src.count_windows(s, 3, 2).orderBy("window").collect()] == [(0, [0, 1, 2]), (1, [2, 3, 4])]


def test_bins_follow_a_zone_with_summer_time(spark):
    # clocks in Berlin went an hour on at 01:00 UTC of the 31st
    rows = [("a", "2024-03-30 22:30:00"), ("a", "2024-03-31 00:30:00"), ("a", "2024-03-31 01:30:00")]
    e = spark.createDataFrame(rows, "series_id string, at string").selectExpr("series_id", "CAST(at AS TIMESTAMP) AS ts")
    got = [r.t for r in src.occupied_bins(e, 60, timezone="Europe/Berlin").where("value").orderBy("t").collect()]
    # 23:30 of the 30th is before the next midnight; then 01:30 and, over the gap, 03:30
    assert got == [1, 3]
    utc = [r.t for r in src.occupied_bins(e, 60).where("value").orderBy("t").collect()]
    assert utc == [0, 1]


def test_errors_name_the_path(spark, tmp_path):
    with pytest.raises(src.SourceError, match="nowhere") as e:
        src.read_draws(spark, str(tmp_path / "nowhere"))
    assert e.value.__cause__ is not None
    src.write_study({"one": spark.range(3)}, {"seed": 1}, str(tmp_path / "study"))
    assert spark.read.option("header", True).csv(str(tmp_path / "study/one")).count() == 3


def test_circular_and_matrix_contracts(spark):
    ok = spark.createDataFrame([("a", 1), ("a", 3)], "series_id string, cp int")
    assert checks.circular(ok, 4).count() == 2
    for rows in ([("a", 1)], [("a", 1), ("a", 4)], [("a", 1), ("a", 1)]):
        with pytest.raises(checks.ContractError):
            checks.circular(spark.createDataFrame(rows, "series_id string, cp int"), 4)
    m = lambda a: spark.createDataFrame([(a,)], "m array<array<double>>")
    assert checks.matrix(m([[1.0, 2.0], [2.0, 1.0]]), "m", 2).count() == 1
    for a in ([[1.0, 2.0], [0.0, 1.0]], [[1.0]], [[float("nan"), 0.0], [0.0, 1.0]]):
        with pytest.raises(checks.ContractError):
            checks.matrix(m(a), "m", 2)


def test_matrix_helpers(spark):
    import math

    import numpy as np

    from shiftspark.functions import columns, matrices

    a = np.array([[2.0, 0.5], [0.5, 1.0]])
    logdet, inverse = matrices.logdet_inverse(a)
    assert logdet == pytest.approx(math.log(np.linalg.det(a))) and np.allclose(inverse, np.linalg.inv(a))
    assert np.linalg.eigvalsh(matrices.nearest_psd(np.array([[1.0, 2], [2, 1]]))).min() > 0
    assert np.isfinite(matrices.logdet_inverse(np.array([[1.0, 1], [1, 1]]))[0])
    x = np.array([[1.0, 2.0], [0.0, 0.0]])
    want = matrices.squared_mahalanobis(x, np.array([0.5, 0.5]), a)
    got = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").select(columns.squared_mahalanobis(F.col("x"), [0.5, 0.5], inverse.tolist()).alias("d")).collect()
    assert [r.d for r in got] == pytest.approx(want.tolist())
    q = matrices.random_orthogonal(4)
    assert np.allclose(q @ q.T, np.eye(4)) and matrices.exp_or_inf(1000) == math.inf
    with pytest.raises(ValueError):
        matrices.exp_or_inf(math.nan)
