"""Keyed streaming state: restarts, steps out of order, gaps by timer, a state that grows."""

import datetime as dt
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pytest

from shiftspark.operators import bocpd
from shiftspark.streaming.online import detect_stream

DETECTOR = bocpd.Detector(bocpd.BetaBernoulli(), bocpd.ConstantHazard(4), max_run_length=8)
HOUR = 3_600_000
ZERO = dt.datetime(2024, 1, 1)


def hours(rows):
    """(series, hour, value) -> rows with a time within the hour"""
    return [(k, ZERO + dt.timedelta(hours=h, minutes=7 * i % 60), v) for i, (k, h, v) in enumerate(rows)]


def ran(spark, folder, rows, schema, out="out", **options):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(schema).parquet(str(folder / "in"))
    found = detect_stream(stream, DETECTOR, **options)
    q = found.writeStream.foreachBatch(lambda df, i: df.write.mode("append").parquet(str(folder / out))).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.read.schema(found.schema).parquet(str(folder / out)).orderBy("series_id", "t").toPandas()


def batch(spark, values, first=0, sid="a"):
    df = spark.createDataFrame([(sid, first + i, v) for i, v in enumerate(values)], "series_id string, t long, value double")
    return bocpd.detect(df, DETECTOR).orderBy("t").toPandas()


TIMED = "series_id string, ts timestamp, value double"


def test_gaps_come_out_by_timer_over_restarts(spark, tmp_path):
    first = int((ZERO - dt.datetime(1970, 1, 1)).total_seconds() // 3600)
    # hour 2 is out, 4 comes before 3, b is silent after its second hour
    one = hours([("a", 0, 1.0), ("a", 1, 0.0), ("a", 4, 1.0), ("a", 3, 1.0), ("b", 0, 0.0), ("b", 1, 1.0)])
    got = ran(spark, tmp_path, one, TIMED, ts="ts", width=HOUR, late="90 minutes")
    assert got[got.series_id == "a"].t.tolist() == [first, first + 1]  # the watermark is in hour 2
    # 5 is late but within the watermark's delay; its step replaces nothing; 2 is too late
    got = ran(spark, tmp_path, hours([("a", 7, 0.0), ("a", 6, 1.0), ("a", 5, None), ("c", 7, 1.0)]), TIMED, ts="ts", width=HOUR, late="90 minutes")
    got = ran(spark, tmp_path, hours([("c", 12, 1.0), ("a", 2, 1.0)]), TIMED, ts="ts", width=HOUR, late="90 minutes")
    values = [1.0, 0.0, None, 1.0, 1.0, None, 1.0, 0.0, None, None]
    want = {"a": batch(spark, values, first), "b": batch(spark, [0.0, 1.0] + [None] * 8, first, "b"), "c": batch(spark, [1.0, None, None], first + 7, "c")}
    for k, w in want.items():
        pd.testing.assert_frame_equal(got[got.series_id == k].reset_index(drop=True), w, obj=k)


def test_state_grows_by_a_field(spark, tmp_path):
    steps = "series_id string, t long, value double"
    ran(spark, tmp_path, [("a", t, float(t % 2)) for t in range(4)], steps)
    got = ran(spark, tmp_path, [("a", t, float(t % 2)) for t in range(4, 7)], steps, out="more", total=True)
    want = batch(spark, [float(t % 2) for t in range(7)])
    assert got.t.tolist() == [4, 5, 6] and got.log_evidence.tolist() == pytest.approx(want.log_evidence[4:].tolist())
    assert got.total.tolist() == pytest.approx(want.log_evidence[4:].cumsum().tolist())


def test_late_and_repeated_steps(spark, tmp_path):
    steps = "series_id string, t long, value double"
    got = ran(spark, tmp_path, [("a", 0, 1.0), ("a", 2, 0.0), ("b", 1, 1.0)], steps)
    got = ran(spark, tmp_path, [("a", 1, 1.0), ("a", 3, 1.0)], steps)
    want = batch(spark, [1.0, None, 0.0, 1.0])
    pd.testing.assert_frame_equal(got[got.series_id == "a"].reset_index(drop=True), want[want.t != 1].reset_index(drop=True))
    assert got[got.series_id == "b"].t.tolist() == [1]
    with pytest.raises(ValueError):
        detect_stream(spark.readStream.schema(TIMED).parquet(str(tmp_path / "in")), DETECTOR, ts="ts")


@dataclass(frozen=True)
class WaitingTimes:
    """A caller's own likelihood: exponential times with a Gamma prior on their rate."""

    shape: float = 2.0
    rate: float = 1.0

    def prior(self):
        return self.shape, self.rate

    def mean(self, a, b):
        return b / (a - 1)

    def log_predictive(self, x, a, b):
        return np.log(a) + a * np.log(b) - (a + 1) * np.log(b + x)

    def update(self, x, a, b):
        return a + 1, b + x


def test_a_likelihood_of_ones_own_on_table_and_stream(spark, tmp_path):
    rng = np.random.default_rng(3)
    values = [*rng.exponential(1.0, 30), *rng.exponential(12.0, 30)]
    detector = bocpd.Detector(WaitingTimes(), bocpd.ConstantHazard(50), max_run_length=100)
    rows = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(values)], "series_id string, t long, value double")
    found = bocpd.detect(rows, detector).orderBy("t").toPandas()
    # plain recursion over all run lengths
    R, post = np.ones(1), [(2.0, 1.0)]
    for t, x in enumerate(values):
        p = np.array([a * b**a / (b + x) ** (a + 1) for a, b in post])
        R = np.concatenate(([R.sum() / 50 * (2.0 / (1 + x) ** 3)], R * (49 / 50) * p))
        R /= R.sum()
        post = [(3.0, 1.0 + x)] + [(a + 1, b + x) for a, b in post]
        assert found.cp_prob[t] == pytest.approx(R[0]) and found.map_run_length[t] == R.argmax()
    assert 25 <= 59 - found.map_run_length[59] <= 33
    rows.write.parquet(str(tmp_path / "in"))
    stream = detect_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), detector)
    q = stream.writeStream.foreachBatch(lambda df, i: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    pd.testing.assert_frame_equal(spark.read.parquet(str(tmp_path / "out")).orderBy("t").toPandas(), found)


def test_what_is_no_likelihood():
    with pytest.raises(TypeError, match="log_predictive"):
        bocpd.Detector(type("Half", (), {"prior": lambda self: (1, 1), "mean": lambda self, a, b: a, "update": lambda self, x, a, b: (a, b)})())
    with pytest.raises(TypeError, match="mean"):
        bocpd.Detector(type("Flat", (WaitingTimes,), {"mean": lambda self, a, b: 1.0})())
