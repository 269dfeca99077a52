"""The same detection on a stream: keyed state in the store, steps in the order of t, timers for steps that stay out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shiftspark.operators.bocpd import ONLINE, Detector

_STATE = "t long, R array<double>, a array<double>, b array<double>"
_COLUMNS = ["series_id", "t", "cp_prob", "map_run_length", "pred_mean", "log_evidence", "error"]

_STORE = "spark.sql.streaming.stateStore"


def use_state_store(spark: SparkSession, grows: bool) -> None:
    """The session's settings for keyed state, which a query takes when it starts: start one before the next is made.

    State is in RocksDB, so that it need not fit the executors' memory. ``grows``: with field names, so that its
    schema can grow; Spark offers that for transformWithState alone.
    """
    spark.conf.set(f"{_STORE}.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(f"{_STORE}.encodingFormat", "avro" if grows else "unsaferow")


class OnlineSteps(StatefulProcessor):
    """The detector's state of each series, moved on by its rows, or by event-time timers.

    Without ``width`` a row moves its series on at once; steps left out before it are missing values,
    and a row older than one that its series has taken is dropped. With ``width`` (milliseconds a step) rows wait in a
    map of pending steps, and the watermark moves a series on: a timer at the end of its next step fires, every step that
    is closed is taken in order, and one that never came is a missing value. A silent series so goes on
    giving rows. ``total`` adds up log evidence in a further field of the state; a query that ran without it can be
    restarted with it.
    """

    def __init__(self, detector: Detector, width: int | None = None, total: bool = False):
        self.detector, self.width, self.total = detector, width, total

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("detector", _STATE + (", total double" if self.total else ""))
        if self.width:
            self.pending = handle.getMapState("pending", "t long", "value double")

    def _now(self) -> dict | None:
        if not self.state.exists():
            return None
        t, R, a, b, *more = self.state.get()
        return {"t": t, "R": np.array(R), "a": np.array(a), "b": np.array(b), "total": (more[0] if more else None) or 0.0}

    def _put(self, now: dict) -> None:
        more = (float(now["total"]),) if self.total else ()
        self.state.update((int(now["t"]), now["R"].tolist(), now["a"].tolist(), now["b"].tolist(), *more))

    def _step(self, now: dict, x: float | None) -> tuple[dict, tuple]:
        after, out = self.detector.step(now, x)
        after["total"] = now["total"] + out[3]
        return after, (*out, after["total"]) if self.total else out

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_COLUMNS + (["total"] if self.total else []))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "value"], na_position="first")
        values = [(int(t), None if pd.isna(x) else float(x)) for t, x in zip(frame["t"], frame["value"])]
        now = self._now()
        if self.width:
            for t, x in values:
                if now is None or t >= now["t"]:
                    self.pending.updateValue((t,), (x,))
            if values:
                self._wake(now["t"] if now else min(t for t, _ in values))
            return
        now, out = now or self.detector.start() | {"total": 0.0}, []
        for t, x in values:
            if t < now["t"]:
                continue
            while now["t"] < t:  # steps that never came are missing values
                now, _ = self._step(now, None)
            now, told = self._step(now, x)
            out.append((key[0], t, *told))
        self._put(now)
        yield self._frame(out)

    def _wake(self, t: int) -> None:
        """One timer a series: at the end of step t."""
        at = (t + 1) * self.width
        for other in list(self.handle.listTimers()):
            if other <= at:
                return
            self.handle.deleteTimer(other)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() // self.width  # steps before this one
        waiting = {t: x for (t,), (x,) in self.pending.iterator() if t < closed}
        now = self._now()
        if now is None:
            if not waiting:
                return
            now = self.detector.start() | {"t": min(waiting), "total": 0.0}
        out = []
        for t in range(now["t"], closed):
            now, told = self._step(now, waiting.get(t))
            out.append((key[0], t, *told))
        for t in waiting:
            self.pending.removeKey((t,))
        self._put(now)
        for other in list(self.handle.listTimers()):
            self.handle.deleteTimer(other)
        self.handle.registerTimer((now["t"] + 1) * self.width)
        yield self._frame(out)

    def close(self) -> None:
        pass


def detect_stream(series: DataFrame, detector: Detector, ts: str | None = None, width: int | None = None, late: str = "1 hour", total: bool = False) -> DataFrame:
    """Streaming rows -> ONLINE rows (and ``total``), as the batch operator gives them. A restart goes on where it stopped.

    By steps: series_id, t, value; rows of a micro-batch are put in the order of t. By time: series_id, ts,
    value, with ``width`` milliseconds a step; t is then the number of the step since the epoch, rows may come up to ``late`` out of
    order (of one step the last one counts), and steps come out when the watermark closes them, those without a row too.
    """
    use_state_store(series.sparkSession, True)
    schema = ONLINE + (", total double" if total else "")
    if ts is None:
        typed = series.select(F.col("series_id").cast("string"), F.col("t").cast("long"), F.col("t").cast("long").alias("at"), F.col("value").cast("double"))
        return typed.groupBy("series_id").transformWithStateInPandas(OnlineSteps(detector, None, total), schema, "Append", "None")
    if not width or width < 1:
        raise ValueError("steps by time have a width")
    stamped = series.select(F.col("series_id").cast("string"), F.col(ts).cast("timestamp").alias("ts"), F.col("value").cast("double")).withWatermark("ts", late)
    typed = stamped.select("series_id", "ts", F.floor(F.unix_millis("ts") / width).cast("long").alias("t"), F.unix_micros("ts").alias("at"), "value")
    return typed.groupBy("series_id").transformWithStateInPandas(OnlineSteps(detector, width, total), schema, "Append", "EventTime")


def binned_counts(events: DataFrame, width: str = "15 minutes", late: str = "1 hour", ts: str = "ts", key: str = "event_type") -> DataFrame:
    """Streaming counts of events in tumbling windows, closed by a watermark."""
    use_state_store(events.sparkSession, False)
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return stamped.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(key).alias("series_id")).agg(F.count("*").alias("value")).select("series_id", F.col("w.start").alias("start"), "value")


def hopping_means(events: DataFrame, size: str, slide: str, late: str = "1 hour", ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Streaming means in sliding windows."""
    use_state_store(events.sparkSession, False)
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return stamped.withWatermark(ts, late).groupBy(F.window(ts, size, slide).alias("w"), F.col(key).alias("series_id")).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select("series_id", F.col("w.start").alias("start"), "mean", "n")
