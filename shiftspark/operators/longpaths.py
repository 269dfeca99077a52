"""Best paths of one very long series: blocks of steps are decoded side by side.

1. Each block gives its max-plus matrix: the best score from every state before it to every state at its end.
2. A scan of the matrices gives the scores at the start of every block.
3. From there each block walks forward once, keeps which state each step came from, and tells which state before the
   block leads to each state at its end.
4. A scan of those maps from the end gives the state in which each block ends, and blocks are read back.

Scores are whole multiples of QUANTUM, so that their sums do not hang on where blocks begin: the
path is exactly that of a step-by-step recursion over the same scores, ties too. Scans of more than ``fan`` blocks go
up and down a tree of groups, so that no task sees more than a block or a group, however long the series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftspark.functions.frames import keep
from shiftspark.operators.statespace import _log, duration_table

BLOCK, FAN = 2048, 256
#: Scores are rounded to multiples of this.
QUANTUM = 2.0**-24
#: No score; far from overflow when finite ones are added to it.
NEVER = -(1 << 61)
#: Largest finite log likelihood of a step, so that a block's sums fit 60 bits.
LARGEST = 2.0**59 * QUANTUM


def whole(scores) -> np.ndarray:
    """Scores in quanta; -inf is NEVER."""
    x = np.asarray(scores, float)
    never = np.isneginf(x)
    return np.where(never, NEVER, np.rint(np.where(never, 0.0, x) / QUANTUM)).astype(np.int64)


def possible(scores: np.ndarray) -> np.ndarray:
    """Scores, with those that no path has set back to NEVER, so that they tie."""
    return np.where(scores > NEVER // 2, scores, NEVER)


class HmmSteps:
    """State scores of a hidden Markov model, one step on; a place is a state."""

    def __init__(self, pi, a):
        self.first, self.a = whole(_log(pi)), whole(_log(a))
        self.places = self.states = len(self.first)

    def start(self, ll: np.ndarray) -> np.ndarray:
        return possible(self.first + ll)

    def on(self, scores: np.ndarray, ll: np.ndarray) -> np.ndarray:
        """scores (rows x places) a step later."""
        return possible((scores[:, :, None] + self.a).max(axis=1) + ll)

    def on_with_source(self, scores: np.ndarray, ll: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        paths = possible(scores[:, None] + self.a)
        return possible(paths.max(axis=0) + ll), paths.argmax(axis=0)

    def last(self, scores: np.ndarray) -> np.ndarray:
        return scores

    def enters(self, place: np.ndarray) -> np.ndarray:
        """Whether a segment begins in a place."""
        return np.zeros(len(place), bool)

    def rows(self, places: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return places, np.zeros(len(places), int)


class HsmmSteps:
    """The same for explicit durations: a place is (state, steps since it was entered), states first."""

    def __init__(self, pi, a, durations: np.ndarray):
        a = np.array(a, float)
        np.fill_diagonal(a, 0)
        self.first, self.a = whole(_log(np.array(pi, float) / np.sum(pi))), whole(_log(a / np.maximum(a.sum(axis=1, keepdims=True), 1e-300)))
        self.durations = whole(durations)
        self.states, self.longest = durations.shape
        self.places = durations.size

    def _aged(self, scores: np.ndarray, entered: np.ndarray, ll: np.ndarray) -> np.ndarray:
        by_age = scores.reshape(-1, self.states, self.longest)
        out = np.concatenate([entered[:, :, None], by_age[:, :, :-1]], axis=2) + ll[:, None]
        return possible(out).reshape(len(scores), -1)

    def start(self, ll: np.ndarray) -> np.ndarray:
        return self._aged(np.full((1, self.places), NEVER), self.first[None], ll)[0]

    def on(self, scores: np.ndarray, ll: np.ndarray) -> np.ndarray:
        done = possible((scores.reshape(-1, self.states, self.longest) + self.durations).max(axis=2))
        return self._aged(scores, possible((done[:, :, None] + self.a).max(axis=1)), ll)

    def on_with_source(self, scores: np.ndarray, ll: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done = possible(scores.reshape(self.states, self.longest) + self.durations)
        age = done.argmax(axis=1)
        paths = possible(done.max(axis=1)[:, None] + self.a)
        source = np.arange(self.places).reshape(self.states, self.longest) - 1
        source[:, 0] = paths.argmax(axis=0) * self.longest + age[paths.argmax(axis=0)]
        return self._aged(scores[None], paths.max(axis=0)[None], ll)[0], source.ravel()

    def last(self, scores: np.ndarray) -> np.ndarray:
        return possible(scores + self.durations.ravel())

    def enters(self, place: np.ndarray) -> np.ndarray:
        return place % self.longest == 0

    def rows(self, places: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states, a segment's duration at its last step)"""
        return places // self.longest, np.where(ended, places % self.longest + 1, 0)


Steps = HmmSteps | HsmmSteps


def _rebased(scores: np.ndarray) -> np.ndarray:
    top = scores.max()
    return np.where(scores > NEVER // 2, scores - top, NEVER) if top > NEVER // 2 else scores


def _blocks(loglik: DataFrame, block: int) -> DataFrame:
    """series_id, pos, last, rows: runs of ``block`` steps in order, written once, as two passes read them."""
    big = F.exists("loglik", lambda v: v.isNull() | F.isnan(v) | (v > LARGEST / block) | ((v < -LARGEST / block) & (v > F.lit(float("-inf")))))
    sound = F.when(big, F.raise_error(F.lit("log likelihoods are numbers or -inf, of bounded size")).cast("array<double>")).otherwise(F.col("loglik"))
    rows = loglik.select(F.col("series_id").cast("string"), F.col("t").cast("long"), F.col("loglik").cast("array<double>").alias("loglik"))
    rows = rows.select("series_id", F.floor(F.col("t") / block).alias("pos"), F.struct("t", sound.alias("ll")).alias("r"))
    made = rows.groupBy("series_id", "pos").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["ll"]).alias("rows"))
    ends = rows.groupBy("series_id").agg(F.max("pos").alias("last"))
    return keep(made.join(ends, "series_id").select("series_id", "pos", (F.col("pos") == F.col("last")).alias("last"), "rows"), "blocks")


def _steps_of(cell: pa.ListScalar, states: int) -> np.ndarray:
    return whole(np.asarray(cell.values.flatten(), dtype=float).reshape(-1, states))


ELEMENT = "series_id string, pos long, value binary"


def _scan(elements: DataFrame, starts: DataFrame, compose: Callable, apply: Callable, fan: int) -> DataFrame:
    """series_id, pos, state (binary): the state before each element of a series, from its start, in the order of pos.

    elements: ELEMENT; starts: series_id, state. compose joins two elements' values into one's; apply takes a state over a value.
    """
    longest = elements.groupBy("series_id").count().agg(F.max("count")).first()[0] or 0

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame, states = frame.sort_values("pos"), []
        state = frame["state"].iloc[0]
        for value in frame["value"]:
            states.append(state)
            state = apply(state, value)
        return pd.DataFrame({"series_id": frame["series_id"], "pos": frame["pos"], "state": states})

    found = "series_id string, pos long, state binary"
    if longest <= fan:
        return keep(elements.join(starts, "series_id").groupBy("series_id").applyInPandas(walk, found), "scan")

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        values = list(frame.sort_values("pos")["value"])
        while len(values) > 1:
            values = [compose(*values[i : i + 2]) if i + 1 < len(values) else values[i] for i in range(0, len(values), 2)]
        return pd.DataFrame({"series_id": [frame["series_id"].iloc[0]], "pos": [frame["group"].iloc[0]], "value": values})

    grouped = elements.withColumn("group", F.floor(F.col("pos") / fan))
    above = _scan(keep(grouped.groupBy("series_id", "group").applyInPandas(together, ELEMENT), "groups"), starts, compose, apply, fan)
    joined = grouped.join(above.withColumnRenamed("pos", "group"), ["series_id", "group"])
    return keep(joined.groupBy("series_id", "group").applyInPandas(walk, found), "scan")


def _best(states: Steps, loglik: DataFrame, block: int, fan: int) -> DataFrame:
    blocks, S = _blocks(loglik, block), states.places

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, pos, cell in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                rows = _steps_of(cell, states.states)
                if pos == 0:  # a row: the start leads to every place
                    scores, rows = states.start(rows[0])[None], rows[1:]
                else:
                    scores = np.where(np.eye(S, dtype=bool), 0, NEVER)
                for ll in rows:
                    scores = states.on(scores, ll)
                yield pa.RecordBatch.from_arrays([pa.array([sid.as_py()]), pa.array([pos]), pa.array([scores.astype(np.int64).tobytes()], pa.binary())], ["series_id", "pos", "value"])

    read = lambda blob, width: np.frombuffer(blob, np.int64).reshape(-1, width)

    def times(a: bytes, b: bytes) -> bytes:
        a, b = read(a, S), read(b, S)
        out = possible(np.stack([(row[:, None] + b).max(axis=0) for row in a]))
        # rebased as a whole, which changes no path; rows must keep their distances
        top = out.max()
        return np.where(out > NEVER // 2, out - top, NEVER).astype(np.int64).tobytes() if top > NEVER // 2 else out.tobytes()

    def passed(state: bytes, value: bytes) -> bytes:
        scores = np.frombuffer(state, np.int64)
        return _rebased(possible((scores[:, None] + read(value, S)).max(axis=0))).astype(np.int64).tobytes()

    begin = blocks.select("series_id").distinct().withColumn("state", F.lit(np.zeros(1, np.int64).tobytes()))
    scores = keep(blocks.select("series_id", "pos", "rows").mapInArrow(matrices, ELEMENT), "matrices")
    entered = _scan(scores, begin, times, passed, fan)
    kind = np.uint8 if S <= 256 else np.uint16 if S <= 1 << 16 else np.int32

    def sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, pos, last, cell, state in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist()):
                rows, came = _steps_of(cell, states.states), []
                if pos == 0:
                    now, rows = states.start(rows[0]), rows[1:]
                else:
                    now = np.frombuffer(state, np.int64)
                for ll in rows:
                    now, source = states.on_with_source(now, ll)
                    came.append(source)
                came = np.array(came, kind).reshape(-1, S)
                # for each place at the end: the place before the block, plus S if the block's first step begins a segment
                at = np.arange(S)
                for source in came[:0:-1]:
                    at = source[at].astype(np.int64)
                leads = came[0][at] + S * states.enters(at) if pos else at
                end = int(states.last(now).argmax()) + S if last else None
                yield pa.RecordBatch.from_arrays([
                    pa.array([sid.as_py()]), pa.array([-pos]), pa.array([leads.astype(np.int64).tobytes()], pa.binary()), pa.array([came.tobytes()], pa.binary()),
                    pa.array([None if end is None else np.array([end]).tobytes()], pa.binary()),
                ], ["series_id", "pos", "value", "came", "end"])

    ready = blocks.join(entered, ["series_id", "pos"]).select("series_id", "pos", "last", "rows", "state")
    back = keep(ready.mapInArrow(sources, "series_id string, pos long, value binary, came binary, end binary"), "sources")
    ints = lambda blob: np.frombuffer(blob, np.int64)
    ends = back.where("end is not null").select("series_id", F.col("end").alias("state"))
    left = _scan(back.select("series_id", "pos", "value"), ends, lambda a, b: ints(b)[ints(a) % S].tobytes(), lambda s, v: ints(v)[ints(s) % S].tobytes(), fan)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, pos, came, state in zip(*(c.to_pylist() for c in batch.columns)):
                came, place = np.frombuffer(came, kind).reshape(-1, S), int(ints(state)[0])
                path, pos = [place % S], -pos
                for source in came[: 0 if pos else None : -1]:
                    path.append(int(source[path[-1]]))
                path = np.array(path[::-1])
                ended = np.append(states.enters(path[1:]), place >= S)
                state_, duration = states.rows(path, ended)
                yield pa.RecordBatch.from_arrays([pa.array([sid] * len(path)), pa.array(pos * block + np.arange(len(path))), pa.array(state_.astype(np.int32)), pa.array(duration.astype(np.int32))], ["series_id", "t", "state", "duration"])

    chosen = back.select("series_id", "pos", "came").join(left, ["series_id", "pos"]).select("series_id", "pos", "came", "state")
    return chosen.mapInArrow(paths, "series_id string, t long, state int, duration int")


def decode_hmm(loglik: DataFrame, pi: list[float], a: list[list[float]], block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """series_id, t, state: statespace.decode_hmm for series (t = 0, 1, ...) of any length."""
    return _best(HmmSteps(pi, a), loglik, block, fan).drop("duration")


def decode_hsmm(loglik: DataFrame, pi: list[float], a: list[list[float]], parameters: list, longest: int, family: str = "poisson", least: int = 1, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """series_id, t, state, duration (at a segment's last step): statespace.decode_hsmm for series of any length.

    A block's matrix has (states x longest)^2 scores, so this is for durations of tens of steps.
    """
    return _best(HsmmSteps(pi, a, duration_table(family, parameters, longest, least)), loglik, block, fan)
