"""Exact integer vectors in blocks, for the operators that move centroids over rounds.

A block is one row: ids, labels and components of up to some thousand vectors, with what
an operator keeps of them from round to round. Each round reads the blocks of the round
before from the shared folder and writes its own, so a lost executor costs its tasks only.

Components are floor(1024 x) with x as double. Up to LARGEST their squared distances fit 64 bits;
a vector with a component beyond counts as one that is not finite.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: |x| up to which distances are exact in 64 bits for any usual length.
LARGEST = float(1 << 18)
#: Relative slack that keeps a bound a bound in spite of rounding.
SLACK = 1e-9

COLUMNS = "ids array<long>, labels array<string>, x binary, width int"


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (text), x (array<long>) of rows whose vector has components, none null, non-finite or beyond LARGEST.

    A table without a column ``label`` gives null labels.
    """
    label = F.col("label").cast("string") if "label" in embeddings.columns else F.lit(None).cast("string")
    rows = embeddings.select(F.col("vec_id").cast("long"), label.alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(sound).select("vec_id", "label", F.transform("v", lambda c: F.floor(c * 1024.0)).alias("x"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points to integer centres: int64, or whole float64 where those are exact."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * largest**2 < 1 << 52:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T
    return np.stack([((x.astype(np.int64) - one) ** 2).sum(axis=1) for one in c.astype(np.int64)], axis=1)


def squared_pairs(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each point to its own centre."""
    return ((x.astype(np.int64) - c.astype(np.int64)) ** 2).sum(axis=1)


def packed(x: np.ndarray) -> tuple[bytes, int]:
    largest = int(np.abs(x).max(initial=0))
    kind = np.int16 if largest < 1 << 15 else np.int32 if largest < 1 << 31 else np.int64
    return x.astype(kind).tobytes(), np.dtype(kind).itemsize


def unpacked(blob: bytes, width: int, length: int) -> np.ndarray:
    return np.frombuffer(blob, {2: np.int16, 4: np.int32, 8: np.int64}[width]).reshape(-1, length).astype(np.int64)


def read_vectors(batch: pa.RecordBatch, length: int) -> np.ndarray:
    """Column x of a batch of (vec_id, label, x) as a matrix."""
    return np.asarray(batch.column(2).flatten()).reshape(-1, length)


def change_rows(old: np.ndarray | None, new: np.ndarray, x: np.ndarray, entries: int) -> bytes:
    """What leaves and joins each entry: (entry, count, components...) of the entries that change, as int64."""
    out = np.zeros((entries, 2 + x.shape[1]), np.int64)
    moved = np.arange(len(new)) if old is None else np.flatnonzero(old != new)
    np.add.at(out[:, 1], new[moved], 1)
    np.add.at(out[:, 2:], new[moved], x[moved])
    if old is not None:
        np.add.at(out[:, 1], old[moved], -1)
        np.add.at(out[:, 2:], old[moved], -x[moved])
    out[:, 0] = np.arange(entries)
    return out[(out[:, 1:] != 0).any(axis=1)].tobytes()


def added_up(state: DataFrame, columns: list[str], length: int) -> np.ndarray:
    """(column, entry, count, sums...) of the changes that the blocks tell, added up over them by Spark.

    The result has a row an entry at most, which the caller's parameters bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, blobs in enumerate(batch.columns):
                for blob in blobs.to_pylist():
                    rows = np.frombuffer(blob, np.int64).reshape(-1, 2 + length)
                    sums = pa.FixedSizeListArray.from_arrays(pa.array(rows[:, 2:].ravel()), length).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), i)), pa.array(rows[:, 0]), pa.array(rows[:, 1]), sums], ["part", "entry", "n", "s"])

    told = state.select(*columns).mapInArrow(run, "part long, entry long, n long, s array<long>")
    sums = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(length)])
    return np.array([tuple(r) for r in sums.collect()], np.int64).reshape(-1, 3 + length)
