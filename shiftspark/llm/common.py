"""Helpers that every operator of this subpackage shares.

Conventions for all operators here:

* input columns are picked by name, so extra columns (clashing names too) are
  ignored unless an operator says that it passes rows on whole;
* a null text counts as an empty text;
* repeated rows are separate rows and each gets its own result row;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import ctypes
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark.functions.frames import shared_dir

#: Python text handed to NumPy at a time; bounds a worker's memory, not the work.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stash(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write to the shared folder once and read it back.

    Unlike a local checkpoint this survives the loss of any executor.
    """
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """True if df has at most that many rows; looks at no more than rows + 1."""
    return df.limit(rows + 1).count() <= rows


def hash_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most ``rows`` rows of df (a few less), picked by a hash of their key; all if there are no more.

    A count sets the share to keep. A sorted limit would send ``rows`` rows of
    every partition to the driver instead.
    """
    n = df.count()
    if n <= rows:
        return df
    # four standard deviations under the bound, so that the limit does not choose
    share = int(max(rows - 4 * rows**0.5, rows / 2) / n * (1 << 62))
    return df.where(F.shiftrightunsigned(F.xxhash64(*key), 2) < share).limit(rows)


def one_in_five(doc_id: Column) -> Column:
    """crc32 of the id as text mod 5 = 0: held out from training."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def held_out_ids(ids) -> np.ndarray:
    import zlib

    return np.fromiter((zlib.crc32(str(i).encode()) % 5 == 0 for i in ids), bool, len(ids))


def byte_slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(first, count) runs of a string array of about ``limit`` bytes each."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    ends = np.cumsum(sizes, dtype=np.int64)
    first, n = 0, len(texts)
    while first < n:
        base = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield first, last - first
        first = last


def texts_of(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def tidied(run):
    """A task's function over batches that hands free memory back to the system at its end.

    Python workers are used again by the tasks of other stages, so what one has freed
    must not add to what the next one needs.
    """

    def tidy(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: no such call
            pass

    return tidy


def cpus_quiet() -> None:
    """Native libraries in a task keep to the task's own core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
