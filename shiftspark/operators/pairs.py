"""Pairs of points of each series without a row a pair: tiles of distances, their sums, and exact order statistics.

A tile is a pair of blocks of a series' points, so the work of a long series is many tasks of
bounded size. Sums are added up over tiles. An order statistic is selected by counting: the
bits of a non-negative double are ordered as the double is, so tiles count how many squared distances
fall into each of BINS ranges of bits, the counts are added up, the range that
holds the wanted rank is split anew, and once it holds few pairs those are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftspark.functions.columns import squared_distance
from shiftspark.functions.frames import keep

#: Points of a block.
TILE = 512
#: Ranges that a range of bits is split into, as a power of two.
BIN_BITS = 13
#: Pairs of a range (of one series) that are looked at one by one.
FEW = 50_000
#: Bits of a non-negative double.
WHOLE = 63


def squared_distances(x: np.ndarray) -> np.ndarray:
    n = (x * x).sum(axis=1)
    d = np.maximum(n[:, None] + n[None, :] - 2 * x @ x.T, 0)
    np.fill_diagonal(d, 0)
    return d


def between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of two point sets."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0)


def differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by differences, added in the order of components: exactly zero for equal points."""
    out = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T):
        step = a[:, None] - b[None, :]
        out += step * step
    return out


def pair_distances(points: DataFrame) -> DataFrame:
    """series_id, i, j, d2 for i < j: for short series and checks only (quadratic rows)."""
    a = points.select("series_id", F.col("t").alias("i"), F.col("x").alias("xi"))
    b = points.select("series_id", F.col("t").alias("j"), F.col("x").alias("xj"))
    return a.join(b, "series_id").where("i < j").select("series_id", "i", "j", squared_distance(F.col("xi"), F.col("xj")).alias("d2"))


def tiles(points: DataFrame, size: int = TILE) -> DataFrame:
    """series_id, own, p, q (arrays of (t, x)), one row for each pair of blocks of a series' points, a block with itself (own) too."""
    block = points.groupBy("series_id", F.floor(F.col("t") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("p"))
    other = block.select(F.col("series_id").alias("_s"), F.col("block").alias("other"), F.col("p").alias("q"))
    return block.join(other, (F.col("series_id") == F.col("_s")) & (F.col("block") <= F.col("other"))).select("series_id", (F.col("block") == F.col("other")).alias("own"), "p", "q")


def tile_points(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    rows = column[i].values
    x = rows.field("x")
    return np.asarray(rows.field("t")).astype(np.int64), np.asarray(x.flatten(), dtype=float).reshape(len(rows), -1)


def as_points(points: DataFrame) -> DataFrame:
    return points.select("series_id", F.col("t").cast("long").alias("t"), F.col("x").cast("array<double>").alias("x"))


def pair_sums(points: DataFrame, alpha: float = 1.0) -> DataFrame:
    """series_id, t, ends (sum of distance^alpha to earlier points), begins (to later ones): tile by tile, then an aggregate."""
    kind = dict(points.dtypes)["series_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (t, x), (u, y) = tile_points(batch.column(2), i), tile_points(batch.column(3), i)
                d = between(x, y) ** (alpha / 2)
                if batch.column(1)[i].as_py():
                    d = np.triu(d, 1)
                zero = np.zeros
                both = [np.concatenate([t, u]), np.concatenate([zero(len(t)), d.sum(axis=0)]), np.concatenate([d.sum(axis=1), zero(len(u))])]
                name = pa.array([batch.column(0)[i].as_py()] * len(both[0]), batch.column(0).type)
                yield pa.RecordBatch.from_arrays([name, *map(pa.array, both)], ["series_id", "t", "ends", "begins"])

    found = tiles(as_points(points)).mapInArrow(run, f"series_id {kind}, t long, ends double, begins double")
    return found.groupBy("series_id", "t").agg(F.sum("ends").alias("ends"), F.sum("begins").alias("begins"))


# --- order statistics -------------------------------------------------------------


def _codes(batch: pa.RecordBatch, i: int) -> np.ndarray:
    """The bits of a tile's squared distances, each pair once."""
    (_, x), (_, y) = tile_points(batch.column(2), i), tile_points(batch.column(3), i)
    d = differences(x, y)
    return (d[np.triu_indices(len(x), 1)] if batch.column(1)[i].as_py() else d.ravel()).view(np.int64)


def _tallied(points: DataFrame, aims: DataFrame, what, schema: str, size: int) -> DataFrame:
    """n summed over tiles by series, range and what ``what`` (codes within a range, first, bits) tells: (keys, counts)."""
    kind = dict(points.dtypes)["series_id"]
    asked = aims.groupBy("series_id").agg(F.collect_set(F.struct("first", "bits")).alias("ranges"))
    side = tiles(points, size).join(asked.withColumnRenamed("series_id", "_a"), F.col("series_id") == F.col("_a")).select("series_id", "own", "p", "q", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes = _codes(batch, i)
                for r in batch.column(4)[i].as_py():
                    first, bits = r["first"], r["bits"]
                    keys, n = what(codes if bits == WHOLE else codes[(codes >= first) & (codes - first < 1 << bits)], first, bits)
                    name = pa.array([batch.column(0)[i].as_py()] * len(n), batch.column(0).type)
                    yield pa.RecordBatch.from_arrays([name, pa.array(np.full(len(n), first)), pa.array(np.full(len(n), bits)), pa.array(keys), pa.array(n)], ["series_id", "first", "bits", "key", "n"])

    told = side.mapInArrow(run, f"series_id {kind}, first long, bits long, key {schema}, n long")
    return told.groupBy("series_id", "first", "bits", "key").agg(F.sum("n").alias("n"))


def _binned(codes: np.ndarray, first: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique((codes - first) >> max(0, bits - BIN_BITS), return_counts=True)


def _binned_above_zero(codes: np.ndarray, first: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return _binned(codes[codes > 0], first, bits)


def _listed(codes: np.ndarray, first: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.unique(codes, return_counts=True)
    return keys.view(np.float64), n


def _listed_above_zero(codes: np.ndarray, first: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return _listed(codes[codes > 0], first, bits)


def pair_quantiles(points: DataFrame, at: list[float], zero: bool = True, few: int = FEW, size: int = TILE) -> DataFrame:
    """series_id, quantile (its place in ``at``), low, high, share: the squared distances on both sides of each quantile, exactly.

    points: series_id, t (0, 1, ...), x. The quantile of squared distances is low + share (high - low); one of a
    monotone function of them has the same neighbours. zero=False leaves out pairs of equal points. Series without a pair
    have no row. The number of passes over the tiles is three or four for any length, and two for a series of few pairs.
    """
    points = as_points(points)
    binned, listed = (_binned, _listed) if zero else (_binned_above_zero, _listed_above_zero)
    sizes = points.groupBy("series_id").agg(F.count("*").alias("c")).where("c > 1").select("series_id", F.expr("c * (c - 1) div 2").alias("inside"))
    # sides 0 and 1: the ranks below and above the quantile; rank and place are null until the pairs are counted
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("quantile"), F.lit(float(a)).alias("a"), F.lit(s).alias("side")) for i, a in enumerate(at) for s in (0, 1)]))
    start = F.lit(0).cast("long").alias("first"), F.lit(WHOLE).cast("long").alias("bits"), F.lit(None).cast("long").alias("rank"), F.lit(None).cast("double").alias("place")
    aims = keep(sizes.select("series_id", sides.alias("s"), "inside").select("series_id", "s.*", *start, "inside"), "ranks")
    left = F.greatest(F.col("bits") - BIN_BITS, F.lit(0))
    while True:
        wide = aims.where((F.col("inside") > few) & (F.col("bits") > 0))
        if wide.isEmpty():
            break
        found = _at_rank(wide, _tallied(points, wide, binned, "long", size))
        into = F.col("first") + F.col("key") * F.expr(f"shiftleft(1L, CAST(greatest(bits - {BIN_BITS}, 0) AS INT))")
        narrowed = found.select("series_id", "quantile", "a", "side", into.alias("first"), left.alias("bits"), (F.col("rank") - F.col("before")).alias("rank"), "place", F.col("n").alias("inside"))
        aims = keep(aims.where((F.col("inside") <= few) | (F.col("bits") == 0)).unionByName(narrowed.select(*aims.columns)), "ranks")
    found = _at_rank(aims, _tallied(points, aims, listed, "double", size))
    side = lambda i: F.max(F.when(F.col("side") == i, F.col("key")))
    two = found.groupBy("series_id", "quantile").agg(side(0).alias("low"), side(1).alias("high"), F.max("place").alias("place"))
    return two.select("series_id", "quantile", "low", "high", (F.col("place") - F.floor("place")).alias("share"))


def _at_rank(aims: DataFrame, counts: DataFrame) -> DataFrame:
    """aims beside the key whose pairs hold their rank, and how many pairs come before it."""
    within = Window.partitionBy("series_id", "first", "bits")
    running = counts.withColumn("upto", F.sum("n").over(within.orderBy("key"))).withColumn("total", F.sum("n").over(within)).withColumn("before", F.col("upto") - F.col("n"))
    asked = aims.withColumnsRenamed({"series_id": "_s", "first": "_first", "bits": "_bits"})
    both = running.join(asked, (F.col("series_id") == F.col("_s")) & (F.col("first") == F.col("_first")) & (F.col("bits") == F.col("_bits")))
    both = both.withColumn("place", F.coalesce("place", F.col("a") * (F.col("total") - 1)))
    rank = F.coalesce("rank", F.when(F.col("side") == 0, F.floor("place")).otherwise(F.ceil("place")).cast("long"))
    return both.withColumn("rank", rank).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto")))


def pair_median(x: np.ndarray, few: int = 4_000_000, rows: int = TILE) -> float:
    """The median squared distance of one series' points, by the same selection within a task; nan without a pair.

    Memory is ``few`` pairs and ``rows`` rows of distances, whatever the number of pairs.
    """
    n = len(x)
    pairs = n * (n - 1) // 2

    def blocks() -> Iterator[np.ndarray]:
        for a in range(0, n, rows):
            d = differences(x[a : a + rows], x[a:])
            yield d[np.triu_indices(len(d), 1, d.shape[1])].view(np.int64)

    def at(rank: int) -> float:
        first, bits, inside = 0, WHOLE, pairs
        while inside > few and bits:
            step = max(0, bits - BIN_BITS)
            counts = np.zeros(1 << (bits - step), np.int64)
            for codes in blocks():
                own = codes[(codes >= first) & (codes - first < 1 << bits)]
                counts += np.bincount((own - first) >> step, minlength=len(counts))
            upto = np.cumsum(counts)
            bin_ = int(np.searchsorted(upto, rank, "right"))
            first, bits, inside, rank = first + (bin_ << step), step, int(counts[bin_]), rank - int(upto[bin_] - counts[bin_])
        if not bits:
            return float(np.int64(first).view(np.float64))
        own = np.concatenate([codes[(codes >= first) & (codes - first < 1 << bits)] for codes in blocks()])
        return float(np.partition(own, rank)[rank].view(np.float64))

    if not pairs:
        return float("nan")
    low, high = (at(r) for r in ((pairs - 1) // 2, pairs // 2))
    return (low + high) / 2
