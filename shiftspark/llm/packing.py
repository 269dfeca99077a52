"""Best-fit-decreasing packing of tokenised documents into fixed-size sequences.

Which bin best-fit decreasing picks depends on piece lengths alone, and a
length is at most ``capacity``. So Spark counts pieces by length, the plan is
made for the counts (at most ``capacity`` of them, whatever the input), and
every piece finds its place by its length and its rank among equals. A segment
tree over remaining capacities finds the tightest open bin in logarithmic time;
bins of one history and pieces of one length are placed together, which gives
the same bins as placing one piece after another.

Nulls, empties, repeats: a null or empty text is a document of the end id
alone; a null doc_id is kept as it is; repeated rows are packed one by one;
a very long text is encoded whole and cut into pieces of ``capacity``; pieces of one length (ties) go
in the order of a digest of their document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftspark.llm import tokens
from shiftspark.llm.common import byte_slices, stash, table, tidied

CAPACITY = 4096

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class TightestBin:
    """Segment tree over remaining capacities 0..capacity: how many bins are open at each."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, remaining: int, bins: int) -> None:
        at = remaining + self.leaves
        while at:
            self.open[at] += bins
            at >>= 1

    def first(self, least: int) -> int | None:
        """The smallest remaining capacity >= least that has an open bin."""
        at = least + self.leaves
        if self.open[at]:
            return least
        while at > 1:  # up, until a right neighbour has bins
            if not at & 1 and self.open[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return None
        while at < self.leaves:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first_rank, pieces, first_sequence, per_sequence, offset).

    Pieces of that length and ranks first_rank.. go, per_sequence at a time, to
    the sequences from first_sequence on, the first of each at ``offset``.
    """
    tree = TightestBin(capacity)
    groups: dict[int, list[tuple[int, int]]] = {}  # remaining -> (first sequence, bins)
    plan, sequences = [], 0

    def put(remaining: int, first: int, bins: int) -> None:
        if remaining and bins:
            groups.setdefault(remaining, []).append((first, bins))
            tree.add(remaining, bins)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            remaining = tree.first(length)
            if remaining is None:
                remaining, first, bins = capacity, sequences, -(-left // (capacity // length))
                sequences += bins
            else:
                first, bins = groups[remaining].pop()
                tree.add(remaining, -bins)
            per, offset = remaining // length, capacity - remaining
            filled = min(bins, left // per)
            for use, each in ((filled, per), (1 if filled < bins and left % per and filled == left // per else 0, left % per)):
                if use:
                    plan.append((length, rank, use * each, first, each, offset))
                    put(remaining - each * length, first, use)
                    first, bins, left, rank = first + use, bins - use, left - use * each, rank + use * each
            put(remaining, first, bins)
    return plan


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: a document's ids and the end id, cut after every ``capacity`` ids."""
    path = vocabulary or tokens.vocabulary_path()
    end = np.array([tokens.END_ID], np.uint32)
    end_bytes = end.astype("<u4").tobytes()
    schema = PIECES + (", ids array<long>" if with_ids else "")

    @tidied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for batch in batches:
            for first, n in byte_slices(batch.column(1), tokens.SLICE_BYTES):
                doc_ids = batch.column(0).slice(first, n).to_pylist()
                flat, count = enc.encode(batch.column(1).slice(first, n))
                flat = flat.astype("<u4", copy=False)
                rows, ids, a = [], [], 0
                for doc_id, k in zip(doc_ids, count.tolist()):
                    for piece, start in enumerate(range(0, k + 1, capacity)):
                        length = min(capacity, k + 1 - start)
                        own = flat[a + start : a + min(k, start + capacity)]
                        crc = zlib.crc32(own)
                        if len(own) < length:
                            crc = zlib.crc32(end_bytes, crc)
                        rows.append((doc_id, piece, start, length, crc))
                        if with_ids:
                            ids.append(own if len(own) == length else np.concatenate((own, end)))
                    a += k
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (see pieces) with sequence_id and offset; it is read twice, so write it first.

    Ranks among pieces of one length are dealt by (length, salt), so a length
    that holds most pieces is still ranked by many tasks.
    """
    spark = cut.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    dealt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # At most ``capacity`` rows for any input.
    counts = {r["length"]: r["n"] for r in dealt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit_plan(counts, capacity)
    before = dealt.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    # The plan's size is bounded by capacity, not by the input.
    rows = spark.createDataFrame(plan, "plan_length long, first_rank long, n long, first_sequence long, per long, first_offset long").coalesce(1)
    p = F.broadcast(rows)
    within = F.col("rank") - F.col("first_rank")
    return (
        ranked.join(p, (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n")))
        .withColumn("sequence_id", F.col("first_sequence") + F.expr("(rank - first_rank) div per"))
        .withColumn("offset", F.col("first_offset") + within % F.col("per") * F.col("length"))
        .select(*cut.columns, "sequence_id", "offset")
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces with their places. Tokenises once; the cut is kept in the shared folder."""
    return place(stash(pieces(docs, capacity, vocabulary, with_ids), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed rows themselves: sequence_id and its ids in order (at most ``capacity``)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
