"""Connected components of a link table, by alternating stars in DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftspark.llm.common import fits_broadcast, stash, tidied

#: Alternating stars take a logarithmic number of rounds; this only ends a faulty run.
MAX_ROUNDS = 60
#: Links of at most so many (16 bytes each) are joined within one task; more go through rounds of joins.
TASK_LINKS = 50_000
#: Rows to drop are broadcast up to so many (16 bytes each), joined beyond.
BROADCAST_IDS = 1_000_000


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (the smallest member of each node's set) after joining a[i] with b[i]."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def connected_components(links: DataFrame, a: str, b: str, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, component): every node of a link and the smallest node it reaches; ends are longs.

    Null ends and self links are ignored, repeated links count once, an empty
    table gives no rows; other columns are ignored. A small table, by its count, is
    joined in one task. Beyond, each round's links go to the shared folder, and so do
    its minima before they are joined: a node with very many neighbours is only met in
    a partial minimum and in joins of plain tables, which adaptive execution splits or
    broadcasts; no group is gathered.
    """
    now = stash(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct(),
        "links",
    )
    if fits_broadcast(now, task_links):
        return _in_a_task(now)
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stash(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = stash(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stash(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        mark, before = _mark(now), mark
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())


def _in_a_task(links: DataFrame) -> DataFrame:
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.asarray(c) for c in batch.columns] for batch in batches]
        if parts:
            u, v = (np.concatenate(x) for x in zip(*parts))
            names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            label = unite(np.arange(len(names)), at[: len(u)], at[len(u) :])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[label])], ["node", "component"])

    return stash(links.coalesce(1).mapInArrow(run, "node long, component long"), "parts")


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one row of each component: the smallest by (doc_id, text's hash).

    found: doc_id, tx (a text's hash) and component of every row of docs. Rows
    without a doc_id stay and drop no other. Rows that share a doc_id are judged
    by their own texts; of rows that repeat both, one stays. Other columns pass
    through.
    """
    found = stash(found.where("doc_id is not null").select("doc_id", "tx", "component"), "components")
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "tx")).alias("first"), F.count("*").alias("n")).where("n > 1").select("component", "first")
    first = stash(first, "firsts")
    gone = found.join(first, "component").where(F.struct("doc_id", "tx") != F.col("first")).select(F.col("doc_id").alias("_doc"), F.col("tx").alias("_tx")).distinct()
    gone = stash(gone, "gone")
    side = F.broadcast(gone) if fits_broadcast(gone, BROADCAST_IDS) else gone
    kept = docs.join(side, (docs["doc_id"].cast("long") == side["_doc"]) & (F.xxhash64(docs["text"]) == side["_tx"]), "left_anti")
    twice = found.groupBy("doc_id", "tx").count().where("count > 1")
    if fits_broadcast(twice, 0):
        return kept
    # a name of its own, as docs may have any columns
    mark = next(n for n in (f"_near_tx{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    named = kept.where(kept["doc_id"].isNotNull()).withColumn(mark, F.xxhash64("text")).dropDuplicates(["doc_id", mark]).drop(mark)
    return named.union(kept.where(kept["doc_id"].isNull()))
