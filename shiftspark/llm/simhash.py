"""SimHash near-duplicates: fingerprints of shingles, BK-trees over shards, components.

1. Every text's 64-bit fingerprint is made from its word shingles in one scan.
2. Equal fingerprints become one node, named by the fingerprint itself.
3. Two fingerprints within ``radius`` bits agree on at least ``blocks - radius``
   of ``blocks`` bit blocks, so each goes to one bucket for every choice of that
   many blocks, and no pair is missed. A bucket is a shard of the search.
4. A task builds a BK-tree for each of its buckets (children keyed by their
   Hamming distance to the parent) and follows only edges within the radius.
   All trees of a task are built and searched together, a level at a time, in
   NumPy. Only one link per node leaves the task: a star to the smallest node of
   each local component, never the pairs of a group.
5. A bucket over ``bucket_rows`` is dealt into chunks, and every pair of chunks
   becomes a shard, so no task holds an unbounded bucket and no pair is lost.
6. Alternating stars join the local components. The smallest doc_id of a
   component's rows only names the result.

The trees are not broadcast whole: fingerprints grow with the corpus, so trees of
all shards have no size bound. The bucket key sends each fingerprint to the few
trees that can hold a neighbour instead.

Nulls, empties, repeats: null and empty texts have fingerprint zero and link like
any other; a null doc_id gets its fingerprint and its component, and names none
(a component without any doc_id is named null); repeated rows each get a row,
rows that share a doc_id each by their own text; a very long text is hashed
whole, its bits counted a run of shingles at a time; at ties a bit is not set,
as it needs over half; an empty table gives no rows; other columns, whatever
their names, are ignored (drop_near_duplicates passes them through).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftspark.llm.common import bytes_of, fits_broadcast, stash, table, tidied
from shiftspark.llm.components import connected_components, keep_first, unite

SEED = 42
SHINGLE_WORDS = 4
RADIUS = 4
BLOCKS = 6
BUCKET_ROWS = 20_000
#: Keyed fingerprints that a task sorts and searches, about; there are more tasks where there is more to search.
TASK_ROWS = 1_000_000
#: Tree nodes visited at a time; bounds a task's memory.
FRONTIER = 500_000
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 17


def shingle_hashes(text: bytes, words_each: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of every shingle of an ASCII-lower-cased text, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    n = len(words)
    if n <= words_each:
        return [xxh64_intdigest(b" ".join(words), SEED)] if n else []
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - words_each + 1].tolist()
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[words_each - 1 :].tolist())]


_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
#: The bits of a byte, each in a byte of its own: sums of up to LANE_ROWS of them do not overflow.
_LANES = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], "<u8")
LANE_ROWS = 255


def majority(hashes: list[int] | np.ndarray, sizes: list[int]) -> np.ndarray:
    """Fingerprints of consecutive runs of hashes: the bits set in over half of a run."""
    sizes, octets = np.array(sizes, np.int64), np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    pieces = -(-sizes // LANE_ROWS)
    run = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = (np.cumsum(sizes) - sizes)[run] + LANE_ROWS * nth
    ones = np.zeros((len(sizes), 64), np.int64)
    first = 0
    while first < len(run):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + COUNTED, "left")))
        end = starts[last] if last < len(run) else len(octets)
        lanes = _LANES[octets[starts[first] : end].T]
        sums = np.ascontiguousarray(np.add.reduceat(lanes, starts[first:last] - starts[first], axis=1).T).view(np.uint8)
        own = run[first:last]
        heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ones[own[heads]] += np.add.reduceat(sums, heads, axis=0, dtype=np.int64)
        first = last
    return ((2 * ones > sizes[:, None]) * _BITS).sum(axis=1, dtype=np.uint64)


def _fingerprints_of(texts: pa.Array, words_each: int) -> np.ndarray:
    out, hashes, sizes = [], [], []
    for text in bytes_of(texts):
        own = shingle_hashes(text, words_each)
        hashes += own
        sizes.append(len(own))
        if len(hashes) >= COUNTED:
            out.append(majority(hashes, sizes))
            hashes, sizes = [], []
    out.append(majority(hashes, sizes))
    return np.concatenate(out).view(np.int64)


def fingerprints(docs: DataFrame, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, tx (a text's hash), fp (the 64 bits as a signed long)."""

    @tidied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_fingerprints_of(batch.column(2), words_each))], ["doc_id", "tx", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tx"), "text").mapInArrow(run, "doc_id long, tx long, fp long")


# --- BK-trees -----------------------------------------------------------------


def build_forest(tree: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A BK-tree for each run of equal ``tree`` (sorted; fp distinct within a run).

    Returns each node's root, and the edges as sorted codes parent * 65 +
    distance with their children: an edge range is then two binary searches.
    """
    n = len(fp)
    is_root = np.ones(n, bool)
    is_root[1:] = tree[1:] != tree[:-1]
    root = np.maximum.accumulate(np.where(is_root, np.arange(n), 0))
    rest = np.flatnonzero(~is_root)
    at, codes, children = root[rest], [], []
    while len(rest):
        code = at * 65 + np.bitwise_count(fp[rest] ^ fp[at])
        found, first, place = np.unique(code, return_index=True, return_inverse=True)
        codes.append(found)
        children.append(rest[first])
        left = np.ones(len(rest), bool)
        left[first] = False
        at, rest = children[-1][place[left]], rest[left]
    if not codes:
        return root, np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, child = np.concatenate(codes), np.concatenate(children)
    order = np.argsort(code)
    return root, code[order], child[order]


def search_forest(root: np.ndarray, code: np.ndarray, child: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (node, other) within the radius, every pair of a tree once or twice."""
    size = np.bincount(root, minlength=len(root))[root]
    ends = np.cumsum(size)
    first = 0
    while first < len(root):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + FRONTIER, "right")))
        q = np.arange(first, last)
        node = root[q]
        while len(q):
            d = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
            hit = (d <= radius) & (node < q)
            if hit.any():
                yield q[hit], node[hit]
            low = np.searchsorted(code, node * 65 + np.maximum(d - radius, 0), "left")
            count = np.searchsorted(code, node * 65 + np.minimum(d + radius, 64), "right") - low
            q, ends_at = np.repeat(q, count), np.cumsum(count)
            node = child[np.repeat(low - ends_at + count, count) + np.arange(len(q))]
        first = last


def _paired(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, fp) in order, without keys of one fingerprint."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:] == key[:-1]) & (fp[1:] == fp[:-1])
    key, fp = key[~same], fp[~same]
    paired = np.zeros(len(key), bool)
    paired[1:] = key[1:] == key[:-1]
    paired[:-1] |= paired[1:]
    return key[paired], fp[paired]


def star_links(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span each component of the trees: from a fingerprint to the smallest that it reaches."""
    key, fp = _paired(key, fp)
    names, local = np.unique(fp.view(np.int64), return_inverse=True)
    label = np.arange(len(names))
    for a, b in search_forest(*build_forest(key, fp), fp, radius):
        label = unite(label, local[a], local[b])
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def nearest_links(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between direct neighbours: from a node to the nearest of those before it in its tree."""
    key, fp = _paired(key, fp)
    best = np.full(len(fp), 65 * len(fp), np.int64)  # distance * nodes + node
    for a, b in search_forest(*build_forest(key, fp), fp, radius):
        np.minimum.at(best, a, np.bitwise_count(fp[a] ^ fp[b]).astype(np.int64) * len(fp) + b)
    found = np.flatnonzero(best < 65 * len(fp))
    names = fp.view(np.int64)
    return names[found], names[best[found] % max(1, len(fp))]


# --- Spark --------------------------------------------------------------------


def _masks(blocks: int, keep: int) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(own[i] for i in chosen) for chosen in combinations(range(blocks), keep)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS, links=star_links) -> DataFrame:
    """Links (a, b) between fingerprints within ``radius`` bits, by default ones that span every component.

    nodes: fp (distinct). See the module's notes for the steps.
    """
    if blocks <= radius:
        raise ValueError("blocks must exceed radius")
    masks = _masks(blocks, blocks - radius)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])
    keyed = nodes.select("fp", F.explode(keys).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows)
    sizes = stash(sizes, "buckets")
    chunks = F.ceil(F.col("n") / bucket_rows)
    more = sizes.agg(F.sum(F.col("n") * (chunks - 1))).first()[0]
    if not more:
        dealt = keyed
    else:
        large = F.broadcast(sizes) if fits_broadcast(sizes, 100_000) else sizes
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
        others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.xxhash64("key", F.least(j, F.col("own")), F.greatest(j, F.col("own"))))
        dealt = (
            keyed.join(large, "key", "left")
            .withColumn("chunks", F.coalesce(chunks.cast("int"), F.lit(1))).withColumn("own", own)
            .select("fp", F.explode(F.when(F.col("chunks") > 1, others).otherwise(F.array("key"))).alias("key"))
        )

    @tidied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.asarray(c) for c in batch.columns] for batch in batches]
        if parts:
            key, fp = (np.concatenate(x) for x in zip(*parts))
            a, b = links(key, fp.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    # a task's rows are bounded by the number of tasks, which follows the number of rows
    rows = nodes.count() * len(masks) + int(more or 0)
    shards = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return dealt.select("key", "fp").repartition(shards, "key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words_each: int = SHINGLE_WORDS, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, tx, fp, fingerprint (16 hex digits), component (of fingerprints), component_id for every row of docs."""
    rows = stash(fingerprints(docs, words_each), "fingerprints")
    nodes = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    parts = connected_components(near_links(nodes.select("fp"), radius, blocks, bucket_rows), "a", "b")
    parted = stash(nodes.join(parts, nodes["fp"] == parts["node"], "left").where("n > 1 or node is not null").select("fp", "rep", F.coalesce("component", "fp").alias("component")), "parted")
    # written, as the table of classes below, so that a component or fingerprint of very many rows is split by adaptive execution
    named = stash(parted.groupBy("component").agg(F.min("rep").alias("component_id")), "named")
    classes = stash(parted.select("fp", "component").join(named, "component"), "classes")
    joined = rows.join(classes, "fp", "left").withColumn("in", F.col("component").isNotNull())
    return joined.select(
        "doc_id", "tx", "fp", hex16("fp").alias("fingerprint"), F.coalesce("component", "fp").alias("component"),
        F.when(F.col("in"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def hex16(name: str) -> Column:
    return F.lower(F.lpad(F.hex(name), 16, "0"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component of fingerprints: see components.keep_first."""
    return keep_first(docs, near_duplicates(docs, **options))


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
