"""SimHash near-dedup of the pipeline: fingerprint neighbours first, then all pairs of Jaccard 0.8.

1. Every text becomes the set of its five-word shingle hashes; equal sets are one
   node, named by a hash of the set. The set's SimHash is its fingerprint.
2. Fingerprints within ``radius`` bits are found by BK-trees over shards, as in
   ``simhash``; each goes with its nearest neighbours. These pairs are compared
   exactly and joined: most near copies of a large group meet here.
3. A radius that holds every pair of similarity 0.8 (about 10 of 64 bits apart, by
   a deviation of 3) would let most buckets meet. So the pairs beyond it are found
   exactly: two sets of similarity s or more share a shingle among the first
   ``n - ceil(s * n) + 1`` of each, in any order that holds for all sets. A node
   goes under those shingles, and no pair is missed. The order puts shingles last
   that a sample of documents shows to be common.
4. Shingles whose nodes are joined already are left out. Of the others, first the
   smallest node of each is compared with the rest, then all pairs that are not
   joined yet. A pair is left out if the sizes of its sets, or the shingles left
   after this one, rule the similarity out, or if four fingerprints of theirs are
   over ``FAR`` of 256 bits apart. A shingle with many nodes is dealt in chunks, and every
   pair of chunks is a shard.
5. A shingle under which very many pairs are left, as in a large group of texts
   that are nearly similar, gives out no pairs. Nodes that such shingles connect
   form a cluster; its nodes with their sets are dealt in blocks, and each pair of
   blocks is compared exactly within one task, which gives out only the links that
   join nodes.
6. Components of the verified links are the groups of near-duplicates.

Nulls, empties, repeats: null and empty texts have the empty set and are alike;
a text under five words is one shingle; a very long text is taken whole, its set
in one row; ties of similarity 0.8 count; rows without a doc_id stay and drop no
other; rows that share a doc_id are judged by their own texts; repeated rows are
near-duplicates of each other; an empty table gives no rows; other columns,
whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftspark.llm.common import bytes_of, fits_broadcast, hash_sample, stash, tidied
from shiftspark.llm.components import BROADCAST_IDS, connected_components, keep_first
from shiftspark.llm.simhash import BLOCKS, COUNTED, RADIUS, TASK_ROWS, majority, near_links, nearest_links, shingle_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Documents that are looked at for common shingles, and in how many of them one is common.
SAMPLE = 4_000
COMMON_IN = 4
#: Common shingles kept, the most frequent first (8 bytes each, in every task).
COMMON = 20_000
#: Sets of similarity 0.8 are over so many of 256 bits apart with a probability under 1e-6 (binomial), from 10 shingles
#: on; smaller sets are not judged by it.
FAR = 72
FAR_SHINGLES = 10
FP = ["fp", "fp1", "fp2", "fp3"]
#: Nodes of one shingle that are compared in one task; beyond, chunks of so many meet pair by pair.
KEY_ROWS = 4_000
#: A shingle that has over so many pairs left for each of its nodes gives its nodes to blocks, of so many nodes each.
DENSE = 16
BLOCK_ROWS = 400


def shingle_set(text: bytes, words_each: int) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    return np.unique(np.array(shingle_hashes(text, words_each), np.uint64).view(np.int64))


def set_id(shingles: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(shingles.tobytes())
    return x - (1 << 64) if x >= 1 << 63 else x


def prefix(shingles: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, common ones last, of which similar sets share one."""
    n = len(shingles)
    if not n:
        return shingles
    length = n - int(np.ceil(similarity * n - 1e-9)) + 1
    if len(common):
        last = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
        shingles = np.concatenate([shingles[~last], shingles[last]])
    return shingles[:length]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def common_shingles(docs: DataFrame, words_each: int = SHINGLE_WORDS) -> np.ndarray:
    """Shingles that many documents of a sample hold, sorted. They only order the search."""

    @tidied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in bytes_of(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, words_each))], ["s"])

    sample = hash_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), SAMPLE, "doc_id", "text")
    counts = sample.select("text").mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_IN)
    top = counts.orderBy(F.desc("n"), "s").limit(COMMON).collect()
    return np.sort(np.array([r["s"] for r in top], np.int64))


_MIX = np.random.default_rng(20_240_702).integers(1, 2**62, len(FP), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _remixed(hashes: np.ndarray, i: int) -> np.ndarray:
    """Other hashes of the same shingles; the first are the hashes themselves."""
    if not i:
        return hashes
    x = (hashes ^ (hashes >> np.uint64(32))) * _MIX[i]
    return x ^ (x >> np.uint64(29))


def _simhashes(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The four fingerprints of sets, some sets at a time."""
    out, first, n = [np.zeros((0, len(FP)), np.int64)], 0, 0
    for i, own in enumerate(sets, 1):
        n += len(own)
        if n >= COUNTED or i == len(sets):
            hashes, sizes = np.concatenate(sets[first:i]).view(np.uint64), [len(x) for x in sets[first:i]]
            out.append(np.column_stack([majority(_remixed(hashes, k), sizes).view(np.int64) for k in range(len(FP))]))
            first, n = i, 0
    return list(np.concatenate(out).T)


def nodes(docs: DataFrame, similarity: float = SIMILARITY, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, tx (a text's hash), sh (its set), n (shingles in it), fp to fp3 (their SimHashes), keys (its prefix)."""
    common = common_shingles(docs, words_each)

    @tidied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, words_each) for text in bytes_of(batch.column(2))]
            ids, sizes = pa.array([set_id(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids, sizes, *map(pa.array, _simhashes(sets)), _lists([prefix(x, common, similarity) for x in sets])], ["doc_id", "tx", "sh", "n", *FP, "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tx"), "text").mapInArrow(run, "doc_id long, tx long, sh long, n int, fp long, fp1 long, fp2 long, fp3 long, keys array<long>")


def neighbours(own: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are equal or near, for the exact comparison; own: sh, fp."""
    leads = stash(own.groupBy("fp").agg(F.min("sh").alias("lead"), F.count("*").alias("n")), "leads")
    equal = own.join(leads.where("n > 1"), "fp").where("sh <> lead").select(F.col("lead").alias("a"), F.col("sh").alias("b"))
    near = near_links(leads.select("fp"), radius, blocks, links=nearest_links).distinct()
    left, right = leads.select(F.col("fp").alias("a"), F.col("lead").alias("x")), leads.select(F.col("fp").alias("b"), F.col("lead").alias("y"))
    apart = near.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return stash(equal.union(apart), "neighbours")


def _met(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    """The columns of a partition, sorted by the first two."""
    parts = [[np.asarray(c) for c in batch.columns] for batch in batches]
    if not parts:
        return None
    columns = [np.concatenate(x) for x in zip(*parts)]
    order = np.lexsort((columns[1], columns[0]))
    return [c[order] for c in columns]


def _shards(df: DataFrame, rows: int) -> int:
    """So many tasks that one has about TASK_ROWS rows, and no fewer than the session's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def shared_places(own: DataFrame) -> DataFrame:
    """key, sh, pos of the prefix shingles that two sets have."""

    @tidied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come in the order of their keys; the last of a batch waits for the next
        last, given = None, True
        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            if last is not None:
                columns = [np.concatenate(x) for x in zip(last, columns)]
            same = columns[0][1:] == columns[0][:-1]
            held = np.r_[same, False] | np.r_[False, same]
            if last is not None and given:
                held[0] = False
            last, given = [c[-1:] for c in columns], bool(held[-1]) or (given and last is not None and len(held) == 1)
            yield pa.RecordBatch.from_arrays([pa.array(c[held]) for c in columns], ["key", "sh", "pos"])

    rows = own.agg(F.sum(F.size("keys").cast("long"))).first()[0] or 0
    keyed = own.select("sh", F.posexplode("keys").alias("pos", "key")).select("key", "sh", "pos")
    return keyed.repartition(_shards(own, rows), "key").sortWithinPartitions("key").mapInArrow(run, "key long, sh long, pos int")


def mixed(places: DataFrame, own: DataFrame, parts: DataFrame) -> DataFrame:
    """places (key, sh, pos) of keys with nodes of two parts, with n, fp to fp3, part and met, the key's nodes; parts: node, component."""
    facts = own.select("sh", "n", *FP).join(parts, F.col("sh") == F.col("node"), "left").select("sh", "n", *FP, F.coalesce("component", "sh").alias("part"))
    parted = stash(places.select("key", "sh", "pos").join(facts, "sh").select("key", "sh", "n", "pos", "part", *FP), "parted")
    keys = parted.groupBy("key").agg(F.count("*").alias("met"), F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("key", "met")
    return stash(parted.join(stash(keys, "mixedkeys"), "key"), "mixed")


def star_candidates(places: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) that can be similar, each of a key's smallest node and another; places: see mixed."""
    first = places.groupBy("key").agg(F.min(F.struct("sh", "n", "pos", "part", *FP)).alias("f"))
    pairs = places.join(stash(first, "stars"), "key").where(F.col("part") != F.col("f.part"))
    small, large = F.least("n", "f.n"), F.greatest("n", "f.n")
    most = F.least(F.col("n") - F.col("pos"), F.col("f.n") - F.col("f.pos"))
    bits = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"f.{w}"))) for w in FP), F.lit(0))
    fits = (small + 1e-9 >= similarity * large) & (most + 1e-9 >= similarity / (1 + similarity) * (F.col("n") + F.col("f.n"))) & ((small < FAR_SHINGLES) | (bits <= FAR))
    return stash(pairs.where(fits).select(F.col("f.sh").alias("a"), F.col("sh").alias("b")).distinct(), "candidates")


def _fitting(i: np.ndarray, j: np.ndarray, n: np.ndarray, pos: np.ndarray, part: np.ndarray, words: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the index pairs that can be similar and are of two parts."""
    apart = part[i] != part[j]
    i, j = i[apart], j[apart]
    small, most = np.minimum(n[i], n[j]), np.minimum(n[i] - pos[i], n[j] - pos[j])
    fits = (small + 1e-9 >= similarity * np.maximum(n[i], n[j])) & (most + 1e-9 >= similarity / (1 + similarity) * (n[i] + n[j]))
    i, j, small = i[fits], j[fits], small[fits]
    bits = sum((np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in words), np.zeros(len(i), np.int64))
    fits = (small < FAR_SHINGLES) | (bits <= FAR)
    return i[fits], j[fits]


def candidates(places: DataFrame, similarity: float, key_rows: int = KEY_ROWS, dense: int = DENSE) -> DataFrame:
    """Distinct (key, null, null) of keys with too many pairs, and (null, a, b) of all other keys: pairs that can be similar and are of two parts; places: see mixed."""
    chunks = F.ceil(F.col("met") / key_rows).cast("int")
    own = F.pmod(F.xxhash64("sh", F.lit(7)), chunks).cast("int")
    dealt = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.xxhash64("home", F.least(j, F.col("own")), F.greatest(j, F.col("own"))))
    keys = F.when(chunks > 1, dealt).otherwise(F.array("home"))
    spread = places.withColumnRenamed("key", "home").withColumn("own", own).select(F.explode(keys).alias("key"), "sh", "home", "n", "pos", "part", *FP)
    rows = places.agg(F.sum(chunks.cast("long"))).first()[0] or 0

    @tidied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _met(batches)
        if not columns:
            return
        key, sh, home, n, pos, part = columns[:6]
        words = [c.view(np.uint64) for c in columns[6:]]
        own = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))  # every row's key, numbered
        left = dense * np.bincount(own)  # pairs that a key may still give out
        at, back, found = np.arange(1, len(key)), 1, []
        while len(at):
            at = at[at >= back]
            at = at[(own[at - back] == own[at]) & (left[own[at]] >= 0)]
            i, j = _fitting(at, at - back, n, pos, part, words, similarity)
            left -= np.bincount(own[i], minlength=len(left))
            if len(i):
                found.append(np.stack([i, j]))
            back += 1
        crowded = home[np.flatnonzero(np.diff(own, prepend=-1))][left < 0]
        i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        i, j = i[left[own[i]] >= 0], j[left[own[i]] >= 0]
        pairs = np.unique(np.stack([sh[i], sh[j]]), axis=1)
        none = pa.nulls(len(crowded), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(crowded, pa.int64()), none, none], ["key", "a", "b"])
        yield pa.RecordBatch.from_arrays([pa.nulls(pairs.shape[1], pa.int64()), pa.array(pairs[0]), pa.array(pairs[1])], ["key", "a", "b"])

    return stash(spread.repartition(_shards(places, rows), "key").mapInArrow(run, "key long, a long, b long").distinct(), "candidates")


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both + 1e-9 >= similarity * (len(x) + len(y) - both)


def block_links(sh: np.ndarray, part: np.ndarray, words: list[np.ndarray], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of similar sets that join parts not joined before, by exact comparison of all pairs that the bounds leave."""
    n = np.array([len(x) for x in sets], np.int64)
    found, words, whole = [], [w.view(np.uint64) for w in words], np.zeros(len(n), np.int64)
    for back in range(1, len(n)):
        i, j = _fitting(np.arange(back, len(n)), np.arange(len(n) - back), n, whole, part, words, similarity)
        if len(i):
            found.append(np.stack([sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in words), i, j]))
    if not found:
        return []
    names = {p: p for p in part.tolist()}

    def top(x: int) -> int:
        while names[x] != x:
            names[x] = x = names[names[x]]
        return x

    links = []
    found = np.concatenate(found, axis=1)
    # the nearest first: what they join needs no comparison
    for _, i, j in found[:, np.argsort(found[0], kind="stable")].T.tolist():
        x, y = top(int(part[i])), top(int(part[j]))
        if x != y and _similar(sets[i], sets[j], similarity):
            names[x] = y
            links.append((int(sh[i]), int(sh[j])))
    return links


def dense_links(docs: DataFrame, own: DataFrame, places: DataFrame, keys: DataFrame, similarity: float, words_each: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) among the nodes of crowded keys; keys: key; places: see mixed."""
    crowded = stash(places.join(stash(keys, "crowded"), "key").select("key", "sh"), "crowdedplaces")
    hubs = stash(crowded.groupBy("key").agg(F.min("sh").alias("hub")), "hubs")
    clusters = stash(connected_components(crowded.join(hubs, "key").select("sh", "hub").distinct(), "sh", "hub"), "clusters")
    sizes = stash(clusters.groupBy("component").agg(F.count("*").alias("met")), "clustersizes")
    nodes_ = places.select("sh", "part", *FP).distinct().join(clusters, F.col("sh") == F.col("node"))
    chunks = F.ceil(F.col("met") / block_rows).cast("int")
    dealt = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.xxhash64("component", F.least(j, F.col("own")), F.greatest(j, F.col("own"))))
    blocks = nodes_.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("sh", F.lit(7)), chunks).cast("int")).select(F.explode(dealt).alias("block"), "sh", "part", *FP)
    blocks = stash(blocks, "blocks")
    sets = sets_of(docs, own, blocks.select("sh"), words_each)

    @tidied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a block's rows follow each other; it holds at most two chunks
        block, rows = None, []

        def done() -> pa.RecordBatch:
            parts = [np.array(c, np.int64) for c in list(zip(*rows))[:-1]]
            links = block_links(parts[0], parts[1], parts[2:], [r[-1] for r in rows], similarity)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

        for batch in batches:
            shingles = batch.column(batch.num_columns - 1)
            ends, values = np.asarray(shingles.offsets), np.asarray(shingles.values)
            for k, row in enumerate(zip(*(c.to_pylist() for c in batch.columns[:-1]))):
                if row[0] != block:
                    if rows:
                        yield done()
                    block, rows = row[0], []
                rows.append((*row[1:], values[ends[k] : ends[k + 1]].copy()))
        if rows:
            yield done()

    full = blocks.join(sets, "sh").select("block", "sh", "part", *FP, "shingles")
    count = blocks.count()
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // (2 * block_rows)))
    return stash(full.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(run, "a long, b long"), "denselinks")


def verified(docs: DataFrame, own: DataFrame, pairs: DataFrame, similarity: float, words_each: int) -> DataFrame:
    """The pairs (a, b) of at least that Jaccard similarity."""

    @tidied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (xe, x), (ye, y) = ((np.asarray(c.offsets), np.asarray(c.values)) for c in batch.columns[2:])
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                ok[i] = _similar(x[xe[i] : xe[i + 1]], y[ye[i] : ye[i + 1]], similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["a", "b"])

    sets = sets_of(docs, own, pairs.select(F.col("a").alias("sh")).union(pairs.select("b")), words_each)
    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    return stash(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "verified")


def sets_of(docs: DataFrame, own: DataFrame, wanted: DataFrame, words_each: int) -> DataFrame:
    """sh, shingles of the nodes that are ``wanted`` (sh)."""
    wanted = own.join(wanted.distinct(), "sh").select(F.col("d.doc_id").alias("_doc"), F.col("d.tx").alias("_tx"), F.col("sh").alias("_sh"))
    wanted = stash(wanted, "wanted")
    side = F.broadcast(wanted) if fits_broadcast(wanted, BROADCAST_IDS) else wanted
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(side, texts["doc_id"].eqNullSafe(side["_doc"]) & (F.xxhash64(texts["text"]) == side["_tx"])).select("_sh", "text")

    @tidied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_set(t, words_each) for t in bytes_of(batch.column(1))])], ["sh", "shingles"])

    # rows that repeat id and text are one node
    return stash(found.mapInArrow(run, "sh long, shingles array<long>").dropDuplicates(["sh"]), "sets")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, tx, component of every row of docs: rows of one component are near-duplicates."""
    rows = stash(nodes(docs, similarity, words_each), "shinglesets")
    own = stash(rows.groupBy("sh").agg(F.min(F.struct("doc_id", "tx")).alias("d"), F.max("n").alias("n"), *[F.max(w).alias(w) for w in FP], F.max("keys").alias("keys")), "nodes")
    places = stash(shared_places(own), "places")
    near = verified(docs, own, neighbours(own), similarity, words_each)
    places = mixed(places, own, connected_components(near, "a", "b"))
    near = near.union(verified(docs, own, star_candidates(places, similarity), similarity, words_each))
    places = mixed(places, own, connected_components(near, "a", "b"))
    found = candidates(places, similarity)
    near = near.union(verified(docs, own, found.where("key is null").select("a", "b"), similarity, words_each))
    crowded = found.where("key is not null").select("key").distinct()
    if not fits_broadcast(crowded, 0):
        near = near.union(dense_links(docs, own, places, crowded, similarity, words_each))
    same = stash(connected_components(near, "a", "b"), "same")
    return rows.join(same, rows["sh"] == same["node"], "left").select("doc_id", "tx", F.coalesce("component", "sh").alias("component"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component: see components.keep_first."""
    return keep_first(docs, near_duplicates(docs, **options))
