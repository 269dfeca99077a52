"""Product codes of vectors, with codebooks by Lloyd's rounds over heaps of slack.

A vector is cut into equal parts, each part position has a codebook of its own, and a part's code
is its nearest entry. After its first exact scan a part sits in the heap of its entry, keyed by the slack
between its lower bound (second nearest entry) and its upper bound (own entry), plus the
cumulative drift of that entry when it was put there. A round moves the entries and adds
to each entry's cumulative drift how far it moved itself and how far any other did at most. From each heap the round
pops the parts whose key the drift has passed, and scans those alone against the codebook; all
others keep their entry. Heaps are local to a block of vectors (see intvectors.py) and are kept as they lie.
Entries' sums change by what moved, added up by Spark; codebooks are parts x entries x part length
numbers, whatever the table's size.

Rows: vectors that are null, hold null or non-finite components, are empty or not to be cut into equal
parts, have another length than the kept one of smallest vec_id, or exceed intvectors.LARGEST are dropped. Repeated rows are separate vectors.
A null vec_id comes after all others among the starts; equal ids are ordered by their components. Ties go to
the lower index. Other columns are ignored. Fewer vectors than entries make smaller codebooks;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftspark.llm.common import stash, table, tidied
from shiftspark.llm.intvectors import COLUMNS, SLACK, added_up, change_rows, packed, read_vectors, squared, squared_pairs, unpacked, whole_vectors

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Parts that are scanned against a codebook at a time.
SCAN = 4096


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (ties: the lower index), and the slack of its bounds, rounded down."""
    own, slack = np.empty(len(x), np.int64), np.empty(len(x))
    for first in range(0, len(x), SCAN):
        d = squared(x[first : first + SCAN], book)
        at = np.arange(len(d))
        best = d.argmin(axis=1)
        near = d[at, best].astype(np.float64)
        rest = d.astype(np.float64)
        rest[at, best] = np.inf
        own[first : first + SCAN] = best
        slack[first : first + SCAN] = np.sqrt(rest.min(axis=1)) * (1 - SLACK) - np.sqrt(near) * (1 + SLACK)
    return own, slack


def _key(slack: np.ndarray, passed: np.ndarray) -> np.ndarray:
    """A heap key: slack counted from the drift so far; rounded down."""
    return slack + passed - 1e-12 * (1 + passed)


class Heaps:
    """Heaps of (key, part) of one part position, one for each entry, flat in heap order between rounds."""

    def __init__(self, keys: np.ndarray, members: np.ndarray, sizes: np.ndarray):
        self.keys, self.members, self.sizes = keys, members, sizes

    @staticmethod
    def of(own: np.ndarray, keys: np.ndarray, entries: int) -> Heaps:
        order = np.lexsort((keys, own))  # a sorted list is a heap
        return Heaps(keys[order], order, np.bincount(own, minlength=entries))

    @property
    def own(self) -> np.ndarray:
        out = np.empty(len(self.members), np.int64)
        out[self.members] = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return out

    def settle(self, x: np.ndarray, book: np.ndarray, passed: np.ndarray) -> tuple[Heaps, int]:
        """Pop what the drift has passed, scan it exactly, and put it into its entry's heap; how many were popped."""
        edges = np.concatenate([[0], np.cumsum(self.sizes)])
        heaps: dict[int, list] = {}

        def heap(e: int) -> list:
            if e not in heaps:
                a, b = edges[e], edges[e + 1]
                heaps[e] = list(zip(self.keys[a:b].tolist(), self.members[a:b].tolist()))
            return heaps[e]

        popped = []
        for e in np.flatnonzero(self.sizes):
            if self.keys[edges[e]] <= passed[e]:
                own = heap(int(e))
                while own and own[0][0] <= passed[e]:
                    popped.append(heapq.heappop(own)[1])
        if not popped:
            return self, 0
        popped = np.array(popped)
        best, slack = _nearest(x[popped], book)
        for e, key, i in zip(best.tolist(), _key(slack, passed[best]).tolist(), popped.tolist()):
            heapq.heappush(heap(e), (key, i))
        keys, members, sizes = [], [], []
        for e in range(len(self.sizes)):
            if e in heaps:
                keys.append(np.array([k for k, _ in heaps[e]]))
                members.append(np.array([i for _, i in heaps[e]], np.int64))
            else:
                keys.append(self.keys[edges[e] : edges[e + 1]])
                members.append(self.members[edges[e] : edges[e + 1]])
            sizes.append(len(keys[-1]))
        return Heaps(np.concatenate(keys), np.concatenate(members), np.array(sizes)), len(popped)

    def packed(self) -> bytes:
        return self.keys.astype(np.float64).tobytes() + self.sizes.astype(np.int32).tobytes() + self.members.astype(np.int32).tobytes()

    @staticmethod
    def unpacked(blob: bytes, entries: int) -> Heaps:
        n = (len(blob) - 4 * entries) // 12
        sizes, members = np.split(np.frombuffer(blob, np.int32, entries + n, 8 * n).astype(np.int64), [entries])
        return Heaps(np.frombuffer(blob, np.float64, n), members, sizes)


def product_codes(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray], int]:
    """(vec_id, label, codes (an index a part), error), the final codebooks, and how many parts the rounds scanned again."""
    spark = embeddings.sparkSession
    rows = whole_vectors(embeddings).where(F.size("x") % parts == 0)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").first()
    schema = "vec_id long, label string, codes array<int>, error long"
    if first is None:
        return spark.createDataFrame([], schema), [], 0
    length = len(first["x"])
    size = length // parts
    rows = rows.where(F.size("x") == length)
    starts = np.array([r["x"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()], np.int64)
    books = [starts[:, p * size : (p + 1) * size] for p in range(parts)]
    k = len(starts)
    told = [f"told{p}" for p in range(parts)]
    names = ["ids", "labels", "x", "width", *[f"heaps{p}" for p in range(parts)], *told, "scanned"]
    state_schema = COLUMNS + "".join(f", heaps{p} binary" for p in range(parts)) + "".join(f", {t} binary" for t in told) + ", scanned long"
    part_of = lambda x, p: x[:, p * size : (p + 1) * size]
    columns = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("x", pa.binary()), ("width", pa.int32()), *[(n, pa.binary()) for n in names[4:-1]], ("scanned", pa.int64())])

    def started(books: list[np.ndarray]):
        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, heaps, changes = read_vectors(batch, length), [], []
                for p in range(parts):
                    own, slack = _nearest(part_of(x, p), books[p])
                    heaps.append(Heaps.of(own, _key(slack, np.zeros(len(own))), k).packed())
                    changes.append(change_rows(None, own, part_of(x, p), k))
                row = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), *packed(x), *heaps, *changes, 0]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, columns.types)], schema=columns)

        return run

    def settled(books: list[np.ndarray], passed: list[np.ndarray]):
        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, labels, blob, width, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                    x, heaps, changes, scanned = unpacked(blob, width, length), [], [], 0
                    for p in range(parts):
                        before = Heaps.unpacked(rest[p], k)
                        now, n = before.settle(part_of(x, p), books[p], passed[p])
                        changes.append(change_rows(before.own, now.own, part_of(x, p), k) if n else b"")
                        heaps.append(now.packed())
                        scanned += n
                    row = [ids, labels, blob, width, *heaps, *changes, scanned]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, columns.types)], schema=columns)

        return run

    state = stash(rows.mapInArrow(started(books), state_schema), "codes")
    sums, counts = np.zeros((parts, k, size), np.int64), np.zeros((parts, k), np.int64)
    passed, scanned = [np.zeros(k) for _ in range(parts)], 0
    for _ in range(rounds):
        found = added_up(state, told, size)
        np.add.at(counts, (found[:, 0], found[:, 1]), found[:, 2])
        np.add.at(sums, (found[:, 0], found[:, 1]), found[:, 3:])
        moved = [np.where(counts[p][:, None] > 0, sums[p] // np.maximum(counts[p], 1)[:, None], books[p]) for p in range(parts)]
        drift = [np.sqrt(squared_pairs(a, b).astype(np.float64)) * (1 + SLACK) for a, b in zip(books, moved)]
        if not any(d.any() for d in drift):
            break
        books, passed = moved, [q + d + _others(d) for q, d in zip(passed, drift)]
        state = stash(state.select(*names[:-1]).mapInArrow(settled(books, passed), state_schema), "codes")
        scanned += state.agg(F.sum("scanned")).first()[0] or 0

    @tidied
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, blob, width, *heaps in zip(*(c.to_pylist() for c in batch.columns)):
                x = unpacked(blob, width, length)
                own = np.stack([Heaps.unpacked(h, k).own for h in heaps], axis=1)
                error = sum(squared_pairs(part_of(x, p), books[p][own[:, p]]) for p in range(parts))
                codes = pa.FixedSizeListArray.from_arrays(pa.array(own.ravel().astype(np.int32)), parts).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), codes, pa.array(error)], ["vec_id", "label", "codes", "error"])

    return stash(state.select(*names[: 4 + parts]).mapInArrow(coded, schema), "coded"), books, scanned


def _others(drift: np.ndarray) -> np.ndarray:
    """For each entry, how far another one moved at most."""
    if len(drift) < 2:
        return np.zeros(len(drift))
    second, first = np.sort(drift)[-2:]
    out = np.full(len(drift), first)
    out[drift.argmax()] = second
    return out


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def _op12_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    distance = "list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(v.x) AS x, min(struct_pack(d := {distance}, e := b.e)) AS best FROM cut v JOIN b{r} b USING (p) GROUP BY vec_id, p)"
        )
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
  SELECT p, best.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY 1, 2, 3) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (p, e))""")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 1024) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
cut AS MATERIALIZED (SELECT vec_id, p, x[p * (len(x) // {parts}) + 1:(p + 1) * (len(x) // {parts})] AS x FROM kept, range({parts}) r(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM cut QUALIFY e < {entries}),
{",".join(steps)},
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN kept USING (vec_id), book
"""


OP12_SQL = _op12_sql()


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    found, books, _ = product_codes(table(spark, sf_dir, "embeddings"))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    by_label = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return found.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
