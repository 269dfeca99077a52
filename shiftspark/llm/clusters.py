"""k centroids over all vectors, by Yinyang's grouped bounds.

The starting centroids are grouped once, by a few rounds of k-means among themselves. Each vector keeps
an upper bound of the distance to its own centroid and, for every group, a lower bound of the
distance to the group's other centroids. A round moves the bounds by the drift of centroids and groups. A vector
whose upper bound stays under all its lower bounds is left alone (the global filter); otherwise the
upper bound is made exact, groups with a higher lower bound are passed over, and in the
others the centroids that a bound of their own drift does not rule out are scanned exactly.
Distances are exact integers; bounds are rounded to the safe side, so that results are those
of plain rounds, ties too.

Blocks of vectors carry the bounds from round to round (see intvectors.py); centroids' sums change by
what moved. The centroids, k x length numbers, are all that the driver holds.

Rows: vectors that are null, of another length than ``length``, hold null or non-finite components or exceed
intvectors.LARGEST are dropped. Repeated rows are separate vectors; a null vec_id is never
a start before others, and equal ids are ordered by their components. Ties go to the smaller number, empty centroids stay. Other columns
are ignored. Fewer vectors than centroids make fewer centroids; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftspark.llm.common import stash, table, tidied
from shiftspark.llm.intvectors import COLUMNS, SLACK, added_up, change_rows, packed, read_vectors, squared, squared_pairs, unpacked, whole_vectors

K, LENGTH, ROUNDS, SALT = 8, 64, 10, 3


def grouped(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: k-means among the centroids, started from evenly spaced ones."""
    groups = max(1, min(groups, len(centroids)))
    points = centroids.astype(np.float64)
    centres = points[np.linspace(0, len(points) - 1, groups).astype(int)]
    for _ in range(rounds):
        own = ((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([points[own == g].mean(axis=0) if (own == g).any() else centres[g] for g in range(groups)])
    return np.unique(own, return_inverse=True)[1]


def first_scan(x: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """own, upper and lower (a column a group) by looking at every centroid."""
    d = squared(x, centroids)
    own = d.argmin(axis=1)
    far = np.sqrt(d.astype(np.float64))
    upper = far[np.arange(len(x)), own] * (1 + SLACK)
    far[np.arange(len(x)), own] = np.inf
    lower = np.stack([far[:, group == g].min(axis=1, initial=np.inf) for g in range(group.max() + 1)], axis=1) * (1 - SLACK)
    return own, upper, lower


def next_scan(x, own, upper, lower, centroids, group, drift) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """own, upper, lower after the centroids moved to ``centroids`` by ``drift``; and how many distances were measured."""
    groups = lower.shape[1]
    most = np.array([drift[group == g].max() for g in range(groups)])
    own, upper, before = own.copy(), upper + drift[own], lower
    lower = lower - most
    rest = np.flatnonzero(lower.min(axis=1) <= upper)  # the others pass the global filter
    if not len(rest):
        return own, upper, lower, 0
    exact = squared_pairs(x[rest], centroids[own[rest]])
    upper[rest] = np.sqrt(exact.astype(np.float64)) * (1 + SLACK)
    measured = len(rest)
    still = lower[rest].min(axis=1) <= upper[rest]
    rest, exact = rest[still], exact[still]
    mine, best, best_d = own[rest], own[rest].copy(), exact.copy()
    own_far = np.sqrt(exact.astype(np.float64)) * (1 - SLACK)
    bounds, scanned = lower[rest], []
    inside = group[mine]  # what leaves a group that is not scanned bounds it from now on
    for g in range(groups):
        open_ = np.flatnonzero(bounds[:, g] <= upper[rest])  # the others pass the group's filter
        members = np.flatnonzero(group == g)
        floor = np.empty((len(open_), len(members)))  # a lower bound of each member's distance
        for j, c in enumerate(members):
            is_own = mine[open_] == c
            floor[:, j] = np.where(is_own, own_far[open_], before[rest[open_], g] - drift[c])
            scan = np.flatnonzero(~is_own & (floor[:, j] <= upper[rest[open_]]))
            at = open_[scan]
            d = squared(x[rest[at]], centroids[c : c + 1])[:, 0].astype(np.int64)
            measured += len(scan)
            floor[scan, j] = np.sqrt(d.astype(np.float64)) * (1 - SLACK)
            nearer = (d < best_d[at]) | ((d == best_d[at]) & (c < best[at]))
            best[at[nearer]], best_d[at[nearer]] = c, d[nearer]
        scanned.append((open_, members, floor))
    left = np.flatnonzero(best != mine)
    bounds[left, inside[left]] = np.minimum(bounds[left, inside[left]], own_far[left])
    for g, (open_, members, floor) in enumerate(scanned):
        floor[best[open_][:, None] == members[None, :]] = np.inf
        bounds[open_, g] = floor.min(axis=1, initial=np.inf)
    own[rest], lower[rest] = best, bounds
    upper[rest] = np.sqrt(best_d.astype(np.float64)) * (1 + SLACK)
    return own, upper, lower, measured


def yinyang(embeddings: DataFrame, k: int = K, length: int = LENGTH, rounds: int = ROUNDS, salt: int = SALT, groups: int | None = None) -> tuple[DataFrame, np.ndarray, int]:
    """(vec_id, cluster, distance), the final centroids, and how many distances the rounds measured.

    Starts: the k vectors of smallest lower-case hex sha256 of "salt:vec_id". groups: by default about the root of k.
    """
    spark = embeddings.sparkSession
    rows = whole_vectors(embeddings).where(F.size("x") == length)
    lot = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    starts = np.array([r["x"] for r in rows.orderBy(F.asc_nulls_last(lot), "x").limit(k).collect()], np.int64).reshape(-1, length)
    schema = "vec_id long, cluster int, distance long"
    if not len(starts):
        return spark.createDataFrame([], schema), starts, 0
    k = len(starts)
    group = grouped(starts, groups or round(k**0.5))
    n_groups = int(group.max()) + 1
    state_schema = COLUMNS + ", own binary, upper binary, lower binary, told binary, measured long"
    names = ["ids", "labels", "x", "width", "own", "upper", "lower", "told", "measured"]
    types = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]

    def row(ids, labels, blob, width, own, upper, lower, told, measured) -> pa.RecordBatch:
        values = [ids, labels, blob, width, own.astype(np.int32).tobytes(), upper.tobytes(), lower.tobytes(), told, measured]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

    @tidied
    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = read_vectors(batch, length)
                own, upper, lower = first_scan(x, starts, group)
                yield row(batch.column(0).to_pylist(), None, *packed(x), own, upper, lower, change_rows(None, own, x, k), 0)

    def moved_on(centroids: np.ndarray, drift: np.ndarray):
        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, labels, blob, width, own, upper, lower in zip(*(c.to_pylist() for c in batch.columns)):
                    x, own = unpacked(blob, width, length), np.frombuffer(own, np.int32).astype(np.int64)
                    bounds = np.frombuffer(upper), np.frombuffer(lower).reshape(-1, n_groups)
                    now, up, low, n = next_scan(x, own, *bounds, centroids, group, drift)
                    yield row(ids, labels, blob, width, now, up, low, change_rows(own, now, x, k), n)

        return run

    state = stash(rows.mapInArrow(started, state_schema), "clusters")
    centroids, sums, counts, measured = starts, np.zeros((k, length), np.int64), np.zeros(k, np.int64), 0
    for _ in range(rounds):
        found = added_up(state, ["told"], length)
        np.add.at(counts, found[:, 1], found[:, 2])
        np.add.at(sums, found[:, 1], found[:, 3:])
        moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        drift = np.sqrt(squared_pairs(moved, centroids).astype(np.float64)) * (1 + SLACK)
        if not drift.any():  # nothing moves any more
            break
        centroids = moved
        state = stash(state.select(*names[:7]).mapInArrow(moved_on(centroids, drift), state_schema), "clusters")
        measured += state.agg(F.sum("measured")).first()[0] or 0

    @tidied
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, blob, width, own in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(own, np.int32)
                distance = squared_pairs(unpacked(blob, width, length), centroids[own])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return stash(state.select("ids", "x", "width", "own").mapInArrow(told, schema), "clustered"), centroids, measured


def _op13_sql(k: int = K, length: int = LENGTH, rounds: int = ROUNDS) -> str:
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v.x) AS x, min(struct_pack(d := {distance}, c := c.c)) AS best FROM kept v, c{r} c GROUP BY vec_id)")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
  SELECT best.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT best, x, unnest(range(1, {length + 1})) AS i FROM a{r}) GROUP BY 1, 2) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (c))""")
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 1024) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {length} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id)) - 1 AS c, x FROM kept QUALIFY c < {k}),
{",".join(steps)}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} f ON f.c = best.c
"""


OP13_SQL = _op13_sql()


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    found, centroids, _ = yinyang(table(spark, sf_dir, "embeddings"))
    sums = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())  # a row a centroid
    if not len(centroids):
        centroids = np.zeros((1, 1), np.int64)
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("cluster"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return found.select(
        "vec_id", "cluster", "distance", of([int(sums.get(c, 0)) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(int(sum(sums.values()))).cast("long").alias("inertia"), of(digests).alias("centroid_sha256"),
    )
