"""Queries whose parameters are given, so that SQL can follow operators that otherwise draw or fit them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shiftspark.operators import emissions, kernels, pointprocess
from shiftspark.plans.build import VECTORS, query, vectors
from shiftspark.plans.detectors import _BACK
from shiftspark.plans.models import _periods

_TEXT_ID = ("SELECT series_id, CAST(start", "SELECT CAST(series_id AS VARCHAR) AS series_id, CAST(start")


@query("WITH RECURSIVE " + f"""{VECTORS},
z AS (SELECT series_id, t, unnest(range(3)) AS k, unnest(list_transform(range(3), lambda k: sqrt(CAST(2 AS DOUBLE) / 3) * cos(list_dot_product(x, list_transform(range(64), lambda d: CAST((d * 3 + k * 5) % 7 - 3 AS DOUBLE) / 10)) + k + CAST(0.5 AS DOUBLE)))) AS z FROM vectors),
p AS (SELECT series_id, k, t, sum(z) OVER w AS s, sum(z * z) OVER w AS q FROM z WINDOW w AS (PARTITION BY series_id, k ORDER BY t)),
l AS (SELECT series_id, k, [CAST(0 AS DOUBLE)] || list(s ORDER BY t) AS s, [CAST(0 AS DOUBLE)] || list(q ORDER BY t) AS q FROM p GROUP BY 1, 2),
sums AS (SELECT series_id, any_value(len(s)) - 1 AS n, list(s ORDER BY k) AS s, list(q ORDER BY k) AS q FROM l GROUP BY 1),
step AS (
  SELECT series_id, n, s, q, CAST(0 AS BIGINT) AS t, [CAST(-0.15 AS DOUBLE)] AS f, [CAST(0 AS BIGINT)] AS prev FROM sums
  UNION ALL
  SELECT series_id, n, s, q, t + 1, f || [coalesce(best.v, CAST('inf' AS DOUBLE))], prev || [coalesce(best.k, 0)]
  FROM (SELECT *, list_min(list_transform(range(greatest(0, t - 1)), lambda k: {{'v': f[k + 1] + CAST(0.15 AS DOUBLE)
    + (q[1][t + 2] - q[1][k + 1]) + (q[2][t + 2] - q[2][k + 1]) + (q[3][t + 2] - q[3][k + 1])
    - ((s[1][t + 2] - s[1][k + 1]) ** 2 + (s[2][t + 2] - s[2][k + 1]) ** 2 + (s[3][t + 2] - s[3][k + 1]) ** 2) / (t + 1 - k), 'k': k}})) AS best FROM step WHERE t < n)
),""" + _BACK.replace(*_TEXT_ID))
def rff_given_partition(spark, sf_dir):
    """Segments in the space of three features of given frequencies."""
    d, k = np.arange(64)[:, None], np.arange(3)[None, :]
    found = kernels.rff_partition(vectors(spark, sf_dir), 0.15, given=(((d * 3 + k * 5) % 7 - 3) / 10, np.arange(3) + 0.5), min_length=3)
    return found.select("series_id", "start", "stop", F.round("score", 5).alias("score"))


_CENTRES = "CAST((i * 3 + j * 5) % 7 - 3 AS DOUBLE) / 20"


@query(f"""
WITH {VECTORS}, c AS (SELECT j, list({_CENTRES} ORDER BY i) AS c FROM (SELECT unnest(range(4)) AS j) CROSS JOIN (SELECT unnest(range(64)) AS i) GROUP BY 1),
near AS (SELECT series_id, t, any_value(x) AS x, min({{'d': list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'j': j}}).j AS j FROM vectors CROSS JOIN c GROUP BY 1, 2),
u AS (SELECT j, unnest(range(64)) AS i, unnest(x) AS v FROM near),
m AS (SELECT j, i, count(*) AS n, sum(v) AS s FROM u GROUP BY 1, 2)
SELECT CAST(c.j AS INTEGER) AS cluster, CAST(i.i AS INTEGER) AS dim, coalesce(n, 0) AS n, round(coalesce(s, 0), 5) AS total
FROM c CROSS JOIN (SELECT unnest(range(64)) AS i) i LEFT JOIN m ON m.j = c.j AND m.i = i.i
""")
def kmeans_step(spark, sf_dir):
    """One step of k-means from given centres."""
    j, i = np.arange(4)[:, None], np.arange(64)[None, :]
    found = emissions.kmeans_step(vectors(spark, sf_dir), ((i * 3 + j * 5) % 7 - 3) / 20)
    return found.select("cluster", "dim", "n", F.round(F.col("n") * F.col("mean"), 5).alias("total"))


@query(f"""
WITH {VECTORS}, g AS (SELECT * FROM (VALUES (0, 0.1, -0.2, 2.0, 0.5, 3.0), (1, 0.0, 0.3, 0.5, -0.1, 0.25)) AS v(state, m1, m2, a, b, c)),
h AS (SELECT state, CAST(m1 AS DOUBLE) AS m1, CAST(m2 AS DOUBLE) AS m2, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c FROM g)
SELECT series_id, t, CAST(state AS INTEGER) AS state, round(-0.5 * (2 * 1.8378770664093453 + ln(a * c - b * b)
  + (c * (x[1] - m1) ** 2 - 2 * b * (x[1] - m1) * (x[2] - m2) + a * (x[2] - m2) ** 2) / (a * c - b * b)), 7) AS loglik FROM vectors CROSS JOIN h
""")
def gaussian_full_given(spark, sf_dir):
    """Two full Gaussians of given parameters on the first two components."""
    v = vectors(spark, sf_dir).withColumn("x", F.slice("x", 1, 2))
    found = emissions.full_loglik(v, {0: [0.1, -0.2], 1: [0.0, 0.3]}, {0: [[2.0, 0.5], [0.5, 3.0]], 1: [[0.5, -0.1], [-0.1, 0.25]]}, ["series_id", "t"])
    return found.select("series_id", "t", F.posexplode("loglik").alias("state", "loglik")).withColumn("loglik", F.round("loglik", 7))


@query("WITH RECURSIVE " + """
days AS (SELECT event_type AS series_id, epoch_us(ts) // 86400000000 AS day, count(*) AS c FROM events GROUP BY 1, 2),
cum AS (SELECT series_id, row_number() OVER w - 1 AS t, sum(c) OVER w AS s FROM days WINDOW w AS (PARTITION BY series_id ORDER BY day)),
sums AS (SELECT series_id, count(*) AS n, [CAST(0 AS DOUBLE)] || list(CAST(s AS DOUBLE) ORDER BY t) AS s FROM cum GROUP BY 1),
step AS (
  SELECT series_id, n, s, CAST(0 AS BIGINT) AS t, [CAST(-4 AS DOUBLE)] AS f, [CAST(0 AS BIGINT)] AS prev FROM sums
  UNION ALL
  SELECT series_id, n, s, t + 1, f || [coalesce(best.v, CAST('inf' AS DOUBLE))], prev || [coalesce(best.k, 0)]
  FROM (SELECT *, list_min(list_transform(range(greatest(0, t - 1)), lambda k: {'v': f[k + 1] + 4
    + 2 * ((s[t + 2] - s[k + 1]) - (s[t + 2] - s[k + 1]) * ln((s[t + 2] - s[k + 1]) / (24 * (t + 1 - k)))), 'k': k})) AS best FROM step WHERE t < n)
),""" + _BACK.replace(*_TEXT_ID).replace("round(score, 5)", "round(score, 3)"))
def sliced_poisson_constant(spark, sf_dir):
    """Days of events with one constant rate a segment."""
    found = pointprocess.sliced_poisson(_periods(spark, sf_dir), 24.0, n_basis=1, degree=0, penalty=4.0, min_length=3)
    return found.select("series_id", "start", "stop", F.round("score", 3).alias("score"))
