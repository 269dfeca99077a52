"""Queries: segmentation, kernels, energy statistics, online detection, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftspark.operators import bocpd, energy, kernels, scoring
from shiftspark.operators import segmentation as seg
from shiftspark.plans.build import HOURLY, ORACLE_SQL, USERS, VECTORS, WEEKLY, hourly_bits, query, table, user_values, vectors, weekly_revenue

# Optimal partitioning as a recursion that carries the lists f (costs) and prev
# (last boundaries); s and q are prefix sums of the centred series.
_OP = """
RECURSIVE {series},
n AS (SELECT series_id, count(*) AS n, avg(value) AS m FROM {name} GROUP BY 1),
z AS (SELECT series_id, t, value - m AS z FROM {name} JOIN n USING (series_id)),
p AS (SELECT series_id, t, sum(z) OVER w AS s, sum(z * z) OVER w AS q FROM z WINDOW w AS (PARTITION BY series_id ORDER BY t)),
a AS (SELECT series_id, [CAST(0 AS DOUBLE)] || list(s ORDER BY t) AS s, [CAST(0 AS DOUBLE)] || list(q ORDER BY t) AS q FROM p GROUP BY 1),
step AS (
  SELECT a.series_id, n, s, q, CAST(0 AS BIGINT) AS t, [CAST(-{penalty} AS DOUBLE)] AS f, [CAST(0 AS BIGINT)] AS prev FROM a JOIN n USING (series_id)
  UNION ALL
  SELECT series_id, n, s, q, t + 1, f || [coalesce(best.v, CAST('inf' AS DOUBLE))], prev || [coalesce(best.k, 0)]
  FROM (SELECT *, list_min(list_transform(range(greatest(0, t + 2 - {least})), lambda k: {{'v': f[k + 1] + {cost} + {penalty}, 'k': k}})) AS best
        FROM step WHERE t < n)
),
"""

_SSE = "greatest(q[t + 2] - q[k + 1] - (s[t + 2] - s[k + 1]) * (s[t + 2] - s[k + 1]) / (t + 1 - k), 0)"
_KNOWN = _SSE + " / {0} + (t + 1 - k) * (1.8378770664093453 + ln({0}))"
_UNKNOWN = f"(t + 1 - k) * (1.8378770664093453 + ln(greatest({_SSE}, 1e-12) / (t + 1 - k)) + 1)"

_BACK = """
done AS (SELECT series_id, n, f[n + 1] AS score, prev FROM step WHERE t = n),
back AS (
  SELECT series_id, score, prev, n AS stop, prev[n + 1] AS start FROM done
  UNION ALL SELECT series_id, score, prev, start, prev[start + 1] FROM back WHERE start > 0
)
SELECT series_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, round(score, 5) AS score FROM back
"""

_WEEK_PENALTY, _WEEK_SIGMA2 = 20.0, 1e6


@query("WITH " + _OP.format(series=WEEKLY, name="weekly", penalty=_WEEK_PENALTY, cost=_KNOWN.format(_WEEK_SIGMA2), least=4) + _BACK)
def optimal_partition_known_var(spark, sf_dir):
    found = seg.partition(weekly_revenue(spark, sf_dir), "known_variance", _WEEK_PENALTY, 4, sigma2=_WEEK_SIGMA2)
    return found.select("series_id", "start", "stop", F.round("score", 5).alias("score"))


@query("WITH " + _OP.format(series=USERS.replace("users AS", "raw AS") + ", users AS (SELECT series_id, t, cents / 100.0 AS value FROM raw)", name="users", penalty=12.0, cost=_KNOWN.format(2500.0), least=5) + _BACK)
def user_shifts(spark, sf_dir):
    """Where did each user's event values shift? One group a user, prefix sums and a minimum a step."""
    v = user_values(spark, sf_dir).select("series_id", "t", (F.col("cents") / 100.0).alias("value"))
    found = seg.partition(v, "known_variance", 12.0, 5, sigma2=2500.0)
    return found.select(F.col("series_id").cast("long").alias("series_id"), "start", "stop", F.round("score", 5).alias("score"))


@query("WITH " + _OP.format(series=USERS.replace("users AS", "raw AS") + ", users AS (SELECT series_id * 10000 + t // 40 AS series_id, t % 40 AS t, cents / 100.0 AS value FROM raw)", name="users", penalty=12.0, cost=_KNOWN.format(2500.0), least=5) + _BACK)
def user_shifts_folded(spark, sf_dir):
    """Forty values of a user at a time: for short series the recursion is a Catalyst fold, without Python."""
    v = user_values(spark, sf_dir).select(F.expr("series_id * 10000 + t div 40").alias("series_id"), (F.col("t") % 40).alias("t"), "cents")
    arrays = v.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "cents"))), lambda x: x["cents"] / 100.0).alias("v"))
    dp = arrays.select("series_id", F.size("v").alias("n"), seg.fold_known_variance(F.col("v"), 12.0, 5, 2500.0).alias("dp"))
    # walk back from n over the start of each last segment
    walk = F.aggregate(
        F.sequence(F.lit(1), F.col("n")), F.array(F.col("n")),
        lambda acc, _: F.when(F.element_at(acc, -1) > 0, F.concat(acc, F.array(F.get(F.col("dp.prev"), F.element_at(acc, -1))))).otherwise(acc),
    )
    e = dp.select("series_id", F.get(F.col("dp.f"), F.col("n")).alias("score"), F.reverse(walk).alias("e"))
    spans = F.transform(F.sequence(F.lit(0), F.size("e") - 2), lambda i: F.struct(F.get("e", i).cast("long").alias("start"), F.get("e", i + 1).cast("long").alias("stop")))
    return e.select("series_id", "score", F.explode(spans).alias("x")).select("series_id", "x.start", "x.stop", F.round("score", 5).alias("score"))


@query("WITH " + f"""
RECURSIVE {HOURLY}, n AS (SELECT series_id, count(*) AS n FROM hourly GROUP BY 1),
p AS (SELECT series_id, t, sum(CASE WHEN n > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY t) AS s FROM hourly),
a AS (SELECT series_id, [CAST(0 AS BIGINT)] || list(CAST(s AS BIGINT) ORDER BY t) AS s FROM p GROUP BY 1),
step AS (
  SELECT a.series_id, n, s, CAST(0 AS BIGINT) AS t, [CAST(-3 AS DOUBLE)] AS f, [CAST(0 AS BIGINT)] AS prev FROM a JOIN n USING (series_id)
  UNION ALL
  SELECT series_id, n, s, t + 1, f || [best.v], prev || [best.k]
  FROM (SELECT *, list_min(list_transform(range(t + 1), lambda k: {{'v': f[k + 1] + lgamma(t + 3 - k) - lgamma(s[t + 2] - s[k + 1] + 1) - lgamma(t + 2 - k - s[t + 2] + s[k + 1]) + 3, 'k': k}})) AS best
        FROM step WHERE t < n)
),""" + _BACK)
def optimal_partition_beta_binomial(spark, sf_dir):
    bits = hourly_bits(spark, sf_dir).select("series_id", "t", (F.col("n") > 2).cast("int").alias("value"))
    found = seg.partition(bits, "beta_binomial", 3.0, 1)
    return found.select("series_id", "start", "stop", F.round("score", 5).alias("score"))


@query("WITH " + _OP.format(series=WEEKLY, name="weekly", penalty=30.0, cost=_UNKNOWN, least=4) + _BACK)
def optimal_partition_unknown_var(spark, sf_dir):
    found = seg.partition(weekly_revenue(spark, sf_dir), "unknown_variance", 30.0, 4)
    return found.select("series_id", "start", "stop", F.round("score", 5).alias("score"))


@query("WITH " + _OP.format(series=WEEKLY, name="weekly", penalty=1.5, cost=f"({_SSE}) / 1e6 + sqrt(t + 1 - k)", least=3) + _BACK)
def custom_cost_partition(spark, sf_dir):
    """A caller's own cost: scatter, and a fee that grows with the root of a segment's length."""
    import numpy as np

    def scatter_and_fee(y):
        s, q = (np.concatenate(([0.0], np.cumsum(v))) for v in (y - y.mean(), (y - y.mean()) ** 2))
        return lambda a, b: np.maximum(q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a), 0) / 1e6 + np.sqrt(b - a)

    found = seg.partition(weekly_revenue(spark, sf_dir), scatter_and_fee, 1.5, 3)
    return found.select("series_id", "start", "stop", F.round("score", 5).alias("score"))


@query()
def concave_penalty_partition(spark, sf_dir):
    return seg.concave_partition(weekly_revenue(spark, sf_dir), lambda m: 10.0 / m**0.5, sigma2=_WEEK_SIGMA2, min_length=4)


# --- kernels ----------------------------------------------------------------------------


@query(f"""
WITH {VECTORS}
SELECT a.series_id, a.t AS i, b.t AS j, round(list_dot_product(a.x, b.x), 9) AS k FROM vectors a JOIN vectors b ON a.series_id = b.series_id AND a.t < b.t
""")
def gram_linear(spark, sf_dir):
    from shiftspark.functions.columns import dot

    v = vectors(spark, sf_dir)
    a, b = v.select("series_id", F.col("t").alias("i"), F.col("x").alias("xi")), v.select("series_id", F.col("t").alias("j"), F.col("x").alias("xj"))
    return a.join(b, "series_id").where("i < j").select("series_id", "i", "j", F.round(dot(F.col("xi"), F.col("xj")), 9).alias("k"))


_D2 = "list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


@query(f"""
WITH {VECTORS}, d AS (SELECT a.series_id, {_D2} AS d2 FROM vectors a JOIN vectors b ON a.series_id = b.series_id AND a.t < b.t)
SELECT series_id, round(CASE WHEN median(d2) > 0 THEN 1 / (2 * median(d2)) ELSE 1 END, 6) AS gamma FROM d GROUP BY 1
""")
def kernel_median_heuristic(spark, sf_dir):
    return kernels.median_heuristic(vectors(spark, sf_dir)).withColumn("gamma", F.round("gamma", 6))


@query(f"""
WITH {VECTORS}, u AS (SELECT series_id, t, unnest(x) AS v, unnest(range(len(x))) AS d FROM vectors),
p AS (SELECT series_id, d, t, sum(v) OVER w AS s, sum(v * v) OVER w AS q FROM u WINDOW w AS (PARTITION BY series_id, d ORDER BY t)),
n AS (SELECT series_id, d, max(t) + 1 AS n, arg_max(s, t) AS ts, arg_max(q, t) AS tq FROM p GROUP BY 1, 2),
c AS (SELECT series_id, t + 1 AS cp, sum(q - s * s / (t + 1) + tq - q - (ts - s) * (ts - s) / (n - t - 1)) AS cost FROM p JOIN n USING (series_id, d) WHERE t + 1 < n GROUP BY 1, 2)
SELECT series_id, arg_min(cp, (round(cost, 9), cp)) AS cp, round(min(cost), 6) AS cost FROM c GROUP BY 1
""")
def kernel_linear_split(spark, sf_dir):
    found = kernels.kernel_fixed(vectors(spark, sf_dir), 2, "linear").where("segment = 1")
    return found.select(F.col("series_id").cast("int").alias("series_id"), F.col("start").alias("cp"), F.round("score", 6).alias("cost"))


# The kernel matrix of each series as lists of its two-way prefix sums (s[b][a]) and of its diagonal's (d).
_GRAM = f"""
{VECTORS}, n AS (SELECT series_id, count(*) AS n FROM vectors GROUP BY 1),
d2 AS (SELECT a.series_id, a.t AS i, b.t AS j, CASE WHEN a.t = b.t THEN 0 ELSE {_D2} END AS d2 FROM vectors a JOIN vectors b ON a.series_id = b.series_id),
g AS (SELECT series_id, CASE WHEN median(d2) > 0 THEN 1 / (2 * median(d2)) ELSE 1 END AS gamma FROM d2 WHERE i < j GROUP BY 1),
k AS (SELECT series_id, i, j, exp(-gamma * d2) AS k FROM d2 JOIN g USING (series_id)),
r AS (SELECT series_id, i, j, sum(k) OVER (PARTITION BY series_id, i ORDER BY j) AS k FROM k),
c AS (SELECT series_id, i, j, sum(k) OVER (PARTITION BY series_id, j ORDER BY i) AS k FROM r),
l AS (SELECT series_id, i, [CAST(0 AS DOUBLE)] || list(k ORDER BY j) AS row FROM c GROUP BY 1, 2),
gram AS (SELECT series_id, n, [list_transform(range(n + 1), lambda x: CAST(0 AS DOUBLE))] || list(row ORDER BY i) AS s FROM l JOIN n USING (series_id) GROUP BY 1, 2)"""
_SCATTER = "{b} - {a} - (s[{b} + 1][{b} + 1] - 2 * s[{b} + 1][{a} + 1] + s[{a} + 1][{a} + 1]) / ({b} - {a})"  # the diagonal is 1


@query("WITH RECURSIVE " + _GRAM + """,
step AS (
  SELECT series_id, n, s, CAST(0 AS BIGINT) AS t, [CAST(-2 AS DOUBLE)] AS f, [CAST(0 AS BIGINT)] AS prev FROM gram
  UNION ALL
  SELECT series_id, n, s, t + 1, f || [coalesce(best.v, CAST('inf' AS DOUBLE))], prev || [coalesce(best.k, 0)]
  FROM (SELECT *, list_min(list_transform(range(greatest(0, t - 1)), lambda k: {'v': f[k + 1] + """ + _SCATTER.format(a="k", b="(t + 1)") + """ + 2, 'k': k})) AS best FROM step WHERE t < n)
),""" + _BACK.replace("SELECT series_id, CAST(start", "SELECT CAST(series_id AS VARCHAR) AS series_id, CAST(start"))
def kernel_rbf_partition(spark, sf_dir):
    found = kernels.kernel_partition(vectors(spark, sf_dir), 2.0, min_length=3)
    return found.select("series_id", "start", "stop", F.round("score", 5).alias("score"))


@query("WITH RECURSIVE " + _GRAM + """,
step AS (
  SELECT series_id, n, s, 0 AS m, [CAST(0 AS DOUBLE)] || list_transform(range(n), lambda x: CAST('inf' AS DOUBLE)) AS f FROM gram
  UNION ALL
  SELECT series_id, n, s, m + 1, list_transform(range(n + 1), lambda t: coalesce(list_min(list_transform(range(greatest(0, t - 2)), lambda k: f[k + 1] + """ + _SCATTER.format(a="k", b="t") + """)), CAST('inf' AS DOUBLE)))
  FROM step WHERE m < 4
),
found AS (SELECT series_id, m, f[n + 1] AS cost, f[n + 1] + m * ln(n) AS criterion FROM step WHERE m > 0 AND f[n + 1] < CAST('inf' AS DOUBLE))
SELECT CAST(series_id AS VARCHAR) AS series_id, m, round(cost, 6) AS cost, round(criterion, 6) AS criterion, m = arg_min(m, (round(criterion, 9), m)) OVER (PARTITION BY series_id) AS selected FROM found
""")
def kernel_model_selection(spark, sf_dir):
    found = kernels.kernel_select(vectors(spark, sf_dir), 4, min_length=3)
    return found.select("series_id", "m", F.round("cost", 6).alias("cost"), F.round("criterion", 6).alias("criterion"), "selected")


@query()
def kernel_custom_partition(spark, sf_dir):
    """A caller's own kernel: Laplace's."""
    import numpy as np

    laplace = lambda a, b: np.exp(-0.3 * np.sqrt(kernels.between(a, b)))
    return kernels.kernel_partition(vectors(spark, sf_dir), 2.0, laplace, min_length=3)


@query()
def rff_kernel_partition(spark, sf_dir):
    return kernels.rff_partition(vectors(spark, sf_dir), 2.0, gamma=0.5, features=128, min_length=3)


@query()
def rff_adaptive_partition(spark, sf_dir):
    """The bandwidth by the median heuristic and the number of features by its error, each series its own."""
    return kernels.rff_partition(vectors(spark, sf_dir), 2.0, features=None, kind="hadamard", min_length=3)


@query()
def rff_fixed_partition(spark, sf_dir):
    return kernels.rff_partition(vectors(spark, sf_dir), 0.0, gamma=0.5, features=128, kind="orthogonal", segments=3)


@query()
def rff_variant_errors(spark, sf_dir):
    return kernels.compare_features(vectors(spark, sf_dir), 0.5, 128)


@query(f"""
WITH {VECTORS}, w AS (SELECT k, list_transform(range(64), lambda d: CAST((d * 3 + k * 5) % 7 - 3 AS DOUBLE) / 10) AS w FROM (SELECT unnest(range(3)) AS k))
SELECT series_id, t, CAST(k AS INTEGER) AS feature, round(sqrt(CAST(2 AS DOUBLE) / 3) * cos(list_dot_product(x, w) + k + CAST(0.5 AS DOUBLE)), 7) AS z FROM vectors CROSS JOIN w
""")
def rff_features(spark, sf_dir):
    import numpy as np

    d, k = np.arange(64)[:, None], np.arange(3)[None, :]
    z = kernels.feature_column(F.col("x"), ((d * 3 + k * 5) % 7 - 3) / 10, np.arange(3) + 0.5)
    return vectors(spark, sf_dir).select("series_id", "t", F.posexplode(z).alias("feature", "z")).withColumn("z", F.round("z", 7))


@query(f"""
WITH {VECTORS}, u AS (SELECT series_id, t, unnest(x) AS v, unnest(range(len(x))) AS feature FROM vectors)
SELECT series_id, t + 1 AS k, CAST(feature AS INTEGER) AS feature, round(sum(v) OVER w, 10) AS s1, round(sum(v * v) OVER w, 10) AS s2 FROM u WINDOW w AS (PARTITION BY series_id, feature ORDER BY t)
""")
def feature_prefix(spark, sf_dir):
    from shiftspark.operators.costs import vector_prefix

    return vector_prefix(vectors(spark, sf_dir)).select("series_id", "k", "feature", F.round("s1", 10).alias("s1"), F.round("s2", 10).alias("s2"))


@query("""
WITH l AS (SELECT DISTINCT label AS series_id FROM embeddings)
SELECT series_id, CAST(i AS INTEGER) AS sigma_id, round(exp(ln(0.1) + i * (ln(10) - ln(0.1)) / 9), 9) AS sigma FROM l CROSS JOIN (SELECT unnest(range(10)) AS i)
""")
def bandwidth_grid(spark, sf_dir):
    """The candidates that a search gives every label."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("label").alias("series_id")).distinct()
    grid = kernels.candidate_sigmas(spark, 0.1, 10.0, 10).withColumn("sigma", F.round("sigma", 9))
    return labels.crossJoin(F.broadcast(grid))


@query()
def bandwidth_cross_validation(spark, sf_dir):
    return kernels.select_bandwidth(vectors(spark, sf_dir), kernels.candidate_sigmas(spark, 0.2, 5.0, 6), folds=4)


@query()
def bandwidth_time_series_cv(spark, sf_dir):
    return kernels.select_bandwidth(vectors(spark, sf_dir), kernels.candidate_sigmas(spark, 0.2, 5.0, 4), folds=3, method="timeseries", scoring="changepoint")


@query()
def bandwidth_information_criterion(spark, sf_dir):
    return kernels.information_criterion(vectors(spark, sf_dir), kernels.candidate_sigmas(spark, 0.2, 5.0, 6))


@query()
def bandwidth_eigenvalue_criterion(spark, sf_dir):
    return kernels.information_criterion(vectors(spark, sf_dir), kernels.candidate_sigmas(spark, 0.2, 5.0, 6, search="random"), "aic", "eigenvalue")


@query()
def bandwidth_simple(spark, sf_dir):
    return kernels.select_bandwidth_simple(vectors(spark, sf_dir), 6, 3)


@query()
def bandwidth_multiscale(spark, sf_dir):
    return kernels.multiscale_bandwidths(vectors(spark, sf_dir), 2, 4, folds=3)


@query(f"""
WITH {VECTORS}, d AS (SELECT a.series_id, {_D2} AS d2 FROM vectors a JOIN vectors b ON a.series_id = b.series_id AND a.t < b.t)
SELECT series_id, CAST(i AS INTEGER) AS scale, round(CASE i WHEN 0 THEN quantile_cont(sqrt(d2), 0.1) WHEN 1 THEN quantile_cont(sqrt(d2), 0.5) ELSE quantile_cont(sqrt(d2), 0.9) END, 7) AS sigma
FROM d CROSS JOIN (SELECT unnest(range(3)) AS i) WHERE d2 > 0 GROUP BY series_id, i
""")
def bandwidth_scales(spark, sf_dir):
    return kernels.multiscale_sigmas(vectors(spark, sf_dir), 3).withColumn("sigma", F.round("sigma", 7))


@query()
def bandwidth_bootstrap(spark, sf_dir):
    return kernels.bandwidth_stability(vectors(spark, sf_dir), 10)


# --- energy statistics --------------------------------------------------------------------


_ENERGY = f"""
WITH {VECTORS}, d AS (SELECT a.series_id, a.t AS i, b.t AS j, sqrt({_D2}) AS d FROM vectors a JOIN vectors b ON a.series_id = b.series_id AND a.t < b.t),
n AS (SELECT series_id, count(*) AS n FROM vectors GROUP BY 1),
s AS (SELECT series_id, t AS split FROM vectors WHERE t > 0)
SELECT s.series_id, s.split, round(split * (n - split) * 1.0 / n * (2 * coalesce(sum(d) FILTER (WHERE i < split AND j >= split), 0) / (split * (n - split))
       - 2 * coalesce(sum(d) FILTER (WHERE j < split), 0) / (split * split) - 2 * coalesce(sum(d) FILTER (WHERE i >= split), 0) / ((n - split) * (n - split))), 7) AS stat
FROM s JOIN n USING (series_id) JOIN d USING (series_id) GROUP BY s.series_id, s.split, n
"""


@query(_ENERGY)
def energy_split_stat(spark, sf_dir):
    return energy.split_statistics(vectors(spark, sf_dir)).withColumn("stat", F.round("stat", 7))


@query(f"""
WITH e AS ({_ENERGY}), n AS (SELECT series_id, max(split) + 1 AS n FROM e GROUP BY 1)
SELECT e.series_id, arg_max(split, (stat, -split)) AS split, max(stat) AS stat FROM e JOIN n USING (series_id) WHERE split >= 5 AND split <= n - 5 GROUP BY 1
""")
def energy_best_split(spark, sf_dir):
    v = vectors(spark, sf_dir)
    stats = energy.split_statistics(v).withColumn("stat", F.round("stat", 7))
    return energy.best_split(stats, v.groupBy("series_id").agg(F.count("*").alias("n")), 5)


@query(ORACLE_SQL["energy_best_split"])
def energy_split_by_tiles(spark, sf_dir):
    """The same by tiles and running sums of places, as a long segment is tested."""
    v = vectors(spark, sf_dir).withColumn("series_id", F.col("series_id").cast("string"))
    whole = v.groupBy("series_id").agg(F.lit(0).cast("long").alias("start"), F.count("*").alias("stop")).where("stop >= 10")
    found = energy.tested_by_tiles(v.select("series_id", F.col("t").cast("long").alias("t"), "x"), whole, 5, 0, 1.0, "iid", 0, 50, None, 16, 3)
    return found.select(F.col("series_id").cast("int").alias("series_id"), F.col("cp").alias("split"), F.round("stat", 7).alias("stat"))


@query()
def energy_divisive(spark, sf_dir):
    return energy.divisive(vectors(spark, sf_dir), min_size=8, replicates=99)


@query()
def energy_divisive_block(spark, sf_dir):
    return energy.divisive(vectors(spark, sf_dir), min_size=8, replicates=49, resampler="block", max_cps=2)


@query()
def energy_divisive_circular(spark, sf_dir):
    return energy.divisive(vectors(spark, sf_dir), min_size=8, replicates=49, resampler="circular", alpha=1.5)


# --- online detection -----------------------------------------------------------------------

_BOCPD = """
RECURSIVE {hourly}, obs AS (SELECT series_id, t, {value} AS x FROM hourly),
step AS (
  SELECT series_id, CAST(-1 AS BIGINT) AS t, [CAST(1 AS DOUBLE)] AS r, [CAST({a0} AS DOUBLE)] AS a, [CAST({b0} AS DOUBLE)] AS b, CAST(0 AS DOUBLE) AS mean FROM (SELECT DISTINCT series_id FROM obs)
  UNION ALL
  SELECT series_id, t, list_transform(w, lambda v: v / list_sum(w)), [{a_new}] || list_transform(a, lambda v: {a_upd}), [{b_new}] || list_transform(b, lambda v: {b_upd}), mean
  FROM (SELECT o.series_id, o.t, o.x, s.a, s.b, list_dot_product(s.r, list_transform(list_zip(s.a, s.b), lambda p: {mean})) AS mean,
               [{p0} / 48] || list_transform(list_zip(s.r, s.a, s.b), lambda p: p[1] * (CAST(1 AS DOUBLE) - CAST(1 AS DOUBLE) / 48) * {pred}) AS w
        FROM step s JOIN obs o ON o.series_id = s.series_id AND o.t = s.t + 1)
),
online AS (SELECT series_id, t, r[1] AS cp_prob, list_position(r, list_max(r)) - 1 AS map_run_length, mean AS pred_mean FROM step WHERE t >= 0)
"""

_BERNOULLI = _BOCPD.format(
    hourly=HOURLY, value="CASE WHEN n > 2 THEN 1 ELSE 0 END", a0=1, b0=1, a_new="CAST(1 + x AS DOUBLE)", b_new="CAST(2 - x AS DOUBLE)", a_upd="v + x", b_upd="v + 1 - x",
    mean="p[1] / (p[1] + p[2])", p0="CAST(0.5 AS DOUBLE)", pred="(CASE WHEN x = 1 THEN p[2] ELSE p[3] END) / (p[2] + p[3])",
)
_ROUNDED = " SELECT series_id, t, round(cp_prob, 7) AS cp_prob, CAST(map_run_length AS INTEGER) AS map_run_length, round(pred_mean, 7) AS pred_mean FROM online"


def _online(spark, sf_dir, poisson: bool = False):
    h = hourly_bits(spark, sf_dir)
    value = F.col("n") if poisson else (F.col("n") > 2).cast("int")
    detector = bocpd.Detector(bocpd.PoissonGamma(1.0, 1.0) if poisson else bocpd.BetaBernoulli(), bocpd.ConstantHazard(48), max_run_length=8192)
    return bocpd.detect(h.select("series_id", "t", value.alias("value")), detector)


def _rounded(online):
    return online.select("series_id", "t", F.round("cp_prob", 7).alias("cp_prob"), "map_run_length", F.round("pred_mean", 7).alias("pred_mean"))


@query("WITH " + _BERNOULLI + _ROUNDED)
def bocpd_beta_bernoulli(spark, sf_dir):
    return _rounded(_online(spark, sf_dir))


@query("WITH " + _BOCPD.format(
    hourly=HOURLY, value="n", a0=1, b0=1, a_new="CAST(1 + x AS DOUBLE)", b_new="CAST(2 AS DOUBLE)", a_upd="v + x", b_upd="v + 1", mean="p[1] / p[2]",
    p0="exp(lgamma(1 + x) - lgamma(x + 1) + ln(0.5) - x * ln(2))", pred="exp(lgamma(p[2] + x) - lgamma(p[2]) - lgamma(x + 1) + p[2] * ln(p[3] / (p[3] + 1)) - x * ln(p[3] + 1))",
) + _ROUNDED)
def bocpd_poisson_gamma(spark, sf_dir):
    return _rounded(_online(spark, sf_dir, poisson=True))


@query("WITH " + _BERNOULLI + """,
l AS (SELECT series_id, t, unnest(r) AS p, unnest(range(len(r))) AS n FROM step WHERE t >= 0)
SELECT series_id, t, CAST(n AS INTEGER) AS run_length, round(p, 7) AS probability FROM l WHERE round(p, 7) >= 0.01
""")
def bocpd_run_lengths(spark, sf_dir):
    bits = hourly_bits(spark, sf_dir).select("series_id", "t", (F.col("n") > 2).cast("int").alias("value"))
    found = bocpd.run_lengths(bits, bocpd.Detector(bocpd.BetaBernoulli(), bocpd.ConstantHazard(48), max_run_length=8192), 0.009)
    return found.withColumn("probability", F.round("probability", 7)).where("probability >= 0.01")


@query("WITH " + _BERNOULLI + """,
peaks AS (SELECT series_id, t, round(cp_prob, 9) AS p, round(lag(cp_prob) OVER w, 9) AS b, round(lead(cp_prob) OVER w, 9) AS a FROM online WINDOW w AS (PARTITION BY series_id ORDER BY t))
SELECT series_id, t FROM peaks WHERE p >= 0.03 AND CASE WHEN b IS NULL THEN p >= a WHEN a IS NULL THEN p > b ELSE p >= b AND p > a END
""")
def bocpd_alerts(spark, sf_dir):
    return bocpd.alerts(_online(spark, sf_dir).withColumn("cp_prob", F.round("cp_prob", 9)), 0.03)


@query(f"""
WITH {HOURLY} SELECT series_id, t, round(CASE t % 4 WHEN 0 THEN 0.01 WHEN 1 THEN 0.02 WHEN 2 THEN 0.05 ELSE 0.1 END * CASE WHEN t % 24 IN (6, 18) THEN 10 ELSE 1 END, 9) AS hazard
FROM (SELECT series_id, t FROM hourly)
""".replace("0.01 WHEN", "CAST(0.01 AS DOUBLE) WHEN").replace("ELSE 0.1 END", "ELSE 0.1 END"))
def hazards(spark, sf_dir):
    h = hourly_bits(spark, sf_dir)
    base = bocpd.scheduled_hazard([0.01, 0.02, 0.05, 0.1], F.col("t"))
    return h.select("series_id", "t", F.round(bocpd.boosted_hazard(base, 24, [6, 18], F.col("t")), 9).alias("hazard"))


# --- scoring ------------------------------------------------------------------------------------

_TWO = f"""{USERS}, p AS (SELECT series_id, t AS cp FROM users WHERE cents > 8000 AND t > 0), a AS (SELECT series_id, t AS cp FROM users WHERE cents < 1500 AND t > 0)"""


def _two(spark, sf_dir):
    v = user_values(spark, sf_dir).where("t > 0")
    return v.where("cents > 8000").select("series_id", F.col("t").alias("cp")), v.where("cents < 1500").select("series_id", F.col("t").alias("cp"))


@query("WITH RECURSIVE " + _TWO + """,
l AS (SELECT series_id, list(cp ORDER BY cp) AS p FROM p GROUP BY 1), m AS (SELECT series_id, list(cp ORDER BY cp) AS a FROM a GROUP BY 1),
walk AS (
  SELECT series_id, p, a, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, CAST(0 AS BIGINT) AS n FROM l JOIN m USING (series_id)
  UNION ALL
  SELECT series_id, p, a, CASE WHEN a[j] < p[i] - 1 THEN i ELSE i + 1 END, CASE WHEN a[j] <= p[i] + 1 THEN j + 1 ELSE j END,
         n + CASE WHEN abs(a[j] - p[i]) <= 1 THEN 1 ELSE 0 END FROM walk WHERE i <= len(p) AND j <= len(a)
),
tp AS (SELECT series_id, max(n) AS tp, max(len(p)) AS np, max(len(a)) AS na FROM walk GROUP BY 1)
SELECT series_id, CAST(tp AS INTEGER) AS tp, CAST(np - tp AS INTEGER) AS fp, CAST(na - tp AS INTEGER) AS fn, round(2.0 * tp / (np + na), 9) AS f1 FROM tp
""")
def score_with_tolerance(spark, sf_dir):
    s = scoring.score(*_two(spark, sf_dir), 1)
    return s.select("series_id", "tp", "fp", "fn", F.round("f1", 9).alias("f1"))


@query("WITH " + _TWO + """,
f AS (SELECT * FROM p UNION ALL SELECT * FROM a),
g AS (SELECT series_id, cp, CASE WHEN cp - lag(cp) OVER (PARTITION BY series_id ORDER BY cp) > 1 THEN 1 ELSE 0 END AS fresh FROM f),
c AS (SELECT series_id, cp, sum(fresh) OVER (PARTITION BY series_id ORDER BY cp RANGE UNBOUNDED PRECEDING) AS cluster FROM g)
SELECT series_id, CAST(floor(avg(cp)) AS BIGINT) AS cp, count(*) AS votes, count(*) / 2.0 AS confidence FROM c GROUP BY series_id, cluster
""".replace("count(*) / 2.0", "CAST(count(*) AS DOUBLE) / 2"))
def consensus_clusters(spark, sf_dir):
    p, a = _two(spark, sf_dir)
    return scoring.consensus(p.union(a), 2, 1)


@query("WITH " + _TWO + """
SELECT a.series_id, CASE WHEN count(*) FILTER (WHERE f IS NULL) > 0 THEN NULL ELSE round(avg(f - cp), 7) END AS delay
FROM (SELECT a.series_id, a.cp, (SELECT min(p.cp) FROM p WHERE p.series_id = a.series_id AND p.cp >= a.cp) AS f FROM a) a GROUP BY 1
""")
def detection_delays(spark, sf_dir):
    p, a = _two(spark, sf_dir)
    d = scoring.detection_delay(p.withColumnRenamed("cp", "t"), a)
    return d.select("series_id", F.when(F.col("delay") < float("inf"), F.round("delay", 7)).alias("delay"))


@query("WITH " + _TWO + """,
n AS (SELECT p.series_id, p.cp, min(abs(p.cp - a.cp)) AS e FROM p JOIN a ON p.series_id = a.series_id AND abs(p.cp - a.cp) <= 3 GROUP BY 1, 2)
SELECT series_id, count(*) AS pairs, round(avg(e), 7) AS mean_abs_error FROM n GROUP BY 1
""")
def nearest_errors(spark, sf_dir):
    return scoring.mean_error(*_two(spark, sf_dir), 3).withColumn("mean_abs_error", F.round("mean_abs_error", 7))


@query("WITH RECURSIVE " + _TWO + """,
l AS (SELECT series_id, list(cp ORDER BY cp) AS p FROM p GROUP BY 1), m AS (SELECT series_id, list(cp ORDER BY cp) AS a FROM a GROUP BY 1),
both_ AS (SELECT series_id, coalesce(p, []) AS p, coalesce(a, []) AS a FROM l FULL JOIN m USING (series_id)),
walk AS (
  SELECT series_id, p, a, a AS rest, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS e FROM both_
  UNION ALL
  SELECT series_id, p, a, CASE WHEN near.d <= 2 THEN list_filter(rest, lambda v, i: i <> near.place) ELSE rest END, i + 1, n + CASE WHEN near.d <= 2 THEN 1 ELSE 0 END, e + CASE WHEN near.d <= 2 THEN near.d ELSE 0 END
  FROM (SELECT *, list_min(list_transform(rest, lambda v, k: {'d': abs(v - p[i]), 'place': k})) AS near FROM walk WHERE i <= len(p))
),
w AS (SELECT series_id, len(p) AS np, len(a) AS na, n, e FROM walk WHERE i = len(p) + 1),
r AS (SELECT series_id, n AS matches, CASE WHEN np > 0 THEN n * 1.0 / np WHEN na = 0 THEN 1 ELSE 0 END AS precision, CASE WHEN na > 0 THEN n * 1.0 / na WHEN np = 0 THEN 1 ELSE 0 END AS recall, CASE WHEN n > 0 THEN e * 1.0 / n END AS err FROM w)
SELECT series_id, matches, round(precision, 7) AS precision, round(recall, 7) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 7) AS f1, round(err, 7) AS mean_abs_error FROM r
""".replace("n * 1.0 /", "CAST(n AS DOUBLE) /").replace("e * 1.0 /", "CAST(e AS DOUBLE) /"))
def greedy_boundary_errors(spark, sf_dir):
    s = scoring.greedy_errors(*_two(spark, sf_dir), 2)
    return s.select("series_id", "matches", *[F.round(c, 7).alias(c) for c in ("precision", "recall", "f1", "mean_abs_error")])


@query("WITH " + _TWO + " SELECT DISTINCT series_id, cp FROM (SELECT * FROM p UNION ALL SELECT * FROM a)")
def channel_union(spark, sf_dir):
    return scoring.union_of(list(_two(spark, sf_dir)))


@query()
def two_stage_detection(spark, sf_dir):
    """Coarse segments first, then the energy statistic inside each."""
    w = weekly_revenue(spark, sf_dir)
    w = w.withColumn("value", F.col("value") + F.when(F.col("t") % 120 >= 60, 3000).otherwise(0))  # raised in every other 60 weeks
    coarse = seg.partition(w, "known_variance", 60.0, 8, sigma2=_WEEK_SIGMA2)
    points = lambda d: d.select("series_id", "t", F.array(F.col("value").cast("double")).alias("x"))
    return scoring.two_stage(w, coarse, lambda d: energy.divisive(points(d), 5, 49).where("accepted").select("series_id", "cp"))


@query(f"""
WITH p AS ({ORACLE_SQL["optimal_partition_known_var"]})
SELECT series_id, round(CAST(0.8 AS DOUBLE) * 96 + CAST(0.2 AS DOUBLE) * arg_max(stop - start, start), 6) AS mean_run_length FROM p GROUP BY 1
""")
def hybrid_run_lengths(spark, sf_dir):
    """What an online detector should expect after an offline look at weekly revenue."""
    coarse = seg.partition(weekly_revenue(spark, sf_dir), "known_variance", _WEEK_PENALTY, 4, sigma2=_WEEK_SIGMA2)
    return scoring.retuned_run_lengths(coarse, 96.0).select("series_id", F.round("mean_run_length", 6).alias("mean_run_length"))


@query()
def detector_comparison(spark, sf_dir):
    """Detectors on weekly revenue that is raised from its middle on, where the truth so is."""
    w = weekly_revenue(spark, sf_dir)
    sizes = w.groupBy("series_id").agg(F.count("*").alias("n"), F.stddev("value").alias("sd"))
    s = w.join(F.broadcast(sizes), "series_id").withColumn("value", F.col("value") / F.col("sd") + F.when(F.col("t") >= F.floor(F.col("n") / 2), 3.0).otherwise(0.0))
    truth = sizes.select("series_id", F.floor(F.col("n") / 2).cast("long").alias("cp"))
    points = lambda d: d.select("series_id", "t", F.array("value").alias("x"))
    detectors = {
        "partition": lambda d: seg.changepoints(seg.partition(d, "unknown_variance", "bic", 5)),
        "kernel": lambda d: seg.changepoints(kernels.kernel_partition(points(d), 3.0, min_length=5)),
        "features": lambda d: seg.changepoints(kernels.rff_partition(points(d), 3.0, 0.5, 128, min_length=5)),
        "energy": lambda d: energy.divisive(points(d), 10, 99).where("accepted").select("series_id", "cp"),
    }
    return scoring.summary(scoring.compare(detectors, s.select("series_id", "t", "value"), truth, 2))


@query()
def hierarchical_detection(spark, sf_dir):
    """Segments within segments: a coarse partition, then a finer one inside each piece."""
    w = weekly_revenue(spark, sf_dir)
    coarse = seg.partition(w, "known_variance", 60.0, 8, sigma2=_WEEK_SIGMA2)
    return seg.partition(scoring.within_segments(w, coarse), "known_variance", 20.0, 4, sigma2=_WEEK_SIGMA2)
