"""Queries: circular posteriors, point processes, emissions and state-space models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from shiftspark.functions import columns as col
from shiftspark.operators import emissions, periodic, pointprocess, statespace, study, synthetic
from shiftspark.plans.build import HOURLY, ORACLE_SQL, USERS, VECTORS, hourly_bits, query, table, user_values, vectors, weekly_revenue
from shiftspark.sources import series as src

# --- within a period -----------------------------------------------------------------------

_EIGHT = f"""{HOURLY}, c AS (SELECT series_id, CAST(t % 8 AS INTEGER) AS phase, CAST(sum(CASE WHEN n > 2 THEN 1 ELSE 0 END) AS BIGINT) AS s, count(*) AS n FROM hourly GROUP BY 1, 2)"""


def _eight(spark, sf_dir):
    bits = hourly_bits(spark, sf_dir).withColumn("value", F.col("n") > 2)
    return periodic.phase_counts(bits, 8)


@query(f"WITH {_EIGHT} SELECT * FROM c")
def phase_counts(spark, sf_dir):
    return _eight(spark, sf_dir)


@query(f"""
WITH {_EIGHT}, b AS (SELECT * FROM (VALUES (1), (4), (6)) AS v(stop)),
o AS (SELECT series_id, s, n, coalesce((SELECT min(stop) FROM b WHERE stop >= phase), 1) AS stop FROM c)
SELECT series_id, CAST(stop AS INTEGER) AS stop, CAST(sum(s) AS BIGINT) AS s, CAST(sum(n) AS BIGINT) AS n FROM o GROUP BY 1, 2
""")
def circular_segment_stats(spark, sf_dir):
    c = _eight(spark, sf_dir)
    b = c.select("series_id").distinct().select("series_id", F.explode(F.array(F.lit(1), F.lit(4), F.lit(6))).alias("cp"))
    return periodic.segment_stats(c, b, 8)


_TAUS = """
taus AS (
  SELECT 0 AS m, CAST(NULL AS INTEGER) AS b1, CAST(NULL AS INTEGER) AS b2, CAST(NULL AS INTEGER) AS b3, CAST(NULL AS INTEGER) AS b4
  UNION ALL SELECT 2, a.i, b.i, NULL, NULL FROM l a JOIN l b ON b.i - a.i >= 2 AND a.i + 8 - b.i >= 2
  UNION ALL SELECT 3, a.i, b.i, c.i, NULL FROM l a JOIN l b ON b.i - a.i >= 2 JOIN l c ON c.i - b.i >= 2 AND a.i + 8 - c.i >= 2
  UNION ALL SELECT 4, a.i, b.i, c.i, d.i FROM l a JOIN l b ON b.i - a.i >= 2 JOIN l c ON c.i - b.i >= 2 JOIN l d ON d.i - c.i >= 2 AND a.i + 8 - d.i >= 2
)"""


@query(f"""
WITH {_EIGHT}, l AS (SELECT CAST(unnest(range(8)) AS INTEGER) AS i), {_TAUS},
ends AS (
  SELECT m, b1, b2, b3, b4, -1 AS a, 7 AS b FROM taus WHERE m = 0
  UNION ALL SELECT m, b1, b2, b3, b4, coalesce(b4, b3, b2) - 8, b1 FROM taus WHERE m > 0
  UNION ALL SELECT m, b1, b2, b3, b4, b1, b2 FROM taus WHERE m > 1
  UNION ALL SELECT m, b1, b2, b3, b4, b2, b3 FROM taus WHERE m > 2
  UNION ALL SELECT m, b1, b2, b3, b4, b3, b4 FROM taus WHERE m > 3
),
arcs AS (SELECT c.series_id, m, b1, b2, b3, b4, b AS stop, sum(s) AS s, sum(n) AS n FROM ends JOIN c ON (c.phase > a AND c.phase <= b) OR (c.phase - 8 > a AND c.phase - 8 <= b) GROUP BY ALL),
lp AS (
  SELECT series_id, m, b1, b2, b3, b4, sum(lgamma(1 + s) + lgamma(1 + n - s) - lgamma(2 + n)) AS ll, greatest(m, 1) AS k FROM arcs GROUP BY ALL
),
full_ AS (SELECT *, ll + CASE WHEN m = 0 THEN 0 ELSE lgamma(9 - 2 * k) + lgamma(k) - lgamma(8 - 2 * k + k) END - 1 - lgamma(k + 1) - ln(exp(-1) * (1 + 1 / CAST(2 AS DOUBLE) + 1 / CAST(6 AS DOUBLE) + 1 / CAST(24 AS DOUBLE))) AS log_post FROM lp),
w AS (SELECT *, exp(log_post - max(log_post) OVER (PARTITION BY series_id)) AS w FROM full_)
SELECT series_id, concat_ws(',', b1, b2, b3, b4) AS tau, round(log_post, 6) AS log_post, round(w / sum(w) OVER (PARTITION BY series_id), 8) AS probability FROM w
""")
def tau_exact_posterior(spark, sf_dir):
    post = periodic.exact_posterior(_eight(spark, sf_dir), periodic.valid_taus(spark, 8, 2), 8, 2)
    return post.select("series_id", F.concat_ws(",", F.col("tau").cast("array<string>")).alias("tau"), F.round("log_post", 6).alias("log_post"), F.round("probability", 8).alias("probability"))


@query()
def within_period_chains(spark, sf_dir):
    draws = periodic.sample(_eight(spark, sf_dir), 8, 2, chains=2, iterations=1500, burn=300)
    return periodic.tau_frequencies(draws).withColumn("tau", F.concat_ws(",", F.col("tau").cast("array<string>")))


@query()
def within_period_tempered(spark, sf_dir):
    draws = periodic.sample(_eight(spark, sf_dir), 8, 2, chains=2, iterations=1000, burn=200, hot=3.0)
    return periodic.boundary_mass(draws)


@query()
def within_period_prior_sensitivity(spark, sf_dir):
    return periodic.sample_rates(_eight(spark, sf_dir), 8, 2, [0.5, 1.0, 3.0], 800, 200)


@query()
def within_period_bands(spark, sf_dir):
    c = _eight(spark, sf_dir)
    return periodic.pointwise_bands(periodic.sample(c, 8, 2, chains=1, iterations=600, burn=200), c, 8)


@query()
def within_period_predictive(spark, sf_dir):
    c = _eight(spark, sf_dir)
    return periodic.predictive_counts(periodic.sample(c, 8, 2, chains=1, iterations=600, burn=200), c, 8)


_DRAWS = f"""{USERS}, d AS (SELECT series_id, t % 7 AS g, count(*) AS n FROM users GROUP BY 1, 2), f AS (SELECT series_id, g, n * 1.0 / sum(n) OVER (PARTITION BY series_id) AS p, n FROM d)"""


@query("WITH " + _DRAWS + """
SELECT series_id, count(*) AS size FROM (
  SELECT series_id, coalesce(sum(n) OVER (PARTITION BY series_id ORDER BY n DESC, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 1.0 / sum(n) OVER (PARTITION BY series_id) AS before FROM f
) WHERE before < 0.8 - 1e-9 GROUP BY 1
""")
def credible_set_sizes(spark, sf_dir):
    d = user_values(spark, sf_dir).select("series_id", F.array((F.col("t") % 7).cast("int")).alias("tau"))
    return periodic.credible_size(periodic.tau_frequencies(d), 0.8)


@query(f"WITH {USERS}, t AS (SELECT series_id, count(*) AS n FROM users GROUP BY 1) SELECT u.series_id, CAST(u.t % 7 AS INTEGER) AS phase, round(count(*) * 1.0 / t.n, 9) AS mass FROM users u JOIN t USING (series_id) GROUP BY 1, 2, t.n")
def boundary_masses(spark, sf_dir):
    d = user_values(spark, sf_dir).select("series_id", F.array((F.col("t") % 7).cast("int")).alias("tau"))
    return periodic.boundary_mass(d).withColumn("mass", F.round("mass", 9))


@query(f"""
WITH {USERS}, n AS (SELECT series_id, count(*) AS n, avg(cents) AS m, max(cents) AS hi, min(cents) AS lo FROM users GROUP BY 1),
z AS (SELECT series_id, t, cents - m AS z FROM users JOIN n USING (series_id)), k AS (SELECT unnest(range(15)) AS lag),
c AS (SELECT a.series_id, lag, sum(a.z * b.z) AS c FROM z a CROSS JOIN k JOIN z b ON b.series_id = a.series_id AND b.t = a.t - lag GROUP BY 1, 2),
r AS (SELECT n.series_id, k.lag, coalesce(c.c, 0) / max(CASE WHEN k.lag = 0 THEN c.c END) OVER (PARTITION BY n.series_id) AS acf FROM n CROSS JOIN k LEFT JOIN c ON c.series_id = n.series_id AND c.lag = k.lag),
g AS (SELECT series_id, (lag - 1) // 2 AS pair, sum(acf) AS g FROM r WHERE lag > 0 GROUP BY 1, 2),
p AS (SELECT series_id, g, min(g) OVER (PARTITION BY series_id ORDER BY pair) AS least FROM g),
s AS (SELECT series_id, sum(g) AS total FROM p WHERE least > 0 GROUP BY 1)
SELECT n.series_id, CASE WHEN hi > lo THEN round(n / (1 + 2 * coalesce(total, 0)), 6) END AS ess FROM n LEFT JOIN s USING (series_id)
""")
def effective_sample_sizes(spark, sf_dir):
    found = periodic.effective_size(user_values(spark, sf_dir), 15, "cents")
    return found.select("series_id", F.when(F.col("ess") < float("inf"), F.round("ess", 6)).alias("ess"))


@query()
def indicator_sample_sizes(spark, sf_dir):
    return periodic.indicator_effective_size(periodic.sample(_eight(spark, sf_dir), 8, 2, chains=2, iterations=800, burn=200), 7)


@query()
def within_period_segments(spark, sf_dir):
    c = _eight(spark, sf_dir)
    return periodic.segment_summaries(periodic.sample(c, 8, 2, chains=2, iterations=800, burn=200), c, 8)


def _observed_rates(spark, sf_dir, period):
    """{series: (days, grid)}: how often each phase of each event type's hours is busy, as the rates of a scenario."""
    bits = hourly_bits(spark, sf_dir).withColumn("value", F.col("n") > 2)
    rates = periodic.phase_counts(bits, period).groupBy("series_id").agg(F.max("n").alias("days"), F.map_from_entries(F.collect_list(F.struct("phase", F.col("s") / F.col("n")))).alias("grid"))
    return {r.series_id: (int(r.days), [float(r.grid.get(i, 0.0)) for i in range(period)]) for r in rates.collect()}  # a handful of event types


@query()
def within_period_scenarios(spark, sf_dir):
    """Chains on scenarios made with each event type's own rates, by how often each phase is a boundary."""
    bits = synthetic.scenario_bits(spark, _observed_rates(spark, sf_dir, 24))
    return periodic.boundary_mass(periodic.sample(periodic.phase_counts(bits, 24), 24, 4, chains=2, iterations=400, burn=100))


@query()
def sensor_home_activity(spark, sf_dir):
    """Whether any type is busy, where types are busy by chance at their own rates."""
    return synthetic.any_of(synthetic.scenario_bits(spark, _observed_rates(spark, sf_dir, 24)))


def _study(spark, sf_dir):
    counts = _eight(spark, sf_dir)
    scenarios = counts.select("series_id").distinct().withColumns({"period": F.lit(8), "min_length": F.lit(2)})
    return counts, scenarios


@query()
def within_period_study(spark, sf_dir):
    """Modes, acceptance, credible sets and convergence of every (event type, prior rate) by two chains each."""
    return study.study_tables(*_study(spark, sf_dir), "ci")["fits"]


@query(f"""
WITH e AS ({ORACLE_SQL["tau_exact_posterior"]}), r AS (SELECT series_id, tau, log_post, CASE WHEN tau = '' THEN 1 ELSE len(string_split(tau, ',')) END AS m FROM e),
z AS (SELECT *, log_post + m * ln(rate) - rate - ln(exp(-rate) * (rate + rate ** 2 / 2 + rate ** 3 / 6 + rate ** 4 / 24)) + 1 + ln(exp(-1) * (1 + 1 / CAST(2 AS DOUBLE) + 1 / CAST(6 AS DOUBLE) + 1 / CAST(24 AS DOUBLE))) AS lp
      FROM r CROSS JOIN (SELECT unnest([CAST(0.5 AS DOUBLE), 1, 2]) AS rate)),
w AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY series_id, rate)) AS w FROM z),
p AS (SELECT *, w / sum(w) OVER (PARTITION BY series_id, rate) AS p FROM w)
SELECT series_id, rate, 'evaluated' AS status, count(*) AS state_count, replace(arg_max(tau, p), ',', ' ') AS exact_mode, round(max(p), 5) AS exact_probability FROM p GROUP BY 1, 2
""")
def within_period_study_exact(spark, sf_dir):
    """The exact posteriors that a study is held against."""
    counts, scenarios = _study(spark, sf_dir)
    found = study.study_tables(counts, scenarios, "ci")["exact"]
    return found.select("series_id", "rate", "status", "state_count", "exact_mode", F.round("exact_probability", 5).alias("exact_probability"))


# --- point processes -------------------------------------------------------------------------


@query("""
WITH i AS (SELECT o_custkey AS key, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS start, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 90 AS stop FROM orders),
m AS (SELECT *, CASE WHEN max(stop) OVER w IS NULL OR start > max(stop) OVER w THEN 1 ELSE 0 END AS fresh FROM i WINDOW w AS (PARTITION BY key ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT key, min(start) AS start, max(stop) AS stop FROM g GROUP BY key, island
""")
def exposure_union(spark, sf_dir):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    i = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), day.alias("start"), (day + F.col("o_orderkey") % 90).alias("stop"))
    return pointprocess.exposure_union(i)


@query("""
WITH e AS (SELECT event_id, event_type AS key, (epoch_us(ts) // 60000000) % 1440 AS time FROM events),
x AS (SELECT * FROM (VALUES (0, 300), (420, 900), (901, 1300)) AS v(start, stop))
SELECT event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM x WHERE e.time >= x.start AND e.time < x.stop)
""")
def events_outside_exposure(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("key"), F.expr("(unix_micros(CAST(ts AS TIMESTAMP)) div 60000000) % 1440").alias("time"))
    spans = spark.createDataFrame([(0, 300), (420, 900), (901, 1300)], "start int, stop int")
    x = e.select("key").distinct().crossJoin(F.broadcast(spans))
    return pointprocess.outside_exposure(e, x, ["key"]).select("event_id")


def _periods(spark, sf_dir):
    us = F.expr("unix_micros(CAST(ts AS TIMESTAMP))")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 86400000000").alias("day"), ((us % 86_400_000_000) / 3.6e9).alias("h"))
    days = e.groupBy("series_id", "day").agg(F.array_sort(F.collect_list("h")).alias("event_times"))
    full = F.array(F.struct(F.lit(0.0).alias("start"), F.lit(24.0).alias("stop")))
    return src.number_rows(days, ["day"], "series_id").select("series_id", "t", "event_times", full.alias("exposure"))


@query()
def sliced_poisson_splines(spark, sf_dir):
    return pointprocess.sliced_poisson(_periods(spark, sf_dir), 24.0, n_basis=5, degree=2, min_length=3)


@query()
def sliced_poisson_marks(spark, sf_dir):
    p = _periods(spark, sf_dir).withColumn("mark", F.col("series_id")).withColumn("series_id", F.lit("all"))
    return pointprocess.marked(p, period=24.0, n_basis=1, degree=0, min_length=2).select("series_id", "mark", "segment", "start", "stop", "cost", "events")


@query()
def sliced_poisson_intensity(spark, sf_dir):
    found = pointprocess.sliced_poisson(_periods(spark, sf_dir), 24.0, n_basis=5, degree=2, min_length=4)
    return pointprocess.intensities(found, 24.0, 5, 2, 12)


# --- emissions --------------------------------------------------------------------------------


@query(f"""
WITH {VECTORS}, u AS (SELECT series_id AS label, unnest(x) AS v, unnest(range(len(x))) AS dim FROM vectors)
SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(v), 8) AS mean, round(greatest(var_pop(v), 1e-6), 8) AS var FROM u GROUP BY 1, 2
""")
def gaussian_diag_by_label(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumnRenamed("series_id", "label")
    return emissions.diag_from_labels(v).select("label", "dim", F.round("mean", 8).alias("mean"), F.round("var", 8).alias("var"))


@query(f"""
WITH {VECTORS}, u AS (SELECT series_id, t, unnest(x) AS v, unnest(range(len(x))) AS dim FROM vectors),
p AS (SELECT series_id AS label, dim, avg(v) AS m, greatest(var_pop(v), 1e-6) AS s FROM u GROUP BY 1, 2)
SELECT u.series_id, u.t, CAST(p.label AS BIGINT) AS state, round(sum(-0.5 * (1.8378770664093453 + ln(s) + (v - m) * (v - m) / s)), 6) AS loglik
FROM u JOIN p USING (dim) GROUP BY 1, 2, 3
""")
def gaussian_diag_loglik(spark, sf_dir):
    v = vectors(spark, sf_dir)
    par = emissions.diag_from_labels(v.withColumnRenamed("series_id", "label"))
    ll = emissions.label_loglik(v, par, ["series_id", "t"])
    return ll.select("series_id", "t", F.posexplode("loglik").alias("state", "loglik")).select("series_id", "t", F.col("state").cast("long"), F.round("loglik", 6).alias("loglik"))


@query(f"""
WITH {VECTORS}, w AS (SELECT t, x, unnest(range(2)) AS state, CASE WHEN unnest(range(2)) = 0 THEN (series_id + 1) / CAST(series_id + 3 AS DOUBLE) ELSE 2 / CAST(series_id + 3 AS DOUBLE) END AS w FROM vectors),
u AS (SELECT state, w, unnest(x) AS v, unnest(range(len(x))) AS dim FROM w)
SELECT CAST(state AS INTEGER) AS state, CAST(dim AS INTEGER) AS dim, round(sum(w * v) / sum(w), 7) AS mean, round(greatest(sum(w * v * v) / sum(w) - (sum(w * v) / sum(w)) * (sum(w * v) / sum(w)), 1e-6), 7) AS var FROM u GROUP BY 1, 2
""")
def gaussian_diag_weighted(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("r", F.array((F.col("series_id") + 1).cast("double"), F.lit(2.0)))
    return emissions.diag_from_responsibilities(v).select("state", "dim", F.round("mean", 7).alias("mean"), F.round("var", 7).alias("var"))


@query(f"""
WITH {VECTORS}, u AS (SELECT series_id AS label, t, unnest(x) AS v, unnest(range(len(x))) AS dim FROM vectors)
SELECT a.label, CAST(a.dim AS INTEGER) AS i, CAST(b.dim AS INTEGER) AS j, round(covar_samp(a.v, b.v), 12) AS cov FROM u a JOIN u b ON a.label = b.label AND a.t = b.t AND a.dim <= b.dim GROUP BY 1, 2, 3
""")
def gaussian_full_by_label(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumnRenamed("series_id", "label")
    return emissions.full_from_labels(v).withColumn("cov", F.round("cov", 12))


@query(f"""
WITH {VECTORS}, u AS (SELECT series_id, t, unnest(x)::DOUBLE AS v, unnest(range(len(x))) AS dim FROM vectors),
p AS (SELECT s.state, CASE s.state WHEN 0 THEN a.series_id + 1 ELSE 2 END / (a.series_id + 3.0)::DOUBLE AS w, a.dim AS i, b.dim AS j, a.v AS xi, b.v AS xj
      FROM u a JOIN u b ON a.series_id = b.series_id AND a.t = b.t AND a.dim <= b.dim, (VALUES (0), (1)) s(state))
SELECT CAST(state AS INTEGER) AS state, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
       round(sum(w * xi * xj) / sum(w) - sum(w * xi) / sum(w) * sum(w * xj) / sum(w), 7) + 0.0 AS cov
FROM p GROUP BY ALL
""")
def gaussian_full_weighted(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("r", F.array((F.col("series_id") + 1).cast("double"), F.lit(2.0)))
    return emissions.full_from_responsibilities(v).withColumn("cov", F.round("cov", 7) + 0.0)


@query(f"""
WITH {USERS}, d AS (SELECT series_id, t, cents / 100.0 AS y, lag(cents / 100.0) OVER w AS l1, lag(cents / 100.0, 2) OVER w AS l2 FROM users WINDOW w AS (PARTITION BY series_id ORDER BY t))
SELECT series_id, t, round(-0.5 * (1.8378770664093453 + ln(900) + (y - 3 - 0.4 * l1 + 0.1 * l2) * (y - 3 - 0.4 * l1 + 0.1 * l2) / 900), 7) AS loglik FROM d WHERE l2 IS NOT NULL
""")
def ar_loglik(spark, sf_dir):
    v = user_values(spark, sf_dir).select("series_id", "t", (F.col("cents") / 100.0).alias("value"))
    d = emissions.ar_design(v, 2)
    return d.select("series_id", "t", F.round(emissions.ar_loglik(d, 3.0, [0.4, -0.1], 900.0), 7).alias("loglik"))


_AR = """
s AS (SELECT {key}, sum(w) AS n, sum(w * y * y) AS yy, sum(w) + 1e-8 AS a, sum(w * l1) AS b, sum(w * l2) AS c, sum(w * l1 * l1) + 1e-8 AS d, sum(w * l1 * l2) AS e, sum(w * l2 * l2) + 1e-8 AS f,
             sum(w * y) AS g, sum(w * l1 * y) AS h, sum(w * l2 * y) AS i FROM v WHERE l2 IS NOT NULL GROUP BY 1),
q AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM s),
x AS (SELECT *, (g * (d * f - e * e) - b * (h * f - e * i) + c * (h * e - d * i)) / det AS x0, (a * (h * f - e * i) - g * (b * f - e * c) + c * (b * i - h * c)) / det AS x1,
             (a * (d * i - h * e) - b * (b * i - h * c) + g * (b * e - d * c)) / det AS x2 FROM q)
SELECT {key}, round(x0, 5) AS intercept, round(x1, 7) AS phi1, round(x2, 7) AS phi2,
       round((yy - 2 * (x0 * g + x1 * h + x2 * i) + (a - 1e-8) * x0 * x0 + (d - 1e-8) * x1 * x1 + (f - 1e-8) * x2 * x2 + 2 * (b * x0 * x1 + c * x0 * x2 + e * x1 * x2)) / n, 4) AS variance FROM x
"""


def _ar_rows(found, key):
    return found.select(key, F.round("intercept", 5).alias("intercept"), F.round(F.get("coefficients", 0), 7).alias("phi1"), F.round(F.get("coefficients", 1), 7).alias("phi2"), F.round("variance", 4).alias("variance"))


@query(f"""
WITH {USERS}, v AS (
  SELECT CAST((t // 20) % 2 AS INTEGER) AS label, CAST(1 AS DOUBLE) AS w, cents / CAST(100 AS DOUBLE) AS y, lag(cents / CAST(100 AS DOUBLE)) OVER o AS l1, lag(cents / CAST(100 AS DOUBLE), 2) OVER o AS l2
  FROM users WINDOW o AS (PARTITION BY series_id, t // 20 ORDER BY t)),
{_AR.format(key="label")}""")
def ar_from_labels(spark, sf_dir):
    v = user_values(spark, sf_dir).select("series_id", "t", (F.col("cents") / 100.0).alias("value"), F.expr("CAST((t div 20) % 2 AS INT)").alias("label"))
    return _ar_rows(emissions.ar_from_labels(v, 2), "label")


@query(f"""
WITH {USERS}, u AS (
  SELECT t, cents / CAST(100 AS DOUBLE) AS y, lag(cents / CAST(100 AS DOUBLE)) OVER o AS l1, lag(cents / CAST(100 AS DOUBLE), 2) OVER o AS l2 FROM users WINDOW o AS (PARTITION BY series_id ORDER BY t)),
v AS (SELECT 0 AS state, (1 + t % 3) / CAST(5 + t % 3 AS DOUBLE) AS w, y, l1, l2 FROM u UNION ALL SELECT 1, 4 / CAST(5 + t % 3 AS DOUBLE), y, l1, l2 FROM u),
{_AR.format(key="state")}""")
def ar_from_responsibilities(spark, sf_dir):
    r = F.array((1 + F.col("t") % 3).cast("double"), F.lit(4.0))
    v = user_values(spark, sf_dir).select("series_id", "t", (F.col("cents") / 100.0).alias("value"), r.alias("r"))
    return _ar_rows(emissions.ar_from_responsibilities(v, 2), "state")


@query()
def ar_simulated(spark, sf_dir):
    """Two autoregressions that take turns along each user's own path of cheap and dear events."""
    states = user_values(spark, sf_dir).select("series_id", "t", (F.col("cents") > 5000).cast("int").alias("state"))
    made = emissions.simulate_ar(states, [0.0, 4.0], [[0.5], [0.2, 0.1]], [1.0, 0.5])
    return emissions.ar_from_labels(made.withColumnRenamed("state", "label"), 1)


@query()
def gaussian_full_loglik(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumnRenamed("series_id", "label")
    return emissions.FullGaussians.from_labels(v, ridge=1e-3).loglik(v, ["label", "t"])


@query()
def gaussian_full_samples(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumnRenamed("series_id", "state")
    return emissions.FullGaussians.from_kmeans(v, 2, ["state", "t"], ridge=1e-3).sample(v.select("t", (F.col("state") % 2).cast("int").alias("state")))


@query(f"""
WITH {VECTORS}, u AS (SELECT series_id, t, unnest(x) AS v, unnest(range(len(x))) AS dim FROM vectors)
SELECT series_id, t, round(sum(CASE dim WHEN 0 THEN 2 * (v - 0.1) * (v - 0.1) WHEN 1 THEN 3 * (v + 0.2) * (v + 0.2) ELSE 0 END) + 2 * 0.5 * max(CASE WHEN dim = 0 THEN v - 0.1 END) * max(CASE WHEN dim = 1 THEN v + 0.2 END), 8) AS d2 FROM u GROUP BY 1, 2
""".replace("0.1)", "CAST(0.1 AS DOUBLE))").replace("0.2)", "CAST(0.2 AS DOUBLE))"))
def squared_mahalanobis(spark, sf_dir):
    d2 = col.squared_mahalanobis(F.col("x"), [0.1, -0.2], [[2.0, 0.5], [0.5, 3.0]])
    return vectors(spark, sf_dir).select("series_id", "t", F.round(d2, 8).alias("d2"))


@query()
def emission_kmeans(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return emissions.kmeans(v, 3, ["series_id", "t"])


# --- state-space models --------------------------------------------------------------------------


@query(f"""
WITH {USERS}, r AS (SELECT DISTINCT series_id, 1 + series_id % 5 AS rate FROM users), d AS (SELECT unnest(range(1, 11)) AS d),
v AS (SELECT series_id, d, d * ln(rate) - rate - lgamma(d + 1) AS v FROM r CROSS JOIN d)
SELECT series_id, CAST(d AS INTEGER) AS d, round(v - ln(sum(exp(v)) OVER (PARTITION BY series_id)), 8) AS log_p FROM v
""")
def duration_table(spark, sf_dir):
    r = user_values(spark, sf_dir).select("series_id").distinct().select("series_id", (1 + F.col("series_id") % 5).cast("double").alias("rate"))
    return r.select("series_id", F.explode(statespace.duration_rows(F.col("rate"), 10)).alias("x")).select("series_id", "x.d", F.round("x.log_p", 8).alias("log_p"))


_SD = """
WITH d AS (SELECT CAST(ts AS DATE) AS day, (count(*) FILTER (WHERE event_type = 'click') + 1.0) / (count(*) + 3) AS a, (count(*) FILTER (WHERE event_type = 'view') + 1.0) / (count(*) + 3) AS b FROM events GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, round(lgamma(6) - lgamma(2) - lgamma(3) - lgamma(1) + 2 * ln(0.2) + 3 * ln(0.3) + ln(0.5) + 1 * ln(a) + 2 * ln(b) - 6 * ln(0.2 * a + 0.3 * b + 0.5 * (1 - a - b)), 7) AS loglik FROM d
"""


@query(_SD)
def scaled_dirichlet_density(spark, sf_dir):
    n = F.count("*") + 3
    d = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(((F.count_if(F.col("event_type") == "click") + 1) / n).alias("a"), ((F.count_if(F.col("event_type") == "view") + 1) / n).alias("b"))
    x = F.array("a", "b", 1 - F.col("a") - F.col("b"))
    return d.select(F.col("day").cast("string"), F.round(statespace.scaled_dirichlet_loglik(x, [2.0, 3.0, 1.0], [0.2, 0.3, 0.5]), 7).alias("loglik"))


_PI, _A = [0.6, 0.4], [[0.9, 0.1], [0.2, 0.8]]


@query(f"""
WITH RECURSIVE {USERS}, ll AS (SELECT series_id, t, CAST(-0.5 * (cents / 100.0 - 20) * (cents / 100.0 - 20) / 400 AS DOUBLE) AS a, CAST(-0.5 * (cents / 100.0 - 60) * (cents / 100.0 - 60) / 900 - ln(1.5) AS DOUBLE) AS b FROM users),
step AS (
  SELECT series_id, t, a + ln(0.6) AS a, b + ln(0.4) AS b FROM ll WHERE t = 0
  UNION ALL
  SELECT l.series_id, l.t, greatest(s.a + ln(0.9), s.b + ln(0.2)) + l.a, greatest(s.a + ln(0.1), s.b + ln(0.8)) + l.b FROM step s JOIN ll l ON l.series_id = s.series_id AND l.t = s.t + 1
)
SELECT series_id, t, round(a, 6) AS a, round(b, 6) AS b FROM step
""")
def viterbi_scores(spark, sf_dir):
    v = F.col("cents") / 100.0
    a, b = -0.5 * (v - 20) * (v - 20) / 400, -0.5 * (v - 60) * (v - 60) / 900 - math.log(1.5)
    rows = user_values(spark, sf_dir).groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", F.array(a, b).alias("ll")))), lambda x: x["ll"]).alias("rows"))
    logs = lambda p: [math.log(v) for v in p]
    s = rows.select("series_id", F.posexplode(statespace.fold_viterbi_scores(F.col("rows"), logs(_PI), [logs(r) for r in _A])).alias("t", "s"))
    return s.select("series_id", F.col("t").cast("long"), F.round(F.get("s", 0), 6).alias("a"), F.round(F.get("s", 1), 6).alias("b"))


def _loglik(spark, sf_dir):
    v = F.col("cents") / 100.0
    a, b = -0.5 * (v - 20) * (v - 20) / 400, -0.5 * (v - 60) * (v - 60) / 900 - math.log(1.5)
    return user_values(spark, sf_dir).select("series_id", "t", F.array(a, b).alias("loglik"))


@query(f"""
WITH RECURSIVE {USERS}, ll AS (SELECT series_id, t, CAST(-0.5 * (cents / 100.0 - 20) * (cents / 100.0 - 20) / 400 AS DOUBLE) AS a, CAST(-0.5 * (cents / 100.0 - 60) * (cents / 100.0 - 60) / 900 - ln(1.5) AS DOUBLE) AS b FROM users),
step AS (
  SELECT series_id, t, a + ln(0.6) AS a, b + ln(0.4) AS b, 0 AS fa, 0 AS fb FROM ll WHERE t = 0
  UNION ALL
  SELECT l.series_id, l.t, greatest(s.a + ln(0.9), s.b + ln(0.2)) + l.a, greatest(s.a + ln(0.1), s.b + ln(0.8)) + l.b,
         CASE WHEN s.a + ln(0.9) >= s.b + ln(0.2) THEN 0 ELSE 1 END, CASE WHEN s.a + ln(0.1) >= s.b + ln(0.8) THEN 0 ELSE 1 END
  FROM step s JOIN ll l ON l.series_id = s.series_id AND l.t = s.t + 1
),
n AS (SELECT series_id, max(t) AS n FROM users GROUP BY 1),
back AS (
  SELECT series_id, t, CASE WHEN a >= b THEN 0 ELSE 1 END AS state, fa, fb FROM step JOIN n USING (series_id) WHERE t = n
  UNION ALL
  SELECT s.series_id, s.t, CASE WHEN b.state = 0 THEN b.fa ELSE b.fb END, s.fa, s.fb FROM back b JOIN step s ON s.series_id = b.series_id AND s.t = b.t - 1
)
SELECT series_id, t, CAST(state AS INTEGER) AS state FROM back
""")
def hmm_viterbi_states(spark, sf_dir):
    found = statespace.decode_hmm(_loglik(spark, sf_dir), _PI, _A)
    return found.select(F.col("series_id").cast("long").alias("series_id"), "t", "state")


# Two states that take turns: entering scores, the best last durations, and cumulated log likelihoods, as lists.
_HSMM = f"""
RECURSIVE {USERS}, ll AS (SELECT series_id, t, CAST(-0.5 * (cents / 100.0 - 20) * (cents / 100.0 - 20) / 400 AS DOUBLE) AS a, CAST(-0.5 * (cents / 100.0 - 60) * (cents / 100.0 - 60) / 900 - ln(1.5) AS DOUBLE) AS b FROM users),
cum AS (SELECT series_id, t, sum(a) OVER w AS a, sum(b) OVER w AS b FROM ll WINDOW w AS (PARTITION BY series_id ORDER BY t)),
lists AS (SELECT series_id, count(*) AS n, [CAST(0 AS DOUBLE)] || list(a ORDER BY t) AS ca, [CAST(0 AS DOUBLE)] || list(b ORDER BY t) AS cb FROM cum GROUP BY 1),
raw AS (SELECT unnest(range(1, 21)) AS d), dens AS (SELECT d, {{density}} AS p FROM raw),
dur AS (SELECT list(p - z ORDER BY d) AS p FROM dens CROSS JOIN (SELECT ln(sum(exp(p))) AS z FROM dens)),
step AS (
  SELECT series_id, n, ca, cb, p, CAST(0 AS BIGINT) AS t, [ln(CAST(0.5 AS DOUBLE))] AS ea, [ln(CAST(0.5 AS DOUBLE))] AS eb, [CAST(0 AS BIGINT)] AS la, [CAST(0 AS BIGINT)] AS lb, CAST(0 AS DOUBLE) AS za, CAST(0 AS DOUBLE) AS zb FROM lists CROSS JOIN dur
  UNION ALL
  SELECT series_id, n, ca, cb, p, t + 1, ea || [xb.v], eb || [xa.v], la || [-xa.d], lb || [-xb.d], xa.v, xb.v
  FROM (SELECT *, list_max(list_transform(range(1, least(20, t + 1) + 1), lambda d: {{{{'v': ea[t + 2 - d] + p[d] + ca[t + 2] - ca[t + 2 - d], 'd': -d}}}})) AS xa,
               list_max(list_transform(range(1, least(20, t + 1) + 1), lambda d: {{{{'v': eb[t + 2 - d] + p[d] + cb[t + 2] - cb[t + 2 - d], 'd': -d}}}})) AS xb
        FROM step WHERE t < n)
),
back AS (
  SELECT series_id, la, lb, CASE WHEN za >= zb THEN 0 ELSE 1 END AS state, n AS stop, CASE WHEN za >= zb THEN la[n + 1] ELSE lb[n + 1] END AS d FROM step WHERE t = n
  UNION ALL
  SELECT series_id, la, lb, 1 - state, stop - d, CASE WHEN state = 1 THEN la[stop - d + 1] ELSE lb[stop - d + 1] END FROM back WHERE stop - d > 0
)
SELECT CAST(series_id AS VARCHAR) AS series_id, u.t, CAST(state AS INTEGER) AS state, CAST(CASE WHEN u.t = stop - 1 THEN d ELSE 0 END AS INTEGER) AS duration FROM back, LATERAL (SELECT unnest(range(stop - d, stop)) AS t) u
"""


@query("WITH " + _HSMM.format(density="d * ln(6) - 6 - lgamma(d + 1)"))
def hsmm_states(spark, sf_dir):
    return statespace.decode_hsmm(_loglik(spark, sf_dir), [0.5, 0.5], [[0, 1], [1, 0]], [6.0, 6.0], 20)


@query("WITH " + _HSMM.format(density="lgamma(d + 2.5) - lgamma(2.5) - lgamma(d + 1) + 2.5 * ln(0.3) + d * ln(0.7)"))
def hsmm_negative_binomial_states(spark, sf_dir):
    return statespace.decode_hsmm(_loglik(spark, sf_dir), [0.5, 0.5], [[0, 1], [1, 0]], [(2.5, 0.7), (2.5, 0.7)], 20, family="negative_binomial")


@query()
def hsmm_negative_binomial_learned(spark, sf_dir):
    ll = _loglik(spark, sf_dir)
    return statespace.state_changepoints(statespace.decode_hsmm(ll, [0.5, 0.5], [[0, 1], [1, 0]], [(3.0, 0.6), (3.0, 0.6)], 12, learn=True, iterations=3, family="negative_binomial"))


@query(f"""
WITH {USERS}, r AS (SELECT DISTINCT series_id, 1.5 + series_id % 4 AS r, 0.2 + (series_id % 7) / CAST(10 AS DOUBLE) AS p FROM users), d AS (SELECT unnest(range(1, 11)) AS d),
v AS (SELECT series_id, d, lgamma(d + r) - lgamma(r) - lgamma(d + 1) + r * ln(1 - p) + d * ln(p) AS v FROM r CROSS JOIN d)
SELECT series_id, CAST(d AS INTEGER) AS d, round(v - ln(sum(exp(v)) OVER (PARTITION BY series_id)), 8) AS log_p FROM v
""")
def negative_binomial_table(spark, sf_dir):
    u = user_values(spark, sf_dir).select("series_id").distinct()
    r, p = (1.5 + F.col("series_id") % 4).cast("double"), 0.2 + (F.col("series_id") % 7) / 10
    return u.select("series_id", F.explode(statespace.negative_binomial_rows(r, p, 10)).alias("x")).select("series_id", "x.d", F.round("x.log_p", 8).alias("log_p"))


@query()
def hsmm_learned_changepoints(spark, sf_dir):
    ll = _loglik(spark, sf_dir)
    return statespace.state_changepoints(statespace.decode_hsmm(ll, [0.5, 0.5], [[0, 1], [1, 0]], [6.0, 6.0], 12, learn=True, iterations=4))


def _shares(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())  # a handful
    # a series for each user, so that the fit is as many tasks as there are users
    comp = src.compositions(e.withColumn("series_id", F.col("user_id").cast("string")), kinds, F.date_trunc("day", F.col("ts").cast("timestamp")), "event_type", "series_id")
    return src.number_rows(comp, ["day"], "series_id").select("series_id", "t", "comp")


@query()
def sdhmm_states(spark, sf_dir):
    return statespace.decode_sdhmm(_shares(spark, sf_dir), 2, iterations=8)


@query()
def sdhmm_mixture_states(spark, sf_dir):
    return statespace.decode_sdhmm(_shares(spark, sf_dir), 2, components=2, iterations=8)


@query(f"""
WITH st AS ({ORACLE_SQL["hmm_viterbi_states"]}),
m AS (SELECT state AS src, lead(state) OVER (PARTITION BY series_id ORDER BY t) AS dst FROM st)
SELECT src, dst, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY src), 9) AS p FROM m WHERE dst IS NOT NULL GROUP BY 1, 2
""")
def pooled_state_transitions(spark, sf_dir):
    return statespace.pooled_transitions(statespace.decode_hmm(_loglik(spark, sf_dir), _PI, _A)).withColumn("p", F.round("p", 9))


# --- synthetic series -----------------------------------------------------------------------------


@query()
def synthetic_outliers(spark, sf_dir):
    """Impulses on weekly revenue."""
    w = weekly_revenue(spark, sf_dir).withColumn("value", F.col("value").cast("double"))
    return synthetic.contaminate(w, 0.05, 80.0)


@query(f"""
WITH {HOURLY} SELECT t, bool_or(n > 2) AS value FROM hourly GROUP BY 1
""")
def synthetic_sensors(spark, sf_dir):
    """Whether any event type is busy in an hour."""
    return synthetic.any_of(hourly_bits(spark, sf_dir).select("series_id", "t", (F.col("n") > 2).alias("value")))


@query()
def synthetic_poisson(spark, sf_dir):
    """Days of each event type, made with half its own rate in the first half and its own in the second."""
    import numpy as np

    counts = hourly_bits(spark, sf_dir).groupBy("series_id", F.floor(F.col("t") / 24).alias("t")).agg(F.sum("n").alias("n"))
    sizes = counts.groupBy("series_id").agg(F.max("t").alias("last"), F.avg("n").alias("mean"))
    mean, last = sizes.agg(F.avg("mean"), F.max("last")).first()
    made = pointprocess.simulate_periods(counts.select("series_id", "t"), 24.0, mean / 24, lambda t, h: np.full(len(h), mean / 24 * (0.5 if t < last / 2 else 1.0)))
    return pointprocess.sliced_poisson(made, 24.0, n_basis=1, degree=0).select("series_id", "segment", "start", "stop", "events")
