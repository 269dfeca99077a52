"""Queries: binning, boundaries, costs, numerics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shiftspark.functions import columns as col
from shiftspark.operators import boundaries, costs, periodic, scoring, synthetic
from shiftspark.plans.build import HOURLY, USERS, WEEKLY, hourly_bits, query, table, user_values, weekly_revenue
from shiftspark.sources import series as src


@query("""
WITH ev AS (SELECT event_type AS series_id, epoch_us(ts) AS us FROM events),
span AS (SELECT series_id, min(us) AS lo, max(us) AS hi, (min(us) // 86400000000) * 86400000000 + 6 * 3600000000 AS m FROM ev GROUP BY 1),
a AS (SELECT series_id, hi, CASE WHEN lo >= m THEN m + 86400000000 ELSE m END AS anchor FROM span),
grid AS (SELECT series_id, unnest(range((hi - anchor) // 900000000 + 1)) AS t FROM a),
hit AS (SELECT DISTINCT ev.series_id, (us - anchor) // 900000000 AS t FROM ev JOIN a USING (series_id) WHERE us >= anchor)
SELECT g.series_id, g.t, hit.t IS NOT NULL AS value FROM grid g LEFT JOIN hit ON hit.series_id = g.series_id AND hit.t = g.t
""")
def bin_occupancy(spark, sf_dir):
    return src.occupied_bins(table(spark, sf_dir, "events"), 15, start_hour=6, key="event_type")


@query("""
WITH ev AS (SELECT event_type AS series_id, epoch_us(ts) + 19800000000 AS us FROM events),
span AS (SELECT series_id, min(us) AS lo, max(us) AS hi, (min(us) // 86400000000) * 86400000000 + 6 * 3600000000 AS m FROM ev GROUP BY 1),
a AS (SELECT series_id, hi, CASE WHEN lo >= m THEN m + 86400000000 ELSE m END AS anchor FROM span),
grid AS (SELECT series_id, unnest(range((hi - anchor) // 900000000 + 1)) AS t FROM a),
hit AS (SELECT DISTINCT ev.series_id, (us - anchor) // 900000000 AS t FROM ev JOIN a USING (series_id) WHERE us >= anchor)
SELECT g.series_id, g.t, hit.t IS NOT NULL AS value FROM grid g LEFT JOIN hit ON hit.series_id = g.series_id AND hit.t = g.t
""")
def bin_occupancy_local(spark, sf_dir):
    """Bins of the wall clock of a zone five and a half hours east."""
    return src.occupied_bins(table(spark, sf_dir, "events"), 15, start_hour=6, key="event_type", timezone="+05:30")


_CELLS = """cells AS (SELECT label AS series_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding FROM embeddings),
c AS (SELECT series_id, i, j, round(CAST(embedding[j + 1] AS DOUBLE), 4) AS v FROM cells CROSS JOIN (SELECT unnest(range(6)) AS j))"""


def _cells(spark, sf_dir):
    from shiftspark.plans.build import vectors

    return vectors(spark, sf_dir).select("series_id", F.col("t").alias("i"), F.posexplode(F.slice("x", 1, 6)).alias("j", "value"))


@query("WITH " + _CELLS + """,
n AS (SELECT DISTINCT series_id FROM c), p AS (SELECT series_id, i + 1 AS i, j + 1 AS j, sum(v) OVER (PARTITION BY series_id, i ORDER BY j) AS s FROM c),
q AS (SELECT series_id, i, j, sum(s) OVER (PARTITION BY series_id, j ORDER BY i) AS s FROM p)
SELECT series_id, i, CAST(j AS BIGINT) AS j, round(s, 9) + 0.0 AS s FROM q
UNION ALL SELECT DISTINCT series_id, i, 0, 0.0 FROM q UNION ALL SELECT DISTINCT series_id, 0, j, 0.0 FROM q UNION ALL SELECT series_id, 0, 0, 0.0 FROM n
""".replace("0.0 ", "CAST(0 AS DOUBLE) ").replace("0, 0.0", "0, CAST(0 AS DOUBLE)"))
def prefix_sums_2d(spark, sf_dir):
    from shiftspark.operators import costs

    return costs.prefix_2d(_cells(spark, sf_dir)).select("series_id", "i", "j", (F.round("s", 9) + 0.0).alias("s"))


@query("WITH " + _CELLS + """,
n AS (SELECT series_id, max(i) + 1 AS n FROM c GROUP BY 1), r AS (SELECT series_id, n // 4 AS i0, n // 2 AS i1, a AS j0, b AS j1 FROM n CROSS JOIN (VALUES (1, 4), (0, 6), (2, 2), (3, 9)) AS v(a, b))
SELECT r.series_id, i0, i1, CAST(j0 AS BIGINT) AS j0, CAST(j1 AS BIGINT) AS j1, CASE WHEN j1 <= 6 THEN round(coalesce(sum(v), 0), 8) + 0 END AS total
FROM r LEFT JOIN c ON c.series_id = r.series_id AND i >= i0 AND i < i1 AND j >= j0 AND j < j1 GROUP BY r.series_id, i0, i1, j0, j1
""")
def range_sums_2d(spark, sf_dir):
    from shiftspark.operators import costs

    cells = _cells(spark, sf_dir)
    n = cells.groupBy("series_id").agg((F.max("i") + 1).alias("n"))
    spans = F.array(*[F.struct(F.lit(a).cast("long").alias("j0"), F.lit(b).cast("long").alias("j1")) for a, b in ((1, 4), (0, 6), (2, 2), (3, 9))])
    ranges = n.select("series_id", F.expr("n div 4").alias("i0"), F.expr("n div 2").alias("i1"), F.explode(spans).alias("j")).select("series_id", "i0", "i1", "j.j0", "j.j1")
    return costs.range_sums_2d(costs.prefix_2d(cells), ranges).withColumn("total", F.round("total", 8) + 0)


@query(f"WITH {HOURLY} SELECT series_id, CAST(t % 24 AS INTEGER) AS phase, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 9) AS mean, count(*) AS n FROM hourly GROUP BY 1, 2")
def phase_mean(spark, sf_dir):
    bits = hourly_bits(spark, sf_dir).withColumn("value", (F.col("n") > 0).cast("int"))
    return src.phase_means(bits, 24).withColumn("mean", F.round("mean", 9))


@query("""
SELECT doc_id, CAST(u.t AS BIGINT) AS t, u.bit = '1' AS value
FROM (SELECT doc_id, regexp_replace(text, '[^01]', '', 'g') AS b FROM documents) d,
     LATERAL (SELECT unnest(string_split(d.b, '')) AS bit, unnest(range(length(d.b))) AS t) u
WHERE d.b <> ''
""")
def parsed_bits(spark, sf_dir):
    return src.parse_bits(table(spark, sf_dir, "documents"), "text", "doc_id")


@query(f"WITH {USERS} SELECT series_id, t // 3 AS window, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM (SELECT a.series_id, a.t, b.cents AS v FROM users a JOIN users b ON a.series_id = b.series_id AND b.t BETWEEN a.t AND a.t + 4 WHERE a.t % 3 = 0) GROUP BY series_id, t HAVING count(*) = 5")
def sliding_windows(spark, sf_dir):
    w = src.count_windows(user_values(spark, sf_dir), 5, 3, "cents")
    total = F.aggregate("values", F.lit(0).cast("long"), lambda acc, x: acc + x)
    return w.select("series_id", "window", total.alias("total"), F.size("values").cast("long").alias("n"))


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2),
t AS (SELECT DISTINCT event_type FROM events)
SELECT CAST(days.day AS VARCHAR) AS day, t.event_type AS category, round(coalesce(d.n, 0) * 1.0 / days.total, 9) AS share
FROM (SELECT day, sum(n) AS total FROM d GROUP BY 1) days CROSS JOIN t LEFT JOIN d ON d.day = days.day AND d.event_type = t.event_type
""")
def composition_shares(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("series_id", F.lit("all"))
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())  # the types of event, a handful
    comp = src.compositions(e, kinds, F.col("ts").cast("date"), "event_type", "series_id")
    shares = comp.select(F.col("day").cast("string").alias("day"), F.posexplode("comp").alias("i", "share"))
    return shares.select("day", F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("i") + 1).alias("category"), F.round("share", 9).alias("share"))


# --- boundaries ---------------------------------------------------------------------

_ROLES = """roles AS (SELECT conv_id AS series_id, turn AS t, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"""


def _roles(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("series_id"), F.col("turn").alias("t"), F.col("role").alias("label"))


@query(f"WITH {_ROLES} SELECT series_id, t AS cp FROM roles WHERE before IS NOT NULL AND before <> role")
def cps_from_labels(spark, sf_dir):
    return boundaries.changepoints_from_labels(_roles(spark, sf_dir))


@query(f"WITH {_ROLES} SELECT series_id, t, CAST(sum(CASE WHEN before <> role THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY t) AS BIGINT) AS label FROM roles")
def labels_from_cps(spark, sf_dir):
    r = _roles(spark, sf_dir)
    return boundaries.labels_from_changepoints(r, boundaries.changepoints_from_labels(r))


def _lengths(spark, sf_dir):
    v = user_values(spark, sf_dir)
    cps = v.where((F.col("t") > 0) & (F.col("cents") > 9000)).select("series_id", F.col("t").alias("cp"))
    return cps, v.groupBy("series_id").agg(F.count("*").alias("n"))


@query(f"""
WITH {USERS}, n AS (SELECT series_id, count(*) AS n FROM users GROUP BY 1),
s AS (SELECT series_id, t AS start FROM users WHERE t = 0 OR cents > 9000)
SELECT s.series_id, CAST(row_number() OVER (PARTITION BY s.series_id ORDER BY start) - 1 AS INTEGER) AS segment, start,
       coalesce(lead(start) OVER (PARTITION BY s.series_id ORDER BY start), n) AS stop
FROM s JOIN n USING (series_id)
""")
def segment_slices(spark, sf_dir):
    return boundaries.segments(*_lengths(spark, sf_dir))


@query(f"""
WITH {USERS}, e AS (SELECT series_id, t AS edge FROM users WHERE t = 0 OR cents > 9000 UNION ALL SELECT series_id, count(*) FROM users GROUP BY 1)
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY edge) - 1 AS i, edge FROM e
""")
def edges_of_changepoints(spark, sf_dir):
    cps, n = _lengths(spark, sf_dir)
    grouped = cps.groupBy("series_id").agg(F.array_sort(F.collect_list("cp")).alias("cps"))
    e = boundaries.edges(F.coalesce("cps", F.array().cast("array<bigint>")), F.col("n"))
    return n.join(grouped, "series_id", "left").select("series_id", F.posexplode(e).alias("i", "edge")).select("series_id", F.col("i").cast("long"), "edge")


@query(f"""
WITH {USERS}, b AS (SELECT DISTINCT series_id, CAST(((cents % 24) + 24) % 24 AS INTEGER) AS cp FROM users WHERE cents > 8000),
c AS (SELECT series_id, cp, coalesce(lag(cp) OVER (PARTITION BY series_id ORDER BY cp), max(cp) OVER (PARTITION BY series_id)) AS before FROM b)
SELECT series_id, CAST((before + 1) % 24 AS INTEGER) AS start, cp AS stop, CAST(CASE WHEN cp = before THEN 24 ELSE (cp - before + 24) % 24 END AS INTEGER) AS length FROM c
""")
def circular_segments(spark, sf_dir):
    b = user_values(spark, sf_dir).where("cents > 8000").select("series_id", F.pmod("cents", F.lit(24)).cast("int").alias("cp")).distinct()
    found = boundaries.circular_segments(b, 24)
    return found.select("series_id", F.col("start").cast("int"), "stop", F.col("length").cast("int"))


@query(f"""
WITH {USERS}, b AS (SELECT DISTINCT series_id, CAST(((cents % 24) + 24) % 24 + 5 AS INTEGER) % 24 AS cp FROM users WHERE cents > 8000)
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY cp) - 1 AS i, CAST(cp AS INTEGER) AS cp FROM b
""")
def rotated_boundaries(spark, sf_dir):
    b = user_values(spark, sf_dir).where("cents > 8000").select("series_id", F.pmod("cents", F.lit(24)).cast("int").alias("cp")).distinct()
    sets = b.groupBy("series_id").agg(F.collect_list("cp").alias("cps"))
    moved = sets.select("series_id", F.posexplode(boundaries.rotated(F.col("cps"), F.lit(5), 24)).alias("i", "cp"))
    return moved.select("series_id", F.col("i").cast("long"), F.col("cp").cast("int"))


@query(f"WITH {HOURLY}, h AS (SELECT CAST(t % 24 AS INTEGER) AS phase, sum(n) AS n FROM hourly GROUP BY 1) SELECT phase AS anchor FROM h ORDER BY n DESC, phase LIMIT 1")
def anchor_of_histogram(spark, sf_dir):
    h = hourly_bits(spark, sf_dir).groupBy(F.pmod("t", F.lit(24)).cast("int").alias("phase")).agg(F.sum("n").alias("n"))
    return boundaries.anchor(h)


@query(f"""
WITH {USERS} SELECT series_id, t, least(((cents - t) % 96 + 96) % 96, 96 - ((cents - t) % 96 + 96) % 96) AS distance FROM users
""")
def circular_distances(spark, sf_dir):
    return user_values(spark, sf_dir).select("series_id", "t", col.circular_distance(F.col("cents"), F.col("t"), 96).cast("long").alias("distance"))


# --- costs --------------------------------------------------------------------------

_CENTRED = f"""{USERS}, c AS (SELECT series_id, t, cents * 1.0 / 100 AS v FROM users)"""


@query(f"""
WITH {USERS},
p AS (SELECT series_id, t + 1 AS k, sum(cents) OVER w AS s1, sum(cents * cents) OVER w AS s2 FROM users WINDOW w AS (PARTITION BY series_id ORDER BY t))
SELECT series_id, k, round(greatest(s2 - CAST(s1 AS DOUBLE) * s1 / k, 0) / 1e8 + k * (1.8378770664093453 + ln(1e4)), 5) AS known,
       CASE WHEN k <= 1 THEN NULL ELSE round(k * (1.8378770664093453 + ln(greatest(greatest(s2 - CAST(s1 AS DOUBLE) * s1 / k, 0), 1e-12) / k) + 1), 5) END AS unknown
FROM p
""")
def prefix_costs(spark, sf_dir):
    p = costs.prefix(user_values(spark, sf_dir), "cents").where("k > 0")
    known = costs.known_variance(F.col("k"), F.col("s1") / 100, F.col("s2") / 10000, 1e4)
    unknown = costs.unknown_variance(F.col("k"), F.col("s1"), F.col("s2"))
    return p.select("series_id", "k", F.round(known, 5).alias("known"), F.when(F.col("k") > 1, F.round(unknown, 5)).alias("unknown"))


@query(f"""
WITH {USERS},
p AS (SELECT series_id, t + 1 AS k, sum(cents) OVER w AS s1, sum(cents * cents) OVER w AS s2 FROM users WINDOW w AS (PARTITION BY series_id ORDER BY t)),
n AS (SELECT series_id, max(k) AS n, arg_max(s1, k) AS t1, arg_max(s2, k) AS t2 FROM p GROUP BY 1),
c AS (SELECT p.series_id, p.k AS cp,
  greatest(s2 - CAST(s1 AS DOUBLE) * s1 / k, 0) / 1e8 + greatest(t2 - s2 - CAST(t1 - s1 AS DOUBLE) * (t1 - s1) / (n - k), 0) / 1e8 AS cost
  FROM p JOIN n USING (series_id) WHERE k < n)
SELECT series_id, arg_min(cp, (round(cost, 7), cp)) AS cp, round(min(cost), 5) AS cost FROM c GROUP BY 1
""")
def best_single_split(spark, sf_dir):
    p = costs.prefix(user_values(spark, sf_dir), "cents").where("k > 0")
    own = Window.partitionBy("series_id")
    last = p.withColumn("n", F.max("k").over(own)).withColumn("t1", F.max_by("s1", "k").over(own)).withColumn("t2", F.max_by("s2", "k").over(own)).where("k < n")
    cost = costs.sse(F.col("k"), F.col("s1"), F.col("s2")) / 1e8 + costs.sse(F.col("n") - F.col("k"), F.col("t1") - F.col("s1"), F.col("t2") - F.col("s2")) / 1e8
    scored = last.select("series_id", "k", cost.alias("cost"))
    return scored.groupBy("series_id").agg(F.min_by("k", F.struct(F.round("cost", 7), "k")).alias("cp"), F.round(F.min("cost"), 5).alias("cost"))


@query(f"""
WITH {HOURLY}, p AS (SELECT series_id, t + 1 AS k, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY t) AS s FROM hourly)
SELECT series_id, k, round(-(lgamma(s + 1) + lgamma(k - s + 1) - lgamma(k + 2)), 6) AS cost FROM p
""")
def beta_binomial_costs(spark, sf_dir):
    bits = hourly_bits(spark, sf_dir).withColumn("value", (F.col("n") > 0).cast("int"))
    p = costs.prefix(bits).where("k > 0")
    return p.select("series_id", "k", F.round(costs.beta_binomial(F.col("k"), F.col("s1")), 6).alias("cost"))


@query(f"WITH {USERS} SELECT series_id, count(*) AS n, round(2 * ln(greatest(count(*), 2)), 9) AS bic, 4.0 AS aic FROM users GROUP BY 1".replace("4.0", "CAST(4 AS DOUBLE)"))
def penalties(spark, sf_dir):
    n = user_values(spark, sf_dir).groupBy("series_id").agg(F.count("*").alias("n"))
    return n.select("series_id", "n", F.round(costs.bic_penalty(2, F.col("n")), 9).alias("bic"), costs.aic_penalty(2).alias("aic"))


@query(f"""
WITH {WEEKLY}, p AS (SELECT series_id, t + 1 AS k, sum(value) OVER (PARTITION BY series_id ORDER BY t) AS s1 FROM weekly
                     UNION ALL SELECT DISTINCT series_id, 0, 0 FROM weekly)
SELECT a.series_id, a.k AS a, b.k AS b, CAST(b.s1 - a.s1 AS BIGINT) AS total FROM p a JOIN p b ON a.series_id = b.series_id AND b.k - a.k BETWEEN 1 AND 8
""")
def range_sums(spark, sf_dir):
    p = costs.prefix(weekly_revenue(spark, sf_dir)).select("series_id", "k", "s1")
    ahead = F.array(*[F.struct((F.col("k") - d).alias("k"), F.lit(d).alias("d")) for d in range(1, 9)])
    right = p.select("series_id", F.col("k").alias("b"), F.col("s1").alias("bs"), F.explode(ahead).alias("x")).select("series_id", "b", "bs", F.col("x.k").alias("k"))
    return right.join(p, ["series_id", "k"]).select("series_id", F.col("k").alias("a"), "b", (F.col("bs") - F.col("s1")).alias("total"))


@query("""
WITH days AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY d) - 1 AS t, n FROM days),
p AS (SELECT series_id, t + 1 AS k, sum(n) OVER (PARTITION BY series_id ORDER BY t) AS e FROM s UNION ALL SELECT DISTINCT series_id, 0, 0 FROM s)
SELECT a.series_id, a.k AS a, b.k AS b, round(2 * ((b.e - a.e) - CASE WHEN b.e > a.e THEN (b.e - a.e) * ln((b.e - a.e) / (24.0 * (b.k - a.k))) ELSE 0 END), 6) AS cost
FROM p a JOIN p b ON a.series_id = b.series_id AND a.k < b.k
""")
def poisson_constant_intensity_cost(spark, sf_dir):
    from shiftspark.operators.pointprocess import constant_costs

    days = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("value"))
    periods = src.number_rows(days, ["d"], "series_id").withColumn("exposure", F.lit(24))
    return constant_costs(periods).withColumn("cost", F.round("cost", 6))


# --- numerics -------------------------------------------------------------------------


@query(f"WITH {USERS} SELECT series_id, round(max(v) + ln(sum(exp(v - m))), 8) AS lse FROM (SELECT series_id, cents / 10000.0 AS v, max(cents / 10000.0) OVER (PARTITION BY series_id) AS m FROM users) GROUP BY 1")
def logsumexp_by_series(spark, sf_dir):
    g = user_values(spark, sf_dir).groupBy("series_id").agg(F.collect_list(F.col("cents") / 10000.0).alias("v"))
    return g.select("series_id", F.round(col.logsumexp(F.col("v")), 8).alias("lse"))


@query(f"WITH {USERS} SELECT series_id, t, round(exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY series_id), 9) AS p FROM (SELECT series_id, t, cents / 10000.0 AS v, max(cents / 10000.0) OVER (PARTITION BY series_id) AS m FROM users)")
def softmax_by_series(spark, sf_dir):
    g = user_values(spark, sf_dir).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", (F.col("cents") / 10000.0).alias("v")))).alias("r"))
    p = col.softmax(F.transform("r", lambda x: x["v"]))
    return g.select("series_id", F.posexplode(p).alias("t", "p")).select("series_id", F.col("t").cast("long"), F.round("p", 9).alias("p"))


@query(f"WITH {USERS} SELECT series_id, t, round(lgamma(t + 0.5), 7) AS lg, round(lgamma(t + 1) + lgamma(abs(cents) % 50 + 1) - lgamma(t + abs(cents) % 50 + 2), 7) AS lb FROM users")
def gamma_functions(spark, sf_dir):
    k = F.abs("cents") % 50
    return user_values(spark, sf_dir).select("series_id", "t", F.round(col.lgamma(F.col("t") + 0.5), 7).alias("lg"), F.round(col.log_beta(F.col("t") + 1, k + 1), 7).alias("lb"))


@query("""
WITH d AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY d) - 1 AS t, n - avg(n) OVER (PARTITION BY series_id) AS v FROM d),
lags AS (SELECT unnest(range(6)) AS lag),
c AS (SELECT a.series_id, lag, sum(a.v * b.v) AS c FROM s a CROSS JOIN lags JOIN s b ON a.series_id = b.series_id AND b.t = a.t - lag GROUP BY 1, 2)
SELECT c.series_id, CAST(c.lag AS INTEGER) AS lag, round(c.c / z.c, 7) AS acf FROM c JOIN c z ON z.series_id = c.series_id AND z.lag = 0
""")
def acf(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").cast("date").alias("d")).agg(F.count("*").alias("value"))
    return periodic.autocorrelation(src.number_rows(d, ["d"], "series_id"), 5).withColumn("acf", F.round("acf", 7))


@query(f"WITH {USERS} SELECT series_id, t, round(cents / 100.0 + 0.25 * t, 4) AS value FROM users")
def linear_drift(spark, sf_dir):
    v = user_values(spark, sf_dir).select("series_id", "t", (F.col("cents") / 100.0).alias("value"))
    return synthetic.add_drift(v, 0.25).withColumn("value", F.round("value", 4))


@query("""
WITH r AS (SELECT conv_id, role AS method, length(text) AS v FROM conversations)
SELECT method, count(*) AS n, round(avg(v), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(v) / sqrt(count(*)) ELSE 0 END, 6) AS se FROM r GROUP BY 1
""")
def mc_mean_se(spark, sf_dir):
    r = table(spark, sf_dir, "conversations").select(F.col("role").alias("method"), F.length("text").alias("v"))
    return scoring.summary(r, "method", "v").select("method", "n", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"))
