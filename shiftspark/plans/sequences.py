"""Queries of models that all series share, and of best paths of long series."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from shiftspark.operators import longpaths, pooled, statespace
from shiftspark.plans.build import USERS, query, table, user_values
from shiftspark.plans.models import _shares
from shiftspark.sources.series import number_rows

# --- long series --------------------------------------------------------------------------


def _type_scores(spark, sf_dir):
    """series_id (an event type), t, loglik of a low and a high level: whole 4096ths, so that sums are exact."""
    from shiftspark.functions.columns import cents

    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", "event_id", cents("value").alias("c"))
    rows = number_rows(e, ["ts", "event_id"], "series_id")
    return rows.select("series_id", "t", F.array(-F.abs(F.col("c") - 2000) / 4096.0, -F.abs(F.col("c") - 6000) / 4096.0).alias("loglik"))


_Q = "round({} * 16777216) / 16777216"
_TYPES = """types AS (
  SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, CAST(round(value * 100) AS BIGINT) AS c FROM events),
ll AS (SELECT series_id, t, -abs(c - 2000) / CAST(4096 AS DOUBLE) AS a, -abs(c - 6000) / CAST(4096 AS DOUBLE) AS b FROM types)"""
_STAY_A, _GO_A, _STAY_B, _GO_B = (_Q.format(f"ln({p})") for p in (0.95, 0.05, 0.9, 0.1))


@query(f"""
WITH RECURSIVE {_TYPES},
step AS (
  SELECT series_id, t, a + {_Q.format("ln(0.5)")} AS a, b + {_Q.format("ln(0.5)")} AS b, 0 AS fa, 0 AS fb FROM ll WHERE t = 0
  UNION ALL
  SELECT l.series_id, l.t, greatest(s.a + {_STAY_A}, s.b + {_GO_B}) + l.a, greatest(s.a + {_GO_A}, s.b + {_STAY_B}) + l.b,
         CASE WHEN s.a + {_STAY_A} >= s.b + {_GO_B} THEN 0 ELSE 1 END, CASE WHEN s.a + {_GO_A} >= s.b + {_STAY_B} THEN 0 ELSE 1 END
  FROM step s JOIN ll l ON l.series_id = s.series_id AND l.t = s.t + 1
),
walk AS (SELECT series_id, list(fa ORDER BY t) AS fa, list(fb ORDER BY t) AS fb, arg_max(CASE WHEN a >= b THEN 0 ELSE 1 END, t) AS last, count(*) AS n FROM step GROUP BY 1),
back AS (
  SELECT series_id, n - 1 AS t, last AS state, fa, fb FROM walk
  UNION ALL
  SELECT series_id, t - 1, CASE WHEN state = 0 THEN fa[t + 1] ELSE fb[t + 1] END, fa, fb FROM back WHERE t > 0
)
SELECT series_id, t, CAST(state AS INTEGER) AS state FROM back
""")
def hmm_long_states(spark, sf_dir):
    """Blocks of 256 steps decoded side by side, scanned in groups of four."""
    return longpaths.decode_hmm(_type_scores(spark, sf_dir), [0.5, 0.5], [[0.95, 0.05], [0.1, 0.9]], block=256, fan=4)


_LONGEST = 8


@query(f"""
WITH RECURSIVE {_TYPES},
cum AS (SELECT series_id, t, sum(a) OVER w AS a, sum(b) OVER w AS b FROM ll WINDOW w AS (PARTITION BY series_id ORDER BY t)),
lists AS (SELECT series_id, count(*) AS n, [CAST(0 AS DOUBLE)] || list(a ORDER BY t) AS ca, [CAST(0 AS DOUBLE)] || list(b ORDER BY t) AS cb FROM cum GROUP BY 1),
dens AS (SELECT d, d * ln(3) - 3 - lgamma(d + 1) AS p FROM (SELECT unnest(range(1, {_LONGEST + 1})) AS d)),
dur AS (SELECT list({_Q.format("(p - z)")} ORDER BY d) AS p FROM dens CROSS JOIN (SELECT ln(sum(exp(p))) AS z FROM dens)),
step AS (
  SELECT series_id, CAST(0 AS BIGINT) AS t, [{_Q.format("ln(CAST(0.5 AS DOUBLE))")}] AS ea, [{_Q.format("ln(CAST(0.5 AS DOUBLE))")}] AS eb, CAST(0 AS BIGINT) AS da, CAST(0 AS BIGINT) AS db, CAST(0 AS DOUBLE) AS za, CAST(0 AS DOUBLE) AS zb FROM lists
  UNION ALL
  SELECT series_id, t + 1, [xb.v] || ea[:{_LONGEST - 1}], [xa.v] || eb[:{_LONGEST - 1}], -xa.d, -xb.d, xa.v, xb.v
  FROM (SELECT s.series_id, t, ea, eb,
               list_max(list_transform(range(1, least({_LONGEST}, t + 1) + 1), lambda d: {{'v': ea[d] + p[d] + ca[t + 2] - ca[t + 2 - d], 'd': -d}})) AS xa,
               list_max(list_transform(range(1, least({_LONGEST}, t + 1) + 1), lambda d: {{'v': eb[d] + p[d] + cb[t + 2] - cb[t + 2 - d], 'd': -d}})) AS xb
        FROM step s JOIN lists l ON l.series_id = s.series_id CROSS JOIN dur WHERE t < n)
),
walk AS (SELECT series_id, list(da ORDER BY t) AS la, list(db ORDER BY t) AS lb, max(t) AS n, arg_max(CASE WHEN za >= zb THEN 0 ELSE 1 END, t) AS last FROM step GROUP BY 1),
back AS (
  SELECT series_id, la, lb, last AS state, n AS stop, CASE WHEN last = 0 THEN la[n + 1] ELSE lb[n + 1] END AS d FROM walk
  UNION ALL
  SELECT series_id, la, lb, 1 - state, stop - d, CASE WHEN state = 1 THEN la[stop - d + 1] ELSE lb[stop - d + 1] END FROM back WHERE stop - d > 0
)
SELECT series_id, u.t, CAST(state AS INTEGER) AS state, CAST(CASE WHEN u.t = stop - 1 THEN d ELSE 0 END AS INTEGER) AS duration FROM back, LATERAL (SELECT unnest(range(stop - d, stop)) AS t) u
""")
def hsmm_long_states(spark, sf_dir):
    return longpaths.decode_hsmm(_type_scores(spark, sf_dir), [0.5, 0.5], [[0, 1], [1, 0]], [3.0, 3.0], _LONGEST, block=256, fan=4)


# --- shared models --------------------------------------------------------------------------

_START, _MOVES, _RATES, _D = [0.5, 0.3, 0.2], [[0, 0.7, 0.3], [0.4, 0, 0.6], [0.5, 0.5, 0]], [2.0, 3.0, 1.5], 6
_LEVELS = [(20.0, 20.0), (60.0, 30.0), (110.0, 40.0)]


def _levels(spark, sf_dir):
    v = F.col("cents") / 100.0
    return user_values(spark, sf_dir).select("series_id", "t", F.array(*[-0.5 * (v - m) * (v - m) / s**2 - math.log(s) for m, s in _LEVELS]).alias("loglik"))


def _lse(values: str) -> str:
    return f"list_max({values}) + ln(list_sum(list_transform({values}, lambda u: exp(u - list_max({values})))))"


def _estep_sql() -> str:
    """One E-step over all users, as two recursions over lists: what enters and ends forward, what follows backward."""
    S = range(3)
    cols = lambda form: ", ".join(form.format(k=k) for k in S)
    log = lambda p: f"ln(CAST({p} AS DOUBLE))"
    come = [[f"x{i} + {log(_MOVES[i][j])}" for i in S if _MOVES[i][j]] for j in S]
    go = [[f"h{j} + {log(_MOVES[i][j])}" for j in S if _MOVES[i][j]] for i in S]
    ll = ", ".join(f"-0.5 * (cents / 100.0 - {m}) * (cents / 100.0 - {m}) / {s**2} - ln(CAST({s} AS DOUBLE)) AS l{k}" for k, (m, s) in enumerate(_LEVELS))
    dens = " UNION ALL ".join(f"SELECT {k} AS k, d, d * ln(CAST({r} AS DOUBLE)) - {r} - lgamma(d + 1) AS p FROM (SELECT unnest(range(1, {_D + 1})) AS d)" for k, r in enumerate(_RATES))
    ahead = ", ".join(f"list_transform(range(1, least({_D}, t + 1) + 1), lambda d: e{k}[t + 2 - d] + p{k}[d] + c{k}[t + 2] - c{k}[t + 2 - d]) AS v{k}" for k in S)
    behind = ", ".join(f"list_transform(range(1, least({_D}, n - t + 1) + 1), lambda d: p{k}[d] + c{k}[t + d] - c{k}[t] + g{k}[d]) AS v{k}" for k in S)
    pick = lambda values: " UNION ALL ".join(values)
    return f"""
WITH RECURSIVE {USERS}, ll AS (SELECT series_id, t, {ll} FROM users),
cum AS (SELECT series_id, t, {cols("sum(l{k}) OVER w AS l{k}")} FROM ll WINDOW w AS (PARTITION BY series_id ORDER BY t)),
lists AS (SELECT series_id, count(*) AS n, {cols("[CAST(0 AS DOUBLE)] || list(l{k} ORDER BY t) AS c{k}")} FROM cum GROUP BY 1),
dens AS ({dens}), norm AS (SELECT k, d, p - ln(sum(exp(p)) OVER (PARTITION BY k)) AS p FROM dens),
dur AS (SELECT {cols("list(p ORDER BY d) FILTER (k = {k}) AS p{k}")} FROM norm),
forward AS (
  SELECT series_id, n, CAST(0 AS BIGINT) AS t, {cols("c{k}")}, {cols("p{k}")}, {", ".join(f"[{log(p)}] AS e{k}" for k, p in enumerate(_START))}, {cols("[CAST('-inf' AS DOUBLE)] AS z{k}")} FROM lists CROSS JOIN dur
  UNION ALL
  SELECT series_id, n, t + 1, {cols("c{k}")}, {cols("p{k}")}, {", ".join(f"e{j} || [{_lse('[' + ', '.join(come[j]) + ']')}]" for j in S)}, {cols("z{k} || [x{k}]")}
  FROM (SELECT *, {", ".join(f"{_lse(f'v{k}')} AS x{k}" for k in S)} FROM (SELECT *, {ahead} FROM forward WHERE t < n))
),
done AS (SELECT *, {_lse("[" + cols("z{k}[n + 1]") + "]")} AS z FROM forward WHERE t = n),
backward AS (
  SELECT series_id, n, n AS t, {cols("c{k}")}, {cols("p{k}")}, {cols("[CAST(0 AS DOUBLE)] AS g{k}")}, {cols("CAST([] AS DOUBLE[]) AS a{k}")} FROM done
  UNION ALL
  SELECT series_id, n, t - 1, {cols("c{k}")}, {cols("p{k}")}, {", ".join(f"[{_lse('[' + ', '.join(go[i]) + ']')}] || g{i}" for i in S)}, {cols("[h{k}] || a{k}")}
  FROM (SELECT *, {", ".join(f"{_lse(f'v{k}')} AS h{k}" for k in S)} FROM (SELECT *, {behind} FROM backward WHERE t > 0))
),
both_ AS (SELECT f.*, {cols("g{k}")}, {cols("a{k}")} FROM done f JOIN backward b ON b.series_id = f.series_id AND b.t = 0),
found AS (
  SELECT 'loglik' AS kind, 0 AS i, 0 AS j, z AS v FROM both_
  UNION ALL {pick(f"SELECT 'start', {k}, 0, exp({log(p)} + a{k}[1] - z) FROM both_" for k, p in enumerate(_START))}
  UNION ALL {pick(f"SELECT 'move', {i}, {j}, " + (f"coalesce(list_sum(list_transform(range(2, n + 1), lambda t: exp(z{i}[t] + {log(_MOVES[i][j])} + a{j}[t] - z))), 0)" if _MOVES[i][j] else "0") + " FROM both_" for i in S for j in S)}
  UNION ALL {pick(f"SELECT 'duration', {k}, {d}, coalesce(list_sum(list_transform(range({d} + 1, n + 2), lambda t: exp(e{k}[t - {d}] + p{k}[{d}] + c{k}[t] - c{k}[t - {d}] + g{k}[t] - z))), 0) FROM both_" for k in S for d in range(1, _D + 1))}
)
SELECT kind, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(v), 6) AS value FROM found GROUP BY 1, 2, 3
"""


@query(_estep_sql())
def hsmm_shared_expectation(spark, sf_dir):
    """What one E-step over all users expects."""
    model = statespace.Hsmm(_START, _MOVES, statespace.duration_table("poisson", _RATES, _D))
    return pooled.expected_counts(pooled.whole_series(_levels(spark, sf_dir), "loglik"), model).withColumn("value", F.round("value", 6))


@query()
def hsmm_shared_states(spark, sf_dir):
    """Decoded under a model that six rounds of EM over all users made."""
    rows = _levels(spark, sf_dir)
    model, _, _ = pooled.fit_hsmm(rows, _START, _MOVES, _RATES, _D, iterations=6)
    return pooled.decode_with(rows, model)


@query()
def hsmm_shared_trace(spark, sf_dir):
    """The log likelihood of all users after each round; it never falls."""
    _, _, trace = pooled.fit_hsmm(_levels(spark, sf_dir), _START, _MOVES, _RATES, _D, iterations=6)
    return spark.createDataFrame([(i, v) for i, v in enumerate(trace)], "round int, loglik double")


@query()
def sdhmm_shared_states(spark, sf_dir):
    """Days of all users under one scaled-Dirichlet model."""
    rows = _shares(spark, sf_dir)
    return pooled.decode_sdhmm(rows, pooled.fit_sdhmm(rows, 2, iterations=5, steps=2))


@query()
def sdhmm_shared_mixture_states(spark, sf_dir):
    rows = _shares(spark, sf_dir)
    return pooled.decode_sdhmm(rows, pooled.fit_sdhmm(rows, 2, components=2, iterations=5, steps=2))
