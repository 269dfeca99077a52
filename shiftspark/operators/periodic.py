"""Changepoints within a period: phase counts, exact posterior in SQL, sampled chains.

A boundary is the last bin of a segment; () is one segment, a single boundary is
not valid. tau is a sorted array of boundaries.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftspark.functions.columns import log_beta, lgamma


def phase_counts(series: DataFrame, period: int, value: str = "value") -> DataFrame:
    """series_id, phase, s (successes), n (trials)."""
    hit = F.col(value).cast("int")
    return series.groupBy("series_id", F.pmod("t", F.lit(period)).cast("int").alias("phase")).agg(F.sum(hit).cast("long").alias("s"), F.count(hit).alias("n"))


def segment_stats(counts: DataFrame, boundaries: DataFrame, period: int) -> DataFrame:
    """series_id, stop, s, n of each arc (after the boundary before, up to its own); boundaries: series_id, cp.

    Every phase belongs to the first boundary at or after it, round the end: an
    as-of match by a running minimum over the union, no join of ranges.
    """
    both = counts.select("series_id", "phase", "s", "n", F.lit(None).cast("int").alias("b")).union(
        boundaries.select("series_id", F.col("cp").cast("int").alias("phase"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("n"), (F.col("cp") + 0).cast("int").alias("b"))
    )
    w = Window.partitionBy("series_id").orderBy("phase").rangeBetween(0, Window.unboundedFollowing)
    own = F.coalesce(F.min("b").over(w), F.min("b").over(Window.partitionBy("series_id")))
    return both.withColumn("stop", own).where("b is null and stop is not null").groupBy("series_id", "stop").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def log_count_prior(m: Column, rate: float, period: int, min_length: int) -> Column:
    """Truncated Poisson on 1..period div min_length segments."""
    top = period // min_length
    z = math.log(sum(math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(1, top + 1)))
    return m * math.log(rate) - rate - lgamma(m + 1) - z


#: Valid taus that an exact posterior takes at most.
MAX_STATES = 200_000


def count_taus(period: int, min_length: int) -> int:
    """How many taus are valid: m boundaries round a period with gaps of min_length at least, for every m but 1."""
    most = period // min_length
    return 1 + sum(period * math.comb(period - m * min_length + m - 1, m - 1) // m for m in range(2, most + 1))


def valid_taus(spark: SparkSession, period: int, min_length: int, max_states: int = MAX_STATES) -> DataFrame:
    """Every valid tau as a row: grown one boundary a level by a join with the lattice. Their number is checked first."""
    if (n := count_taus(period, min_length)) > max_states:
        raise ValueError(f"{n} valid states, over {max_states}: draw chains instead")
    lattice = F.broadcast(spark.range(period).select(F.col("id").cast("int").alias("b")))
    grown = spark.range(1).select(F.array().cast("array<int>").alias("tau"))
    levels, now = [grown], spark.range(period).select(F.array(F.col("id").cast("int")).alias("tau"))
    for _ in range(2, period // min_length + 1):
        last = F.element_at("tau", -1)
        now = now.crossJoin(lattice).where((F.col("b") - last >= min_length) & (F.element_at("tau", 1) + period - F.col("b") >= min_length)).select(F.concat("tau", F.array("b")).alias("tau"))
        levels.append(now)
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    return out


def exact_posterior(counts: DataFrame, taus: DataFrame, period: int, min_length: int, rate: float = 1.0, gamma: float = 1.0) -> DataFrame:
    """series_id, tau, log_post, probability over all valid taus. Small periods: the number of taus grows fast."""
    arrays = counts.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("phase", "s", "n"))).alias("c"))
    every = F.sequence(F.lit(0), F.lit(period - 1))
    at = F.map_from_entries(F.transform("c", lambda x: F.struct(x["phase"], F.struct(x["s"].alias("s"), x["n"].alias("n")))))
    dense = arrays.select("series_id", F.transform(every, lambda i: F.coalesce(F.element_at(at, i)["s"], F.lit(0).cast("long"))).alias("s"), F.transform(every, lambda i: F.coalesce(F.element_at(at, i)["n"], F.lit(0).cast("long"))).alias("n"))
    m = F.size("tau")
    before = lambda k: F.when(k == 0, F.element_at("tau", -1) - period).otherwise(F.get("tau", k - 1))
    arcs = F.when(m == 0, F.array(F.struct(F.lit(-1).alias("a"), F.lit(period - 1).alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(0), m - 1), lambda k: F.struct(before(k).alias("a"), F.get("tau", k).alias("b")))
    )
    both = dense.crossJoin(F.broadcast(taus)).withColumn("arc", F.explode(arcs))
    inside = lambda c: F.aggregate(F.sequence(F.col("arc.a") + 1, F.col("arc.b")), F.lit(0).cast("long"), lambda acc, i: acc + F.get(c, F.pmod(i, F.lit(period))))
    stats = both.select("series_id", "tau", inside(F.col("s")).alias("hit"), inside(F.col("n")).alias("all"), (F.col("arc.b") - F.col("arc.a")).alias("length"))
    fit = stats.groupBy("series_id", "tau").agg(
        F.sum(log_beta(F.col("hit") + 1, F.col("all") - F.col("hit") + 1)).alias("ll"),
        F.sum(lgamma(F.col("length") - min_length + gamma) - lgamma(F.lit(gamma)) - lgamma(F.col("length") - min_length + 1)).alias("excess"), F.count("*").alias("arcs"),
    )
    segments = F.greatest(F.size("tau"), F.lit(1))
    spare = period - segments * min_length
    layout = F.when(F.size("tau") == 0, 0.0).otherwise(F.col("excess") + lgamma(spare + 1) + lgamma(segments * gamma) - lgamma(spare + segments * gamma))
    scored = fit.withColumn("log_post", F.col("ll") + layout + log_count_prior(segments, rate, period, min_length))
    w = Window.partitionBy("series_id")
    weight = F.exp(F.col("log_post") - F.max("log_post").over(w))
    return scored.select("series_id", "tau", "log_post", weight.alias("weight")).select("series_id", "tau", "log_post", (F.col("weight") / F.sum("weight").over(w)).alias("probability"))


# --- chains -------------------------------------------------------------------------


class Target:
    """Log posterior of tau for one series' phase counts."""

    def __init__(self, s: np.ndarray, n: np.ndarray, min_length: int, rate: float, gamma: float = 1.0):
        self.period, self.min_length, self.rate, self.gamma = len(s), min_length, rate, gamma
        self.S, self.N = (np.concatenate(([0], np.cumsum(np.concatenate((v, v))))) for v in (s, n))
        self.most = self.period // min_length

    def arcs(self, tau: tuple[int, ...]) -> list[tuple[int, int, int]]:
        """(successes, trials, length) of each arc."""
        if not tau:
            return [(int(self.S[self.period]), int(self.N[self.period]), self.period)]
        out = []
        for a, b in zip((tau[-1] - self.period, *tau), tau):
            lo, hi = a + 1 + self.period, b + 1 + self.period
            lo, hi = (lo, hi) if hi <= 2 * self.period else (lo - self.period, hi - self.period)
            out.append((int(self.S[hi] - self.S[lo]), int(self.N[hi] - self.N[lo]), b - a))
        return out

    def valid(self, tau: tuple[int, ...]) -> bool:
        return len(tau) != 1 and len(tau) <= self.most and all(length >= self.min_length for _, _, length in self.arcs(tau))

    def log(self, tau: tuple[int, ...]) -> float:
        arcs, g = self.arcs(tau), self.gamma
        m = len(arcs)
        out = sum(math.lgamma(1 + s) + math.lgamma(1 + n - s) - math.lgamma(2 + n) for s, n, _ in arcs)
        if tau:
            spare = self.period - m * self.min_length
            out += math.lgamma(spare + 1) + math.lgamma(m * g) - math.lgamma(spare + m * g)
            out += sum(math.lgamma(length - self.min_length + g) - math.lgamma(g) - math.lgamma(length - self.min_length + 1) for _, _, length in arcs)
        z = math.log(sum(math.exp(k * math.log(self.rate) - self.rate - math.lgamma(k + 1)) for k in range(1, self.most + 1)))
        return out + m * math.log(self.rate) - self.rate - math.lgamma(m + 1) - z

    def targets(self, tau: tuple[int, ...]) -> dict[str, list[tuple[int, ...]]]:
        """Valid other states by one move, birth (two boundaries from none) or death."""
        here = set(tau)
        free = [b for b in range(self.period) if b not in here]
        moves = [tuple(sorted(here - {x} | {b})) for x in tau for b in ((x - 1) % self.period, (x + 1) % self.period) if b not in here]
        if tau:
            births = [tuple(sorted(here | {b})) for b in free]
            deaths = [()] if len(tau) == 2 else [tuple(sorted(here - {x})) for x in tau]
        else:
            births = [(a, b) for a in free for b in free if a < b]
            deaths = []
        return {k: [t for t in v if self.valid(t)] for k, v in (("move", moves), ("birth", births), ("death", deaths))}

    def proposal(self, tau: tuple[int, ...]) -> dict[tuple[int, ...], float]:
        """The exact law of the next proposal: a family that can move, then one of its states."""
        families = [v for v in self.targets(tau).values() if v]
        out: dict[tuple[int, ...], float] = {}
        for v in families:
            for t in v:
                out[t] = out.get(t, 0.0) + 1 / len(families) / len(v)
        return out


def chain(target: Target, iterations: int, burn: int, thin: int, rng: np.random.Generator, hot: float | None = None, swap_every: int = 50) -> tuple[list[tuple[tuple[int, ...], float]], float]:
    """(kept (tau, log posterior), acceptance); with ``hot`` a second chain at that temperature trades places."""
    temperatures = [1.0] if hot is None else [1.0, hot]
    states = [()] * len(temperatures)
    logs = [target.log(())] * len(temperatures)
    laws: dict[tuple[int, ...], dict] = {}

    def law(tau):
        if tau not in laws:
            laws[tau] = target.proposal(tau)
        return laws[tau]

    kept, accepted = [], 0
    # a stream for each chain and one for trades, so that none shifts another
    *streams, trades = rng.spawn(len(temperatures) + 1)
    for it in range(iterations):
        for c, (temperature, rng) in enumerate(zip(temperatures, streams)):
            options = law(states[c])
            if not options:
                continue
            names = list(options)
            new = names[int(rng.choice(len(names), p=np.array(list(options.values())) / sum(options.values())))]
            back = law(new).get(states[c], 0.0)
            value = target.log(new)
            if back > 0 and math.log(rng.uniform()) < (value - logs[c]) / temperature + math.log(back) - math.log(options[new]):
                states[c], logs[c] = new, value
                accepted += c == 0
        if hot is not None and it % swap_every == swap_every - 1 and math.log(trades.uniform()) < (logs[1] - logs[0]) * (1 - 1 / hot):
            states.reverse(), logs.reverse()
        if it >= burn and (it - burn) % thin == 0:
            kept.append((states[0], logs[0]))
    return kept, accepted / max(1, iterations)


POSTERIOR = "series_id string, chain int, draw int, tau array<int>, log_post double, acceptance double"


def sample(counts: DataFrame, period: int, min_length: int, rate: float = 1.0, chains: int = 4, iterations: int = 2000, burn: int = 500, thin: int = 5, seed: int = 0, hot: float | None = None) -> DataFrame:
    """Draws of tau: one task for each (series, chain); only the phase counts travel."""
    spark = counts.sparkSession

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        s, n = np.zeros(period, int), np.zeros(period, int)
        s[frame["phase"]], n[frame["phase"]] = frame["s"], frame["n"]
        sid, c = str(frame["series_id"].iloc[0]), int(frame["chain"].iloc[0])
        rng = np.random.default_rng([seed, c, *sid.encode()])
        kept, acceptance = chain(Target(s, n, min_length, rate), iterations, burn, thin, rng, hot)
        return pd.DataFrame([(sid, c, i, list(t), v, acceptance) for i, (t, v) in enumerate(kept)], columns=["series_id", "chain", "draw", "tau", "log_post", "acceptance"])

    tasks = counts.select(F.col("series_id").cast("string"), "phase", "s", "n").crossJoin(F.broadcast(spark.range(chains).select(F.col("id").cast("int").alias("chain"))))
    return tasks.groupBy("series_id", "chain").applyInPandas(run, POSTERIOR)


def segment_summaries(draws: DataFrame, counts: DataFrame, period: int, level: float = 0.95, draws_each: int = 5000, seed: int = 0) -> DataFrame:
    """series_id, stop, s, n, mean, lower, upper of each segment of a series' best tau: the Beta posterior's mean natively, its interval by draws."""
    best = map_tau(draws).select("series_id", F.explode_outer("tau").alias("cp"))
    named = counts.withColumn("series_id", F.col("series_id").cast("string"))
    # one segment has no boundary: its end stands for it
    bounds = best.select("series_id", F.coalesce("cp", F.lit(period - 1)).alias("cp"))
    stats = segment_stats(named, bounds, period).withColumn("mean", (F.col("s") + 1) / (F.col("n") + 2))
    tail = (1 - level) / 2

    def run(batches):
        for frame in batches:
            lower, upper = [], []
            for sid, stop, s, n in zip(frame["series_id"], frame["stop"], frame["s"], frame["n"]):
                x = np.random.default_rng([seed, int(stop), *str(sid).encode()]).beta(1 + s, 1 + n - s, draws_each)
                lo, hi = np.quantile(x, [tail, 1 - tail])
                lower.append(lo), upper.append(hi)
            yield frame.assign(lower=lower, upper=upper)

    return stats.mapInPandas(run, "series_id string, stop int, s long, n long, mean double, lower double, upper double")


def indicator_effective_size(draws: DataFrame, phase: int, lags: int = 50) -> DataFrame:
    """series_id, ess of the indicator that a draw has a boundary at that phase; draws of a chain follow each other."""
    w = Window.partitionBy("series_id").orderBy("chain", "draw")
    hit = draws.select("series_id", (F.row_number().over(w) - 1).cast("long").alias("t"), F.array_contains("tau", phase).cast("double").alias("value"))
    return effective_size(hit, lags)


def sample_rates(counts: DataFrame, period: int, min_length: int, rates: list[float], iterations: int = 2000, burn: int = 500, thin: int = 5, seed: int = 0) -> DataFrame:
    """series_id, rate, m, probability: how the number of segments hangs on the prior rate; a task for each (series, rate)."""
    spark = counts.sparkSession
    grid = F.broadcast(spark.createDataFrame([(float(r),) for r in rates], "rate double"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        s, n = np.zeros(period, int), np.zeros(period, int)
        s[frame["phase"]], n[frame["phase"]] = frame["s"], frame["n"]
        sid, rate = str(frame["series_id"].iloc[0]), float(frame["rate"].iloc[0])
        kept, _ = chain(Target(s, n, min_length, rate), iterations, burn, thin, np.random.default_rng([seed, *sid.encode()]))
        m = pd.Series([max(1, len(t)) for t, _ in kept]).value_counts(normalize=True)
        return pd.DataFrame({"series_id": sid, "rate": rate, "m": m.index, "probability": m.to_numpy()})

    tasks = counts.select(F.col("series_id").cast("string"), "phase", "s", "n").crossJoin(grid)
    return tasks.groupBy("series_id", "rate").applyInPandas(run, "series_id string, rate double, m int, probability double")


# --- summaries, all native ----------------------------------------------------------


def tau_frequencies(draws: DataFrame) -> DataFrame:
    w = Window.partitionBy("series_id")
    return draws.groupBy("series_id", "tau").count().select("series_id", "tau", (F.col("count") / F.sum("count").over(w)).alias("probability"))


def credible_size(frequencies: DataFrame, mass: float = 0.95) -> DataFrame:
    """How many of the likeliest taus hold that mass."""
    w = Window.partitionBy("series_id").orderBy(F.desc("probability"), "tau").rowsBetween(Window.unboundedPreceding, -1)
    return frequencies.withColumn("before", F.coalesce(F.sum("probability").over(w), F.lit(0.0))).where(F.col("before") < mass - 1e-12).groupBy("series_id").agg(F.count("*").alias("size"))


def boundary_mass(draws: DataFrame) -> DataFrame:
    """series_id, phase, mass: the share of draws that hold a boundary there."""
    total = draws.groupBy("series_id").agg(F.count("*").alias("total"))
    return draws.select("series_id", F.explode("tau").alias("phase")).groupBy("series_id", "phase").count().join(total, "series_id").select("series_id", "phase", (F.col("count") / F.col("total")).alias("mass"))


def segment_counts(draws: DataFrame) -> DataFrame:
    """series_id, m, probability: segments are as many as boundaries, one if there are none."""
    w = Window.partitionBy("series_id")
    return draws.groupBy("series_id", F.greatest(F.size("tau"), F.lit(1)).alias("m")).count().select("series_id", "m", (F.col("count") / F.sum("count").over(w)).alias("probability"))


def map_tau(draws: DataFrame) -> DataFrame:
    """The first draw of the highest log posterior."""
    best = F.max_by(F.struct("tau", "log_post"), F.struct("log_post", -F.col("chain"), -F.col("draw")))
    return draws.groupBy("series_id").agg(best.alias("b")).select("series_id", "b.tau", "b.log_post")


def pointwise_bands(draws: DataFrame, counts: DataFrame, period: int, level: float = 0.95, seed: int = 0) -> DataFrame:
    """series_id, phase, lower, median, upper of the success rate, painted from posterior draws."""
    arrays = counts.groupBy("series_id").agg(F.collect_list("phase").alias("phases"), F.collect_list("s").alias("ss"), F.collect_list("n").alias("ns"))

    def run(batches):
        for frame in batches:
            rows = []
            for sid, c, i, tau, ph, ss, ns in frame.itertuples(index=False):
                s, n = np.zeros(period, int), np.zeros(period, int)
                s[ph], n[ph] = ss, ns
                rng = np.random.default_rng([seed, c, i, *str(sid).encode()])
                tau = [int(b) for b in tau]
                phi = [rng.beta(1 + a, 1 + b - a) for a, b, _ in Target(s, n, 1, 1.0).arcs(tuple(tau))]
                owner = np.searchsorted(tau, np.arange(period)) % max(1, len(tau))
                rows += [(sid, p, float(phi[owner[p]])) for p in range(period)]
            yield pd.DataFrame(rows, columns=["series_id", "phase", "phi"])

    painted = draws.join(arrays, "series_id").select("series_id", "chain", "draw", "tau", "phases", "ss", "ns").mapInPandas(run, "series_id string, phase int, phi double")
    tail = (1 - level) / 2
    return painted.groupBy("series_id", "phase").agg(F.percentile("phi", tail).alias("lower"), F.median("phi").alias("median"), F.percentile("phi", 1 - tail).alias("upper"))


def predictive_counts(bands_source: DataFrame, counts: DataFrame, period: int, seed: int = 0) -> DataFrame:
    """series_id, mean, lower, upper of a simulated period's total from posterior draws."""
    arrays = counts.groupBy("series_id").agg(F.collect_list("phase").alias("phases"), F.collect_list("s").alias("ss"), F.collect_list("n").alias("ns"))

    def run(batches):
        for frame in batches:
            rows = []
            for sid, c, i, tau, ph, ss, ns in frame.itertuples(index=False):
                s, n = np.zeros(period, int), np.zeros(period, int)
                s[ph], n[ph] = ss, ns
                rng = np.random.default_rng([seed, 1, c, i, *str(sid).encode()])
                arcs = Target(s, n, 1, 1.0).arcs(tuple(int(b) for b in tau))
                rows.append((sid, int(sum(rng.binomial(length, rng.beta(1 + a, 1 + b - a)) for a, b, length in arcs))))
            yield pd.DataFrame(rows, columns=["series_id", "total"])

    drawn = bands_source.join(arrays, "series_id").select("series_id", "chain", "draw", "tau", "phases", "ss", "ns").mapInPandas(run, "series_id string, total long")
    return drawn.groupBy("series_id").agg(F.avg("total").alias("mean"), F.percentile("total", 0.025).alias("lower"), F.percentile("total", 0.975).alias("upper"))


def autocorrelation(series: DataFrame, lags: int, value: str = "value") -> DataFrame:
    """series_id, lag, acf: sums of lagged products of deviations over the sum of squares; constant series give 1."""
    own = Window.partitionBy("series_id")
    d = series.withColumn("d", F.col(value) - F.avg(value).over(own))
    w = own.orderBy("t")
    products = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("d") * (F.col("d") if k == 0 else F.lag("d", k).over(w))).alias("p")) for k in range(lags + 1)])
    return d.select("series_id", products.alias("x")).select("series_id", F.explode("x").alias("x")).groupBy("series_id", "x.lag").agg(F.sum("x.p").alias("c")).withColumn("c0", F.max(F.when(F.col("lag") == 0, F.col("c"))).over(own)).select("series_id", "lag", F.when(F.col("c0") > 0, F.coalesce("c", F.lit(0.0)) / F.col("c0")).otherwise(1.0).alias("acf"))


def effective_size(series: DataFrame, lags: int, value: str = "value") -> DataFrame:
    """series_id, ess by Geyer's initial positive pairs over the autocorrelations; constant series give infinity."""
    a = autocorrelation(series, lags, value)
    n = series.groupBy("series_id").agg(F.count("*").alias("n"), F.max(value).alias("hi"), F.min(value).alias("lo"))
    pairs_ = a.where("lag > 0").groupBy("series_id", F.expr("(lag - 1) div 2").alias("pair")).agg(F.sum("acf").alias("g"), F.count("*").alias("k")).where("k = 2")
    w = Window.partitionBy("series_id").orderBy("pair").rowsBetween(Window.unboundedPreceding, 0)
    positive = pairs_.withColumn("least", F.min("g").over(w)).where("least > 0").groupBy("series_id").agg(F.sum("g").alias("total"))
    return n.join(positive, "series_id", "left").select("series_id", F.when(F.col("hi") == F.col("lo"), float("inf")).otherwise(F.col("n") / (1 + 2 * F.coalesce("total", F.lit(0.0)))).alias("ess"))
