"""A study of within-period changepoints: chains of every (scenario, prior rate, chain) as rows of one job table.

Scenarios are series of phase counts with a period and a least segment length each. The jobs
that a folder does not hold yet are run, a wave of them at a time, and each wave is appended, so that a study that
was stopped goes on with what is missing. Summaries, convergence and the comparison
with exact posteriors are aggregates over the draws.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftspark.functions.frames import keep, shared_dir
from shiftspark.operators.periodic import Target, chain, count_taus, effective_size, exact_posterior, valid_taus

DRAWS = "series_id string, rate double, chain int, draw int, tau array<int>, log_post double, acceptance double"


@dataclass(frozen=True)
class Profile:
    """How long chains are, what prior rates they take, and how many states an exact posterior may have."""

    name: str
    iterations: int
    burn: int
    thin: int
    chains: int
    exact_states: int
    rates: tuple[float, ...]
    seed: int = 20260723


#: A short profile that shows that a study runs, and one whose summaries can be read.
PROFILES = {
    "ci": Profile("ci", 120, 40, 10, 2, 5_000, (0.5, 1.0, 2.0)),
    "research": Profile("research", 30_000, 10_000, 10, 4, 200_000, (0.5, 1.0, 2.0, 4.0)),
}


def job_table(scenarios: DataFrame, profile: Profile) -> DataFrame:
    """series_id, period, min_length, rate, chain: a row a chain. scenarios: series_id, period, min_length."""
    spark = scenarios.sparkSession
    rates = F.broadcast(spark.createDataFrame([(float(r),) for r in profile.rates], "rate double"))
    chains = F.broadcast(spark.range(profile.chains).select(F.col("id").cast("int").alias("chain")))
    named = scenarios.select(F.col("series_id").cast("string"), F.col("period").cast("int"), F.col("min_length").cast("int"))
    return named.crossJoin(rates).crossJoin(chains)  # grids of fixed, small size


def run_jobs(counts: DataFrame, jobs: DataFrame, profile: Profile) -> DataFrame:
    """DRAWS of every job; a task each, to which its scenario's phase counts travel."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame.iloc[0]
        s, n = np.zeros(int(head["period"]), int), np.zeros(int(head["period"]), int)
        s[frame["phase"]], n[frame["phase"]] = frame["s"], frame["n"]
        rng = np.random.default_rng([profile.seed, int(head["chain"]), *np.array([head["rate"]]).view(np.uint64).tolist(), *head["series_id"].encode()])
        kept, acceptance = chain(Target(s, n, int(head["min_length"]), float(head["rate"])), profile.iterations, profile.burn, profile.thin, rng)
        rows = [(head["series_id"], head["rate"], head["chain"], i, list(t), v, acceptance) for i, (t, v) in enumerate(kept)]
        return pd.DataFrame(rows, columns=["series_id", "rate", "chain", "draw", "tau", "log_post", "acceptance"])

    named = counts.select(F.col("series_id").cast("string"), "phase", "s", "n")
    return named.join(jobs, "series_id").groupBy("series_id", "rate", "chain").applyInPandas(run, DRAWS)


def run_study(counts: DataFrame, scenarios: DataFrame, profile: Profile | str = "ci", path: str | None = None, wave: int = 256) -> DataFrame:
    """DRAWS of all jobs of a study, from ``path`` where they were run before, else run now and appended to it, ``wave`` jobs at a time.

    counts: series_id, phase, s, n (periodic.phase_counts); scenarios: series_id, period, min_length.
    """
    profile = PROFILES[profile] if isinstance(profile, str) else profile
    spark = counts.sparkSession
    path = path or f"{shared_dir(spark)}/study-{np.random.default_rng().integers(1 << 62):x}"
    jobs = keep(job_table(scenarios, profile).withColumn("at", F.row_number().over(Window.orderBy("series_id", "rate", "chain")) - 1), "jobs")  # as many rows as chains
    missing = jobs
    try:
        done = spark.read.schema(DRAWS).parquet(path).select("series_id", "rate", "chain").distinct()
        missing = jobs.join(done, ["series_id", "rate", "chain"], "left_anti")
    except AnalysisException:  # nothing there yet
        pass
    for (number,) in sorted(missing.select(F.floor(F.col("at") / wave)).distinct().collect()):
        run_jobs(counts, keep(missing.where(F.floor(F.col("at") / wave) == number).drop("at"), "wave"), profile).write.mode("append").parquet(path)
    found = spark.createDataFrame([], DRAWS) if jobs.isEmpty() else spark.read.schema(DRAWS).parquet(path)
    return found.join(jobs.select("series_id", "rate", "chain"), ["series_id", "rate", "chain"], "left_semi").select(*[f.split()[0] for f in DRAWS.split(", ")])


_FIT = ["series_id", "rate"]


def frequencies(draws: DataFrame) -> DataFrame:
    """series_id, rate, tau, probability."""
    return draws.groupBy(*_FIT, "tau").agg(F.count("*").alias("k")).select(*_FIT, "tau", (F.col("k") / F.sum("k").over(Window.partitionBy(*_FIT))).alias("probability"))


def fits(draws: DataFrame, truth: DataFrame | None = None, mass: float = 0.95) -> DataFrame:
    """series_id, rate, mode_tau, mode_log_post, samples, acceptance, credible_size (taus that hold ``mass``), r_hat, ess and, with truth (series_id, tau), truth_probability.

    r_hat compares the spread of log posteriors between chains with that within them (1 where neither has any); ess is
    of the number of boundaries, added up over chains.
    """
    shares = frequencies(draws)
    before = Window.partitionBy(*_FIT).orderBy(F.desc("probability"), "tau").rowsBetween(Window.unboundedPreceding, -1)
    size = shares.withColumn("before", F.coalesce(F.sum("probability").over(before), F.lit(0.0))).where(F.col("before") < mass - 1e-12).groupBy(*_FIT).agg(F.count("*").alias("credible_size"))
    mode = F.max_by(F.struct("tau", "log_post"), F.struct("log_post", -F.col("chain"), -F.col("draw")))
    whole = draws.groupBy(*_FIT).agg(mode.alias("b"), F.count("*").alias("samples"), F.avg("acceptance").alias("acceptance"))
    by_chain = draws.groupBy(*_FIT, "chain").agg(F.avg("log_post").alias("m"), F.var_samp("log_post").alias("v"), F.count("*").alias("n"))
    spread = by_chain.groupBy(*_FIT).agg(F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.avg("n").alias("n"))
    r_hat = F.when(F.coalesce("b", F.lit(0.0)) == 0, F.lit(1.0)).when(F.col("w") > 0, F.sqrt((F.col("n") - 1) / F.col("n") + F.col("b") / F.col("w"))).otherwise(F.lit(float("inf")))
    # a chain is a series of its own
    one = F.concat_ws("\x1f", "series_id", F.col("rate").cast("string"), "chain")
    ess = effective_size(draws.select(one.alias("series_id"), F.col("draw").cast("long").alias("t"), F.size("tau").cast("double").alias("value")), 50)
    ess = ess.select(F.substring_index("series_id", "\x1f", 1).alias("series_id"), F.split_part("series_id", F.lit("\x1f"), F.lit(2)).cast("double").alias("rate"), "ess").groupBy(*_FIT).agg(F.sum("ess").alias("ess"))
    out = whole.join(size, _FIT).join(spread.select(*_FIT, r_hat.alias("r_hat")), _FIT).join(ess, _FIT, "left")
    out = out.select(*_FIT, F.col("b.tau").alias("mode_tau"), F.col("b.log_post").alias("mode_log_post"), "samples", "acceptance", "credible_size", "r_hat", "ess")
    if truth is None:
        return out
    right = shares.join(truth.select(F.col("series_id").cast("string"), "tau"), ["series_id", "tau"]).select(*_FIT, F.col("probability").alias("truth_probability"))
    return out.join(right, _FIT, "left").withColumn("truth_probability", F.coalesce("truth_probability", F.lit(0.0)))


def segment_tables(draws: DataFrame) -> DataFrame:
    """series_id, rate, m, probability: how the number of segments hangs on the prior rate."""
    k = draws.groupBy(*_FIT, F.greatest(F.size("tau"), F.lit(1)).alias("m")).agg(F.count("*").alias("k"))
    return k.select(*_FIT, "m", (F.col("k") / F.sum("k").over(Window.partitionBy(*_FIT))).alias("probability"))


def masses(draws: DataFrame) -> DataFrame:
    """series_id, rate, phase, mass: the share of draws with a boundary there."""
    total = draws.groupBy(*_FIT).agg(F.count("*").alias("total"))
    hit = draws.select(*_FIT, F.explode("tau").alias("phase")).groupBy(*_FIT, "phase").agg(F.count("*").alias("k"))
    return hit.join(total, _FIT).select(*_FIT, "phase", (F.col("k") / F.col("total")).alias("mass"))


def exact_checks(draws: DataFrame, counts: DataFrame, scenarios: DataFrame, profile: Profile | str = "ci") -> DataFrame:
    """series_id, rate, status, state_count, exact_mode, exact_probability, l1_error of the draws against the exact posterior.

    A scenario with more states than the profile allows is "skipped". Scenarios of one period and least length share their states.
    """
    profile = PROFILES[profile] if isinstance(profile, str) else profile
    spark, out = draws.sparkSession, None
    named = scenarios.select(F.col("series_id").cast("string"), F.col("period").cast("int"), F.col("min_length").cast("int"))
    own = counts.withColumn("series_id", F.col("series_id").cast("string"))
    empirical = frequencies(draws).withColumnRenamed("probability", "drawn")
    columns = ["series_id", "rate", "status", "state_count", "exact_mode", "exact_probability", "l1_error"]
    for period, least in sorted(map(tuple, named.select("period", "min_length").distinct().collect())):
        these, n = named.where((F.col("period") == period) & (F.col("min_length") == least)).select("series_id"), count_taus(period, least)
        if n > profile.exact_states:
            one = draws.select(*_FIT).distinct().join(these, "series_id").select(*_FIT, F.lit("skipped").alias("status"), F.lit(n).cast("long").alias("state_count"), F.lit(None).cast("array<int>").alias("exact_mode"), F.lit(None).cast("double").alias("exact_probability"), F.lit(None).cast("double").alias("l1_error"))
            out = one if out is None else out.unionByName(one)
            continue
        taus = keep(valid_taus(spark, period, least, profile.exact_states), "taus")
        for rate in profile.rates:
            exact = exact_posterior(own.join(these, "series_id"), taus, period, least, rate).select("series_id", "tau", "probability")
            drawn = empirical.where(F.col("rate") == rate).join(these, "series_id").select("series_id", "tau", "drawn")
            both = exact.join(drawn, ["series_id", "tau"], "full").fillna(0.0, ["probability", "drawn"])
            mode = F.max_by("tau", F.struct("probability", F.transform("tau", lambda v: -v)))
            one = both.groupBy("series_id").agg(mode.alias("exact_mode"), F.max("probability").alias("exact_probability"), F.sum(F.abs(F.col("probability") - F.col("drawn"))).alias("l1_error"))
            one = one.select("series_id", F.lit(float(rate)).alias("rate"), F.lit("evaluated").alias("status"), F.lit(n).cast("long").alias("state_count"), "exact_mode", "exact_probability", "l1_error")
            out = one if out is None else out.unionByName(one)
    return out.select(*columns) if out is not None else spark.createDataFrame([], "series_id string, rate double, status string, state_count long, exact_mode array<int>, exact_probability double, l1_error double")


def study_tables(counts: DataFrame, scenarios: DataFrame, profile: Profile | str = "ci", truth: DataFrame | None = None, path: str | None = None) -> dict[str, DataFrame]:
    """fits, segments, masses and exact of a study; arrays as text, so that sources.series.write_study can write them."""
    draws = run_study(counts, scenarios, profile, path)
    text = lambda df, *names: df.withColumns({n: F.concat_ws(" ", F.col(n).cast("array<string>")) for n in names})
    return {
        "fits": text(fits(draws, truth), "mode_tau"), "segments": segment_tables(draws), "masses": masses(draws),
        "exact": text(exact_checks(draws, counts, scenarios, profile), "exact_mode"),
    }
