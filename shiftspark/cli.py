"""spark-submit entry: detect changepoints in a CSV of measurements, in binned events, in a demo, or in saved draws.

    python -m shiftspark.cli partition in.csv out --column count --set penalty=10 min_length=3
    python -m shiftspark.cli bocpd events.csv out --timestamp ts --bin-minutes 15 --boost-phases 28,84 --period 96 --steps
    python -m shiftspark.cli within_period demo out --days 30 --save-draws --set period=96 min_length=4
    python -m shiftspark.cli within_period out/draws again --load
"""

from __future__ import annotations

import argparse
import ast

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from shiftspark import connect
from shiftspark.operators import bocpd, periodic, synthetic
from shiftspark.plans.detect import METHODS, detect, online_detector
from shiftspark.sources import series as src


def _value(text: str):
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shiftspark", description=__doc__.split("\n")[0])
    p.add_argument("method", choices=list(METHODS))
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--column", help="the measurement (default: the first number column)")
    p.add_argument("--series", help="a column that names the series")
    p.add_argument("--timestamp", help="a time column: rows are events, put into bins")
    p.add_argument("--bin-minutes", type=int, default=15)
    p.add_argument("--start-hour", type=int, default=0)
    p.add_argument("--skip-rows", type=int, default=0)
    p.add_argument("--max-rows", type=int)
    p.add_argument("--value-column", help="of events: only those whose value is over --value-threshold count")
    p.add_argument("--value-threshold", type=float, default=0.0)
    p.add_argument("--days-span", type=int, help="of events: so many days from the first")
    p.add_argument("--timezone", help="of events: whose midnight days begin at")
    p.add_argument("--days", type=int, default=30, help="of a demo (input: demo), which draws days of 96 bins with two busy spells")
    p.add_argument("--seed", type=int, default=123, help="of a demo")
    p.add_argument("--schedule", help="bocpd: hazards of the phases of a period, by commas")
    p.add_argument("--period", type=int, help="bocpd: steps of a period")
    p.add_argument("--boost-phases", help="bocpd: phases where changes are expected, by commas")
    p.add_argument("--boost-factor", type=float, default=10.0)
    p.add_argument("--steps", action="store_true", help="bocpd: write every step, with a flag for alerts, as CSV")
    p.add_argument("--save-draws", action="store_true", help="within_period: keep the draws, for --load")
    p.add_argument("--load", action="store_true", help="within_period: the input is a folder of draws")
    p.add_argument("--set", nargs="*", default=[], metavar="NAME=VALUE")
    return p


def _numbers(text: str | None, kind) -> list | None:
    return [kind(v) for v in text.split(",")] if text else None


def _series(spark: SparkSession, a: argparse.Namespace):
    """series_id, t, value of the input that the arguments name."""
    if a.input == "demo":
        grid = synthetic.probability_grid(96, (27, 39, 67, 83), (0.05, 0.6, 0.15, 0.45))
        bits = synthetic.scenario_bits(spark, {"demo": (a.days, grid)}, a.seed)
        return bits.withColumn("value", F.col("value").cast("double"))
    if a.timestamp:
        raw = spark.read.option("header", True).csv(a.input)
        for name in filter(None, (a.timestamp, a.value_column)):
            if name not in raw.columns:
                raise src.SourceError(f"{a.input}: no column {name}")
        key = F.col(a.series) if a.series else F.lit("all")
        value = F.expr(f"try_cast(`{a.value_column}` AS DOUBLE)") if a.value_column else F.lit(None).cast("double")
        events = raw.select(key.alias("series_id"), F.expr(f"try_cast(`{a.timestamp}` AS TIMESTAMP)").alias("ts"), value.alias("v"))
        bins = src.occupied_bins(events, a.bin_minutes, a.start_hour, a.days_span, value="v" if a.value_column else None, threshold=a.value_threshold, timezone=a.timezone)
        return bins.withColumn("value", F.col("value").cast("double"))
    wanted = [a.column] if a.column else None
    rows = src.read_csv(spark, a.input, wanted, a.series, a.skip_rows, a.max_rows)
    column = a.column or next(c for c in rows.columns if c not in ("row", a.series))
    key = F.col(a.series) if a.series else F.lit("all")
    return src.number_rows(rows.select(key.alias("series_id"), "row", F.col(column).alias("value")), ["row"], "series_id").select("series_id", "t", "value")


def run(spark: SparkSession, argv: list[str]) -> None:
    a = parser().parse_args(argv)
    connect(spark)
    parameters = {k: _value(v) for k, v in (x.split("=", 1) for x in a.set)}
    if (a.load or a.save_draws) and a.method != "within_period" or a.steps and a.method != "bocpd":
        raise SystemExit("--load and --save-draws are for within_period, --steps is for bocpd")
    if a.method == "bocpd":
        given = {"schedule": _numbers(a.schedule, float), "period": a.period, "boost_phases": _numbers(a.boost_phases, int)}
        parameters |= {k: v for k, v in given.items() if v is not None} | ({"boost_factor": a.boost_factor} if a.boost_phases else {})
    config = {"method": a.method, "input": a.input, **parameters}
    if a.load:
        draws, saved = src.read_draws(spark, a.input)
        config |= saved
    elif a.save_draws:
        own = dict(parameters)
        period, least = own.pop("period", 24), own.pop("min_length", 1)
        draws = periodic.sample(periodic.phase_counts(_series(spark, a), period), period, least, **own)
        src.write_draws(draws, {k: str(v) for k, v in config.items()}, f"{a.output}/draws")
        draws, _ = src.read_draws(spark, f"{a.output}/draws")
    if a.load or a.save_draws:
        found = periodic.map_tau(draws).select("series_id", F.explode("tau").alias("cp"), F.col("log_post").alias("score"))
        periodic.boundary_mass(draws).write.option("header", True).csv(f"{a.output}/boundary_mass")
        periodic.segment_counts(draws).write.option("header", True).csv(f"{a.output}/segment_counts")
    else:
        series = _series(spark, a)
        if a.steps:
            alerting = {k: parameters.pop(k) for k in ("threshold", "reset", "min_spacing") if k in parameters}
            bocpd.detect(series, online_detector(**parameters)).write.parquet(f"{a.output}/steps")
            steps = spark.read.parquet(f"{a.output}/steps")
            alerts = bocpd.alerts(steps, alerting.get("threshold", 0.6), alerting.get("reset", False), alerting.get("min_spacing", 1))
            src.write_online_csv(steps, alerts, f"{a.output}/steps_csv")
            found = alerts.join(steps, ["series_id", "t"]).select("series_id", F.col("t").alias("cp"), F.col("cp_prob").alias("score"))
        else:
            found = detect(series, a.method, **parameters)
    found.write.mode("errorifexists").parquet(f"{a.output}/changepoints")
    spark.read.parquet(f"{a.output}/changepoints").write.option("header", True).csv(f"{a.output}/changepoints_csv")
    spark.createDataFrame([({k: str(v) for k, v in config.items()},)], "config map<string,string>").coalesce(1).write.json(f"{a.output}/config")


def main() -> None:
    import sys

    run(SparkSession.builder.appName("shiftspark").getOrCreate(), sys.argv[1:])


if __name__ == "__main__":
    main()
