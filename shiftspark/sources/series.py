"""Reading events and measurements as keyed series, and writing results."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftspark.functions.columns import not_nan


class SourceError(ValueError):
    """A file's schema or content can't be used; names the path."""


@contextmanager
def at_path(path: str, doing: str = "reading"):
    """Errors of a source or sink as a SourceError that names the path, with their cause."""
    try:
        yield
    except SourceError:
        raise
    except Exception as e:
        raise SourceError(f"{doing} {path}: {e}") from e


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, timestamp: str | None = None, skip_rows: int = 0, max_rows: int | None = None) -> DataFrame:
    """row, the timestamp text, and number columns of a header CSV; rows with unreadable numbers go."""
    with at_path(path):
        raw = spark.read.option("header", True).csv(path)
    if not raw.columns:
        raise SourceError(f"{path}: no header")
    wanted = columns or [c for c in raw.columns if c != timestamp]
    lacking = [c for c in [*wanted, *([timestamp] if timestamp else [])] if c not in raw.columns]
    if lacking:
        raise SourceError(f"{path}: no column {', '.join(lacking)}")
    kept = raw.withColumn("row", F.monotonically_increasing_id()).select("row", *([timestamp] if timestamp else []), *[F.expr(f"try_cast(trim(`{c}`) as double)").alias(c) for c in wanted])
    if skip_rows:
        # the first rows are in the first partition: a bounded top, no global sort
        first = kept.select("row").orderBy("row").limit(skip_rows)
        kept = kept.join(F.broadcast(first), "row", "left_anti")
    good = kept.dropna(subset=wanted)
    return good.orderBy("row").limit(max_rows) if max_rows is not None else good


def number_rows(df: DataFrame, order: list[str], key: str) -> DataFrame:
    """A position t = 0, 1, .. within each key."""
    return df.withColumn("t", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def micros(ts: str | Column, timezone: str | None = None) -> Column:
    """Microseconds since the epoch, in UTC, of a timestamp with or without a zone.

    With ``timezone`` those that the wall clock there shows, so that days begin at its midnight.
    """
    c = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")
    return F.unix_micros(F.from_utc_timestamp(c, timezone) if timezone else c)


def occupied_bins(events: DataFrame, minutes: int, start_hour: int = 0, days: int | None = None, key: str = "series_id", ts: str = "ts", value: str | None = None, threshold: float = 0.0, timezone: str | None = None) -> DataFrame:
    """series_id, t, value: whether each bin of a key's calendar holds an event.

    Bins divide the day. The calendar starts at the first day's start_hour, or a
    day later if the first event is at or after it, and ends ``days`` later or
    after the last event's bin. Unreadable times go; with ``value`` only events
    over the threshold count. With ``timezone`` bins are of the wall clock there: an
    hour that it skips stays empty, one that it repeats is one.
    """
    if 1440 % minutes:
        raise ValueError("minutes divides 1440")
    width, day = minutes * 60_000_000, 86_400_000_000
    kept = events.where(F.col(ts).isNotNull())
    if value:
        kept = kept.where(F.col(value) > threshold)
    at = kept.select(F.col(key).cast("string").alias("series_id"), micros(ts, timezone).alias("us"))
    span = at.groupBy("series_id").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    morning = F.expr(f"lo div {day} * {day}") + start_hour * 3_600_000_000
    span = span.withColumn("anchor", F.when(F.col("lo") >= morning, morning + day).otherwise(morning))
    bins = F.lit(days * 1440 // minutes).cast("long") if days else F.expr(f"(hi - anchor) div {width} + 1")
    span = span.withColumn("bins", bins).where("bins > 0")
    hit = at.join(span, "series_id").where(F.col("us") >= F.col("anchor")).select("series_id", F.expr(f"(us - anchor) div {width}").alias("t")).distinct().withColumn("hit", F.lit(True))
    calendar = span.select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("t"))
    return calendar.join(hit, ["series_id", "t"], "left").select("series_id", "t", F.coalesce("hit", F.lit(False)).alias("value"))


def parse_bits(texts: DataFrame, text: str, key: str) -> DataFrame:
    """key, t, value of the 0 and 1 characters of a text."""
    bits = F.regexp_replace(text, "[^01]", "")
    return texts.select(key, F.posexplode(F.array_remove(F.split(bits, ""), "")).alias("t", "bit")).select(key, F.col("t").cast("long"), (F.col("bit") == "1").alias("value"))


def phase_means(series: DataFrame, period: int, value: str = "value") -> DataFrame:
    return series.groupBy("series_id", F.pmod("t", F.lit(period)).cast("int").alias("phase")).agg(F.avg(F.col(value).cast("double")).alias("mean"), F.count("*").alias("n"))


def compositions(events: DataFrame, categories: list[str], day: Column, category: str, key: str) -> DataFrame:
    """key, day, comp: shares of each category, in order, of days that have any."""
    counts = events.groupBy(key, day.alias("day")).agg(*[F.count_if(F.col(category) == c).alias(f"c{i}") for i, c in enumerate(categories)])
    total = sum((F.col(f"c{i}") for i in range(1, len(categories))), F.col("c0"))
    return counts.where(total > 0).select(key, "day", F.array(*[F.col(f"c{i}") / total for i in range(len(categories))]).alias("comp"))


def clean(series: DataFrame, value: str = "value") -> DataFrame:
    """NaN as null, so that both mean missing."""
    return series.withColumn(value, not_nan(value))


def count_windows(series: DataFrame, size: int, step: int, value: str = "value") -> DataFrame:
    """series_id, window, values: windows of ``size`` rows every ``step`` rows; short ones at the end are left out."""
    w = Window.partitionBy("series_id").orderBy("t").rowsBetween(0, size - 1)
    return series.select("series_id", "t", F.collect_list(value).over(w).alias("values")).where((F.pmod("t", F.lit(step)) == 0) & (F.size("values") == size)).select("series_id", F.expr(f"t div {step}").alias("window"), "values")


# --- results ------------------------------------------------------------------------


def write_draws(draws: DataFrame, config: dict, path: str) -> None:
    """Posterior draws and a one-row configuration."""
    draws.write.parquet(f"{path}/draws")
    spark = draws.sparkSession
    spark.createDataFrame([({k: str(v) for k, v in config.items()},)], "config map<string,string>").coalesce(1).write.parquet(f"{path}/config")


def read_draws(spark: SparkSession, path: str, required: tuple[str, ...] = ("series_id", "tau", "log_post")) -> tuple[DataFrame, dict]:
    with at_path(path):
        draws, config = spark.read.parquet(f"{path}/draws"), spark.read.parquet(f"{path}/config").first()["config"]
    lacking = set(required) - set(draws.columns)
    if lacking:
        raise SourceError(f"{path}: no column {', '.join(sorted(lacking))}")
    return draws, config


def write_study(tables: dict[str, DataFrame], config: dict, path: str) -> None:
    """Each table of a study as CSV with a header, and its configuration as JSON."""
    with at_path(path, "writing"):
        for name, table in tables.items():
            table.write.option("header", True).csv(f"{path}/{name}")
        spark = next(iter(tables.values())).sparkSession
        spark.createDataFrame([({k: str(v) for k, v in config.items()},)], "config map<string,string>").coalesce(1).write.json(f"{path}/config")


def write_online_csv(online: DataFrame, alerts: DataFrame, path: str) -> None:
    """Steps with their alert flag as CSV."""
    marked = online.join(alerts.select("series_id", "t", F.lit(1).alias("is_cp")), ["series_id", "t"], "left").fillna(0, ["is_cp"])
    marked.select("series_id", "t", "cp_prob", "map_run_length", "pred_mean", "is_cp").write.option("header", True).csv(path)
