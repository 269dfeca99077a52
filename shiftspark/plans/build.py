"""How queries and their SQL are put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark.functions.columns import cents
from shiftspark.sources.series import number_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name, with the DuckDB SQL of the same rows."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id (a user), t, cents: event values in the order of time."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), "ts", "event_id", cents("value").alias("cents"))
    return number_rows(e, ["ts", "event_id"], "series_id").select("series_id", "t", "cents")


USERS = """users AS (
  SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
         CAST(round(value * 100) AS BIGINT) AS cents
  FROM events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id (a label), t, x: each label's embeddings in the order of vec_id, to four decimals."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("series_id"), "vec_id", F.transform("embedding", lambda v: F.round(v.cast("double"), 4)).alias("x"))
    return number_rows(e, ["vec_id"], "series_id").select("series_id", "t", "x")


VECTORS = """vectors AS (
  SELECT label AS series_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t,
         list_transform(embedding, lambda v: round(CAST(v AS DOUBLE), 4)) AS x
  FROM embeddings)"""


def weekly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id (a priority), t (weeks), value: revenue in thousands, whole numbers."""
    o = table(spark, sf_dir, "orders")
    week = F.expr("datediff(CAST(o_orderdate AS DATE), DATE'1992-01-01') div 7")
    w = o.groupBy(F.col("o_orderpriority").alias("series_id"), week.alias("week")).agg(F.sum(cents("o_totalprice")).alias("c"))
    return number_rows(w, ["week"], "series_id").select("series_id", "t", F.expr("c div 100000").alias("value"))


WEEKLY = """weekly AS (
  SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY week) - 1 AS t, c // 100000 AS value FROM (
    SELECT o_orderpriority AS series_id, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) // 7 AS week,
           sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS c
    FROM orders GROUP BY 1, 2))"""


def hourly_bits(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    """series_id (an event type), t (hours), n: how often it occurred; a dense calendar."""
    e = table(spark, sf_dir, "events")
    width = minutes * 60_000_000
    at = e.select(F.col("event_type").alias("series_id"), F.expr("unix_micros(CAST(ts AS TIMESTAMP))").alias("us"))
    lo = at.groupBy("series_id").agg(F.min(F.expr(f"us div {width}")).alias("lo"), F.max(F.expr(f"us div {width}")).alias("hi"))
    counts = at.groupBy("series_id", F.expr(f"us div {width}").alias("bin")).agg(F.count("*").alias("n"))
    grid = lo.select("series_id", "lo", F.explode(F.sequence("lo", "hi")).alias("bin"))
    return grid.join(counts, ["series_id", "bin"], "left").select("series_id", (F.col("bin") - F.col("lo")).alias("t"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


HOURLY = """hourly AS (
  WITH ev AS (SELECT event_type AS series_id, epoch_us(ts) // 3600000000 AS bin FROM events),
  lo AS (SELECT series_id, min(bin) AS lo, max(bin) AS hi FROM ev GROUP BY 1),
  n AS (SELECT series_id, bin, count(*) AS n FROM ev GROUP BY 1, 2),
  grid AS (SELECT series_id, lo, unnest(range(lo, hi + 1)) AS bin FROM lo)
  SELECT g.series_id, g.bin - g.lo AS t, coalesce(n.n, 0) AS n FROM grid g LEFT JOIN n ON n.series_id = g.series_id AND n.bin = g.bin)"""
