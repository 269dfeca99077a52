"""Queries on streams: each replays a table through a streaming job and returns what its sink holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark.functions.frames import keep, shared_dir
from shiftspark.operators import bocpd
from shiftspark.plans.build import HOURLY, hourly_bits, query, table
from shiftspark.plans.detectors import _BERNOULLI, _BOCPD, _ROUNDED, _rounded
from shiftspark.streaming import online


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _replay(spark: SparkSession, rows: DataFrame, job) -> DataFrame:
    """Run ``job`` (stream -> stream) over all of rows, once, to a Parquet sink."""
    root = _root(spark)
    rows.write.parquet(f"{root}/in")
    out = job(spark.readStream.schema(rows.schema).parquet(f"{root}/in"))
    q = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@query("WITH " + _BERNOULLI + _ROUNDED)
def streaming_bocpd(spark, sf_dir):
    """The online detector over a stream gives what it gives over the table."""
    bits = hourly_bits(spark, sf_dir).select("series_id", F.col("t").cast("long").alias("t"), (F.col("n") > 2).cast("double").alias("value"))
    detector = bocpd.Detector(bocpd.BetaBernoulli(), bocpd.ConstantHazard(48), max_run_length=8192)
    return _rounded(_replay(spark, keep(bits, "bits"), lambda s: online.detect_stream(s, detector)))


# a silent series goes on to the end of all
_GAPS = _BOCPD.format(
    hourly=HOURLY.replace("min(bin) AS lo, max(bin) AS hi", "min(bin) AS lo, (SELECT max(bin) FROM ev) AS hi"), value="CASE WHEN n > 0 THEN CAST(n > 2 AS INTEGER) END", a0=1, b0=1, a_new="CAST(coalesce(1 + x, 1) AS DOUBLE)", b_new="CAST(coalesce(2 - x, 1) AS DOUBLE)",
    a_upd="v + coalesce(x, 0)", b_upd="v + coalesce(1 - x, 0)", mean="p[1] / (p[1] + p[2])", p0="CAST(CASE WHEN x IS NULL THEN 1 ELSE 0.5 END AS DOUBLE)",
    pred="(CASE WHEN x = 1 THEN p[2] WHEN x = 0 THEN p[3] ELSE p[2] + p[3] END) / (p[2] + p[3])",
)


@query("WITH " + _GAPS + """, first AS (SELECT event_type AS series_id, min(epoch_us(ts) // 3600000000) AS h FROM events GROUP BY 1),
mark AS (SELECT max(epoch_us(ts)) // 1000 - 7200000 AS ms FROM events)
SELECT series_id, t + h AS t, round(cp_prob, 7) AS cp_prob, CAST(map_run_length AS INTEGER) AS map_run_length, round(pred_mean, 7) AS pred_mean
FROM online JOIN first USING (series_id) CROSS JOIN mark WHERE (t + h + 1) * 3600000 <= ms
""")
def streaming_bocpd_gaps(spark, sf_dir):
    """By event time: hours without an event come out as missing steps when the watermark has closed them."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"))
    hour = e.groupBy("series_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.max("ts").alias("ts"), (F.count("*") > 2).cast("double").alias("value"))
    detector = bocpd.Detector(bocpd.BetaBernoulli(), bocpd.ConstantHazard(48), max_run_length=8192)
    return _rounded(_replay(spark, keep(hour.select("series_id", "ts", "value"), "hours"), lambda s: online.detect_stream(s, detector, "ts", 3_600_000, "2 hours")))


@query("""
WITH w AS (SELECT event_type AS series_id, epoch_us(ts) // 3600000000 AS h, count(*) AS value FROM events GROUP BY 1, 2)
SELECT series_id, h, value FROM w WHERE (h + 1) * 3600000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 7200000000 FROM events)
""")
def streaming_window_counts(spark, sf_dir):
    """Tumbling windows that the watermark has closed by the end of the stream."""
    events = table(spark, sf_dir, "events").select("ts", "event_type")
    found = _replay(spark, events, lambda s: online.binned_counts(s, "1 hour", "2 hours"))
    return found.select("series_id", F.expr("unix_micros(start) div 3600000000").alias("h"), "value")


@query("""
WITH w AS (SELECT event_type AS series_id, epoch_us(ts) // 3600000000 - k AS h, avg(value) AS mean, count(*) AS n FROM events CROSS JOIN (SELECT unnest(range(6)) AS k) GROUP BY 1, 2)
SELECT series_id, h, round(mean, 7) AS mean, n FROM w WHERE (h + 6) * 3600000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 FROM events)
""")
def streaming_hopping_means(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    found = _replay(spark, events, lambda s: online.hopping_means(s, "6 hours", "1 hour"))
    return found.select("series_id", F.expr("unix_micros(start) div 3600000000").alias("h"), F.round("mean", 7).alias("mean"), "n")
