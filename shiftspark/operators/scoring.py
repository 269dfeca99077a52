"""Scores of detected against true changepoints, comparison and consensus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matched(predicted: Column, actual: Column, tolerance: int) -> Column:
    """How many of two sorted arrays pair one to one within the tolerance (as many as can be)."""
    start = F.struct(F.lit(0).alias("j"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        # the next actual one that is not too far left
        rest = F.filter(F.sequence(acc["j"], F.size(actual)), lambda j: (j < F.size(actual)) & (F.get(actual, j) >= p - tolerance))
        j = F.coalesce(F.get(rest, 0), F.size(actual))
        hit = F.coalesce(F.get(actual, j) <= p + tolerance, F.lit(False))
        return F.struct(F.when(hit, j + 1).otherwise(j).alias("j"), F.when(hit, acc["n"] + 1).otherwise(acc["n"]).alias("n"))

    return F.aggregate(predicted, start, step, lambda acc: acc["n"])


def score(predicted: DataFrame, actual: DataFrame, tolerance: int, key: str = "series_id") -> DataFrame:
    """key, tp, fp, fn, precision, recall, f1; predicted and actual: key, cp. Both empty never occur as rows."""
    p = predicted.groupBy(key).agg(F.array_sort(F.collect_set("cp")).alias("p"))
    a = actual.groupBy(key).agg(F.array_sort(F.collect_set("cp")).alias("a"))
    none = F.array().cast("array<bigint>")
    both = p.join(a, key, "full").select(key, F.coalesce("p", none).cast("array<bigint>").alias("p"), F.coalesce("a", none).cast("array<bigint>").alias("a"))
    tp = both.withColumn("tp", matched(F.col("p"), F.col("a"), tolerance)).withColumn("fp", F.size("p") - F.col("tp")).withColumn("fn", F.size("a") - F.col("tp"))
    share = lambda n, d: F.when(F.col("tp") + F.col("fp") + F.col("fn") == 0, 1.0).when(d == 0, 0.0).otherwise(n / d)
    return tp.select(key, "tp", "fp", "fn", share(F.col("tp"), F.size("p")).alias("precision"), share(F.col("tp"), F.size("a")).alias("recall"), share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def consensus(found: DataFrame, detectors: int, tolerance: int, key: str = "series_id") -> DataFrame:
    """key, cp, votes, confidence: clusters of several detectors' changepoints, split at gaps over the tolerance."""
    w = Window.partitionBy(key).orderBy("cp")
    fresh = F.coalesce((F.col("cp") - F.lag("cp").over(w) > tolerance).cast("int"), F.lit(0))
    numbered = found.withColumn("fresh", fresh).withColumn("cluster", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "cluster").agg(F.floor(F.avg("cp")).cast("long").alias("cp"), F.count("*").alias("votes")).select(key, "cp", "votes", (F.col("votes") / detectors).alias("confidence"))


def detection_delay(alerts: DataFrame, actual: DataFrame, key: str = "series_id") -> DataFrame:
    """key, delay: mean gap from each true changepoint to the first alert at or after it; infinite if one has none.

    A forward as-of match by one window over the union of both.
    """
    both = actual.select(key, F.col("cp").alias("at"), F.lit(None).cast("long").alias("alert")).union(alerts.select(key, F.col("t").alias("at"), (F.col("t") + 0).cast("long").alias("alert")))
    w = Window.partitionBy(key).orderBy("at").rangeBetween(0, Window.unboundedFollowing)
    met = both.withColumn("first", F.min("alert").over(w)).where("alert is null")
    return met.groupBy(key).agg(F.when(F.count_if(F.col("first").isNull()) > 0, float("inf")).otherwise(F.avg(F.col("first") - F.col("at"))).alias("delay"))


def mean_error(predicted: DataFrame, actual: DataFrame, tolerance: int, key: str = "series_id") -> DataFrame:
    """key, pairs, mean_abs_error: each prediction with its nearest true one within the tolerance."""
    near = predicted.select(key, F.col("cp").alias("p")).join(actual.select(key, F.col("cp").alias("a")), key).where(F.abs(F.col("p") - F.col("a")) <= tolerance)
    best = near.groupBy(key, "p").agg(F.min(F.abs(F.col("p") - F.col("a"))).alias("e"))
    return best.groupBy(key).agg(F.count("*").alias("pairs"), F.avg("e").alias("mean_abs_error"))


def compare(detectors: dict[str, Callable[[DataFrame], DataFrame]], series: DataFrame, actual: DataFrame, tolerance: int) -> DataFrame:
    """method, series_id and scores of several detectors (series -> series_id, cp) on the same data."""
    out = None
    for name, detect in detectors.items():
        try:
            one = score(detect(series), actual, tolerance).select(F.lit(name).alias("method"), "*")
        except Exception as e:
            raise RuntimeError(f"detector {name}: {e}") from e
        out = one if out is None else out.unionByName(one)
    return out


class Registry:
    """Named detector factories, in the order in which they were put in."""

    def __init__(self) -> None:
        self._made: dict[str, Callable[[], Callable[[DataFrame], DataFrame]]] = {}

    def register(self, name: str, factory: Callable[[], Callable[[DataFrame], DataFrame]]) -> None:
        if not name or name != name.strip() or name in self._made:
            raise ValueError("a name is new and has no spaces around it")
        self._made[name] = factory

    def names(self) -> list[str]:
        return list(self._made)

    def build(self, names: list[str] | None = None) -> dict[str, Callable[[DataFrame], DataFrame]]:
        return {n: self._made[n]() for n in names or self._made}


def summary(scores: DataFrame, by: str = "method", value: str = "f1") -> DataFrame:
    """by, n, mean and standard error over replicates."""
    return scores.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.when(F.count("*") > 1, F.stddev_samp(value) / F.sqrt(F.count("*"))), F.lit(0.0)).alias("se"))


def within_segments(series: DataFrame, segments: DataFrame) -> DataFrame:
    """Series re-keyed by segment (series_id/segment, t from 0), to detect again inside each."""
    s = segments.select(F.col("series_id").alias("_s"), "segment", "start", "stop")
    met = series.join(s, (F.col("series_id") == F.col("_s")) & (F.col("t") >= F.col("start")) & (F.col("t") < F.col("stop")))
    kept = [c for c in series.columns if c not in ("series_id", "t")]
    return met.select(F.concat_ws("/", "series_id", "segment").alias("series_id"), (F.col("t") - F.col("start")).alias("t"), *kept)


def greedy_errors(predicted: DataFrame, actual: DataFrame, tolerance: int, key: str = "series_id") -> DataFrame:
    """key, matches, precision, recall, f1, mean_abs_error: predictions from left to right each take the nearest true one left.

    One pass over sorted arrays: a true one too far from a prediction stays for the next.
    """
    none = F.array().cast("array<bigint>")
    p = predicted.groupBy(key).agg(F.array_sort(F.collect_set("cp")).alias("p"))
    a = actual.groupBy(key).agg(F.array_sort(F.collect_set("cp")).alias("a"))
    both = p.join(a, key, "full").select(key, F.coalesce("p", none).cast("array<bigint>").alias("p"), F.coalesce("a", none).cast("array<bigint>").alias("a"))
    start = F.struct(F.col("a").alias("left"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e"))

    def step(acc: Column, x: Column) -> Column:
        near = F.array_min(F.transform(acc["left"], lambda v, i: F.struct(F.abs(v - x).alias("d"), i.alias("i"))))
        hit = F.coalesce(near["d"] <= tolerance, F.lit(False))
        left = F.when(hit, F.filter(acc["left"], lambda v, i: i != near["i"])).otherwise(acc["left"])
        return F.struct(left.alias("left"), F.when(hit, acc["n"] + 1).otherwise(acc["n"]).alias("n"), F.when(hit, acc["e"] + near["d"]).otherwise(acc["e"]).alias("e"))

    done = both.withColumn("m", F.aggregate("p", start, step))
    n = F.col("m.n")
    share = lambda of, other: F.when(F.size(of) > 0, n / F.size(of)).otherwise(F.when(F.size(other) == 0, 1.0).otherwise(0.0))
    rated = done.select(key, n.alias("matches"), share("p", "a").alias("precision"), share("a", "p").alias("recall"), F.when(n > 0, F.col("m.e") / n).alias("mean_abs_error"))
    total = F.col("precision") + F.col("recall")
    return rated.select(key, "matches", "precision", "recall", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0).alias("f1"), "mean_abs_error")


def benchmark(detectors: dict[str, Callable[[DataFrame], DataFrame]], series: DataFrame, actual: DataFrame, tolerance: int) -> DataFrame:
    """method, n, mean, se of F1 over replicates: each replicate is a series, all are detected side by side."""
    return summary(compare(detectors, series, actual, tolerance))


def union_of(found: list[DataFrame]) -> DataFrame:
    """series_id, cp of several detectors or channels, each once."""
    out = found[0].select("series_id", "cp")
    for more in found[1:]:
        out = out.union(more.select("series_id", "cp"))
    return out.distinct()


def two_stage(series: DataFrame, segments: DataFrame, refine: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """series_id, cp: what ``refine`` (series -> series_id, cp) finds inside each segment, and the segments' own starts."""
    inner = refine(within_segments(series, segments)).select(F.col("series_id").alias("_part"), "cp")
    starts = segments.select("series_id", F.concat_ws("/", "series_id", "segment").alias("_part"), F.col("start").alias("_start"))
    found = inner.join(starts, "_part").select("series_id", (F.col("cp") + F.col("_start")).alias("cp"))
    return union_of([found, segments.where("start > 0").select("series_id", F.col("start").alias("cp"))])


def retuned_run_lengths(segments: DataFrame, before: float, share: float = 0.8) -> DataFrame:
    """series_id, mean_run_length for an online detector after an offline look: ``share`` of what it was and the rest of the last segment's length."""
    last = segments.groupBy("series_id").agg(F.max_by(F.col("stop") - F.col("start"), "start").alias("length"))
    return last.select("series_id", (share * before + (1 - share) * F.col("length")).alias("mean_run_length"))
