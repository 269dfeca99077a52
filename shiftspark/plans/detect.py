"""One entry for every detector: the same columns out, by name of the method."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark.operators import bocpd, emissions, energy, kernels, periodic, pointprocess, pooled, statespace
from shiftspark.operators import segmentation as seg

RIGHT_EXCLUSIVE, TIME_INDEX, PERIODIC = "right_exclusive", "time_index", "periodic_bin_end"


def _points(df: DataFrame) -> DataFrame:
    return df if "x" in df.columns else df.select("series_id", "t", F.array(F.col("value").cast("double")).alias("x"))


def _segments(found: DataFrame, sense: str = "minimize") -> DataFrame:
    ok = found.where("start > 0 and status = 'ok'")
    return ok.select("series_id", F.col("start").alias("cp"), "score", F.lit(sense).alias("orientation"))


def _partition(df, cost="known_variance", penalty="bic", min_length=1, **options):
    return _segments(seg.partition(df, cost, penalty, min_length, **options))


def _kernel(df, penalty=1.0, **options):
    return _segments(kernels.kernel_partition(_points(df), penalty, **options))


def _kernel_fixed(df, segments=2, **options):
    return _segments(kernels.kernel_fixed(_points(df), segments, **options))


def _rff(df, penalty=1.0, gamma=None, **options):
    return _segments(kernels.rff_partition(_points(df), penalty, gamma, **options))


def _rff_fixed(df, segments=2, gamma=None, **options):
    return _segments(kernels.rff_partition(_points(df), 0.0, gamma, segments=segments, **options))


def _energy(df, **options):
    found = energy.divisive(_points(df), **options).where("accepted")
    return found.select("series_id", "cp", F.col("stat").alias("score"), F.lit("maximize").alias("orientation"))


def online_detector(mean_run_length=96.0, likelihood="bernoulli", prior=(1.0, 1.0), schedule=None, period=None, boost_phases=None, boost_factor=10.0, max_run_length=512, **options) -> bocpd.Detector:
    """A detector from plain parameters: a constant or scheduled hazard, raised at some phases of a period; ``likelihood`` may be the caller's own."""
    named = {"bernoulli": bocpd.BetaBernoulli, "poisson": bocpd.PoissonGamma}
    if isinstance(likelihood, str) and likelihood not in named:
        raise ValueError(f"{likelihood}: neither bernoulli nor poisson")
    if schedule and period and len(schedule) != period:
        raise ValueError("a schedule has a hazard for each phase of its period")
    hazard = bocpd.ScheduledHazard(tuple(float(h) for h in schedule)) if schedule else bocpd.ConstantHazard(mean_run_length)
    if boost_phases:
        period = period or (len(schedule) if schedule else None)
        if not period:
            raise ValueError("phases that raise the hazard need a period")
        hazard = bocpd.BoostedHazard(hazard, int(period), tuple(int(p) for p in boost_phases), boost_factor)
    return bocpd.Detector(named[likelihood](*prior) if isinstance(likelihood, str) else likelihood, hazard, max_run_length, **options)


def _bocpd(df, threshold=0.6, reset=False, min_spacing=1, **options):
    online = bocpd.detect(df, online_detector(**options))
    found = bocpd.alerts(online, threshold, reset, min_spacing)
    return found.join(online, ["series_id", "t"]).select("series_id", F.col("t").alias("cp"), F.col("cp_prob").alias("score"), F.lit("maximize").alias("orientation"))


def _hsmm(df, states=2, mean_duration=10.0, longest=40, learn=True, seed=0, shared=False, iterations=50):
    """Gaussian emissions from a clustering of the points, then explicit durations, of each series or shared by all."""
    points = _points(df)
    labelled = points.join(emissions.kmeans(points, states, ["series_id", "t"], seed=seed), ["series_id", "t"])
    ll = emissions.label_loglik(points, emissions.diag_from_labels(labelled), ["series_id", "t"])
    a = [[0.0 if i == j else 1.0 for j in range(states)] for i in range(states)]
    start, durations = [1.0 / states] * states, [mean_duration] * states
    if shared and learn:
        decoded = pooled.decode_with(ll, pooled.fit_hsmm(ll, start, a, durations, longest, iterations)[0])
    else:
        decoded = statespace.decode_hsmm(ll, start, a, durations, longest, learn, iterations)
    found = statespace.state_changepoints(decoded)
    return found.select("series_id", "cp", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("orientation"))


def _sdhmm(df, states=2, components=1, shared=False, **options):
    comp = df if "comp" in df.columns else df.withColumnRenamed("x", "comp")
    decoded = pooled.decode_sdhmm(comp, pooled.fit_sdhmm(comp, states, components, **options)) if shared else statespace.decode_sdhmm(comp, states, components, **options)
    found = statespace.state_changepoints(decoded)
    return found.select("series_id", "cp", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("orientation"))


def _within_period(df, period=24, min_length=1, **options):
    best = periodic.map_tau(periodic.sample(periodic.phase_counts(df, period), period, min_length, **options))
    return best.select("series_id", F.explode("tau").alias("cp"), F.col("log_post").alias("score"), F.lit("maximize").alias("orientation"))


def _sliced_poisson(df, period=24.0, **options):
    return _segments(pointprocess.sliced_poisson(df, period, **options))


@dataclass(frozen=True)
class Method:
    run: Callable[..., DataFrame]
    boundary: str
    status: str = "stable"


METHODS = {
    "partition": Method(_partition, RIGHT_EXCLUSIVE), "kernel": Method(_kernel, RIGHT_EXCLUSIVE), "kernel_fixed": Method(_kernel_fixed, RIGHT_EXCLUSIVE),
    "rff": Method(_rff, RIGHT_EXCLUSIVE), "rff_fixed": Method(_rff_fixed, RIGHT_EXCLUSIVE), "energy": Method(_energy, RIGHT_EXCLUSIVE),
    "bocpd": Method(_bocpd, TIME_INDEX), "within_period": Method(_within_period, PERIODIC), "hsmm": Method(_hsmm, RIGHT_EXCLUSIVE, "experimental"),
    "sdhmm": Method(_sdhmm, RIGHT_EXCLUSIVE, "experimental"), "sliced_poisson": Method(_sliced_poisson, RIGHT_EXCLUSIVE, "experimental"),
}


def detect(series: DataFrame, method: str, **parameters: Any) -> DataFrame:
    """series_id, cp, score, orientation, method, boundary for series_id, t and value (or x, comp)."""
    if method not in METHODS:
        raise ValueError(f"{method}: not one of {', '.join(METHODS)}")
    known = METHODS[method]
    found = known.run(series.withColumn("series_id", F.col("series_id").cast("string")), **parameters)
    return found.select("series_id", F.col("cp").cast("long"), "score", "orientation", F.lit(method).alias("method"), F.lit(known.boundary).alias("boundary"))


@dataclass
class Detector:
    """fit / predict over :func:`detect`, for code that passes detectors around."""

    method: str
    parameters: dict[str, Any] = field(default_factory=dict)
    _series: DataFrame | None = None

    def fit(self, series: DataFrame) -> Detector:
        self._series = series
        return self

    def predict(self) -> DataFrame:
        if self._series is None:
            raise RuntimeError("fit comes before predict")
        return detect(self._series, self.method, **self.parameters)

    def fit_predict(self, series: DataFrame) -> DataFrame:
        return self.fit(series).predict()

    def get_params(self) -> dict[str, Any]:
        return {"method": self.method, **self.parameters}


def register_table_functions(spark: SparkSession) -> None:
    """partition_segments for SQL: ``SELECT * FROM partition_segments(TABLE(s) PARTITION BY series_id ORDER BY (t), 'known_variance', 10.0)``."""
    import numpy as np
    from pyspark.sql.functions import udtf

    @udtf(returnType="series_id: string, segment: int, start: bigint, stop: bigint, cost: double")
    class PartitionSegments:
        def __init__(self):
            self.values, self.sid, self.cost, self.penalty = [], None, None, None

        def eval(self, row, cost: str, penalty: float):
            self.sid, self.cost, self.penalty = str(row["series_id"]), cost, float(penalty)
            self.values.append(float(row["value"]))

        def terminate(self):
            if self.values:
                own = seg.COSTS[self.cost](np.array(self.values))
                n = len(self.values)
                for r in seg.segment_rows(self.sid, own, n, *seg.optimal_partition(own, n, self.penalty)):
                    yield r[:5]

    spark.udtf.register("partition_segments", PartitionSegments)
