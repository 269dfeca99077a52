"""Pictures of small results. Needs matplotlib; frames are aggregated by Spark before they come here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _axes(ax=None):
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise ImportError("plots need matplotlib") from e
    return ax or plt.subplots()[1]


def _one(df: DataFrame, series_id: str, order: str):
    return df.where(F.col("series_id") == series_id).orderBy(order).toPandas()


def changepoint_probability(online: DataFrame, series_id: str, threshold: float | None = None, ax=None):
    ax, d = _axes(ax), _one(online, series_id, "t")
    ax.plot(d["t"], d["cp_prob"])
    if threshold is not None:
        ax.axhline(threshold, linestyle="--")
    return ax


def run_lengths(online: DataFrame, series_id: str, ax=None):
    ax, d = _axes(ax), _one(online, series_id, "t")
    ax.step(d["t"], d["map_run_length"], where="post")
    return ax


def segments(series: DataFrame, found: DataFrame, series_id: str, ax=None):
    ax, d, s = _axes(ax), _one(series, series_id, "t"), _one(found, series_id, "start")
    ax.plot(d["t"], d["value"])
    for at in s["start"]:
        if at:
            ax.axvline(at, linestyle="--")
    return ax


def scree(models: DataFrame, series_id: str, ax=None):
    """Cost and criterion by the number of segments."""
    ax, d = _axes(ax), _one(models, series_id, "m")
    ax.plot(d["m"], d["cost"], marker="o")
    ax.plot(d["m"], d["criterion"], marker="x")
    return ax


def boundary_mass(mass: DataFrame, series_id: str, ax=None):
    ax, d = _axes(ax), _one(mass, series_id, "phase")
    ax.bar(d["phase"], d["mass"])
    return ax


def bands(pointwise: DataFrame, series_id: str, ax=None):
    ax, d = _axes(ax), _one(pointwise, series_id, "phase")
    ax.fill_between(d["phase"], d["lower"], d["upper"], alpha=0.3)
    ax.plot(d["phase"], d["median"])
    return ax


def segment_counts(counts: DataFrame, series_id: str, ax=None):
    ax, d = _axes(ax), _one(counts, series_id, "m")
    ax.bar(d["m"], d["probability"])
    return ax
