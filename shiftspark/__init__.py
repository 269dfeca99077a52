"""Changepoint detection and state-space segmentation over many keyed series, on Spark."""

from shiftspark.ship import connect

__all__ = ["connect"]
