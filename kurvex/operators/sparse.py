"""Smoothers of sparse curves: local-linear mean, raw covariance pairs, conformal radius (fits: ``sparse_fit``)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analytic import epanechnikov

CURVE = "curve_id"


def local_linear_mean(samples: DataFrame, grid: DataFrame, bandwidth: float, value: str = "x", min_points: int = 3) -> DataFrame:
    """Local-linear smooth of the pooled samples at the grid points g; NULL where fewer than ``min_points`` support it.

    The grid (declared, small) is exploded onto each sample's own window only, so rows grow with samples times
    grid points in a bandwidth, and the five moments are combined before the shuffle.
    """
    u = (F.col("t") - F.col("g")) / bandwidth
    near = samples.where(F.col(value).isNotNull()).join(F.broadcast(grid.select("g_idx", "g")), F.abs(F.col("t") - F.col("g")) < bandwidth)
    k, d = epanechnikov(u), F.col("t") - F.col("g")
    m = near.groupBy("g_idx", "g").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("s0"), F.sum(k * d).alias("s1"), F.sum(k * d * d).alias("s2"), F.sum(k * F.col(value)).alias("t0"), F.sum(k * d * F.col(value)).alias("t1"))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    return m.select("g_idx", "g", "n", F.when((F.col("n") >= min_points) & (det > 0), (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det).alias("mean"))


def raw_covariance_pairs(residuals: DataFrame, value: str = "e") -> DataFrame:
    """Products of residuals at two different times of one curve, both orders."""
    a = residuals.select(CURVE, F.col("t_idx").alias("i"), F.col("t").alias("s"), F.col(value).alias("p"))
    b = residuals.select(CURVE, F.col("t_idx").alias("j"), F.col("t").alias("t"), F.col(value).alias("q"))
    return a.join(b, CURVE).where("i <> j").select(CURVE, "s", "t", (F.col("p") * F.col("q")).alias("c"))


def conformal_radius(calibration: DataFrame, alpha: float = 0.1) -> float:
    """The ceil((n + 1)(1 - alpha))-th least calibration score (column ``score``); infinite if there are too few."""
    n = calibration.count()
    k = int(np.ceil((n + 1) * (1 - alpha)))
    if k > n:
        return float("inf")
    return float(calibration.agg(F.percentile("score", (k - 1) / max(1, n - 1)).alias("q")).first().q)
