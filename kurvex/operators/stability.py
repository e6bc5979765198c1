"""Uncertainty of decompositions: bootstrap tables (``decomposition.bootstrap_fits``) summarised by Spark aggregates.

A bootstrap has one row per replicate and component; its size follows the declared replicates and the grid, not the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import chi_square_quantile, gamma_cdf
from ..functions.sums import matrix
from .decomposition import Decomposition, subspace_distance


def higher(value, level: float):
    """The ``level`` quantile without interpolation of the rows of a group (replicates: few)."""
    values = F.sort_array(F.collect_list(value))
    return F.element_at(values, F.least(F.size(values), F.ceil(F.lit(level) * (F.size(values) - 1)).cast("int") + 1))


def summarise_stability(boot: DataFrame, threshold: float = 0.8, interval: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """Per component: median similarity, its interval, the share of replicates at or above the threshold, and of those matched in place."""
    s = F.col("similarity")
    return boot.groupBy("component").agg(F.count(F.lit(1)).alias("replicates"), F.percentile(s, 0.5).alias("median_similarity"), F.percentile(s, interval[0]).alias("lower"), F.percentile(s, interval[1]).alias("upper"), F.avg((s >= threshold).cast("double")).alias("stable_share"), F.avg((F.col("matched") == F.col("component")).cast("double")).alias("in_place_share"))


def _cells(boot: DataFrame) -> DataFrame:
    return boot.select("rep", "component", F.posexplode("shape").alias("place", "value"))


def component_envelopes(boot: DataFrame, level: float = 0.95) -> DataFrame:
    """Pointwise percentile envelopes of the sign-aligned components: (component, place, lower, median, upper)."""
    return _cells(boot).groupBy("component", "place").agg(F.percentile("value", (1 - level) / 2).alias("lower"), F.percentile("value", 0.5).alias("median"), F.percentile("value", (1 + level) / 2).alias("upper"))


def component_bands(boot: DataFrame, fit: Decomposition, level: float = 0.95, scope: str = "component", relative_gap: float | None = None, near_tie: str = "error") -> DataFrame:
    """Simultaneous bands of component shapes: estimate, se, critical value and ends per (component, place).

    The critical value is the quantile without interpolation of each replicate's largest studentised deviation, per component
    or over all of them (``family``).  Components whose eigenvalue is nearer to a neighbour's than ``relative_gap`` have no
    shape of their own: that is an error unless ``near_tie`` is ``ignore``.
    """
    if relative_gap is not None and near_tie == "error":
        ev = fit.explained_variance
        gaps = (ev[:-1] - ev[1:]) / np.maximum(ev[:-1], 1e-300)
        if len(gaps) and gaps.min() < relative_gap:
            raise ValueError(f"components {int(gaps.argmin()) + 1} and {int(gaps.argmin()) + 2} are nearly tied")
    spark = boot.sparkSession
    estimate = spark.createDataFrame([(k + 1, i, float(v)) for k, c in enumerate(fit.components) for i, v in enumerate(c)], "component long, place int, estimate double")
    cells = _cells(boot)
    se = cells.groupBy("component", "place").agg(F.stddev_samp("value").alias("se"))
    centre = estimate.join(se, ["component", "place"])
    z = cells.join(F.broadcast(centre), ["component", "place"]).select("rep", "component", F.when(F.col("se") > 0, F.abs(F.col("value") - F.col("estimate")) / F.col("se")).otherwise(0.0).alias("z"))
    if scope == "component":
        top = z.groupBy("rep", "component").agg(F.max("z").alias("m")).groupBy("component").agg(higher("m", level).alias("critical"))
        out = centre.join(F.broadcast(top), "component")
    else:
        out = centre.crossJoin(F.broadcast(z.groupBy("rep").agg(F.max("z").alias("m")).agg(higher("m", level).alias("critical"))))
    return out.withColumns({"lower": F.col("estimate") - F.col("critical") * F.col("se"), "upper": F.col("estimate") + F.col("critical") * F.col("se")})


def spectrum_uncertainty(boot: DataFrame, fit: Decomposition, level: float = 0.95, scope: str = "component") -> DataFrame:
    """Eigenvalues, shares and cumulative shares with bootstrap se, percentile interval and simultaneous ends: (component, measure, ...)."""
    spark = boot.sparkSession
    cumulative = np.cumsum(fit.ratio)
    estimate = spark.createDataFrame([(k + 1, m, float(v[k])) for m, v in (("eigenvalue", fit.explained_variance), ("ratio", fit.ratio), ("cumulative", cumulative)) for k in range(len(cumulative))], "component long, measure string, estimate double")
    long = boot.select("rep", "component", F.explode(F.create_map(*(x for m in ("eigenvalue", "ratio", "cumulative") for x in (F.lit(m), F.col(m))))).alias("measure", "value"))
    per = long.groupBy("component", "measure").agg(F.stddev_samp("value").alias("se"), F.percentile("value", (1 - level) / 2).alias("percentile_lower"), F.percentile("value", (1 + level) / 2).alias("percentile_upper"))
    centre = estimate.join(per, ["component", "measure"])
    z = long.join(F.broadcast(centre), ["component", "measure"]).withColumn("z", F.when(F.col("se") > 0, F.abs(F.col("value") - F.col("estimate")) / F.col("se")).otherwise(0.0))
    keys = ["component", "measure"] if scope == "component" else ["measure"]
    top = z.groupBy("rep", *keys).agg(F.max("z").alias("m")).groupBy(*keys).agg(higher("m", level).alias("critical"))
    out = centre.join(F.broadcast(top), keys)
    return out.withColumns({"lower": F.col("estimate") - F.col("critical") * F.col("se"), "upper": F.col("estimate") + F.col("critical") * F.col("se")})


def _replicate_bases(boot: DataFrame, fit: Decomposition) -> tuple[np.ndarray, np.ndarray]:
    """Means (replicates x places) and score bases (replicates x places x components); their size is replicates times grid."""
    rows = boot.select("rep", "component", "shape", "mean").toPandas().sort_values(["rep", "component"])
    k = len(fit.components)
    shapes = np.stack(rows["shape"]).reshape(-1, k, len(fit.mean))
    return np.stack(rows["mean"].iloc[::k]), np.swapaxes(shapes * fit.weights / np.square(fit.scale), 1, 2)


def score_uncertainty(boot: DataFrame, fit: Decomposition, targets: DataFrame, level: float = 0.95) -> DataFrame:
    """Scores of fixed targets (curve_id, values) with their spread over refitted bases: (curve_id, component, score, se, lower, median, upper)."""
    means, bases = _replicate_bases(boot, fit)
    tails = [(1 - level) / 2, 0.5, (1 + level) / 2]
    offset = np.einsum("rp,rpk->rk", means, bases)

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            m = matrix(b.column(1))
            z = np.einsum("np,rpk->nrk", m, bases, optimize=True) - offset
            q, own, k = np.quantile(z, tails, axis=1), (m - fit.mean) @ fit.basis, z.shape[2]
            cols = [b.column(0).take(pa.array(np.repeat(np.arange(len(b)), k))), pa.array(np.tile(np.arange(1, k + 1), len(b)))]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x.ravel()) for x in (own, z.std(1, ddof=1), *q))], ["curve_id", "component", "score", "se", "lower", "median", "upper"])

    kind = dict(targets.dtypes)["curve_id"]
    return targets.select("curve_id", "values").mapInArrow(run, f"curve_id {kind}, component long, score double, se double, lower double, median double, upper double")


def subspace_stability(boot: DataFrame) -> DataFrame:
    """Per replicate: smallest and largest principal angle (degrees) of the component subspaces and their projector distances."""

    @F.pandas_udf("double")
    def distance(angles: pd.Series) -> pd.Series:
        return angles.map(lambda a: subspace_distance(np.asarray(a))[0])

    one = boot.where("component = 1").select("rep", "angles")
    out = one.select("rep", F.degrees(F.array_min("angles")).alias("least_angle"), F.degrees(F.array_max("angles")).alias("largest_angle"), distance("angles").alias("projector_distance"), F.size("angles").alias("size"))
    return out.withColumn("normalized_distance", F.col("projector_distance") / F.sqrt(2.0 * F.col("size"))).drop("size")


def summarise_subspace_stability(stability: DataFrame, interval: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """Median and interval over replicates of each measure of ``subspace_stability``."""
    measures = ["least_angle", "largest_angle", "projector_distance", "normalized_distance"]
    long = stability.select("rep", F.explode(F.create_map(*(x for m in measures for x in (F.lit(m), F.col(m))))).alias("measure", "value"))
    return long.groupBy("measure").agg(F.count(F.lit(1)).alias("replicates"), F.percentile("value", 0.5).alias("median"), F.percentile("value", interval[0]).alias("lower"), F.percentile("value", interval[1]).alias("upper"))


def score_covariance(scored: DataFrame, k: int, robust: bool = False, steps: int = 10, support: float = 0.75) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of the first k scores; ``robust``: of the ``support`` share nearest to the centre, found by concentration steps.

    Every step is two aggregates: the distance that the share has, and the moments within it; the last covariance is scaled
    so that it is right for normal scores.
    """
    z = [F.col("scores")[i] for i in range(k)]

    def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        r = rows.agg(F.count(F.lit(1)), *(F.avg(a) for a in z), *(F.avg(z[i] * z[j]) for i in range(k) for j in range(k))).first()
        m = np.array(r[1 : k + 1])
        return m, (np.array(r[k + 1 :]).reshape(k, k) - np.outer(m, m)) * r[0] / max(1, r[0] - 1)

    if not robust:
        return moments(scored)
    r = scored.agg(*(F.percentile(a, 0.5) for a in z)).first()
    centre = np.array(list(r))
    spread = np.array(list(scored.agg(*(F.percentile(F.abs(a - float(c)), 0.5) for a, c in zip(z, centre, strict=True))).first())) / 0.67448975
    cov = np.diag(np.maximum(spread, 1e-12) ** 2)
    for _ in range(steps):
        near = scored.withColumn("_d", mahalanobis(centre, cov))
        cut = near.agg(F.percentile("_d", support)).first()[0]
        centre, fresh = moments(near.where(F.col("_d") <= float(cut)))
        done = np.allclose(fresh, cov, rtol=1e-9)
        cov = fresh
        if done:
            break
    return centre, cov * support / gamma_cdf(chi_square_quantile(support, k) / 2, k / 2 + 1)


def mahalanobis(centre: np.ndarray, cov: np.ndarray):
    """Squared distance of the column ``scores`` from a centre in the metric of a covariance, as one expression."""
    inverse, k = np.linalg.inv(cov), len(centre)
    d = [F.col("scores")[i] - float(c) for i, c in enumerate(centre)]
    return sum((d[i] * d[j] * float(inverse[i, j]) for i in range(k) for j in range(k)), F.lit(0.0))


def diagnose_outliers(errors: DataFrame, scored: DataFrame, k: int, z_threshold: float = 3.5, alpha: float = 0.99, robust: bool = True) -> DataFrame:
    """Curves by two screens: robust z of the reconstruction error, and the scores' squared distance against a chi-square quantile."""
    from .inference import robust_z

    centre, cov = score_covariance(scored, k, robust)
    cut = chi_square_quantile(alpha, k)
    e = robust_z(errors.select("curve_id", "rmse"), "rmse").withColumnRenamed("z", "error_z")
    out = e.join(scored.select("curve_id", mahalanobis(centre, cov).alias("distance")), "curve_id")
    out = out.withColumns({"error_outlier": F.col("error_z") > z_threshold, "score_outlier": F.col("distance") > cut, "cutoff": F.lit(cut)})
    return out.withColumn("outlier", F.col("error_outlier") | F.col("score_outlier"))


def split_conformal_anomaly(fit: Decomposition, calibration: DataFrame, targets: DataFrame, nonconformity: str = "reconstruction_rmse", training_scores: DataFrame | None = None, alpha: float = 0.05) -> DataFrame:
    """Conformal p-value and verdict of each target; the fit is of curves of neither set.

    The score is the reconstruction error, or (``mahalanobis``) the distance of the fitted scores in the training scores' covariance.
    """
    from .decomposition import reconstruction_error, scores
    from .inference import conformal_p_values

    if nonconformity == "reconstruction_rmse":
        score = lambda a: reconstruction_error(a, fit).withColumnRenamed("rmse", "score")
    else:
        centre, cov = score_covariance(training_scores, len(fit.components))
        score = lambda a: scores(a, fit).select("curve_id", F.sqrt(mahalanobis(centre, cov)).alias("score"))
    return conformal_p_values(score(calibration), score(targets)).withColumn("anomalous", F.col("p_value") <= alpha)
