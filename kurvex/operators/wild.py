"""Wild bootstrap of projections in functional component regression: intervals, truncation scans, families of tests.

The scores are fixed; every replicate multiplies the residuals of a pilot fit (g components) by draws that are a function of
curve and replicate, refits h components, and studentises with its own residuals.  Both passes add up matrices of
replicates and components in the tasks; nothing of the data's or of the targets' size is sent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import clopper_pearson, draws, higher_quantile
from ..functions.sums import add_up, gram, matrix, vector


@dataclass(frozen=True)
class WildProjection:
    """Per target: estimate, pilot's projection and standard error; per replicate and target the studentised root."""

    targets: list
    estimate: np.ndarray
    pilot: np.ndarray
    se: np.ndarray
    roots: np.ndarray
    level: float
    components: int

    def critical(self) -> np.ndarray:
        return higher_quantile(np.abs(self.roots), self.level, 0)


def _solve(g: np.ndarray, h: int) -> np.ndarray:
    """Coefficients of the outcome on an intercept and the first h scores, from the Gram matrix of (1, scores, outcome)."""
    return np.linalg.solve(g[: h + 1, : h + 1], g[: h + 1, -1])


def _forms(z: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Per column of residuals the sums over curves of residual x scores, and of residual squared x scores x scores."""
    pairs = (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)
    return np.concatenate((residual.T @ z, (residual * residual).T @ pairs), 1)


def _of_targets(forms: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of residual x projection and of its square, for every row of ``_forms`` and every target."""
    h = directions.shape[1]
    squares = (directions[:, :, None] * directions[:, None, :]).reshape(len(directions), -1)
    return forms[:, :h] @ directions.T, forms[:, h:] @ squares.T


def wild_projection(scored: DataFrame, outcome: str, targets: pd.DataFrame, pilot: int, components: int, replicates: int = 500, multiplier: str = "normal", level: float = 0.95, seed: int = 0) -> WildProjection:
    """Studentised wild bootstrap of centred projections.

    ``scored`` has curve_id, scores and the outcome; ``targets`` curve_id and scores of the fixed targets, a declared set.
    """
    if not 1 <= pilot <= components:
        raise ValueError("the pilot has one to as many components as the inference")
    rows = scored.select(F.xxhash64("curve_id").alias("u"), F.slice("scores", 1, components).alias("z"), F.col(outcome).cast("double").alias("y")).where("y is not null")
    g = gram(rows, vector("z", F.array("y")))
    n, h = g[0, 0], components
    z0 = np.stack(targets["scores"])[:, :h]
    b_pilot, b_full = _solve(g, pilot), _solve(g, h)
    directions = z0 @ np.linalg.inv(g[1 : h + 1, 1 : h + 1] / n)
    wide, full = np.linalg.inv(g[: h + 1, : h + 1]), np.linalg.inv(g[: pilot + 1, : pilot + 1])

    def first(batches):
        """Sums over curves of design x multiplied residual, and of score x residual and scores x scores x its square.

        A target's sums are a linear and a quadratic form of these, so their size doesn't follow the number of targets.
        """
        total, own = 0.0, 0.0
        for b in batches:
            w, z, y = draws(np.asarray(b.column(0)), replicates, seed, multiplier), matrix(b.column(1)), np.asarray(b.column(2), float)
            x = np.column_stack((np.ones(len(z)), z))
            e = y - x[:, : pilot + 1] @ b_pilot
            total = total + (x * e[:, None]).T @ w
            own = own + _forms(z, e[:, None])
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64())), pa.array([own.ravel().tolist()], pa.list_(pa.float64()))], ["total", "own"])

    r = add_up(rows.mapInArrow(first, "total array<double>, own array<double>")).first()
    shift = np.asarray(r.total).reshape(h + 1, replicates)  # X' (multiplied residuals)
    spread = lambda s, q: np.sqrt(np.maximum(q - s * s / n, 0) / (n - 1) / n)
    se = spread(*_of_targets(np.asarray(r.own).reshape(1, -1), directions))[0]
    fitted = np.zeros(h + 1)
    fitted[: pilot + 1] = b_pilot
    star = fitted[:, None] + wide @ shift  # coefficients of every replicate's refit
    refit_pilot = b_pilot[:, None] + full @ shift[: pilot + 1]

    def second(batches):
        """The same sums with every replicate's residual."""
        total = 0.0
        for b in batches:
            w, z, y = draws(np.asarray(b.column(0)), replicates, seed, multiplier), matrix(b.column(1)), np.asarray(b.column(2), float)
            x = np.column_stack((np.ones(len(z)), z))[:, : pilot + 1]
            e = y - x @ b_pilot
            total = total + _forms(z, (x @ b_pilot + (e[:, None] * w).T).T - x @ refit_pilot)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["total"])

    t = np.asarray(add_up(rows.mapInArrow(second, "total array<double>")).first().total).reshape(replicates, -1)
    se_star = spread(*_of_targets(t, directions))
    root = z0 @ star[1:] - (z0[:, :pilot] @ b_pilot[1:])[:, None]
    roots = np.divide(root.T, se_star, out=np.zeros_like(se_star), where=se_star > 1e-12)
    return WildProjection(list(targets["curve_id"]), z0 @ b_full[1:], z0[:, :pilot] @ b_pilot[1:], se, roots, level, h)


def projection_frame(spark: SparkSession, w: WildProjection) -> DataFrame:
    """Per target: projection, standard error, critical value and interval."""
    c = w.critical()
    rows = [(str(i), float(e), float(p), float(s), float(k), float(e - k * s), float(e + k * s)) for i, e, p, s, k in zip(w.targets, w.estimate, w.pilot, w.se, c, strict=True)]
    return spark.createDataFrame(rows, "target string, projection double, pilot double, se double, critical double, lower double, upper double")


def simultaneous_interval(spark: SparkSession, w: WildProjection, level: float | None = None) -> DataFrame:
    """Intervals of all targets with one critical value: the quantile of each replicate's largest root."""
    c = float(higher_quantile(np.abs(w.roots).max(1), level or w.level))
    own = w.critical()
    rows = [(str(i), float(e), float(s), float(k), float(e - k * s), float(e + k * s), c, float(e - c * s), float(e + c * s)) for i, e, s, k in zip(w.targets, w.estimate, w.se, own, strict=True)]
    return spark.createDataFrame(rows, "target string, projection double, se double, critical double, lower double, upper double, family_critical double, family_lower double, family_upper double")


def family_test(spark: SparkSession, w: WildProjection, null: float | list[float] = 0.0, level: float = 0.05, correction: str = "plus_one") -> DataFrame:
    """Tests of each target's projection against a null value: own p-value, the one adjusted by the largest root, the global one."""
    t = np.abs(np.divide(w.estimate - np.asarray(null, float), w.se, out=np.zeros_like(w.se), where=w.se > 0))
    roots = np.abs(w.roots)
    top, b = roots.max(1), len(roots)
    p = (lambda c: (c + 1) / (b + 1)) if correction == "plus_one" else (lambda c: c / b)
    own, adjusted, whole = (roots >= t).sum(0), (top[:, None] >= t).sum(0), int((top >= t.max()).sum())
    rows = [(str(i), float(w.estimate[k]), float(t[k]), int(own[k]), float(p(own[k])), int(adjusted[k]), float(p(adjusted[k])), bool(p(adjusted[k]) <= level), float(p(whole))) for k, i in enumerate(w.targets)]
    return spark.createDataFrame(rows, "target string, projection double, statistic double, exceedances long, p_value double, family_exceedances long, adjusted_p double, rejected boolean, global_p double")


def monte_carlo_diagnostics(tests: DataFrame, replicates: int, level: float = 0.95) -> DataFrame:
    """Precision of the tail counts of ``family_test``: Monte Carlo standard error and exact binomial interval per target and measure."""
    share = F.col("hits") / F.lit(float(replicates))
    long = tests.select("target", F.explode(F.create_map(F.lit("own"), F.col("exceedances"), F.lit("family"), F.col("family_exceedances"))).alias("measure", "hits"))
    ends = {h.hits: clopper_pearson(h.hits, replicates, level) for h in long.select("hits").distinct().collect()}  # targets are a declared set
    interval = tests.sparkSession.createDataFrame([(int(k), float(lo), float(hi)) for k, (lo, hi) in ends.items()], "hits long, lower double, upper double")
    return long.join(F.broadcast(interval), "hits").select("target", "measure", "hits", share.alias("share"), F.sqrt(share * (1 - share) / replicates).alias("mc_se"), "lower", "upper")


def scan_truncations(scored: DataFrame, outcome: str, targets: pd.DataFrame, pilot: int, candidates: list[int], **how) -> DataFrame:
    """Intervals of each target for consecutive numbers of components, all with the same multipliers: (target, h, projection, se, lower, upper, width, centre)."""
    if list(candidates) != list(range(candidates[0], candidates[-1] + 1)):
        raise ValueError("the candidates are consecutive")
    out = None
    for h in candidates:
        one = projection_frame(scored.sparkSession, wild_projection(scored, outcome, targets, pilot, h, **how)).withColumn("h", F.lit(h))
        out = one if out is None else out.union(one)
    return out.withColumns({"width": F.col("upper") - F.col("lower"), "centre": (F.col("upper") + F.col("lower")) / 2})


def select_truncation(scan: DataFrame, width_threshold: float, centre_threshold: float, run: int) -> DataFrame:
    """Stabilised volatility: per target the least h from which ``run`` + 1 transitions in a row change width and centre by little.

    A transition is stable if the relative change of the width and the change of the centre over the width are within their
    thresholds.  Targets without such a run have no h (NULL).
    """
    w = Window.partitionBy("target").orderBy("h")
    ahead = w.rowsBetween(0, run)
    step = scan.withColumns({"next_width": F.lead("width").over(w), "next_centre": F.lead("centre").over(w)}).where("next_width is not null")
    stable = (F.abs(F.col("next_width") - F.col("width")) <= width_threshold * F.col("width")) & (F.abs(F.col("next_centre") - F.col("centre")) <= centre_threshold * F.col("width"))
    step = step.withColumn("stable", stable.cast("int"))
    start = step.withColumns({"all": F.min("stable").over(ahead), "full": F.count(F.lit(1)).over(ahead)}).where((F.col("full") == run + 1) & (F.col("all") == 1))
    return scan.select("target").distinct().join(start.groupBy("target").agg(F.min("h").alias("h")), "target", "left")
