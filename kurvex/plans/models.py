"""Workflows of the model families: declared parameters in, stored tables, steps and decisions out."""

from __future__ import annotations

import json
import platform

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import function_on_scalar as fos
from ..operators import functional_mixed as fm
from ..operators import generalized as gen
from ..operators import sparse_fit as sf
from .workflows import WorkflowResult


def positive_integer(value, name: str) -> int:
    """The value, if it is a whole number above zero and no boolean."""
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} is a positive integer")
    return value


def checked_grid(values, name: str = "grid") -> np.ndarray:
    """A finite, strictly increasing grid that can't be written to."""
    g = np.array(values, float)
    if g.ndim != 1 or len(g) < 2 or not np.isfinite(g).all() or not (np.diff(g) > 0).all():
        raise ValueError(f"{name} has two or more finite, strictly increasing times")
    g.setflags(write=False)
    return g


def candidates(values, name: str) -> tuple[float, ...]:
    """Distinct positive candidate values, in order."""
    out = tuple(sorted({float(v) for v in values}))
    if not out or not np.isfinite(out).all() or out[0] <= 0:
        raise ValueError(f"{name} are finite and positive")
    return out


def no_preprocessing(plan: list) -> None:
    """Irregular routes take curves as they are: a plan is an error."""
    if plan:
        raise ValueError("irregular curves aren't preprocessed: no such step is qualified")


def config_json(config: dict) -> str:
    """Strict JSON of a configuration; numbers that aren't finite are an error."""
    return json.dumps(config, sort_keys=True, allow_nan=False, default=lambda x: x.tolist() if isinstance(x, np.ndarray) else list(x))


def summary_frame(spark: SparkSession, result: WorkflowResult) -> DataFrame:
    """One row about a workflow: name, configuration, steps, seconds, decisions, tables."""
    return spark.createDataFrame([(result.name, config_json(result.config), len(result.steps), float(sum(s["seconds"] for s in result.steps)), len(result.decisions), sorted(result.tables))], "name string, config string, steps int, seconds double, decisions int, tables array<string>")


def environment(spark: SparkSession) -> dict:
    """Versions that a result depends on."""
    import pandas
    import pyarrow

    return {"python": platform.python_version(), "spark": spark.version, "numpy": np.__version__, "pandas": pandas.__version__, "pyarrow": pyarrow.__version__, "timezone": spark.conf.get("spark.sql.session.timeZone")}


def export_bundle(result: WorkflowResult, spark: SparkSession, folder: str) -> None:
    """All tables of a workflow with digests, its configuration, steps, decisions, environment and report in one manifest; a folder that exists is an error."""
    from ..sources.portable import export_result
    from .workflows import render_report

    provenance = {"config": json.loads(config_json(result.config)), "steps": result.steps, "decisions": result.decisions, "environment": environment(spark), "report": render_report(result), **result.provenance}
    export_result(result.tables, folder, provenance)


def response_workflow(arrays: DataFrame, predictors: list[str], *, unit: str | None = None, replicates: int = 200, level: float = 0.95, scope: str = "each", seed: int = 0) -> WorkflowResult:
    """Function-on-scalar regression with simultaneous bands."""
    spark = arrays.sparkSession
    w = WorkflowResult("function_on_scalar", {"predictors": predictors, "unit": unit, "replicates": positive_integer(replicates, "replicates"), "level": level, "scope": scope, "seed": seed})
    rows = fos.design(arrays, predictors, unit)
    m = fos.fit(rows, predictors)
    w.step("coefficients", lambda: fos.coefficient_frame(spark, m, fos.bootstrap(rows, m, replicates, seed=seed), level, scope))
    w.step("residuals", lambda: fos.fitted(rows, m))
    return w


def generalized_workflow(arrays: DataFrame, time, predictors: list[str], *, participant: str, family: str, basis_size: int = 5, exposure: str | None = None, denominator: str | None = None, replicates: int = 100, profiles=None, seed: int = 0) -> WorkflowResult:
    """Generalised function-on-scalar model, its bands and the means of declared profiles."""
    spark, grid = arrays.sparkSession, checked_grid(time)
    w = WorkflowResult("generalized_function_on_scalar", {"predictors": predictors, "participant": participant, "family": family, "basis_size": basis_size, "replicates": replicates, "seed": seed})
    rows = gen.model_rows(arrays, predictors, participant, exposure, denominator)
    m = gen.fit(rows, grid, predictors, family, positive_integer(basis_size, "basis_size"))
    draws = gen.bootstrap(rows, m, replicates, seed) if replicates else None
    w.step("coefficients", lambda: gen.coefficient_frame(spark, m, draws))
    if exposure:
        w.step("exposure", lambda: gen.exposure_frame(arrays, exposure))
    if profiles is not None:
        w.step("predictions", lambda: spark.createDataFrame(gen.predict(m, profiles, draws)))
    w.decide("participants", m.participants, "as the data have them")
    return w


def mixed_workflow(arrays: DataFrame, time, predictors: list[str], *, participant: str, replicates: int = 200, max_lag: int = 3, iterations: int = 40, seed: int = 0, **layout) -> WorkflowResult:
    """Functional mixed effects: coefficients with bands, random functions, variances, residual dependence."""
    spark, grid = arrays.sparkSession, checked_grid(time)
    w = WorkflowResult("functional_mixed_effects", {"predictors": predictors, "participant": participant, "replicates": replicates, "max_lag": max_lag, "seed": seed, **layout})
    m = fm.fit(arrays, fm.layout(grid, predictors, **layout), participant, iterations=iterations)
    w.step("coefficients", lambda: fm.coefficient_frame(spark, m, fm.bootstrap(m, replicates, seed)))
    w.step("random_effects", lambda: fm.random_effects(m))
    w.step("variances", lambda: fm.variance_decomposition(spark, m))
    res = w.step("residuals", lambda: fm.residuals(arrays, m, participant))
    w.step("residual_dependence", lambda: fm.residual_diagnostics(res, max_lag))
    w.decide("boundary", m.boundary, "a random function's variance is at zero" if m.boundary else "inside the parameter space")
    return w


def sparse_workflow(samples: DataFrame, grid, n_components: int, *, dims: tuple[str, ...] = ("x",), mean_bandwidths, covariance_bandwidths, noise=None, folds: int = 3, unit: str = "curve_id", plan: list | None = None, support: str = "error") -> WorkflowResult:
    """Sparse components of one channel, of paired or of asynchronous channels; several candidate bandwidths are chosen between by held-out likelihood."""
    no_preprocessing(plan or [])
    spark, g = samples.sparkSession, checked_grid(grid)
    hm, hc = candidates(mean_bandwidths, "mean bandwidths"), candidates(covariance_bandwidths, "covariance bandwidths")
    w = WorkflowResult("sparse_components", {"grid": g, "n_components": positive_integer(n_components, "n_components"), "dims": dims, "mean_bandwidths": hm, "covariance_bandwidths": hc, "support": support})
    if len(hm) * len(hc) > 1:
        table = sf.select_bandwidths(samples, g, n_components, list(hm), list(hc), folds, unit, dims=dims, noise=noise, support=support)
        w.step("bandwidths", lambda: spark.createDataFrame(table, "fold int, mean_bandwidth double, covariance_bandwidth double, loss double, failure string"))
        chosen = sf.best_bandwidths(table)
        w.decide("bandwidths", chosen, "least held-out loss")
    else:
        chosen = (hm[0], hc[0])
        w.decide("bandwidths", chosen, "declared by the caller")
    m = sf.fit(samples, g, n_components, *chosen, dims=dims, noise=noise, support=support)
    w.decide("covariance", {k: m.audit[k] for k in ("projected", "change", "negative")}, "audit of the smoothed surface")
    w.step("mean", lambda: spark.createDataFrame([(d, float(t), float(v)) for d, row in zip(dims, m.mean, strict=True) for t, v in zip(g, row, strict=True)], "channel string, t double, mean double"))
    w.step("components", lambda: spark.createDataFrame([(k + 1, d, float(t), float(m.phi[k, c, i])) for k in range(n_components) for c, d in enumerate(dims) for i, t in enumerate(g)], "component int, channel string, t double, value double"))
    n = len(g)
    w.step("covariance", lambda: spark.createDataFrame([(f"{dims[p]}{dims[q]}", float(g[i]), float(g[j]), float(m.cov[p * n + i, q * n + j])) for p in range(len(dims)) for q in range(len(dims)) for i in range(n) for j in range(n)], "block string, s double, t double, cov double"))
    total = float(np.trace(m.cov * np.diag(m.weights)))
    ev = m.eigenvalues
    w.step("spectrum", lambda: spark.createDataFrame([(k + 1, float(ev[k]), float(ev[k] / total), float(ev[: k + 1].sum() / total)) for k in range(n_components)], "component int, eigenvalue double, ratio double, cumulative double"))
    w.step("scores", lambda: sf.score_frame(sf.pace_scores(samples, m)))
    return w


def sparse_multilevel_workflow(samples: DataFrame, grid, *, participant: str, between: int, within: int, mean_bandwidth: float, covariance_bandwidth: float, noise: float | None = None, plan: list | None = None, support: str = "error") -> WorkflowResult:
    """Sparse components of participants and trials with their joint scores."""
    no_preprocessing(plan or [])
    spark, g = samples.sparkSession, checked_grid(grid)
    w = WorkflowResult("sparse_multilevel", {"grid": g, "participant": participant, "between": between, "within": within, "mean_bandwidth": mean_bandwidth, "covariance_bandwidth": covariance_bandwidth})
    m = sf.fit_multilevel(samples, g, participant, between, within, mean_bandwidth, covariance_bandwidth, noise=noise, support=support)
    w.step("spectrum", lambda: spark.createDataFrame([(level, k + 1, float(v)) for level, f in (("participant", m.between), ("trial", m.within)) for k, v in enumerate(f.eigenvalues)], "level string, component int, eigenvalue double"))
    people, trials = sf.multilevel_scores(samples, m, participant)
    w.step("participant_scores", lambda: people)
    w.step("trial_scores", lambda: trials)
    return w


def sparse_prediction_workflow(training: DataFrame, calibration: DataFrame, targets: DataFrame, grid, n_components: int, *, mean_bandwidth: float, covariance_bandwidth: float, cutoff: float, alpha: float = 0.1, noise: float | None = None, support: str = "error") -> WorkflowResult:
    """Prediction of targets' futures with a conformal band; training, calibration and targets are disjoint."""
    ids = [d.select("curve_id").distinct() for d in (training, calibration, targets)]
    for i in range(3):
        for j in range(i):
            if not ids[i].join(ids[j], "curve_id", "left_semi").isEmpty():
                raise ValueError("training, calibration and targets share curves")
    g = checked_grid(grid)
    w = WorkflowResult("sparse_prediction", {"grid": g, "n_components": n_components, "cutoff": cutoff, "alpha": alpha})
    m = sf.fit(training, g, n_components, mean_bandwidth, covariance_bandwidth, noise=noise, support=support)
    critical = sf.calibrate_conformal(calibration, m, cutoff, alpha)
    w.decide("critical", critical, "order statistic of the calibration curves")
    w.step("predictions", lambda: sf.partial_prediction(targets, m, cutoff))
    w.step("bands", lambda: sf.conformal_band(targets, m, cutoff, critical))
    return w


#: What operators compute, in formulas: key, function, formula.
CONTRACTS = (
    ("components", "decomposition.fit_fpca", "C phi_k = lambda_k phi_k in the quadrature-weighted inner product, C the sample covariance with n - 1"),
    ("scores", "decomposition.scores", "s_ik = sum_t w_t (x_i(t) - m(t)) phi_k(t) / scale^2"),
    ("reconstruction", "decomposition.reconstruction_error", "sqrt(sum_t w_t (x - xhat)^2 / sum_t w_t)"),
    ("subspaces", "decomposition.compare_subspaces", "cos(theta) = singular values of Phi_a' W Phi_b; distance sqrt(2 sum sin^2 theta)"),
    ("mean_band", "inference.multiplier_mean_band", "m(t) +- c se(t), c the quantile of max_t |sum_i g_i (x_i(t) - m(t))| / (n se(t))"),
    ("conformal", "inference.conformal_p_values", "p = (1 + #{calibration >= target}) / (n + 1)"),
    ("hc1", "function_on_scalar.fit", "se^2 = n / (n - p) sum_i (h_i e_i(t))^2, h = X (X'X)^-1"),
    ("gee", "generalized.fit", "sum_i X_i' (y_i - mu_i) = 0; covariance A^-1 (sum_p u_p u_p') A^-1 over participants"),
    ("mixed", "functional_mixed.fit", "y_i = X_i beta + Z_i b_i + W t_ij + e, b ~ N(0, G), t ~ N(0, T), e ~ N(0, s^2 R); REML"),
    ("wild", "wild.wild_projection", "root = (z' b*_h - z' b_g) / se*, y* = fit_g + e_g V"),
    ("smoothing", "sparse_fit.fit", "local-linear mean and covariance, pairs of different samples, Epanechnikov kernel"),
    ("pace", "sparse_fit.pace_scores", "E[xi_k | y] = lambda_k phi_k' (C + R)^-1 (y - m)"),
    ("prediction", "sparse_fit.partial_prediction", "m_f + C_fo (C_oo + R)^-1 (y_o - m_o)"),
    ("levels", "sparse_fit.fit_multilevel", "within = total - between; between from products of a participant's different curves"),
    ("recurrence", "recurrence.recurrence_pairs", "|s_i - s_j| <= r, |i - j| > theiler"),
    ("rqa", "recurrence.rqa_metrics", "rate = pairs / n^2; determinism = sum_{l >= lmin} l P(l) / sum l P(l)"),
    ("divergence", "neighbours.divergence_curve", "mean_i log |s_{i+k} - s_{nn(i)+k}|"),
    ("transfer_entropy", "information.transfer_entropy", "sum p(x, y, z) log2 p(x | y, z) / p(x | y)"),
    ("warping", "distances.dtw", "least sum of d(i, j) over monotone paths, steps as declared"),
    ("frechet", "distances.discrete_frechet", "min over couplings of max d(i, j)"),
    ("log_ratio", "geometry.alr", "log(p_k / p_reference) of floored, closed shares"),
    ("curvature", "geometry.kinematics", "(x' y'' - y' x'') / (x'^2 + y'^2)^(3/2)"),
    ("nested_regression", "score_regression.nested_cross_validate", "inner folds choose k, outer folds assess it"),
)


def contract(name: str) -> tuple[str, str, str]:
    """A contract by its key or its function."""
    for c in CONTRACTS:
        if name in c[:2] or c[1].endswith(f".{name}"):
            return c
    raise KeyError(name)


def contract_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONTRACTS), "contract string, function string, formula string")


def curve_summary(samples: DataFrame, dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """One row about a set of curves: curves, samples, span, missing share."""
    missing = sum((F.col(d).isNull().cast("double") for d in dims), F.lit(0.0)) / len(dims)
    return samples.agg(F.countDistinct("curve_id").alias("n_curves"), F.count(F.lit(1)).alias("n_samples"), F.min("t").alias("start"), F.max("t").alias("end"), F.avg(missing).alias("missing_fraction"))
