"""Figures of results: tidy data from a result table, and a plain SVG of it.

``FIGURES`` has, by the figure's name, which columns are across, up, by group, and the ends of a band.  All rows are drawn
unless the caller bounds them; nothing is averaged or smoothed on the way.
"""

from __future__ import annotations

import html
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Figure:
    """Columns or expressions of a table; kind: line, point, bar or cell (a value at x and y)."""

    x: str
    y: str
    by: str | None = None
    low: str | None = None
    high: str | None = None
    kind: str = "line"
    value: str | None = None


def _ends(x: str, y: str, by: str | None = None, kind: str = "line") -> Figure:
    return Figure(x, y, by, "lower", "upper", kind)


_SURFACE = Figure("s", "t", "block", kind="cell", value="cov")

FIGURES: dict[str, Figure] = {
    "generalized_function_on_scalar_coefficients": _ends("t", "estimate", "coefficient"),
    "generalized_function_on_scalar_predictions": _ends("t", "mean", "profile_id"),
    "generalized_function_on_scalar_mean_difference": _ends("t", "contrast"),
    "functional_trial_random_effects": Figure("place", "value", "curve_id"),
    "functional_mixed_effects_residual_acf": Figure("lag", "autocorrelation", kind="bar"),
    "functional_mixed_effects_residual_variogram": Figure("lag", "semivariance", kind="point"),
    "covariance_sensitivity_coefficients": Figure("t", "difference", "model"),
    "covariance_sensitivity_band_widths": Figure("t", "error_ratio", "model"),
    "functional_variance_decomposition": Figure("t", "variance", "component"),
    "functional_mixed_effects_coefficient": _ends("t", "estimate", "coefficient"),
    "functional_random_effects": Figure("place", "value", "u"),
    "functional_mixed_effects_bootstrap_comparison": Figure("t", "ratio", "coefficient"),
    "function_on_scalar_coefficients": _ends("place", "estimate", "coefficient"),
    "transfer_entropy_circular_shift_test": Figure("observed", "p_value", kind="point"),
    "conditional_transfer_entropy_circular_shift_test": Figure("observed", "p_value", kind="point"),
    "transfer_entropy_sensitivity": Figure("lag", "transfer_entropy", "concat_ws('/', k, l)", kind="point"),
    "functional_recovery_summary": Figure("scenario", "value", "metric", kind="point"),
    "workflow_preflight": Figure("curve_id", "missing_fraction", kind="bar"),
    "workflow_sensitivity": Figure("parameters", "value", kind="point"),
    "functional_simulation_curve": Figure("t", "x", "curve_id"),
    "functional_simulation_phase_warps": Figure("t", "warped", "curve_id"),
    "functional_simulation_score_variances": Figure("component", "variance", kind="bar"),
    "trajectory_distance_rank_correlations": Figure("concat_ws(' - ', `left`, `right`)", "spearman", kind="bar"),
    "trajectory_overlay": Figure("t", "x", "curve_id"),
    "planar_trajectories": Figure("x", "y", "curve_id"),
    "dynamic_time_warping_alignment": Figure("i", "j", kind="line"),
    "fpca_variance": Figure("component", "ratio", kind="bar"),
    "fpca_wild_bootstrap_truncation_scan": _ends("h", "projection", "target"),
    "fpca_wild_bootstrap_projection": _ends("target", "projection", kind="point"),
    "fpca_wild_bootstrap_family_test": Figure("target", "adjusted_p", kind="point"),
    "fpca_wild_bootstrap_monte_carlo_diagnostics": _ends("target", "share", "measure", "point"),
    "fpca_wild_bootstrap_simultaneous_interval": Figure("target", "projection", None, "family_lower", "family_upper", "point"),
    "fpca_regression_future_prediction_interval": _ends("curve_id", "prediction", kind="point"),
    "fpca_regression_slope_band": _ends("place", "slope", "dimension"),
    "fpca_regression_slope_uncertainty": _ends("place", "slope"),
    "fpca_regression_mean_prediction_uncertainty": _ends("curve_id", "prediction", kind="point"),
    "fpca_score_uncertainty": _ends("curve_id", "score", "component", "point"),
    "fpca_spectrum_uncertainty": _ends("component", "estimate", "measure", "point"),
    "fpca_component": Figure("place", "value", "multiplier"),
    "registration": Figure("t", "x", "curve_id"),
    "warping_functions": Figure("t", "warped", "curve_id"),
    "fpca_stability": Figure("component", "median_similarity", None, "lower", "upper", "point"),
    "reconstruction_curve": Figure("n_components", "mean_rmse"),
    "conformal_fpca_anomaly": Figure("curve_id", "p_value", kind="point"),
    "fpca_outlier_diagnostics": Figure("error_z", "distance", "outlier", kind="point"),
    "fpca_influence": Figure("grp", "influence", kind="bar"),
    "fpca_cross_validation": Figure("n_components", "rmse", "fold", kind="point"),
    "fpca_component_envelope": _ends("place", "median", "component"),
    "fpca_component_band": _ends("place", "estimate", "component"),
    "fpca_subspace_stability": Figure("rep", "normalized_distance", kind="point"),
    "sparse_fpca_component": Figure("t", "value", "component"),
    "sparse_fpca_covariance": _SURFACE,
    "sparse_fpca_score_diagnostics": Figure("score", "score_sd", "component", kind="point"),
    "sparse_irregular_dimension": Figure("t", "x", "curve_id", kind="point"),
    "functional_mean_band": _ends("t_idx", "mean"),
    "fpca_regression_cv": Figure("n_components", "loss", "fold", kind="point"),
    "nested_fpca_regression_cv": Figure("fold", "loss", "n_components", kind="point"),
    "embedding_delay_diagnostics": Figure("lag", "acf", "curve_id"),
    "embedding_dimension_diagnostics": Figure("dimension", "false_share", "curve_id"),
    "joint_recurrence": Figure("i", "j", "curve_id", kind="point"),
    "recurrence_network_degree": Figure("t_idx", "degree", "curve_id", kind="bar"),
    "recurrence": Figure("i", "j", "curve_id", kind="point"),
    "recurrence_rate_curve": Figure("radius", "rate", "curve_id"),
    "rqa_metric_mean_bootstrap": Figure("rep", "mean", kind="point"),
    "windowed_rqa": Figure("centre", "recurrence_rate", "curve_id"),
    "windowed_rqa_trajectories": Figure("window_start", "determinism", "curve_id"),
    "windowed_rqa_sensitivity": Figure("window_start", "recurrence_rate", "parameters"),
    "rqa_sensitivity": Figure("parameters", "recurrence_rate", "curve_id", kind="point"),
    "kantz_sensitivity": Figure("parameters", "slope", "curve_id", kind="point"),
    "lyapunov_sensitivity": Figure("parameters", "slope", "curve_id", kind="point"),
    "local_divergence": Figure("k", "mean_log", "curve_id"),
    "multivariate_iaaft_diagnostics": Figure("surrogate", "spectrum_error", kind="point"),
    "multivariate_surrogate_nonlinearity": Figure("observed", "p_value", kind="point"),
    "surrogate_nonlinearity": Figure("observed", "p_value", kind="point"),
    "poincare_return_map": Figure("x", "next_x", "curve_id", kind="point"),
    "sparse_mfpca_component": Figure("t", "value", "concat_ws('/', component, channel)"),
    "sparse_mfpca_covariance_blocks": _SURFACE,
    "sparse_mfpca_score_diagnostics": Figure("score", "score_sd", "component", kind="point"),
    "sparse_mfpca_cross_covariance": _SURFACE,
}


def figure_data(name: str, table: DataFrame, where: str | None = None, max_groups: int | None = None) -> DataFrame:
    """Tidy data (group, x, y and, as the figure has them, lower, upper, value) of all rows, or of those the caller asks for."""
    f = FIGURES[name]
    t = table if where is None else table.where(where)
    group = (F.expr(f.by) if f.by else F.lit("all")).cast("string").alias("group")
    cols = {"x": f.x, "y": f.y, "lower": f.low, "upper": f.high, "value": f.value}
    out = t.select(group, *(F.expr(v).alias(k) for k, v in cols.items() if v))
    if max_groups is not None:
        first = out.select(F.col("group").alias("shown")).distinct().orderBy("shown").limit(max_groups)
        out = out.join(F.broadcast(first), F.col("group").eqNullSafe(F.col("shown"))).drop("shown")
    return out


def svg(name: str, data: DataFrame, title: str = "", max_points: int = 20_000, size: tuple[int, int] = (640, 400)) -> str:
    """A plain SVG of tidy data; more rows than ``max_points`` are an error, as the driver draws them."""
    f = FIGURES[name]
    if data.limit(max_points + 1).count() > max_points:
        raise ValueError(f"more than {max_points} points: bound the figure with where or max_groups")
    p = data.toPandas()
    w, h = size
    place = lambda c: pd.to_numeric(c, errors="coerce") if pd.to_numeric(c, errors="coerce").notna().all() else c.astype(str).rank(method="dense")
    if len(p):
        p["x"] = place(p["x"]).astype(float)
        for c in ("y", "lower", "upper"):
            if c in p:
                p[c] = place(p[c]).astype(float)
    ys = pd.concat([p[c] for c in ("y", "lower", "upper") if c in p]).dropna() if len(p) else pd.Series(dtype=float)
    span = lambda lo, hi: (hi - lo) or 1.0
    x0, x1, y0, y1 = (p["x"].min(), p["x"].max(), ys.min(), ys.max()) if len(ys) else (0.0, 1.0, 0.0, 1.0)
    px = lambda v: 40 + (v - x0) / span(x0, x1) * (w - 60)
    py = lambda v: h - 30 - (v - y0) / span(y0, y1) * (h - 60)
    shapes = []
    for k, (g, rows) in enumerate(p.dropna(subset=["x", "y"]).sort_values("x", kind="stable").groupby("group", sort=True, dropna=False)):
        color = f"hsl({k * 137 % 360},60%,40%)"
        if "lower" in rows and rows["lower"].notna().all():
            if f.kind == "line":
                ends = [*zip(rows["x"], rows["upper"], strict=True), *zip(rows["x"][::-1], rows["lower"][::-1], strict=True)]
                shapes.append(f'<polygon fill="{color}" opacity="0.2" points="{" ".join(f"{px(a):.1f},{py(b):.1f}" for a, b in ends)}"/>')
            else:
                shapes += [f'<line stroke="{color}" x1="{px(a):.1f}" x2="{px(a):.1f}" y1="{py(lo):.1f}" y2="{py(hi):.1f}"/>' for a, lo, hi in zip(rows["x"], rows["lower"], rows["upper"], strict=True)]
        if f.kind == "line":
            shapes.append(f'<polyline fill="none" stroke="{color}" points="{" ".join(f"{px(a):.1f},{py(b):.1f}" for a, b in zip(rows["x"], rows["y"], strict=True))}"><title>{html.escape(str(g))}</title></polyline>')
        elif f.kind == "bar":
            shapes += [f'<rect fill="{color}" x="{px(a) - 2:.1f}" width="4" y="{min(py(b), py(max(y0, 0))):.1f}" height="{abs(py(b) - py(max(y0, 0))):.1f}"/>' for a, b in zip(rows["x"], rows["y"], strict=True)]
        else:
            shapes += [f'<circle fill="{color}" r="2.5" cx="{px(a):.1f}" cy="{py(b):.1f}"/>' for a, b in zip(rows["x"], rows["y"], strict=True)]
    axes = f'<text x="40" y="16">{html.escape(title or name)}</text><text x="4" y="{h - 30}">{y0:.3g}</text><text x="4" y="36">{y1:.3g}</text><text x="40" y="{h - 8}">{x0:.3g}</text><text x="{w - 50}" y="{h - 8}">{x1:.3g}</text>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" font-size="11">{axes}{"".join(shapes)}</svg>'


def save_figure(name: str, data: DataFrame, path: str, **how) -> str:
    """Writes the SVG to a file of the driver's machine, for the caller."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(svg(name, data, **how))
    return path
