"""Reporting texts: each is one aggregate over a result table and a sentence that says what was done, and what wasn't.

A text computes nothing that the table doesn't hold.  ``TEXTS`` has, by the result's name, the sentence, its aggregates in SQL,
and the limits that a reader has to know; values that a table can't tell (a level, a unit) are given by the caller.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Text:
    sentence: str
    values: dict[str, str]
    limits: str = ""


_RANGE = {"least": "min({0})", "median": "percentile({0}, 0.5)", "largest": "max({0})"}


def _range(column: str) -> dict[str, str]:
    return {k: v.format(column) for k, v in _RANGE.items()}


_N = {"n": "count(*)"}
_NO_CAUSE = "Associations are descriptive; no cause is claimed."
_NO_SELECTION = "No parameter was selected by these values."
_BASIS = "The basis is refitted in every replicate; replicates are counts of whole units."
_GRID = "Simultaneous over the observed grid alone, not between its points."


def _intervals(subject: str, estimate: str) -> Text:
    return Text(f"{subject}: {{n}} targets, intervals {{least:.4g}} to {{largest:.4g}} wide (median {{median:.4g}}); estimates from {{low:.4g}} to {{high:.4g}}.", _N | _range("upper - lower") | {"low": f"min({estimate})", "high": f"max({estimate})"}, "Target curves are fixed; intervals hold for each target alone unless they say otherwise.")


def _band(subject: str, estimate: str, points: str) -> Text:
    return Text(f"{subject}: {{n}} points ({points}), half widths from {{least:.4g}} to {{largest:.4g}}; zero lies outside the band at {{outside}} of them.", _N | _range("(upper - lower) / 2") | {"outside": "count_if(lower > 0 or upper < 0)", "e": f"avg({estimate})"}, _GRID)


def _sensitivity(subject: str, value: str) -> Text:
    return Text(f"{subject}: {{n}} results of {{settings}} declared settings; {value} from {{least:.4g}} to {{largest:.4g}} (median {{median:.4g}}).", _N | {"settings": "count(distinct parameters)"} | _range(value), _NO_SELECTION)


def _cv(subject: str) -> Text:
    return Text(f"{subject}: {{folds}} folds, {{k}} candidate numbers of components; mean loss from {{least:.4g}} to {{largest:.4g}}.", {"folds": "count(distinct fold)", "k": "count(distinct n_components)"} | _range("loss"), "Components are refitted in every fold; folds keep whole units together.")


def _surrogate(subject: str) -> Text:
    return Text(f"{subject}: {{n}} curves, {{rejected}} with a p-value of at most 0.05; p-values from {{least:.4g}} to {{largest:.4g}}.", _N | {"rejected": "count_if(p_value <= 0.05)"} | _range("p_value"), "A small p-value speaks against the surrogates' null, not for any particular dynamics.")


def _scores(subject: str) -> Text:
    return Text(f"{subject}: scores of {{curves}} curves and {{k}} components, conditional deviations from {{least:.4g}} to {{largest:.4g}}; {{failed}} curves have none.", {"curves": "count(distinct curve_id)", "k": "count(distinct component)", "failed": "count(distinct case when status <> 'ok' then curve_id end)"} | _range("score_sd"), "Conditional on the fitted mean, covariance and noise, whose uncertainty isn't included.")


def _bandwidths(subject: str) -> Text:
    return Text(f"{subject}: {{pairs}} pairs of bandwidths in {{folds}} folds; held-out loss from {{least:.4g}} to {{largest:.4g}}; {{failed}} fits failed and are kept as such.", {"pairs": "count(distinct struct(mean_bandwidth, covariance_bandwidth))", "folds": "count(distinct fold)", "failed": "count_if(loss is null)"} | _range("loss"), "Held-out likelihood; no fit was dropped.")


def _flow(subject: str) -> Text:
    return Text(f"{subject}: {{n}} curves, from {{least:.4g}} to {{largest:.4g}} bits (median {{median:.4g}}), {{terms}} terms.", _N | _range("transfer_entropy") | {"terms": "sum(n_terms)"}, "Plug-in estimates of declared histories; no bias correction. " + _NO_CAUSE)


def _shift(subject: str) -> Text:
    return Text(f"{subject}: {{n}} curves against {{shifts}} circular shifts each; {{rejected}} p-values of at most 0.05, least {{least:.4g}}.", _N | {"shifts": "max(n_shifts)", "rejected": "count_if(p_value <= 0.05)"} | _range("p_value"), "Plus-one p-values; shifts keep each sequence's own dynamics. " + _NO_CAUSE)


def _fit(subject: str) -> Text:
    return Text(f"{subject}: {{k}} components explain {{share:.1%}} of the variance; eigenvalues from {{largest:.4g}} down to {{least:.4g}}.", {"k": "count(*)", "share": "max(cumulative)"} | _range("eigenvalue"), "Components are defined up to sign.")


def _coefficients(subject: str) -> Text:
    return Text(f"{subject}: {{k}} coefficient functions on {{points}} points; standard errors from {{least:.4g}} to {{largest:.4g}}.", {"k": "count(distinct coefficient)", "points": "cast(count(*) / count(distinct coefficient) as bigint)"} | _range("se"), _NO_CAUSE)


TEXTS: dict[str, Text] = {
    "generalized_function_on_scalar": _coefficients("Marginal generalised function-on-scalar model, link scale, robust errors by participant"),
    "generalized_function_on_scalar_prediction": Text("Marginal means of {profiles} declared profiles: from {least:.4g} to {largest:.4g}; {outside} points are outside the fitted range of a predictor.", {"profiles": "count(distinct profile_id)", "outside": "count_if(extrapolated)"} | _range("mean"), _GRID),
    "generalized_function_on_scalar_mean_difference": _band("Declared contrast of two profiles", "contrast", "times"),
    "functional_mixed_effects": _coefficients("Functional mixed-effects model with random functions of participants"),
    "functional_mixed_effects_residual": Text("Residual dependence up to lag {lags}: autocorrelation at lag 1 {first:.4g}, semivariance from {least:.4g} to {largest:.4g}.", {"lags": "max(lag)", "first": "max(case when lag = 1 then autocorrelation end)"} | _range("semivariance"), "Descriptive; no test is made and no covariance is chosen."),
    "functional_mixed_effects_covariance_sensitivity": Text("{models} declared covariance structures: coefficient differences up to {largest:.4g}, error ratios up to {ratio:.4g}; {failed} fits failed.", {"models": "count(distinct model)", "ratio": "max(error_ratio)", "failed": "count(failure)"} | _range("abs(difference)"), "No structure is selected."),
    "function_on_scalar": _coefficients("Pointwise least squares of curves on scalars, robust errors"),
    "sparse_fpca": _fit("Sparse components by local-linear smoothing"),
    "sparse_fpca_bandwidth_selection": _bandwidths("Bandwidth selection"),
    "sparse_fpca_score_uncertainty": _scores("Conditional scores"),
    "sparse_fpca_partial_prediction": _intervals("Prediction from partial histories", "prediction"),
    "sparse_fpca_conformal_band": Text("Conformal prediction bands of {curves} curves on {points} future points, {least:.4g} to {largest:.4g} wide.", {"curves": "count(distinct curve_id)", "points": "count(distinct t)"} | _range("upper - lower"), "Marginal coverage at the calibrated grid points, for exchangeable units."),
    "sparse_mfpca": _fit("Sparse components of paired channels"),
    "sparse_mfpca_bandwidth_selection": _bandwidths("Bandwidth selection of paired channels"),
    "sparse_mfpca_score_uncertainty": _scores("Conditional joint scores"),
    "sparse_mfpca_async": _fit("Sparse components of asynchronous channels"),
    "sparse_multilevel_fpca": Text("Participants' and trials' components: {k} components, eigenvalues from {least:.4g} to {largest:.4g}.", {"k": "count(*)"} | _range("eigenvalue"), "The within covariance is the difference of total and between; levels aren't tested."),
    "transfer_entropy": _flow("Transfer entropy"),
    "transfer_entropy_circular_shift": _shift("Transfer entropy"),
    "conditional_transfer_entropy": _flow("Conditional transfer entropy"),
    "conditional_transfer_entropy_circular_shift": _shift("Conditional transfer entropy"),
    "transfer_entropy_parameter_sensitivity": Text("Transfer entropy over {settings} settings of histories and lag: from {least:.4g} to {largest:.4g} bits.", {"settings": "count(distinct struct(k, l, lag))"} | _range("transfer_entropy"), _NO_SELECTION),
    "observation_process": Text("{n} time bins: observed shares from {least:.1%} to {largest:.1%}; least support {curves} curves.", _N | _range("n_observed / n_candidates") | {"curves": "min(n_curves)"}, "Missingness is described, not modelled; nothing is imputed."),
    "functional_recovery": Text("{n} recovery values of {metrics} metrics, from {least:.4g} to {largest:.4g}.", _N | {"metrics": "count(distinct metric)"} | _range("value"), "No threshold is applied."),
    "functional_simulation": Text("{curves} simulated curves with {n} samples, times from {first:.4g} to {last:.4g}.", {"curves": "count(distinct curve_id)", "n": "count(*)", "first": "min(t)", "last": "max(t)"}, "All draws are functions of seed and curve."),
    "trajectory_distance_sensitivity": Text("{n} pairs of distance specifications: rank correlations from {least:.4g} to {largest:.4g}, mean neighbour overlap {overlap:.4g}.", _N | _range("spearman") | {"overlap": "avg(mean_jaccard)"}, _NO_SELECTION),
    "dynamic_time_warping": Text("{n} warping distances, from {least:.4g} to {largest:.4g} (median {median:.4g}).", _N | _range("distance"), "The step pattern and the window are declared; distances aren't a metric."),
    "fpca": _fit("Functional components"),
    "fpca_score_uncertainty": Text("Scores of {curves} fixed curves: bootstrap errors from {least:.4g} to {largest:.4g}.", {"curves": "count(distinct curve_id)"} | _range("se"), _BASIS),
    "fpca_spectrum_uncertainty": Text("{n} spectrum measures: relative errors up to {largest:.4g}.", _N | _range("se / estimate"), _BASIS),
    "multilevel_fpca": Text("Between variance share {share:.1%} over {n} samples.", _N | {"share": "sum(`between` * `between`) / sum(`between` * `between` + within * within)"}, "The grand mean weights curves."),
    "fpca_stability": Text("{n} components: median similarities from {least:.4g} to {largest:.4g}; least stable share {stable:.1%}.", _N | _range("median_similarity") | {"stable": "min(stable_share)"}, _BASIS),
    "registration_sensitivity": Text("{n} matched components before and after registration: similarities from {least:.4g} to {largest:.4g}.", _N | _range("similarity"), "Landmarks are declared."),
    "fpca_outlier": Text("{n} curves screened: {errors} by reconstruction, {scores} by scores, {both} in all.", _N | {"errors": "count_if(error_outlier)", "scores": "count_if(score_outlier)", "both": "count_if(outlier)"}, "Screens mark curves for inspection; none is removed."),
    "fpca_influence": Text("{n} groups left out in turn: influence from {least:.4g} to {largest:.4g}.", _N | _range("influence"), "One minus the least matched similarity."),
    "fpca_cross_validation": Text("{folds} folds: reconstruction errors from {least:.4g} to {largest:.4g} over {k} candidates.", {"folds": "count(distinct fold)", "k": "count(distinct n_components)"} | _range("rmse"), "Held-out curves are projected on components that never saw them."),
    "fpca_component_envelope": Text("Pointwise envelopes of {k} components on {points} places, up to {largest:.4g} wide.", {"k": "count(distinct component)", "points": "count(distinct place)"} | _range("upper - lower"), "Pointwise, not simultaneous. " + _BASIS),
    "fpca_component_band": _band("Simultaneous bands of components", "estimate", "places of all components"),
    "fpca_eigengap": Text("{k} eigenvalues: least relative gap {least:.4g}.", {"k": "count(*)"} | _range("relative_gap"), "Components with a small gap have no stable shape of their own."),
    "fpca_subspace_stability": Text("{n} measures over {replicates} replicates: medians from {least:.4g} to {largest:.4g}.", _N | {"replicates": "max(replicates)"} | _range("median"), _BASIS),
    "functional_mean_band": _band("Simultaneous band of the mean", "mean", "times"),
    "fpca_wild_bootstrap_truncation": Text("{n} targets: {found} have a stable number of components, from {least:.0f} to {largest:.0f}.", _N | {"found": "count(h)"} | _range("h"), "The rule is declared; targets without a stable run have none."),
    "fpca_wild_bootstrap_projection": _intervals("Wild bootstrap of centred projections", "projection"),
    "fpca_wild_bootstrap_family_test": Text("{n} projections tested together: {rejected} rejected, least adjusted p-value {least:.4g}; global p-value {whole:.4g}.", _N | {"rejected": "count_if(rejected)", "whole": "max(global_p)"} | _range("adjusted_p"), "The family of targets is fixed in advance."),
    "fpca_wild_bootstrap_monte_carlo": Text("{n} tail shares: Monte Carlo errors up to {largest:.4g}.", _N | _range("mc_se"), "Precision of the finite bootstrap only."),
    "fpca_wild_bootstrap_simultaneous": Text("{n} targets with one critical value {critical:.4g}; intervals up to {largest:.4g} wide.", _N | {"critical": "max(family_critical)"} | _range("family_upper - family_lower"), "Simultaneous over the fixed targets."),
    "fpca_regression_future_prediction": _intervals("Prediction intervals of future outcomes", "prediction"),
    "fpca_regression_slope_band": _band("Simultaneous band of the slope function", "slope", "places"),
    "fpca_regression_uncertainty": _intervals("Conditional means by paired bootstrap", "prediction"),
    "fpca_regression_cv": _cv("Cross-validated outcome regression on scores"),
    "fpca_nested_regression_cv": _cv("Nested cross-validation of outcome regression on scores"),
    "conformal_fpca_anomaly": Text("{n} targets: {found} anomalous, least p-value {least:.4g}.", _N | {"found": "count_if(anomalous)"} | _range("p_value"), "Marginal validity for exchangeable curves; training, calibration and targets are disjoint."),
    "joint_recurrence": Text("{n} curves: joint recurrence rates from {least:.4g} to {largest:.4g}, mean determinism {d:.4g}.", _N | _range("recurrence_rate") | {"d": "avg(determinism)"}, "Each system has its own declared radius."),
    "recurrence_network": Text("{n} networks of {nodes} nodes: mean clustering from {least:.4g} to {largest:.4g}.", _N | {"nodes": "sum(n_nodes)"} | _range("mean_clustering"), "Edges are recurrences within the declared radius."),
    "recurrence_radius_profile": Text("{radii} radii: recurrence rates from {least:.4g} to {largest:.4g}.", {"radii": "count(distinct radius)"} | _range("rate"), _NO_SELECTION),
    "rqa": Text("{n} curves: recurrence rates from {least:.4g} to {largest:.4g}, mean determinism {d:.4g}, mean laminarity {l:.4g}.", _N | _range("recurrence_rate") | {"d": "avg(determinism)", "l": "avg(laminarity)"}, "Line measures need a regular grid; curves without recurrences have none."),
    "rqa_metric_mean_bootstrap": Text("{n} bootstrap means, from {least:.4g} to {largest:.4g}.", _N | _range("mean"), "Units are resampled whole."),
    "windowed_rqa": Text("{n} windows of {curves} curves: recurrence rates from {least:.4g} to {largest:.4g}.", _N | {"curves": "count(distinct curve_id)"} | _range("recurrence_rate"), "Overlapping windows share samples; a short tail has no window."),
    "windowed_rqa_functional": Text("Windowed measures of {curves} curves as functions of time: {n} values.", _N | {"curves": "count(distinct curve_id)"}, "Overlapping windows aren't independent."),
    "windowed_rqa_sensitivity": _sensitivity("Windowed recurrence", "recurrence_rate"),
    "windowed_rqa_mean_band": _band("Simultaneous band of a windowed measure's mean", "mean", "windows"),
    "rqa_parameter_sensitivity": _sensitivity("Recurrence quantification", "recurrence_rate"),
    "kantz_parameter_sensitivity": _sensitivity("Divergence of neighbourhoods", "slope"),
    "lyapunov_parameter_sensitivity": _sensitivity("Divergence of nearest neighbours", "slope"),
    "largest_lyapunov": Text("{n} curves: slopes from {least:.4g} to {largest:.4g}, fits with R2 of {r2:.4g} on average.", _N | _range("slope") | {"r2": "avg(r2)"}, "The fitted range is declared; a positive slope alone doesn't show chaos."),
    "multivariate_iaaft": Text("{n} surrogates: spectrum errors up to {largest:.4g}.", _N | _range("spectrum_error"), "Amplitudes are kept exactly, spectra approximately."),
    "multivariate_surrogate_nonlinearity": _surrogate("Multivariate surrogates"),
    "surrogate_nonlinearity": _surrogate("Surrogates"),
    "return_map_stability": Text("{n} return maps: spectral radii from {least:.4g} to {largest:.4g}; {stable} stable.", _N | _range("spectral_radius") | {"stable": "count_if(verdict = 'stable')"}, "A local affine map around a declared reference."),
    "workflow": Text("{n} steps took {seconds:.3g} seconds in all.", _N | {"seconds": "sum(seconds)"}, "Parameters are declared; none was selected."),
}


def columns_of(name: str) -> set[str]:
    """Columns that a text reads."""
    import re

    words = set(re.findall(r"`?([a-z_][a-z_0-9]*)`?", " ".join(TEXTS[name].values.values())))
    return words - set("count distinct min max avg sum percentile count_if cast as bigint case when then end is null or and struct abs ok stable".split())


def reporting_text(name: str, table: DataFrame, title: str = "", **declared) -> str:
    """The sentence of a result, with declared values (level, unit, ...) and the limits behind it."""
    spec = TEXTS[name]
    row = table.agg(*(F.expr(v).alias(k) for k, v in spec.values.items())).first().asDict()
    body = spec.sentence
    for k, v in row.items():
        if v is None:  # nothing was aggregated: the place says so, whatever its format
            import re

            body = re.sub(rf"\{{{k}(:[^}}]*)?\}}", "undefined", body)
    text = body.format(**{k: float(v) if hasattr(v, "as_tuple") else v for k, v in row.items()})
    more = ", ".join(f"{k.replace('_', ' ')} {v}" for k, v in declared.items())
    return " ".join(x for x in (title, text, f"Declared: {more}." if more else "", spec.limits) if x)


def result_names() -> list[str]:
    return sorted(TEXTS)
