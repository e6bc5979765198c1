"""Functional principal components: Spark adds up one Gram matrix of grid size, the driver factors it.

Curves are rows of ``arrays`` (curve_id, values: the flattened, time-major grid).  What reaches the driver, and what is
sent to tasks, has the size of the grid and doesn't follow the number of curves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import assign
from ..functions.sums import gram, matrix, replicate_grams, vector


def trapezoid_weights(t: np.ndarray, normalize: bool = False) -> np.ndarray:
    t = np.asarray(t, float)
    if len(t) < 2 or not np.all(np.diff(t) > 0):
        raise ValueError("a grid needs two or more strictly increasing times")
    w = np.zeros(len(t))
    w[:-1] += np.diff(t) / 2
    w[1:] += np.diff(t) / 2
    return w / w.sum() if normalize else w


@dataclass(frozen=True)
class Decomposition:
    """Mean and components on the flattened (time-major) grid, eigenvalues, their shares, weights, curve count, scale of each place."""

    mean: np.ndarray
    components: np.ndarray
    explained_variance: np.ndarray
    ratio: np.ndarray
    weights: np.ndarray
    n: float
    scale: np.ndarray | float = field(default=1.0)

    @property
    def basis(self) -> np.ndarray:
        """Scores are centred values times this matrix (places x components)."""
        return (self.components * self.weights / np.square(self.scale)).T

    def first(self, k: int) -> Decomposition:
        return Decomposition(self.mean, self.components[:k], self.explained_variance[:k], self.ratio[:k], self.weights, self.n, self.scale)


def moments(arrays: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sum and Gram matrix of the curves' value arrays; one row reaches the driver."""
    g = gram(arrays, vector("values"))
    return int(round(g[0, 0])), g[0, 1:], g[1:, 1:]


def dimension_scales(mean_square: np.ndarray, weights: np.ndarray, dims: int) -> np.ndarray:
    """Scale of each place: the root of its dimension's integrated variance over the length of the domain."""
    v, w = mean_square.reshape(-1, dims), weights.reshape(-1, dims)
    return np.tile(np.sqrt((v * w).sum(0) / w.sum(0)), len(v))


def factor(n: float, s: np.ndarray, g: np.ndarray, weights: np.ndarray, n_components: float | int, scale: np.ndarray | float = 1.0) -> Decomposition:
    """Quadrature-weighted components of a number, sum and Gram matrix; a share takes the least number of components above it."""
    mean = s / n
    cov = (g - n * np.outer(mean, mean)) / (n - 1)
    root = np.sqrt(weights) / scale
    ev, vec = np.linalg.eigh(cov * np.outer(root, root) if np.ndim(root) else cov * root * root)
    order = np.argsort(ev)[::-1]
    ev, vec = np.maximum(ev[order], 0), vec[:, order]
    total = ev.sum()
    ratio = ev / total if total > 0 else np.zeros(len(ev))
    k = int(np.searchsorted(np.cumsum(ratio), n_components, "right") + 1) if isinstance(n_components, float) else n_components
    k = int(min(k, max(1, n - 1), len(ev)))
    comp = (vec[:, :k] / np.sqrt(weights)[:, None]).T * scale
    sign = np.sign(comp[np.arange(k), np.abs(comp).argmax(1)])
    return Decomposition(mean, comp * np.where(sign == 0, 1, sign)[:, None], ev[:k], ratio[:k], weights, n, scale)


def fit_fpca(arrays: DataFrame, time: np.ndarray, n_components: float | int = 0.95, dims: int = 1, scale: np.ndarray | None = None, scaling: str = "none") -> Decomposition:
    """Components of one or more dimensions.  ``scaling`` ``integrated`` divides each dimension by its integrated deviation."""
    n, s, g = moments(arrays)
    if n < 2:
        raise ValueError("two or more curves are needed")
    w = np.repeat(trapezoid_weights(time), dims)
    if scaling == "integrated":
        scale = dimension_scales((np.diag(g) - s * s / n) / (n - 1), w, dims)
    elif scaling != "none":
        raise ValueError("scaling is none or integrated")
    return factor(n, s, g, w, n_components, 1.0 if scale is None else np.asarray(scale, float))


def _mapped(arrays: DataFrame, columns: list[str], schema: str, names: list[str], run) -> DataFrame:
    def batches(found):
        for b in found:
            if len(b):
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(columns) - 1)), *run(matrix(b.column(len(columns) - 1)))], names)

    return arrays.select(*columns).mapInArrow(batches, schema)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.array(m.tolist(), pa.list_(pa.float64()))


def scores(arrays: DataFrame, fit: Decomposition) -> DataFrame:
    """Scores (one array per curve) by projection; a batch is one matrix product."""
    return _mapped(arrays, ["curve_id", "values"], f"curve_id {dict(arrays.dtypes)['curve_id']}, scores array<double>", ["curve_id", "scores"], lambda m: [_lists((m - fit.mean) @ fit.basis)])


def score_frame(scored: DataFrame, k: int, prefix: str = "FPC", curves: DataFrame | None = None) -> DataFrame:
    """One column per score, with the curves' metadata if they are given."""
    out = scored.select("curve_id", *(F.col("scores")[i].alias(f"{prefix}{i + 1}") for i in range(k)))
    return out if curves is None else out.join(curves, "curve_id")


def reconstruct(score_rows: DataFrame, fit: Decomposition, n_components: int | None = None) -> DataFrame:
    """Mean and components summed by the scores: (curve_id, values)."""
    k = n_components or len(fit.components)
    return _mapped(score_rows, ["curve_id", "scores"], f"curve_id {dict(score_rows.dtypes)['curve_id']}, values array<double>", ["curve_id", "values"], lambda m: [_lists(m[:, :k] @ fit.components[:k] + fit.mean)])


def reconstruction_error(arrays: DataFrame, fit: Decomposition, candidates: list[int] | None = None) -> DataFrame:
    """Weighted root-mean-square distance of each curve from its reconstruction: rmse, or an array with one for each of the ``candidates``."""
    total = fit.weights.sum()

    def errors(m: np.ndarray, ks: list[int]) -> np.ndarray:
        m = m - fit.mean
        z, out = m @ fit.basis, []
        for k in ks:
            e = m - z[:, :k] @ fit.components[:k]
            out.append(np.sqrt((e * e) @ fit.weights / total))
        return np.stack(out, 1)

    kind = dict(arrays.dtypes)["curve_id"]
    if candidates is None:
        return _mapped(arrays, ["curve_id", "values"], f"curve_id {kind}, rmse double", ["curve_id", "rmse"], lambda m: [pa.array(errors(m, [len(fit.components)])[:, 0])])
    return _mapped(arrays, ["curve_id", "values"], f"curve_id {kind}, rmse array<double>", ["curve_id", "rmse"], lambda m: [_lists(errors(m, candidates))])


def reconstruction_curve(arrays: DataFrame, fit: Decomposition) -> DataFrame:
    """Mean and median error over curves for each number of components."""
    e = reconstruction_error(arrays, fit, list(range(1, len(fit.components) + 1)))
    return e.select(F.posexplode("rmse").alias("k", "rmse")).groupBy((F.col("k") + 1).alias("n_components")).agg(F.avg("rmse").alias("mean_rmse"), F.percentile("rmse", 0.5).alias("median_rmse"))


def spectrum(fit: Decomposition, near: float | None = None) -> list[dict]:
    """Eigenvalue, share, cumulative share, gap to the next (plain, relative, as a ratio) of each component; with ``near`` whether the relative gap is below it."""
    ev, out = fit.explained_variance, []
    for k, v in enumerate(ev):
        row = {"component": k + 1, "eigenvalue": float(v), "ratio": float(fit.ratio[k]), "cumulative": float(fit.ratio[: k + 1].sum())}
        after = float(ev[k + 1]) if k + 1 < len(ev) else None
        row |= {"gap": None if after is None else float(v) - after, "relative_gap": None if after is None or v <= 0 else (float(v) - after) / float(v), "next_ratio": None if after is None or v <= 0 else after / float(v)}
        out.append(row if near is None else row | {"near_tie": None if row["relative_gap"] is None else row["relative_gap"] < near})
    return out


def select_n_components(fit: Decomposition, threshold: float = 0.95) -> int:
    """The least number of components whose cumulative share reaches the threshold."""
    c = np.cumsum(fit.ratio)
    if c[-1] < threshold - 1e-12:
        raise ValueError("the fitted components don't reach the threshold")
    return int(np.searchsorted(c, threshold - 1e-12) + 1)


def component_trajectories(fit: Decomposition, component: int, multipliers: tuple[float, ...] = (-2.0, -1.0, 0.0, 1.0, 2.0)) -> pd.DataFrame:
    """The mean plus multiples of one component's standard deviation: (multiplier, place, value)."""
    step = np.sqrt(fit.explained_variance[component - 1]) * fit.components[component - 1]
    return pd.concat([pd.DataFrame({"multiplier": m, "place": np.arange(len(step)), "value": fit.mean + m * step}) for m in multipliers], ignore_index=True)


def signed_similarity(a: Decomposition, b: Decomposition) -> np.ndarray:
    """Signed weighted cosines of two sets of components, each in the geometry of its own fit."""
    return (a.components * a.weights / a.scale) @ (b.components / b.scale).T


def component_similarity(a: Decomposition, b: Decomposition) -> np.ndarray:
    """Absolute weighted inner products of two sets of components."""
    return np.abs(signed_similarity(a, b))


def match_components(similarity: np.ndarray) -> list[int]:
    """Assignment of rows to columns with the greatest total, in cubic time."""
    return assign(np.abs(similarity))


def principal_angles(a: Decomposition, b: Decomposition) -> np.ndarray:
    """Principal angles between two component subspaces in the weighted space."""
    return np.arccos(np.clip(np.linalg.svd(signed_similarity(a, b), compute_uv=False), -1, 1))


def subspace_distance(angles: np.ndarray) -> tuple[float, float]:
    """Distance of the projectors on two subspaces, plain and divided by its largest possible value."""
    d = float(np.sqrt(2 * (np.sin(angles) ** 2).sum()))
    return d, d / float(np.sqrt(2 * len(angles)))


def compare_subspaces(a: Decomposition, b: Decomposition, start: int = 0, size: int = 2) -> dict:
    """Principal angles (degrees) and projector distance of the components start + 1 to start + size of two fits."""
    cut = lambda f: Decomposition(f.mean, f.components[start : start + size], f.explained_variance[start : start + size], f.ratio[start : start + size], f.weights, f.n, f.scale)
    angles = principal_angles(cut(a), cut(b))
    plain, share = subspace_distance(angles)
    return {"angles": np.degrees(angles).tolist(), "projector_distance": plain, "normalized_distance": share}


def multilevel_parts(samples: DataFrame) -> DataFrame:
    """Participant mean minus the grand mean, and curve minus participant mean, on a common grid.

    The grand mean weights curves.  Both means are aggregates: participants' are joined by participant and place (a hot
    participant is pre-aggregated and its join can be split), the grand mean has the size of the grid and is broadcast.
    """
    sums = samples.groupBy("participant", "t_idx").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    grand = sums.groupBy("t_idx").agg((F.sum("s") / F.sum("n")).alias("gm"))
    means = sums.select("participant", "t_idx", (F.col("s") / F.col("n")).alias("pm"))
    return samples.join(means, ["participant", "t_idx"]).join(F.broadcast(grand), "t_idx").select("curve_id", "participant", "t_idx", "t", (F.col("pm") - F.col("gm")).alias("between"), (F.col("x") - F.col("pm")).alias("within"))


def bootstrap_fits(arrays: DataFrame, time: np.ndarray, n_components: int, replicates: int, unit: str = "curve_id", dims: int = 1, seed: int = 0, reference: Decomposition | None = None) -> DataFrame:
    """Refits on bootstrap counts of ``unit`` (curves, or whole participants), matched to the reference's components.

    One row per replicate and component: rep, component, matched, similarity, eigenvalue, ratio, cumulative, shape (with the
    reference's sign), mean, angles (principal angles of all components, in radians).
    """
    fit = reference or fit_fpca(arrays, time, n_components, dims)

    def refit(batches):
        for b in batches:
            out = []
            for rep, flat in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                g = np.asarray(flat.values, float)
                p = int(round(len(g) ** 0.5))
                g = g.reshape(p, p)
                if g[0, 0] < 2:
                    continue
                again = factor(g[0, 0], g[0, 1:], g[1:, 1:], fit.weights, len(fit.components), fit.scale)
                sim = signed_similarity(fit, again)
                angles = principal_angles(fit, again).tolist()
                at = assign(np.abs(sim))
                for i, j in enumerate(at):
                    sign = -1.0 if sim[i, j] < 0 else 1.0
                    out.append((rep, i + 1, j + 1, abs(float(sim[i, j])), float(again.explained_variance[j]), float(again.ratio[j]), float(again.ratio[: j + 1].sum()), (again.components[j] * sign).tolist(), again.mean.tolist(), angles))
            kinds = (pa.int64(), pa.int64(), pa.int64(), *(pa.float64(),) * 4, *(pa.list_(pa.float64()),) * 3)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], BOOT)

    g = replicate_grams(arrays, vector("values"), unit, replicates, seed)
    return g.select("rep", "gram").mapInArrow(refit, "rep long, component long, matched long, similarity double, eigenvalue double, ratio double, cumulative double, shape array<double>, mean array<double>, angles array<double>")


BOOT = ["rep", "component", "matched", "similarity", "eigenvalue", "ratio", "cumulative", "shape", "mean", "angles"]


def bootstrap_stability(arrays: DataFrame, time: np.ndarray, n_components: int, replicates: int, seed: int = 0, unit: str = "curve_id") -> DataFrame:
    """Similarity of each component to its bootstrap counterpart: (rep, component, similarity)."""
    return bootstrap_fits(arrays, time, n_components, replicates, unit, seed=seed).select("rep", "component", "similarity")


def spectrum_uncertainty(arrays: DataFrame, time: np.ndarray, n_components: int, replicates: int = 100, seed: int = 0, unit: str = "curve_id") -> np.ndarray:
    """Percentile intervals (2.5, 50, 97.5) of the eigenvalues over bootstrap counts of ``unit``."""
    boot = bootstrap_fits(arrays, time, n_components, replicates, unit, seed=seed)
    rows = boot.groupBy("component").agg(F.percentile("eigenvalue", F.array(*(F.lit(q) for q in (0.025, 0.5, 0.975)))).alias("q")).orderBy("component").collect()
    return np.array([r.q for r in rows]).T


def multilevel_fpca(samples: DataFrame, time: np.ndarray, between: float | int = 0.95, within: float | int = 0.95) -> tuple[Decomposition, Decomposition]:
    """Components of participants' deviations from the curve-weighted grand mean, and of curves from their participant's mean."""
    from .distances import curve_arrays

    parts = multilevel_parts(samples)
    one = parts.groupBy("participant", "t_idx").agg(F.first("between").alias("between")).withColumnRenamed("participant", "curve_id")
    return fit_fpca(curve_arrays(one, ("between",)), time, between), fit_fpca(curve_arrays(parts, ("within",)), time, within)


def compositional_fpca(parts: DataFrame, dims: tuple[str, ...], reference: str, time: np.ndarray, n_components: float | int = 0.95) -> Decomposition:
    """Components of additive log-ratios of composition curves (three parts or more)."""
    from .distances import curve_arrays
    from .geometry import alr

    if len(dims) < 3:
        raise ValueError("three or more parts are needed")
    logs = tuple(f"alr_{d}" for d in dims if d != reference)
    return fit_fpca(curve_arrays(alr(parts, dims, reference), logs), time, n_components, dims=len(logs))


def reconstruct_composition(score_rows: DataFrame, fit: Decomposition, dims: tuple[str, ...], reference: str) -> DataFrame:
    """Compositions (curve_id, t_idx, one column per part) of scores: log-ratios are reconstructed, then closed to shares."""
    from .geometry import inverse_alr

    logs = [f"alr_{d}" for d in dims if d != reference]
    flat = reconstruct(score_rows, fit).select("curve_id", F.posexplode("values").alias("place", "v"))
    wide = flat.groupBy("curve_id", F.floor(F.col("place") / len(logs)).cast("int").alias("t_idx")).agg(*(F.max(F.when(F.col("place") % len(logs) == k, F.col("v"))).alias(c) for k, c in enumerate(logs)))
    return inverse_alr(wide, dims, reference).select("curve_id", "t_idx", *dims)


def compare_fits(a: Decomposition, b: Decomposition) -> list[dict]:
    """Matched components of two fits: similarity and both shares (registered against unregistered curves, for one)."""
    sim = component_similarity(a, b)
    return [{"component": i + 1, "matched": j + 1, "similarity": float(sim[i, j]), "ratio_a": float(a.ratio[i]), "ratio_b": float(b.ratio[j])} for i, j in enumerate(match_components(sim))]
