"""Sparse functional components end to end: smoothing, noise, eigenfunctions, conditional scores, prediction, bandwidths, levels.

Covariance smoothing needs products of all pairs of a curve's samples.  The kernel of a pair is a product, so the sum over
pairs is an outer product of the curve's kernel moments less the pairs of a sample with itself: samples are added up per
curve and grid point, curves by one Gram matrix, and no pair is ever made.  In the same way a curve enters its conditional
scores only by sums over grid cells (a tridiagonal matrix and a vector), so a curve of any length is one small row.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analytic import epanechnikov
from ..functions.numeric import normal_quantile
from ..functions.sums import add_up, gram, matrix
from .decomposition import trapezoid_weights

CURVE = "curve_id"


@dataclass(frozen=True)
class SparseFit:
    """Grid, channels, mean (channels x grid), covariance (channel-major), noise (channels x channels), eigenpairs, what was audited."""

    grid: np.ndarray
    dims: tuple[str, ...]
    mean: np.ndarray
    cov: np.ndarray
    noise: np.ndarray
    eigenvalues: np.ndarray
    phi: np.ndarray
    audit: dict = field(default_factory=dict)

    @property
    def weights(self) -> np.ndarray:
        return np.tile(trapezoid_weights(self.grid), len(self.dims))

    @property
    def root(self) -> np.ndarray:
        """A factor of the covariance."""
        ev, vec = np.linalg.eigh((self.cov + self.cov.T) / 2)
        keep = ev > ev[-1] * 1e-12
        return vec[:, keep] * np.sqrt(ev[keep])


def on_support(samples: DataFrame, grid: np.ndarray, dims: tuple[str, ...], action: str = "error") -> DataFrame:
    """Samples inside the grid with a value in some channel; samples outside are an error unless they are to be left out (``restrict``)."""
    inside = F.col("t").between(float(grid[0]), float(grid[-1]))
    known = samples.where(F.coalesce(*(F.col(d) for d in dims)).isNotNull())
    if action == "error":
        if not known.where(~inside).isEmpty():
            raise ValueError("samples lie outside the grid")
        return known
    return known.where(inside)


def cell(grid: np.ndarray, t: Column) -> tuple[Column, Column]:
    """Grid cell of a time (0-based) and its place in it, from 0 to 1."""
    i = F.least(F.lit(len(grid) - 2), sum(((t >= float(g)).cast("int") for g in grid[1:]), F.lit(0)))
    lo, width = F.array(*(F.lit(float(g)) for g in grid[:-1])), F.array(*(F.lit(float(g)) for g in np.diff(grid)))
    return i, (t - F.element_at(lo, i + 1)) / F.element_at(width, i + 1)


def evaluated(grid: np.ndarray, values: np.ndarray, t: Column) -> Column:
    """A function on the grid at times inside it, by linear interpolation."""
    i, f = cell(grid, t)
    v = F.array(*(F.lit(float(x)) for x in values))
    return F.element_at(v, i + 1) * (1 - f) + F.element_at(v, i + 2) * f


def _grid_frame(samples: DataFrame, grid: np.ndarray) -> DataFrame:
    return samples.sparkSession.createDataFrame([(k, float(g)) for k, g in enumerate(grid)], "g_idx int, g double")


def mean_function(samples: DataFrame, value: str, grid: np.ndarray, bandwidth: float, min_points: int = 3) -> np.ndarray:
    """Local-linear mean at the grid points; too little support anywhere is an error."""
    from .sparse import local_linear_mean

    rows = {r.g_idx: r.mean for r in local_linear_mean(samples, _grid_frame(samples, grid), bandwidth, value, min_points).collect()}
    if any(rows.get(k) is None for k in range(len(grid))):
        raise ValueError(f"the mean has too little support at grid points {[k for k in range(len(grid)) if rows.get(k) is None][:5]}")
    return np.array([rows[k] for k in range(len(grid))])


def kernel_vectors(residuals: DataFrame, grid: np.ndarray, bandwidth: float, values: tuple[str, ...], degree: int, key: str = CURVE) -> DataFrame:
    """(key, v): kernel moments of every curve's samples around every grid point.

    Channel-major; per channel, first the numbers of samples, then sums of kernel x distance**a (a up to ``degree``), then
    those times the residual (a up to half the degree), each over the grid.
    """
    d, half = F.col("t") - F.col("g"), degree // 2
    near = residuals.join(F.broadcast(_grid_frame(residuals, grid)), F.abs(F.col("t") - F.col("g")) < bandwidth)
    k = epanechnikov(d / bandwidth)
    sums = []
    for c, e in enumerate(values):
        have = F.col(e).isNotNull()
        power = lambda a: F.lit(1.0) if a == 0 else F.pow(d, a)
        sums.append(F.sum(F.when(have, 1.0).otherwise(0.0)).alias(f"n{c}"))
        sums += [F.sum(F.when(have, k * power(a)).otherwise(0.0)).alias(f"s{c}_{a}") for a in range(degree + 1)]
        sums += [F.sum(F.when(have, k * power(a) * F.col(e)).otherwise(0.0)).alias(f"e{c}_{a}") for a in range(half + 1)]
    per = near.groupBy(key, "g_idx").agg(*sums)
    names = [f"{x}" for c in range(len(values)) for x in (f"n{c}", *(f"s{c}_{a}" for a in range(degree + 1)), *(f"e{c}_{a}" for a in range(half + 1)))]
    cells = per.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("g_idx"), F.array(*names)))).alias("m"))
    zeros = F.array(*(F.lit(0.0) for _ in names))
    dense = F.transform(F.sequence(F.lit(0), F.lit(len(grid) - 1)), lambda i: F.coalesce(F.element_at("m", i), zeros))  # grid x names
    by_name = F.transform(F.sequence(F.lit(1), F.lit(len(names))), lambda j: F.transform(dense, lambda row: F.element_at(row, j)))
    return cells.select(key, F.flatten(by_name).alias("v"))


def _self_moments(residuals: DataFrame, grid: np.ndarray, bandwidth: float, p: str, q: str, degree: int) -> dict[tuple, np.ndarray]:
    """Sums over samples with both channels of kernel products at two grid points: what pairs of a sample with itself would add."""
    g = _grid_frame(residuals, grid)
    one = F.broadcast(g.toDF("i", "gi"))
    two = F.broadcast(g.toDF("j", "gj"))
    ds, dt, h = F.col("t") - F.col("gi"), F.col("t") - F.col("gj"), bandwidth
    near = residuals.where(F.col(p).isNotNull() & F.col(q).isNotNull()).join(one, F.abs(F.col("t") - F.col("gi")) < h).join(two, F.abs(F.col("t") - F.col("gj")) < h)
    k = epanechnikov(ds / h) * epanechnikov(dt / h)
    kinds = [("s", a, b) for a in range(degree + 1) for b in range(degree + 1 - a)] + [("e", a, b) for a in range(degree // 2 + 1) for b in range(degree // 2 + 1 - a)]
    power = lambda x, a: F.lit(1.0) if a == 0 else F.pow(x, a)
    terms = [F.sum(k * power(ds, a) * power(dt, b) * (F.lit(1.0) if kind == "s" else F.col(p) * F.col(q))).alias(f"{kind}{a}_{b}") for kind, a, b in kinds]
    rows = near.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), *terms).toPandas()
    out = {}
    for key in [("n",), *kinds]:
        m = np.zeros((len(grid), len(grid)))
        m[rows["i"], rows["j"]] = rows["n" if key == ("n",) else f"{key[0]}{key[1]}_{key[2]}"]
        out[key] = m
    return out


def pair_moments(residuals: DataFrame, grid: np.ndarray, bandwidth: float, values: tuple[str, ...], degree: int = 2, key: str = CURVE, same: bool = False) -> dict[tuple[int, int], dict[tuple, np.ndarray]]:
    """Per pair of channels (p <= q): moments over all pairs of different samples of one ``key``; with ``same`` a sample's own pairs count too."""
    per = 1 + (degree + 1) + (degree // 2 + 1)
    g = gram(kernel_vectors(residuals, grid, bandwidth, values, degree, key), F.col("v"))
    n = len(grid)
    at = lambda c, name: (c * per + name) * n
    out = {}
    for p in range(len(values)):
        for q in range(p, len(values)):
            own = None if same else _self_moments(residuals, grid, bandwidth, values[p], values[q], degree)
            m = {}
            block = lambda a, b, p=p, q=q: g[at(p, a) : at(p, a) + n, at(q, b) : at(q, b) + n]
            m["n",] = block(0, 0)
            for a in range(degree + 1):
                for b in range(degree + 1 - a):
                    m["s", a, b] = block(1 + a, 1 + b)
            for a in range(degree // 2 + 1):
                for b in range(degree // 2 + 1 - a):
                    m["e", a, b] = block(2 + degree + a, 2 + degree + b)
            out[p, q] = {k: v - own[k] if own else v.copy() for k, v in m.items()}
    return out


def plane_surface(m: dict[tuple, np.ndarray], min_pairs: int = 6) -> np.ndarray:
    """Local-linear covariance surface from pair moments: a plane per cell; too few pairs or a flat design are an error."""
    s = lambda a, b: m["s", a, b]
    left = np.stack([np.stack([s(0, 0), s(1, 0), s(0, 1)], -1), np.stack([s(1, 0), s(2, 0), s(1, 1)], -1), np.stack([s(0, 1), s(1, 1), s(0, 2)], -1)], -2)
    right = np.stack([m["e", 0, 0], m["e", 1, 0], m["e", 0, 1]], -1)
    scale = np.maximum(np.abs(s(0, 0)), 1e-300)
    bad = (m["n",] < min_pairs - 1e-6) | (np.abs(np.linalg.det(left)) <= 1e-12 * scale * np.maximum(s(2, 0) * s(0, 2), 1e-300))
    if bad.any():
        raise ValueError(f"the covariance has too little support in {int(bad.sum())} cells")
    return np.linalg.solve(left, right[..., None])[..., 0, 0]


def rotated_diagonal(m: dict[tuple, np.ndarray], min_pairs: int = 6) -> np.ndarray:
    """The surface's diagonal by a plane along it and a parabola across it (moments up to the fourth degree)."""
    n = len(m["n",])
    diag = {k: np.diag(v) for k, v in m.items()}
    along, across = {(1, 0): 2**-0.5, (0, 1): 2**-0.5}, {(2, 0): 0.5, (1, 1): -1.0, (0, 2): 0.5}
    basis = [{(0, 0): 1.0}, along, across]

    def moment(p: dict, q: dict, kind: str) -> np.ndarray:
        out = np.zeros(n)
        for (a, b), x in p.items():
            for (c, d), y in q.items():
                out = out + x * y * diag[kind, a + c, b + d]
        return out

    left = np.stack([np.stack([moment(p, q, "s") for q in basis], -1) for p in basis], -2)
    right = np.stack([moment(p, {(0, 0): 1.0}, "e") for p in basis], -1)
    if (np.diag(m["n",]) < min_pairs - 1e-6).any():
        raise ValueError("the diagonal has too little support")
    return np.linalg.solve(left, right[..., None])[:, 0, 0]


def noise_variance(residuals: DataFrame, value: str, grid: np.ndarray, diagonal: np.ndarray, bandwidth: float, support: tuple[float, float] | None = None) -> float:
    """Mean difference of the smoothed squared residuals and the latent diagonal over the support; a value that isn't positive is an error."""
    raw = mean_function(residuals.where(F.col(value).isNotNull()).withColumn("_sq", F.col(value) * F.col(value)), "_sq", grid, bandwidth)
    lo, hi = support or (grid[0], grid[-1])
    use = (grid >= lo) & (grid <= hi)
    w = trapezoid_weights(grid[use])
    out = float(((raw - diagonal)[use] * w).sum() / w.sum())
    if out <= 0:
        raise ValueError(f"the noise variance comes out as {out:.4g}")
    return out


def audited_psd(cov: np.ndarray, weights: np.ndarray, action: str = "error", tolerance: float = 1e-8) -> tuple[np.ndarray, dict]:
    """The covariance, projected on positive semidefinite operators if asked for, and what that changed."""
    cov, root = (cov + cov.T) / 2, np.sqrt(weights)
    ev, vec = np.linalg.eigh(cov * np.outer(root, root))
    least, largest = float(ev[0]), float(max(ev[-1], 0))
    audit = {"least_eigenvalue": least, "largest_eigenvalue": largest, "negative": int((ev < 0).sum()), "projected": False, "change": 0.0}
    if least >= -tolerance * max(largest, 1e-300):
        return cov, audit
    if action != "project":
        raise ValueError(f"the covariance has an eigenvalue of {least:.4g}")
    fixed = (vec * np.maximum(ev, 0)) @ vec.T / np.outer(root, root)
    return fixed, audit | {"projected": True, "change": float(np.linalg.norm(fixed - cov) / max(np.linalg.norm(cov), 1e-300))}


def eigenfunctions(cov: np.ndarray, weights: np.ndarray, k: int, channels: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues and functions (k x channels x grid) of the weighted operator, the largest entry positive."""
    root = np.sqrt(weights)
    ev, vec = np.linalg.eigh(cov * np.outer(root, root))
    ev, phi = ev[::-1][:k], (vec[:, ::-1][:, :k] / root[:, None]).T
    if ev[-1] <= 1e-10 * max(ev[0], 1e-300):
        raise ValueError("there are fewer positive eigenvalues than components")
    sign = np.sign(phi[np.arange(k), np.abs(phi).argmax(1)])
    return ev, (phi * sign[:, None]).reshape(k, channels, -1)


def _residuals(samples: DataFrame, dims: tuple[str, ...], grid: np.ndarray, mean: np.ndarray) -> DataFrame:
    return samples.select("*", *((F.col(d) - evaluated(grid, m, F.col("t"))).alias(f"e_{d}") for d, m in zip(dims, mean, strict=True)))


def fit(samples: DataFrame, grid: np.ndarray, n_components: int, mean_bandwidth: float, covariance_bandwidth: float, dims: tuple[str, ...] = ("x",), noise_bandwidth: float | None = None, noise: float | list | np.ndarray | None = None, support: str = "error", psd: str = "project", min_points: int = 3, min_pairs: int = 6) -> SparseFit:
    """Sparse components of one or more channels; a row may lack any channel (asynchronous channels need no partner).

    ``noise`` is the measurement-error variance, a list of one per channel, or a matrix; if it isn't given it is estimated
    per channel by the difference of diagonals.  Cross-channel products of one row carry its common noise and are left out.
    """
    grid = np.asarray(grid, float)
    rows = on_support(samples, grid, dims, support)
    mean = np.stack([mean_function(rows.where(F.col(d).isNotNull()), d, grid, mean_bandwidth, min_points) for d in dims])
    res, names = _residuals(rows, dims, grid, mean), tuple(f"e_{d}" for d in dims)
    degree = 4 if noise is None else 2
    moments = pair_moments(res, grid, covariance_bandwidth, names, degree)
    n, c = len(grid), len(dims)
    cov = np.zeros((c * n, c * n))
    for (p, q), m in moments.items():
        block = plane_surface(m, min_pairs)
        block = (block + block.T) / 2 if p == q else block
        cov[p * n : (p + 1) * n, q * n : (q + 1) * n] = block
        cov[q * n : (q + 1) * n, p * n : (p + 1) * n] = block.T
    if noise is None:
        sigma = np.diag([noise_variance(res, names[p], grid, rotated_diagonal(moments[p, p], min_pairs), noise_bandwidth or covariance_bandwidth) for p in range(c)])
    else:
        sigma = measurement_error(noise, c)
    w = np.tile(trapezoid_weights(grid), c)
    cov, audit = audited_psd(cov, w, psd)
    ev, phi = eigenfunctions(cov, w, n_components, c)
    return SparseFit(grid, tuple(dims), mean, cov, sigma, ev, phi, audit | {"mean_bandwidth": mean_bandwidth, "covariance_bandwidth": covariance_bandwidth})


def measurement_error(noise, channels: int) -> np.ndarray:
    """A variance, one per channel, or a whole matrix as a checked covariance of the channels' errors."""
    m = np.asarray(noise, float)
    m = np.eye(channels) * m if m.ndim < 2 else m
    if m.shape != (channels, channels) or not np.allclose(m, m.T) or np.linalg.eigvalsh(m)[0] <= 0:
        raise ValueError("the measurement error is a positive variance, one per channel, or a positive definite matrix")
    return m


def observation_sums(samples: DataFrame, fit_: SparseFit, key: str = CURVE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, v): what conditional scores need of a curve's samples, by sums over grid cells.

    v: the number of values, the sum of r' R^-1 r, the sum of log |R|, then per cell and pair of channels three weights of
    the interpolation's normal matrix, then per cell and channel two of its right-hand side.
    """
    dims, c = fit_.dims, len(fit_.dims)
    res = _residuals(samples, dims, fit_.grid, fit_.mean)
    i, f = cell(fit_.grid, F.col("t"))
    res = res.withColumns({"_i": i, "_f": f})
    have = [F.col(f"e_{d}").isNotNull() for d in dims]
    r = [F.coalesce(F.col(f"e_{d}"), F.lit(0.0)) for d in dims]
    if c == 1:
        w = {(0, 0): F.when(have[0], 1 / float(fit_.noise[0, 0])).otherwise(0.0)}
        logs = F.when(have[0], float(np.log(fit_.noise[0, 0]))).otherwise(0.0)
    else:
        if c != 2:
            raise ValueError("one or two channels")
        whole, both = np.linalg.inv(fit_.noise), have[0] & have[1]
        one = lambda p: F.when(both, float(whole[p, p])).when(have[p], 1 / float(fit_.noise[p, p])).otherwise(0.0)
        w = {(0, 0): one(0), (1, 1): one(1), (0, 1): F.when(both, float(whole[0, 1])).otherwise(0.0)}
        logs = F.when(both, float(np.linalg.slogdet(fit_.noise)[1])).when(have[0], float(np.log(fit_.noise[0, 0]))).when(have[1], float(np.log(fit_.noise[1, 1]))).otherwise(0.0)
    u = [sum((w[min(p, q), max(p, q)] * r[q] for q in range(c)), F.lit(0.0)) for p in range(c)]
    f, g = F.col("_f"), 1 - F.col("_f")
    sums = [F.sum(sum((h.cast("double") for h in have), F.lit(0.0))), F.sum(sum((r[p] * u[p] for p in range(c)), F.lit(0.0))), F.sum(logs)]
    for pair in [(p, q) for p in range(c) for q in range(p, c)]:
        sums += [F.sum(w[pair] * x) for x in (g * g, f * g, f * f)]
    sums += [F.sum(u[p] * x) for p in range(c) for x in (g, f)]
    per = res.groupBy(key, *keep, "_i").agg(F.array(*sums).alias("a"))
    size, cells = 3 + 3 * c * (c + 1) // 2 + 2 * c, len(fit_.grid) - 1
    m = per.groupBy(key, *keep).agg(F.map_from_entries(F.collect_list(F.struct("_i", "a"))).alias("m"))
    zeros = F.array(*(F.lit(0.0) for _ in range(size)))
    dense = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda k: F.coalesce(F.element_at("m", k), zeros)))
    return m.select(key, *keep, dense.alias("v"))


def unfold(v: np.ndarray, cells: int, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Totals (number, square, log), normal matrices and right-hand sides of rows of ``observation_sums``."""
    x, n, g = v.reshape(len(v), cells, -1), len(v), cells + 1
    normal, right, at = np.zeros((n, c * g, c * g)), np.zeros((n, c * g)), 3
    k = np.arange(cells)
    for p in range(c):
        for q in range(p, c):
            a, b, d = x[:, :, at], x[:, :, at + 1], x[:, :, at + 2]
            at += 3
            block = np.zeros((n, g, g))
            block[:, k, k] += a
            block[:, k + 1, k + 1] += d
            block[:, k, k + 1] += b
            block[:, k + 1, k] += b
            normal[:, p * g : (p + 1) * g, q * g : (q + 1) * g] = block
            if p != q:
                normal[:, q * g : (q + 1) * g, p * g : (p + 1) * g] = block
    for p in range(c):
        right[:, p * g + k] += x[:, :, at + 2 * p]
        right[:, p * g + k + 1] += x[:, :, at + 2 * p + 1]
    return x[:, :, :3].sum(1), normal, right


def posterior(fit_: SparseFit, v: np.ndarray, ridge: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every row: totals, posterior mean on the grid, the inner inverse, log determinant and quadratic form (without noise terms)."""
    totals, normal, right = unfold(v, len(fit_.grid) - 1, len(fit_.dims))
    if ridge:  # a ridge on the observations' covariance, as more noise of all channels
        normal, right = normal / (1 + ridge), right / (1 + ridge)
    root = fit_.root
    k = np.eye(root.shape[1]) + root.T @ normal @ root
    e = right @ root
    inner = np.linalg.inv(k)
    c = np.einsum("nij,nj->ni", inner, e)
    return totals, c @ root.T, inner, np.linalg.slogdet(k)[1], -np.einsum("ni,ni->n", e, c)


def pace_scores(samples: DataFrame, fit_: SparseFit, min_samples: int = 2, failure: str = "null", ridge: float = 0.0) -> DataFrame:
    """Conditional scores of every curve with their conditional deviations and covariance: (curve_id, n, status, scores, score_sd, covariance).

    Curves with fewer than ``min_samples`` values have status too_few_samples and NULL scores (``failure`` error: that is an error).
    """
    basis = fit_.phi.reshape(len(fit_.phi), -1) * fit_.weights  # projections on the eigenfunctions
    lift = basis @ fit_.root

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            totals, mean, inner, _, _ = posterior(fit_, matrix(b.column(1)), ridge)
            s, cov = mean @ basis.T, np.einsum("ki,nij,lj->nkl", lift, inner, lift)
            ok = totals[:, 0] >= min_samples
            lists = lambda m, ok=ok: pa.array([x.ravel().tolist() if y else None for x, y in zip(m, ok, strict=True)], pa.list_(pa.float64()))
            sd = np.sqrt(np.maximum(np.einsum("nkk->nk", cov), 0))
            status = pa.array(np.where(ok, "ok", "too_few_samples").tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(totals[:, 0].astype(np.int64)), status, lists(s), lists(sd), lists(cov)], [CURVE, "n", "status", "scores", "score_sd", "covariance"])

    rows = on_support(samples, fit_.grid, fit_.dims, "restrict")
    kind = dict(samples.dtypes)[CURVE]
    out = observation_sums(rows, fit_).mapInArrow(run, f"{CURVE} {kind}, n long, status string, scores array<double>, score_sd array<double>, covariance array<double>")
    if failure == "error" and not out.where("status <> 'ok'").isEmpty():
        raise ValueError("curves have too few samples for their scores")
    return out


def score_frame(scored: DataFrame, curves: DataFrame | None = None) -> DataFrame:
    """One row per curve and component: score, conditional deviation; with the curves' metadata if given."""
    long = scored.select(CURVE, "status", F.posexplode_outer(F.arrays_zip("scores", "score_sd")).alias("k", "z")).select(CURVE, "status", (F.col("k") + 1).alias("component"), F.col("z.scores").alias("score"), F.col("z.score_sd").alias("score_sd"))
    return long if curves is None else long.join(curves, CURVE, "left")


def partial_prediction(samples: DataFrame, fit_: SparseFit, cutoff: float, level: float = 0.95, min_history: int = 2) -> DataFrame:
    """Every curve's future on the grid from its samples up to the cutoff: (curve_id, channel, t, prediction, latent_se, se, lower, upper)."""
    ahead = np.flatnonzero(fit_.grid > cutoff)
    g, c, root = len(fit_.grid), len(fit_.dims), fit_.root
    places = np.concatenate([p * g + ahead for p in range(c)])
    z = normal_quantile((1 + level) / 2)

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            totals, mean, inner, _, _ = posterior(fit_, matrix(b.column(1)))
            ok = np.flatnonzero(totals[:, 0] >= min_history)
            if not len(ok):
                continue
            centre = (mean + fit_.mean.ravel())[ok][:, places]
            latent = np.sqrt(np.maximum(np.einsum("gi,nij,gj->ng", root[places], inner[ok], root[places]), 0))
            se = np.sqrt(latent**2 + np.repeat(np.diag(fit_.noise), len(ahead)))
            n = len(places)
            cols = [b.column(0).take(pa.array(np.repeat(ok, n))), pa.array(np.tile(np.repeat(fit_.dims, len(ahead)), len(ok)).tolist()), pa.array(np.tile(np.tile(fit_.grid[ahead], c), len(ok)))]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x.ravel()) for x in (centre, latent, se, centre - z * se, centre + z * se))], [CURVE, "channel", "t", "prediction", "latent_se", "se", "lower", "upper"])

    history = on_support(samples, fit_.grid, fit_.dims, "restrict").where(F.col("t") <= cutoff)
    kind = dict(samples.dtypes)[CURVE]
    return observation_sums(history, fit_).mapInArrow(run, f"{CURVE} {kind}, channel string, t double, prediction double, latent_se double, se double, lower double, upper double")


def calibrate_conformal(calibration: DataFrame, fit_: SparseFit, cutoff: float, alpha: float = 0.05, unit: str = CURVE) -> float:
    """Critical value of a simultaneous future band: the ceil((n + 1)(1 - alpha))-th least of the calibration units' largest
    studentised errors at the grid points where they were observed (times that are grid points)."""
    p = partial_prediction(calibration, fit_, cutoff)
    d = fit_.dims[0]
    keep = [CURVE] if unit == CURVE else [CURVE, unit]
    seen = calibration.select(*keep, F.round("t", 9).alias("_t"), F.col(d).alias("y")).where("y is not null")
    near = p.where(F.col("channel") == d).withColumn("_t", F.round("t", 9)).join(seen, [CURVE, "_t"])
    top = near.groupBy(unit).agg(F.max(F.abs(F.col("y") - F.col("prediction")) / F.col("se")).alias("score"))
    n = top.count()
    k = int(np.ceil((n + 1) * (1 - alpha)))
    if k > n:
        raise ValueError("there are too few calibration units for this level")
    return float(top.orderBy("score").limit(k).agg(F.max("score")).first()[0])


def conformal_band(targets: DataFrame, fit_: SparseFit, cutoff: float, critical: float) -> DataFrame:
    """The calibrated band of new curves."""
    p = partial_prediction(targets, fit_, cutoff)
    return p.withColumns({"lower": F.col("prediction") - critical * F.col("se"), "upper": F.col("prediction") + critical * F.col("se")})


def held_out_loss(samples: DataFrame, fit_: SparseFit) -> tuple[float, int]:
    """Sum over curves of the Gaussian negative log likelihood under a fit, and the number of values."""

    def run(batches):
        for b in batches:
            if len(b):
                totals, _, _, logs, quad = posterior(fit_, matrix(b.column(1)))
                loss = 0.5 * (totals[:, 0] * np.log(2 * np.pi) + totals[:, 2] + logs + totals[:, 1] + quad)
                yield pa.RecordBatch.from_arrays([pa.array([float(loss.sum())]), pa.array([int(totals[:, 0].sum())])], ["loss", "n"])

    rows = on_support(samples, fit_.grid, fit_.dims, "restrict")
    r = add_up(observation_sums(rows, fit_).mapInArrow(run, "loss double, n long")).first()
    return (r.loss, r.n) if r else (float("nan"), 0)


def select_bandwidths(samples: DataFrame, grid: np.ndarray, n_components: int, mean_bandwidths: list[float], covariance_bandwidths: list[float], folds: int = 3, unit: str = CURVE, seed: int = 0, **how) -> pd.DataFrame:
    """Held-out loss per value of every pair of bandwidths and fold; fits that fail keep a row with their error.

    Units are dealt to folds by their hash.  The best pair has the least mean loss over folds (``best_bandwidths``).
    """
    fold = F.pmod(F.xxhash64(unit, F.lit(seed)), F.lit(folds))
    rows = []
    for f in range(folds):
        train, test = samples.where(fold != f), samples.where(fold == f)
        for hm in mean_bandwidths:
            for hc in covariance_bandwidths:
                try:
                    loss, n = held_out_loss(test, fit(train, grid, n_components, hm, hc, **how))
                    rows.append((f, hm, hc, loss / max(n, 1), None))
                except ValueError as e:
                    rows.append((f, hm, hc, None, str(e)))
    return pd.DataFrame(rows, columns=["fold", "mean_bandwidth", "covariance_bandwidth", "loss", "failure"])


def best_bandwidths(table: pd.DataFrame, min_folds: int | None = None) -> tuple[float, float]:
    """The pair of least mean loss among those valid in ``min_folds`` folds (all, if not given)."""
    s = table.groupby(["mean_bandwidth", "covariance_bandwidth"])["loss"].agg(["mean", "count"])
    s = s[s["count"] >= (min_folds or table["fold"].nunique())]
    if s.empty:
        raise ValueError("no pair of bandwidths is valid in enough folds")
    return tuple(float(x) for x in s["mean"].idxmin())


@dataclass(frozen=True)
class MultilevelFit:
    """Levels as two fits of one mean: participants' functions (between) and trials' (within); the noise is the within fit's."""

    between: SparseFit
    within: SparseFit


def fit_multilevel(samples: DataFrame, grid: np.ndarray, participant: str, between_components: int, within_components: int, mean_bandwidth: float, covariance_bandwidth: float, value: str = "x", noise: float | None = None, support: str = "error", psd: str = "project", min_pairs: int = 6) -> MultilevelFit:
    """Between covariance from products of a participant's different curves, total from products within curves; within is their difference."""
    grid = np.asarray(grid, float)
    rows = on_support(samples, grid, (value,), support)
    mean = mean_function(rows, value, grid, mean_bandwidth)
    res, e, degree = _residuals(rows, (value,), grid, mean[None]), (f"e_{value}",), 4
    curve = pair_moments(res, grid, covariance_bandwidth, e, degree)[0, 0]
    within_all = pair_moments(res, grid, covariance_bandwidth, e, degree, CURVE, True)[0, 0]
    people = pair_moments(res, grid, covariance_bandwidth, e, degree, participant, True)[0, 0]
    cross = {k: people[k] - within_all[k] for k in people}
    sym = lambda m: (m + m.T) / 2
    total, between = sym(plane_surface(curve, min_pairs)), sym(plane_surface(cross, min_pairs))
    sigma = measurement_error(noise, 1) if noise is not None else np.array([[noise_variance(res, e[0], grid, rotated_diagonal(curve, min_pairs), covariance_bandwidth)]])
    w = trapezoid_weights(grid)
    out = []
    for cov, k in ((between, between_components), (total - between, within_components)):
        fixed, audit = audited_psd(cov, w, psd)
        ev, phi = eigenfunctions(fixed, w, k)
        out.append(SparseFit(grid, (value,), mean[None], fixed, sigma, ev, phi, audit))
    return MultilevelFit(*out)


def multilevel_scores(samples: DataFrame, m: MultilevelFit, participant: str) -> tuple[DataFrame, DataFrame]:
    """Joint conditional scores of participants and trials: (participant, scores) and (curve_id, participant, scores).

    A trial passes its sums, less what its own level explains, to its participant; participants' functions come back to
    their trials.  No participant's samples are put together in one task.
    """
    b, t = m.between, m.within
    rows = on_support(samples, t.grid, t.dims, "restrict")
    sums = observation_sums(rows, t, CURVE, (participant,))
    cells, lw, lb = len(t.grid) - 1, t.root, b.root
    g = cells + 1

    def up(batches):
        for x in batches:
            if not len(x):
                continue
            _, normal, right = unfold(matrix(x.column(1)), cells, 1)
            inner = np.linalg.inv(np.eye(lw.shape[1]) + lw.T @ normal @ lw)
            nl = normal @ lw
            left = normal - nl @ inner @ np.swapaxes(nl, 1, 2)
            side = right - np.einsum("ngi,nij,nj->ng", nl, inner, right @ lw)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(left.reshape(len(left), -1).tolist(), pa.list_(pa.float64())), pa.array(side.tolist(), pa.list_(pa.float64()))], [participant, "left", "side"])

    kind, curve_kind = dict(samples.dtypes)[participant], dict(samples.dtypes)[CURVE]
    people = add_up(sums.select(participant, "v").mapInArrow(up, f"`{participant}` {kind}, left array<double>, side array<double>"), [participant])
    wb = b.phi.reshape(len(b.phi), -1) * b.weights

    def solve(batches):
        for x in batches:
            if not len(x):
                continue
            left, side = matrix(x.column(1)).reshape(-1, g, g), matrix(x.column(2))
            c = np.linalg.solve(np.eye(lb.shape[1]) + lb.T @ left @ lb, (side @ lb)[:, :, None])[:, :, 0]
            f = c @ lb.T
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array((f @ wb.T).tolist(), pa.list_(pa.float64())), pa.array(f.tolist(), pa.list_(pa.float64()))], [participant, "scores", "curve"])

    upper = people.select(participant, "left", "side").mapInArrow(solve, f"`{participant}` {kind}, scores array<double>, curve array<double>")
    wt = t.phi.reshape(len(t.phi), -1) * t.weights

    def down(batches):
        for x in batches:
            if not len(x):
                continue
            _, normal, right = unfold(matrix(x.column(2)), cells, 1)
            rest = right - np.einsum("ngh,nh->ng", normal, matrix(x.column(3)))
            c = np.linalg.solve(np.eye(lw.shape[1]) + lw.T @ normal @ lw, (rest @ lw)[:, :, None])[:, :, 0]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array((c @ lw.T @ wt.T).tolist(), pa.list_(pa.float64()))], [CURVE, participant, "scores"])

    joined = sums.join(upper.select(participant, "curve"), participant).select(CURVE, participant, "v", "curve")
    lower = joined.mapInArrow(down, f"{CURVE} {curve_kind}, `{participant}` {kind}, scores array<double>")
    return upper.select(participant, "scores"), lower


def with_components(fit_: SparseFit, k: int) -> SparseFit:
    """The fit with another number of components."""
    ev, phi = eigenfunctions(fit_.cov, fit_.weights, k, len(fit_.dims))
    return replace(fit_, eigenvalues=ev, phi=phi)
