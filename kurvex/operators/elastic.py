"""Elastic components of curves in the plane or space: time warps apart from shapes.

A curve is represented by its square-root velocity, for which warping time is an isometry.  Each round every curve is warped to
the template by dynamic programming, in batches of curves inside a task, and the warped ones are averaged; the template, which
has the size of the grid, is all that is broadcast.  In the end the mean warp is made the identity, and components are
those of the aligned square-root velocities.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import dropped, stored
from ..functions.sums import add_up, matrix
from .decomposition import Decomposition, fit_fpca, trapezoid_weights

CURVE = "curve_id"
#: Longest step of a warp on the grid, in either direction.
REACH = 4
#: Curves that are aligned together in a task.
TOGETHER = 64


def square_root_velocity(curves: np.ndarray, time: np.ndarray) -> np.ndarray:
    """(curves, times, dims) to velocity over the root of its length; zero where nothing moves."""
    v = np.gradient(curves, time, axis=1)
    return v / np.sqrt(np.maximum(np.linalg.norm(v, axis=2, keepdims=True), 1e-12))


def steps(reach: int = REACH) -> list[tuple[int, int]]:
    """Moves (template, curve) of a warp, in the order in which they win ties: the plain one, then by size."""
    moves = [(k, m) for k in range(1, reach + 1) for m in range(1, reach + 1) if gcd(k, m) == 1]
    return sorted(moves, key=lambda x: (x[0] + x[1], x))


def _segments(mean: np.ndarray, q: np.ndarray, k: int, m: int, lam: float) -> np.ndarray:
    """Cost (curves, i, j) of the move from (i, j) to (i + k, j + m): squared distance along it by trapezoids, and its bend."""
    t = n = len(mean)
    root = np.sqrt(m / k)
    h = 1.0 / (t - 1)
    cost = np.full((len(q), t - k, n - m), lam * k * h * (1 - root) ** 2)
    for s in range(k + 1):
        weight = h * (0.5 if s in (0, k) else 1.0)
        low, part = divmod(s * m, k)
        at = q[:, low : low + n - m] if not part else q[:, low : low + n - m] * (1 - part / k) + q[:, low + 1 : low + 1 + n - m] * (part / k)
        target = mean[s : s + t - k]
        cost += weight * ((target**2).sum(1)[None, :, None] + (m / k) * (at**2).sum(2)[:, None, :] - 2 * root * np.einsum("id,bjd->bij", target, at))
    return cost


def align(mean: np.ndarray, q: np.ndarray, lam: float = 0.0, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Best warps of every curve to the template, on the unit interval, and their costs.

    A warp is a chain of ``steps`` from the first to the last grid point, linear inside a step; of equal chains the one
    whose last steps come first in ``steps`` is taken.
    """
    b, t = len(q), len(mean)
    moves = steps(reach)
    costs = [_segments(mean, q, k, m, lam) for k, m in moves]
    total, back = np.full((b, t, t), np.inf), np.zeros((b, t, t), np.int8)
    total[:, 0, 0] = 0.0
    for i in range(1, t):
        for s, ((k, m), cost) in enumerate(zip(moves, costs, strict=True)):
            if k > i:
                continue
            found = total[:, i - k, : t - m] + cost[:, i - k]
            better = found < total[:, i, m:]
            total[:, i, m:] = np.where(better, found, total[:, i, m:])
            back[:, i, m:] = np.where(better, s, back[:, i, m:])
    grid, warps = np.linspace(0, 1, t), np.empty((b, t))
    for c in range(b):
        i = j = t - 1
        knots = [(i, j)]
        while i > 0:
            k, m = moves[back[c, i, j]]
            i, j = i - k, j - m
            knots.append((i, j))
        a = np.array(knots[::-1]) / (t - 1)
        warps[c] = np.interp(grid, a[:, 0], a[:, 1])
    return warps, total[:, -1, -1]


def slopes(warps: np.ndarray) -> np.ndarray:
    return np.maximum(np.gradient(warps, 1.0 / (warps.shape[1] - 1), axis=1), 0.0)


def at_warp(values: np.ndarray, warps: np.ndarray) -> np.ndarray:
    """Each curve's values at its warped times (linear between grid points)."""
    n = values.shape[1] - 1
    at = np.clip(warps * n, 0, n)
    low = np.minimum(at.astype(int), n - 1)
    part = (at - low)[:, :, None]
    rows = np.arange(len(values))[:, None]
    return values[rows, low] * (1 - part) + values[rows, low + 1] * part


def warped(q: np.ndarray, warps: np.ndarray) -> np.ndarray:
    """Square-root velocities of the warped curves."""
    return at_warp(q, warps) * np.sqrt(slopes(warps))[:, :, None]


@dataclass(frozen=True)
class ElasticFit:
    """Template and mean of the aligned square-root velocities (times, dims), components, and how the rounds ended."""

    time: np.ndarray
    dims: int
    template: np.ndarray
    centre: np.ndarray
    components: Decomposition
    lam: float
    reach: int
    rotation: bool
    scale_curves: bool
    rounds: int
    change: float
    curves: int


def _turned(q: np.ndarray, mean: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rotations (no reflections) that bring each curve nearest to the template."""
    u, _, v = np.linalg.svd(np.einsum("t,td,bte->bde", weights, mean, q))
    sign = np.ones((len(q), q.shape[2]))
    sign[:, -1] = np.sign(np.linalg.det(u @ v))
    return np.einsum("bij,bj,bjk->bik", u, sign, v)


def _each(rows: DataFrame, extra: list[str], schema: str, names: list[str], run) -> DataFrame:
    """``run(values, columns)`` over batches of at most ``TOGETHER`` curves; it returns columns."""

    def batches(found):
        for b in found:
            for at in range(0, len(b), TOGETHER):
                part = b.slice(at, TOGETHER)
                yield pa.RecordBatch.from_arrays(run(matrix(part.column(0)), [part.column(k + 1) for k in range(len(extra))]), names)

    return rows.select("values", *extra).mapInArrow(batches, schema)


def _lists(m: np.ndarray) -> pa.Array:
    m = m.reshape(len(m), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


class _Kernel:
    """What a task does with a batch of curves, given template and settings."""

    def __init__(self, time: np.ndarray, dims: int, template: np.ndarray | None, lam: float, reach: int, rotation: bool, scale: bool, centre: np.ndarray | None = None):
        self.time, self.dims, self.template, self.lam, self.reach, self.rotation, self.scale, self.centre = time, dims, template, lam, reach, rotation, scale, centre
        self.weights = trapezoid_weights(np.linspace(0, 1, len(time)))

    def velocities(self, values: np.ndarray) -> np.ndarray:
        q = square_root_velocity(values.reshape(len(values), len(self.time), self.dims), np.linspace(0, 1, len(self.time)))
        return q / np.sqrt(np.maximum(np.einsum("t,btd->b", self.weights, q**2), 1e-12))[:, None, None] if self.scale else q

    def aligned(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Warps, aligned square-root velocities, rotations and costs."""
        q = self.velocities(values)
        turn = np.tile(np.eye(self.dims), (len(q), 1, 1))
        if self.rotation:
            turn = _turned(q, self.template, self.weights)
            q = np.einsum("bij,btj->bti", turn, q)
        warps, cost = align(self.template, q, self.lam, self.reach)
        if self.rotation:  # once more, for the warped curve
            more = _turned(warped(q, warps), self.template, self.weights)
            q, turn = np.einsum("bij,btj->bti", more, q), more @ turn
        if self.centre is not None:
            grid = np.linspace(0, 1, len(self.time))
            warps = np.stack([np.interp(self.centre, grid, w) for w in warps])
        return warps, warped(q, warps), turn, cost


def fit_elastic_fpca(arrays: DataFrame, time: np.ndarray, n_components: int = 3, dims: int = 2, lam: float = 0.0, rotation: bool = False, scale_curves: bool = False, reach: int = REACH, rounds: int = 20, tolerance: float = 1e-3) -> ElasticFit:
    """Template, centring warp and components of curves (curve_id, values: dimensions interleaved on an equidistant grid).

    ``lam`` penalises warps that bend; rotation and scale are kept unless asked for.  An error if curves are incomplete, have
    fewer than two dimensions, if the grid isn't equidistant, or if after ``rounds`` the sum of squared distances to the template still
    falls by a share of ``tolerance`` or more; it never rises.
    """
    time = np.asarray(time, float)
    if dims < 2:
        raise ValueError("elastic analysis needs curves of two dimensions or more")
    if n_components < 1 or lam < 0 or rounds < 1:
        raise ValueError("n_components and rounds are positive, lam isn't negative")
    if len(time) < 3 or not np.allclose(np.diff(time), time[1] - time[0]):
        raise ValueError("elastic analysis needs an equidistant grid of three times or more")
    size = len(time) * dims
    if not arrays.where((F.size("values") != size) | F.exists("values", lambda v: v.isNull() | F.isnan(v))).isEmpty():
        raise ValueError("elastic analysis needs complete curves on the common grid")
    names = ["n", "cost", "s", "p"]
    schema = "n double, cost double, s array<double>, p array<double>"

    def mean_of(kernel: _Kernel, first: bool = False):
        def run(values, _):
            if first:
                q = kernel.velocities(values)
                psi, cost = np.ones((1, len(time))), np.zeros(1)
            else:
                warps, q, _, cost = kernel.aligned(values)
                psi = np.sqrt(slopes(warps))
            return [pa.array([float(len(values))]), pa.array([float(cost.sum())]), _lists(q.sum(0)[None]), _lists(psi.sum(0)[None])]

        r = add_up(_each(arrays, [], schema, names, run)).first()
        if r is None:
            raise ValueError("there are no curves")
        return int(r.n), np.asarray(r.s).reshape(len(time), dims) / r.n, np.asarray(r.p) / r.n, r.cost

    kernel = lambda template, centre=None: _Kernel(time, dims, template, lam, reach, rotation, scale_curves, centre)
    count, template, _, _ = mean_of(kernel(None), True)
    change, before, done = np.inf, np.inf, 0
    for done in range(1, rounds + 1):
        _, template, psi, cost = mean_of(kernel(template))
        change = 0.0 if cost <= 0 else float((before - cost) / cost)
        before = cost
        if change < tolerance:
            break
    if change >= tolerance:
        raise RuntimeError(f"the squared distances to the template still fall by {change:.3g} of their sum after {rounds} rounds")
    # the mean warp, by the mean root of the slopes, and its inverse
    grid = np.linspace(0, 1, len(time))
    speed = np.maximum(psi, 1e-6) ** 2
    mean_warp = np.concatenate(([0.0], np.cumsum((speed[1:] + speed[:-1]) / 2)))
    centre = np.interp(grid, mean_warp / mean_warp[-1], grid)
    final = kernel(template, centre)
    kind = dict(arrays.dtypes)[CURVE]
    aligned = stored(_each(arrays, [CURVE], f"{CURVE} {kind}, values array<double>", [CURVE, "values"], lambda values, more: [more[0], _lists(final.aligned(values)[1])]), "aligned")
    components = fit_fpca(aligned, grid, n_components, dims)
    dropped(aligned)
    return ElasticFit(time, dims, template, centre, components, lam, reach, rotation, scale_curves, done, change, count)


def elastic_scores(arrays: DataFrame, fit: ElasticFit) -> DataFrame:
    """Per curve: scores of the aligned square-root velocities, the warp (in units of time), the aligned curve, and amplitude and phase distance.

    The aligned curve is the given one at warped times (turned, with ``rotation``); the amplitude distance is to the template, the
    phase distance the angle between the warp's root slope and that of standing still.
    """
    kernel = _Kernel(fit.time, fit.dims, fit.template, fit.lam, fit.reach, fit.rotation, fit.scale_curves, fit.centre)
    grid, t0, t1 = np.linspace(0, 1, len(fit.time)), fit.time[0], fit.time[-1]
    weights = kernel.weights
    mean, basis = fit.components.mean, fit.components.basis

    def run(values, more):
        warps, q, turn, cost = kernel.aligned(values)
        curves = at_warp(values.reshape(len(values), len(grid), fit.dims), warps)
        curves = np.einsum("bij,btj->bti", turn, curves)
        phase = np.arccos(np.clip(np.sqrt(slopes(warps)) @ weights, -1, 1))
        scores = (q.reshape(len(q), -1) - mean) @ basis
        return [more[0], _lists(scores), _lists(t0 + warps * (t1 - t0)), _lists(curves), pa.array(np.sqrt(np.maximum(cost, 0))), pa.array(phase)]

    kind = dict(arrays.dtypes)[CURVE]
    lists = ", ".join(f"{c} array<double>" for c in ("scores", "warp", "aligned"))
    return _each(arrays, [CURVE], f"{CURVE} {kind}, {lists}, amplitude double, phase double", [CURVE, "scores", "warp", "aligned", "amplitude", "phase"], run)
