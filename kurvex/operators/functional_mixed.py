"""Functional mixed effects: spline coefficient functions with random functions of participants and trials.

On a common grid all curves share one residual-and-trial covariance A, so a participant enters the likelihood only by the
sums of z z' and z y' over their curves (z: 1 and the predictors).  These sums are added up once and stored; a likelihood is
one pass over participants, and a pass takes as many parameter vectors as wanted: exact gradients, line searches,
and all replicates of a full-refit bootstrap go together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import clamped_spline, draws, simultaneous
from ..functions.shared import stored
from ..functions.sums import add_up, gram, matrix, replicate_grams, scalars


@dataclass(frozen=True)
class Layout:
    """Grid, bases and what is random: participants' intercept functions and those of the listed predictors, trials' functions."""

    time: np.ndarray
    names: tuple[str, ...]
    fixed: np.ndarray
    random: np.ndarray
    slopes: tuple[int, ...] = ()
    trial: np.ndarray | None = None
    correlation: str = "iid"

    @property
    def at(self) -> list[int]:
        return [0, *self.slopes]

    @property
    def d(self) -> int:
        return len(self.at) * self.random.shape[1]

    @property
    def sizes(self) -> tuple[int, int, int]:
        """Numbers of parameters: participants' factor, trials' factor, correlation."""
        t = 0 if self.trial is None else self.trial.shape[1]
        return self.d * (self.d + 1) // 2, t * (t + 1) // 2, int(self.correlation != "iid")

    def unpack(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, float, float | None]:
        """Factor of participants' covariance, factor of trials', residual deviation, correlation parameter."""
        a, b, c = self.sizes
        t = None if self.trial is None else _factor(theta[a : a + b], self.trial.shape[1])
        rho = None if not c else float(np.exp(theta[-1])) if self.correlation == "exponential" else float(np.tanh(theta[-1]))
        return _factor(theta[:a], self.d), t, float(np.exp(theta[a + b])), rho

    def residual(self, rho: float | None) -> np.ndarray:
        n = len(self.time)
        if self.correlation == "iid":
            return np.eye(n)
        if self.correlation == "exponential":
            return np.exp(-np.abs(self.time[:, None] - self.time[None, :]) / rho)
        if self.correlation == "ar1":
            return rho ** np.abs(np.arange(n)[:, None] - np.arange(n)[None, :])
        raise ValueError("the residual correlation is iid, exponential or ar1")

    def within(self, theta: np.ndarray) -> np.ndarray:
        """Covariance of a curve given its participant: trial function and residual."""
        _, t, sd, rho = self.unpack(theta)
        a = sd * sd * self.residual(rho)
        return a if t is None else a + (self.trial @ t) @ (self.trial @ t).T


    def chained(self, theta: np.ndarray, by_g: np.ndarray, by_a: np.ndarray) -> np.ndarray:
        """Derivatives by the parameters, given those by participants' covariance and by the curves' covariance (both symmetric)."""
        factor, t, sd, rho = self.unpack(theta)
        parts = [_by_factor(2 * by_g @ factor, factor)]
        if t is not None:
            parts.append(_by_factor(2 * self.trial.T @ by_a @ self.trial @ t, t))
        parts.append([2 * sd * sd * (by_a * self.residual(rho)).sum()])
        if self.correlation == "exponential":
            gap = np.abs(self.time[:, None] - self.time[None, :])
            parts.append([sd * sd * (by_a * self.residual(rho) * gap).sum() / rho])
        elif self.correlation == "ar1":
            lag = np.abs(np.subtract.outer(np.arange(len(self.time)), np.arange(len(self.time))))
            parts.append([sd * sd * (by_a * lag * rho ** np.maximum(lag - 1, 0)).sum() * (1 - rho * rho)])
        return np.concatenate(parts)


def _by_factor(g: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Derivatives by the entries of a factor as derivatives by its parameters."""
    g = g.copy()
    g[np.diag_indices(len(g))] *= np.diag(factor)
    return g[np.tril_indices(len(g))]


def _factor(theta: np.ndarray, d: int) -> np.ndarray:
    """Lower triangle with positive diagonal (logarithms) of a covariance factor."""
    out = np.zeros((d, d))
    out[np.tril_indices(d)] = theta
    out[np.diag_indices(d)] = np.exp(np.clip(np.diag(out), -20, 20))
    return out


def layout(time: np.ndarray, predictors: list[str], fixed_size: int = 6, random_size: int = 4, random_slope: str | None = None, trial_size: int = 0, correlation: str = "iid", degree: int = 3) -> Layout:
    basis = lambda k: clamped_spline(time, k, min(degree, k - 1))
    slopes = () if random_slope is None else (1 + predictors.index(random_slope),)
    return Layout(np.asarray(time, float), ("intercept", *predictors), basis(fixed_size), basis(random_size), slopes, basis(trial_size) if trial_size else None, correlation)


@dataclass(frozen=True)
class MixedFit:
    """Fixed coefficients (names x basis), their information, parameters, likelihood, size of the data."""

    layout: Layout
    beta: np.ndarray
    information: np.ndarray
    theta: np.ndarray
    loss: float
    participants: int
    curves: int
    reml: bool
    iterations: int
    boundary: bool
    decrement: float
    stats: DataFrame = field(repr=False, default=None)

    @property
    def functions(self) -> np.ndarray:
        return self.beta @ self.layout.fixed.T

    @property
    def errors(self) -> np.ndarray:
        c, k, b = np.linalg.inv(self.information), self.layout.fixed.shape[1], self.layout.fixed
        return np.sqrt(np.maximum([np.einsum("ti,ij,tj->t", b, c[j * k : (j + 1) * k, j * k : (j + 1) * k], b) for j in range(len(self.beta))], 0))


def participant_sums(arrays: DataFrame, predictors: list[str], participant: str) -> DataFrame:
    """(u, n, zz, zy): per participant the number of curves and the sums of z z' and z y', pre-aggregated in every task."""
    rows = arrays.select(F.xxhash64(participant).alias("u"), F.concat(F.array(F.lit(1.0)), scalars(*predictors)).alias("z"), F.col("values").alias("y"))

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            z, y = matrix(b.column(1)), matrix(b.column(2))
            u, inv = np.unique(np.asarray(b.column(0)), return_inverse=True)
            zz, zy = np.zeros((len(u), z.shape[1] ** 2)), np.zeros((len(u), z.shape[1] * y.shape[1]))
            np.add.at(zz, inv, np.einsum("np,nq->npq", z, z).reshape(len(z), -1))
            np.add.at(zy, inv, np.einsum("np,nt->npt", z, y).reshape(len(z), -1))
            lists = lambda m: pa.array(m.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.bincount(inv).astype(float)), lists(zz), lists(zy)], ["u", "n", "zz", "zy"])

    return add_up(rows.mapInArrow(run, "u long, n double, zz array<double>, zy array<double>"), ["u"])


def _contributions(lay: Layout, theta: np.ndarray, zz: np.ndarray, zy: np.ndarray):
    """Per participant: information and score of the fixed effects, and what determinant and quadratic form get beyond A's."""
    factor = lay.unpack(theta)[0]
    a = np.linalg.inv(lay.within(theta))
    fixed, random = a @ lay.fixed, a @ lay.random
    at, p = lay.at, len(zz)
    kron = lambda s, f: np.einsum("npq,ab->npaqb", s, f).reshape(p, s.shape[1] * f.shape[0], -1)
    xx, xz, c = kron(zz, lay.fixed.T @ fixed), kron(zz[:, :, at], lay.fixed.T @ random), kron(zz[:, at][:, :, at], lay.random.T @ random)
    xy, zty = (zy @ fixed).reshape(p, -1), (zy[:, at] @ random).reshape(p, -1)
    q = np.eye(lay.d) + factor.T @ c @ factor
    dx, e = xz @ factor, zty @ factor
    inner = np.linalg.solve(q, np.concatenate((np.swapaxes(dx, 1, 2), e[:, :, None]), 2))
    info = xx - dx @ inner[:, :, :-1]
    score = xy - np.einsum("npd,nd->np", dx, inner[:, :, -1])
    return info, score, np.linalg.slogdet(q)[1], -np.einsum("nd,nd->n", e, inner[:, :, -1])


@dataclass(frozen=True)
class _Point:
    """What a likelihood's gradient needs besides the participants: coefficients and the inverse of their information."""

    theta: np.ndarray
    beta: np.ndarray
    inverse: np.ndarray


def _curvature_sums(lay: Layout, at: _Point, zz: np.ndarray, zy: np.ndarray, w: np.ndarray, reml: bool) -> list[np.ndarray]:
    """Weighted sums over participants from which the derivatives by both covariances follow (see ``_Likelihood.gradients``).

    A curve's prediction and the columns that restricted likelihood adds are combinations of the fixed and the random basis,
    so all sums are small matrices of their coefficients.
    """
    factor, f, r, q, p = lay.unpack(at.theta)[0], lay.fixed, lay.random, len(lay.names), len(zz)
    a = np.linalg.inv(lay.within(at.theta))
    k, m, cols = f.shape[1], r.shape[1], lay.at
    kron = lambda s, g: np.einsum("npq,ab->npaqb", s, g).reshape(p, s.shape[1] * g.shape[0], -1)
    xz, c = kron(zz[:, :, cols], f.T @ a @ r), kron(zz[:, cols][:, :, cols], r.T @ a @ r)
    h = factor @ np.linalg.solve(np.eye(lay.d) + factor.T @ c @ factor, np.broadcast_to(factor.T, (p, lay.d, lay.d)))
    beta = at.beta.reshape(q, k)
    e = ((zy[:, cols] - zz[:, cols] @ (beta @ f.T)) @ a @ r).reshape(p, -1)
    b = np.einsum("nij,nj->ni", h, e)
    u = e - np.einsum("nij,nj->ni", c, b)
    by_effect = c - c @ h @ c - u[:, :, None] * u[:, None, :]
    d = h @ np.swapaxes(xz, 1, 2)
    both = np.zeros((p, q, k + m))  # coefficients of the prediction of every predictor
    both[:, :, :k] = beta
    both[:, cols, k:] += b.reshape(p, len(cols), m)
    columns = np.zeros((p, q, k + m, q * k))
    for i in range(q):
        columns[:, i, :k, i * k : (i + 1) * k] = np.eye(k)
    columns[:, cols, k:] -= d.reshape(p, len(cols), m, q * k)
    restricted = np.zeros((k + m, k + m))
    if reml:
        n = np.swapaxes(xz, 1, 2) - c @ d
        by_effect = by_effect - n @ at.inverse @ np.swapaxes(n, 1, 2)
        restricted = np.einsum("n,nij,nixs,st,njyt->xy", w, zz, columns, at.inverse, columns, optimize=True)
    spread = np.einsum("n,nij,niajb->ab", w, zz[:, cols][:, :, cols], h.reshape(p, len(cols), m, len(cols), m), optimize=True)
    cross = np.einsum("n,nix,nit->xt", w, both, zy, optimize=True)
    return [np.tensordot(w, by_effect, 1), spread, cross, np.einsum("n,nix,nij,njy->xy", w, both, zz, both, optimize=True), restricted]


class _Likelihood:
    """Losses of parameter vectors; each belongs to a replicate (0 and weights of one without bootstrap)."""

    def __init__(self, lay: Layout, stats: DataFrame, yy: np.ndarray, curves: np.ndarray, reml: bool, replicates: int = 0, seed: int = 0):
        self.lay, self.stats, self.yy, self.curves, self.reml, self.replicates, self.seed = lay, stats, yy, curves, reml, replicates, seed

    def _sums(self, of: np.ndarray, width: int, part) -> np.ndarray:
        """One pass: for each of the parameter vectors the sum of ``part(index, zz, zy, weights)`` over all participants."""
        q, t, replicates, seed = len(self.lay.names), len(self.lay.time), self.replicates, self.seed

        def run(batches):
            total, seen = np.zeros((len(of), width)), False
            for b in batches:
                if not len(b):
                    continue
                seen = True
                w = draws(np.asarray(b.column(0)), replicates, seed, "poisson") if replicates else np.ones((len(b), 1))
                zz, zy = matrix(b.column(1)).reshape(-1, q, q), matrix(b.column(2)).reshape(-1, q, t)
                for j in range(len(of)):
                    total[j] += part(j, zz, zy, w[:, of[j]])
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["s"])

        return np.asarray(add_up(self.stats.select("u", "zz", "zy").mapInArrow(run, "s array<double>")).first().s).reshape(len(of), width)

    def __call__(self, thetas: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, list]:
        """Loss of each vector, and its (beta, information) where it is finite."""
        lay, t = self.lay, len(self.lay.time)
        size = len(lay.names) * lay.fixed.shape[1]

        def part(j, zz, zy, w):
            with np.errstate(all="ignore"):  # a step into nowhere has an infinite loss
                info, score, logs, quad = _contributions(lay, thetas[j], zz, zy)
                return np.concatenate((np.tensordot(w, info, 1).ravel(), w @ score, [w @ logs, w @ quad]))

        s = self._sums(of, size * size + size + 2, part)
        losses, states = np.full(len(thetas), np.inf), [None] * len(thetas)
        for j, theta in enumerate(thetas):
            info, score = s[j, : size * size].reshape(size, size), s[j, size * size : -2]
            cov = lay.within(theta)
            sign, det = np.linalg.slogdet(info)
            if sign <= 0 or not np.isfinite(s[j]).all():
                continue
            beta, curves = np.linalg.solve(info, score), self.curves[of[j]]
            quad = np.trace(np.linalg.solve(cov, self.yy[of[j]])) + s[j, -1] - beta @ score
            n = curves * t
            losses[j] = 0.5 * (curves * np.linalg.slogdet(cov)[1] + s[j, -2] + quad + ((det + (n - size) * np.log(2 * np.pi)) if self.reml else n * np.log(2 * np.pi)))
            states[j] = (beta, info)
        return losses, states

    def gradients(self, thetas: np.ndarray, states: list, of: np.ndarray) -> np.ndarray:
        """Derivatives of the losses: by participants' covariance G, by the curves' covariance A, then by what both are made of."""
        lay, reml = self.lay, self.reml
        points = [_Point(x, beta, np.linalg.inv(info)) for x, (beta, info) in zip(thetas, states, strict=True)]
        d, t, k, m = lay.d, len(lay.time), lay.fixed.shape[1], lay.random.shape[1]
        shapes = [(d, d), (m, m), (k + m, t), (k + m, k + m), (k + m, k + m)]
        sizes = [x * y for x, y in shapes]
        s = self._sums(of, sum(sizes), lambda j, zz, zy, w: np.concatenate([x.ravel() for x in _curvature_sums(lay, points[j], zz, zy, w, reml)]))
        basis = np.concatenate((lay.fixed, lay.random), 1)
        out = np.zeros_like(thetas)
        for j, theta in enumerate(thetas):
            by_g, spread, cross, square, restricted = (x.reshape(shape) for x, shape in zip(np.split(s[j], np.cumsum(sizes)[:-1]), shapes, strict=True))
            a = np.linalg.inv(lay.within(theta))
            rest = self.yy[of[j]] - basis @ cross - (basis @ cross).T + basis @ (square + restricted) @ basis.T
            by_a = 0.5 * (self.curves[of[j]] * a - a @ (lay.random @ spread @ lay.random.T + rest) @ a)
            out[j] = lay.chained(theta, 0.5 * by_g, by_a)
        return out


#: Step lengths that a line search tries in its one pass.
_LENGTHS = 2.0 ** np.arange(3, -11, -1)


def _minimise(f: _Likelihood, start: np.ndarray, iterations: int, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, list, int, np.ndarray]:
    """Newton steps of every replicate at once: a pass for all step lengths, two for all gradients and their differences.

    A replicate has converged when half of its Newton decrement, the decrease of the loss that a full step promises, is under
    ``tolerance``; it then costs nothing more.  Directions of no curvature, as on the way to a variance of zero, move by the gradient.
    Returned: parameters, losses, states, iterations, and that decrement of every replicate.
    """
    r, d = start.shape
    x, left, decrement, turn = start.copy(), np.arange(r), np.full(r, np.inf), 0
    loss, states = f(x, left)
    if any(state is None for state in states):
        raise RuntimeError("the likelihood has no finite value at the start")
    for turn in range(1, iterations + 1):
        near = (x[left, None] + 1e-4 * np.eye(d)).reshape(-1, d)
        of = np.repeat(left, d)
        beside = f(near, of)[1]
        slopes = f.gradients(np.concatenate((x[left], near)), [*(states[i] for i in left), *beside], np.concatenate((left, of)))
        gradient, around = slopes[: len(left)], slopes[len(left) :].reshape(-1, d, d)
        second = (around - gradient[:, None]) / 1e-4
        value, vector = np.linalg.eigh((second + np.swapaxes(second, 1, 2)) / 2)
        direction = -np.einsum("rik,rk,rjk,rj->ri", vector, 1 / np.maximum(np.abs(value), 1e-6), vector, gradient)
        decrement[left] = -0.5 * np.einsum("ri,ri->r", direction, gradient)
        going = decrement[left] >= tolerance
        left, direction = left[going], direction[going]
        if not len(left):
            break
        direction *= np.minimum(1, 4 / np.maximum(np.abs(direction).max(1), 1e-12))[:, None]
        losses, found = f((x[left, None, :] + _LENGTHS[None, :, None] * direction[:, None, :]).reshape(-1, d), np.repeat(left, len(_LENGTHS)))
        losses = losses.reshape(len(left), -1)
        best, moved = losses.argmin(1), losses.min(1) < loss[left]
        for k in np.flatnonzero(moved):
            i = left[k]
            x[i], loss[i], states[i] = x[i] + _LENGTHS[best[k]] * direction[k], losses[k, best[k]], found[k * len(_LENGTHS) + best[k]]
        left = left[moved]  # no lower point on the way: the decrement tells how far off it ends
        if not len(left):
            break
    return x, loss, states, turn, decrement


def _start(lay: Layout, deviation: float) -> np.ndarray:
    a, b, c = lay.sizes
    x = np.zeros(a + b + 1 + c)
    for at, d in ((0, lay.d), (a, 0 if lay.trial is None else lay.trial.shape[1])):
        m = np.zeros((d, d))
        m[np.diag_indices(d)] = np.log(deviation / 2)
        x[at : at + d * (d + 1) // 2] = m[np.tril_indices(d)]
    x[a + b] = np.log(deviation)
    if c:
        x[-1] = np.log((lay.time[-1] - lay.time[0]) / 10) if lay.correlation == "exponential" else 0.3
    return x


def fit(arrays: DataFrame, lay: Layout, participant: str, reml: bool = True, iterations: int = 60, tolerance: float = 1e-6) -> MixedFit:
    """Restricted or full maximum likelihood of the covariance parameters, generalised least squares of the coefficients.

    An error if ``iterations`` end before the loss is within ``tolerance`` of its minimum (by half the Newton decrement), or if
    the predictor of a random slope is the same in all curves of some participant.
    """
    predictors = list(lay.names[1:])
    stats = stored(participant_sums(arrays, predictors, participant), "participants")
    participants = stats.count()
    if participants < max(4, len(lay.names) + 1):
        raise ValueError("there are too few participants")
    q = len(lay.names)
    for k in lay.slopes:  # a participant's sums of 1, z and z z, whose spread is to be positive
        n, one, two = (F.element_at("zz", i) for i in (1, k + 1, k * q + k + 1))
        if not stats.where(n * two - one * one <= 1e-10 * n * two).isEmpty():
            raise ValueError(f"{lay.names[k]} has a random slope, but does not vary within every participant")
    g = gram(arrays, F.concat(F.array(F.lit(1.0)), F.col("values")))
    n, t = g[0, 0], len(lay.time)
    deviation = float(np.sqrt(max((np.trace(g[1:, 1:]) - (g[0, 1:] ** 2).sum() / n) / (n * t), 1e-12)))
    f = _Likelihood(lay, stats, g[None, 1:, 1:], np.array([n]), reml)
    x, loss, states, turns, decrement = _minimise(f, _start(lay, deviation)[None], iterations, tolerance)
    if decrement[0] >= tolerance:
        raise RuntimeError(f"the fit has not converged after {turns} iterations: half the Newton decrement is {decrement[0]:.3g}")
    beta, info = states[0]
    ev = np.linalg.eigvalsh(lay.unpack(x[0])[0] @ lay.unpack(x[0])[0].T)
    return MixedFit(lay, beta.reshape(len(lay.names), -1), info, x[0], float(loss[0]), participants, int(n), reml, turns, bool(ev[0] < 1e-6 * max(ev[-1], 1e-12)), float(decrement[0]), stats)


def coefficient_frame(spark: SparkSession, m: MixedFit, draws_: np.ndarray | None = None, level: float = 0.95, scope: str = "each") -> DataFrame:
    """Coefficient functions with model errors or, with draws, bootstrap errors and simultaneous bands about the estimate."""
    f = m.functions
    e = m.errors if draws_ is None else draws_.std(0, ddof=1)
    c = None if draws_ is None else simultaneous(draws_, draws_.mean(0), e, level, scope)
    rows = [(n, float(t), float(f[k, i]), float(e[k, i]), *((None,) * 3 if c is None else (float(c[k]), float(f[k, i] - c[k] * e[k, i]), float(f[k, i] + c[k] * e[k, i])))) for k, n in enumerate(m.layout.names) for i, t in enumerate(m.layout.time)]
    return spark.createDataFrame(rows, "coefficient string, t double, estimate double, se double, critical double, lower double, upper double")


def bootstrap(m: MixedFit, replicates: int = 500, seed: int = 0) -> np.ndarray:
    """Coefficient functions on counts of whole participants, covariances held at the fit: weighted sums of participants' blocks."""
    lay, q, t = m.layout, len(m.layout.names), len(m.layout.time)
    size, theta = m.information.shape[0], m.theta

    def run(batches):
        total = None
        for b in batches:
            if len(b):
                info, score, _, _ = _contributions(lay, theta, matrix(b.column(1)).reshape(-1, q, q), matrix(b.column(2)).reshape(-1, q, t))
                w = draws(np.asarray(b.column(0)), replicates, seed, "poisson")
                part = w.T @ np.concatenate((info.reshape(len(info), -1), score), 1)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["s"])

    s = np.asarray(add_up(m.stats.select("u", "zz", "zy").mapInArrow(run, "s array<double>")).first().s).reshape(replicates, -1)
    beta = np.stack([np.linalg.solve(r[: size * size].reshape(size, size), r[size * size :]) for r in s])
    return beta.reshape(replicates, q, -1) @ lay.fixed.T


def full_refit(m: MixedFit, arrays: DataFrame, participant: str, replicates: int = 20, seed: int = 0, iterations: int = 60, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Coefficient functions and covariance parameters of replicates in which everything is estimated anew, all in the same passes.

    An error names the replicates that have not converged.
    """
    g = replicate_grams(arrays.select(F.xxhash64(participant).alias("u"), "values"), F.concat(F.array(F.lit(1.0)), F.col("values")), "u", replicates, seed)
    # the counts of replicate_grams hash the hash once more: the statistics are keyed in the same way
    stats = m.stats.withColumn("u", F.xxhash64("u"))
    t = len(m.layout.time)
    yy, n = np.zeros((replicates, t, t)), np.zeros(replicates)
    for r in g.collect():
        x = np.asarray(r.gram).reshape(t + 1, t + 1)
        yy[r.rep], n[r.rep] = x[1:, 1:], x[0, 0]
    f = _Likelihood(m.layout, stats, yy, n, m.reml, replicates, seed)
    x, _, states, turns, decrement = _minimise(f, np.tile(m.theta, (replicates, 1)), iterations, tolerance)
    if (decrement >= tolerance).any():
        raise RuntimeError(f"replicates {np.flatnonzero(decrement >= tolerance).tolist()} have not converged after {turns} iterations")
    beta = np.stack([s[0].reshape(m.beta.shape) for s in states])
    return beta @ m.layout.fixed.T, x


def refit_audit(m: MixedFit, arrays: DataFrame, participant: str, replicates: int, seed: int = 0) -> DataFrame:
    """How often every participant stands in every replicate of ``full_refit``: (participant, rep, count)."""

    @F.pandas_udf("array<double>")
    def counts(u):
        import pandas as pd

        return pd.Series(list(draws(u.to_numpy(), replicates, seed, "poisson")))

    people = arrays.select(F.col(participant).alias("participant")).distinct()
    return people.select("participant", F.posexplode(counts(F.xxhash64(F.xxhash64("participant")))).alias("rep", "count")).where("count > 0").withColumn("count", F.col("count").cast("int"))


def refit_trial_audit(arrays: DataFrame, participant: str, audit: DataFrame) -> DataFrame:
    """Source participant, trial and replicate of every draw: trials stand as often as their participant."""
    return audit.join(arrays.select(F.col(participant).alias("participant"), "curve_id"), "participant")


def variance_frame(spark: SparkSession, lay: Layout, thetas: np.ndarray) -> DataFrame:
    """Per parameter vector (replicate): mean variance over time of participants, trials and residual, and the correlation parameter."""
    rows = []
    for r, theta in enumerate(np.atleast_2d(thetas)):
        parts = {k: float(v.mean()) for k, v in variance_functions(lay, theta).items()}
        rows += [(r, k, v) for k, v in parts.items()] + ([(r, "correlation", lay.unpack(theta)[3])] if lay.correlation != "iid" else [])
    return spark.createDataFrame(rows, "rep int, component string, value double")


def variance_functions(lay: Layout, theta: np.ndarray) -> dict[str, np.ndarray]:
    """Variance on the grid of participants' intercept and slope functions, their covariance, trials' functions and residual."""
    factor, trial, sd, _ = lay.unpack(theta)
    g, k, b = factor @ factor.T, lay.random.shape[1], lay.random
    block = lambda i, j: np.einsum("ta,ab,tb->t", b, g[i * k : (i + 1) * k, j * k : (j + 1) * k], b)
    out = {"participant_intercept": block(0, 0)}
    for i in range(1, len(lay.at)):
        out |= {"participant_slope": block(i, i), "participant_cross": block(0, i)}
    if trial is not None:
        out["trial"] = ((lay.trial @ trial) ** 2).sum(1)
    return out | {"residual": np.full(len(lay.time), sd * sd)}


def variance_decomposition(spark: SparkSession, m: MixedFit, label: str = "model") -> DataFrame:
    """The variance functions and their shares of the total (cross terms apart): (model, component, t, variance, share)."""
    f = variance_functions(m.layout, m.theta)
    total = sum(v for k, v in f.items() if k != "participant_cross")
    rows = [(label, k, float(t), float(v[i]), None if k == "participant_cross" else float(v[i] / total[i])) for k, v in f.items() for i, t in enumerate(m.layout.time)]
    return spark.createDataFrame(rows, "model string, component string, t double, variance double, share double")


def random_effects(m: MixedFit, effect: str = "intercept") -> DataFrame:
    """Predicted random functions of participants: (u: the participant's hash, values)."""
    lay, q, t = m.layout, len(m.layout.names), len(m.layout.time)
    k, at = lay.random.shape[1], 0 if effect == "intercept" else 1
    if at >= len(lay.at):
        raise ValueError("the model has no random slope")
    b = lambda zz, zy: _blup(m, zz, zy)[:, at * k : (at + 1) * k] @ lay.random.T

    def run(batches):
        for x in batches:
            if len(x):
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(b(matrix(x.column(1)).reshape(-1, q, q), matrix(x.column(2)).reshape(-1, q, t)).tolist(), pa.list_(pa.float64()))], ["u", "values"])

    small = MixedFit(m.layout, m.beta, m.information, m.theta, m.loss, m.participants, m.curves, m.reml, m.iterations, m.boundary, m.decrement)
    stats, m = m.stats, small  # the tasks get the numbers alone
    return stats.select("u", "zz", "zy").mapInArrow(run, "u long, values array<double>")


def _blup(m: MixedFit, zz: np.ndarray, zy: np.ndarray) -> np.ndarray:
    lay, p = m.layout, len(zz)
    factor, a = lay.unpack(m.theta)[0], np.linalg.inv(lay.within(m.theta))
    random, at = a @ lay.random, lay.at
    fitted = zz[:, at] @ m.functions  # sums of z_r times the fixed part of the curves
    rest = ((zy[:, at] - fitted) @ random).reshape(p, -1)
    c = np.einsum("npq,ab->npaqb", zz[:, at][:, :, at], lay.random.T @ random).reshape(p, lay.d, lay.d)
    return np.linalg.solve(np.eye(lay.d) + factor.T @ c @ factor, (rest @ factor)[:, :, None])[:, :, 0] @ factor.T


def residuals(arrays: DataFrame, m: MixedFit, participant: str, scale: str = "raw") -> DataFrame:
    """Per curve: participant, predicted trial function (empty without one) and conditional residuals, ``whitened`` by the residual factor."""
    lay, predictors = m.layout, list(m.layout.names[1:])
    _, trial, sd, rho = lay.unpack(m.theta)
    noise = np.linalg.cholesky(sd * sd * lay.residual(rho))
    gain = None if trial is None else (trial @ trial.T) @ lay.trial.T @ np.linalg.inv(lay.within(m.theta))
    functions, at, wanted, basis = m.functions, lay.at, scale, lay.trial
    own = random_effects(m)
    if len(at) > 1:
        own = own.join(random_effects(m, "slope").withColumnRenamed("values", "slope"), "u")
    rows = arrays.select("curve_id", participant, F.xxhash64(participant).alias("u"), F.concat(F.array(F.lit(1.0)), scalars(*predictors)).alias("z"), F.col("values").alias("y")).join(own.withColumnRenamed("values", "intercept"), "u")
    columns = ["curve_id", participant, "z", "y", "intercept", *(["slope"] if len(at) > 1 else [])]

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            z, y, i = (matrix(b.column(k)) for k in (2, 3, 4))
            r = y - z @ functions - i - (z[:, at[1], None] * matrix(b.column(5)) if len(at) > 1 else 0)
            t = np.zeros((len(r), 0))
            if gain is not None:
                t = (r @ gain.T) @ basis.T
                r = r - t
            if wanted == "whitened":
                r = np.linalg.solve(noise, r.T).T
            lists = lambda v: pa.array(v.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(t), lists(r)], ["curve_id", "participant", "trial", "residual"])

    kinds = dict(rows.dtypes)
    return rows.select(*columns).mapInArrow(run, f"curve_id {kinds['curve_id']}, participant {kinds[participant]}, trial array<double>, residual array<double>")


def residual_pairs(residual: DataFrame, lag: int) -> DataFrame:
    """The residuals of every curve at index distance ``lag``: (curve_id, participant, t_idx, e, f)."""
    n = F.size("residual") - lag
    pair = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((i - 1).alias("t_idx"), F.element_at("residual", i).alias("e"), F.element_at("residual", i + lag).alias("f")))
    rows = residual.where(n >= 1).select("curve_id", "participant", F.explode(pair).alias("z"))
    return rows.select("curve_id", "participant", "z.t_idx", "z.e", "z.f")


def residual_diagnostics(residual: DataFrame, max_lag: int, level: str = "overall") -> DataFrame:
    """Autocovariance, autocorrelation and semivariance by lag: of every trial (curve), participant, or overall.

    Curves count by their numbers of pairs; the autocorrelation is over the mean square of the curve's residuals.
    """
    own = residual.select("curve_id", "participant", "residual", (F.aggregate("residual", F.lit(0.0), lambda s, x: s + x * x) / F.size("residual")).alias("v"))
    lags = F.explode(F.sequence(F.lit(0), F.least(F.lit(max_lag), F.size("residual") - 1))).alias("lag")
    at = own.select("curve_id", "participant", "residual", "v", lags)
    a, b = F.slice("residual", F.lit(1), F.size("residual") - F.col("lag")), F.slice("residual", F.col("lag") + 1, F.size("residual"))
    total = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)
    rows = at.select("curve_id", "participant", "lag", "v", (F.size("residual") - F.col("lag")).alias("n"), total(lambda x, y: x * y).alias("p"), total(lambda x, y: (x - y) * (x - y)).alias("d"))
    keys = {"trial": ["curve_id", "participant"], "participant": ["participant"], "overall": []}[level]
    n = F.sum("n")
    return rows.groupBy(*keys, "lag").agg(n.alias("n_pairs"), (F.sum("p") / n).alias("autocovariance"), (F.sum(F.when(F.col("v") > 0, F.col("p") / F.col("v"))) / n).alias("autocorrelation"), (F.sum("d") / (2 * n)).alias("semivariance"))


def compare_diagnostics(reference: DataFrame, other: DataFrame) -> DataFrame:
    """Differences by lag of two overall diagnostics."""
    m = ["autocorrelation", "semivariance"]
    r = reference.select("lag", *(F.col(c).alias(f"reference_{c}") for c in m))
    o = other.select("lag", *(F.col(c).alias(f"comparison_{c}") for c in m))
    return r.join(o, "lag").select("*", *((F.col(f"comparison_{c}") - F.col(f"reference_{c}")).alias(f"delta_{c}") for c in m))


def compare_bootstraps(spark: SparkSession, m: MixedFit, held: np.ndarray, refitted: np.ndarray, level: float = 0.95, scope: str = "each") -> DataFrame:
    """Simultaneous band widths with covariances held and refitted, and their ratio: (coefficient, t, ...)."""
    width = lambda d: 2 * simultaneous(d, d.mean(0), d.std(0, ddof=1), level, scope)[:, None] * d.std(0, ddof=1)
    a, b = width(held), width(refitted)
    rows = [(n, float(t), float(a[k, i]), float(b[k, i]), float(b[k, i] / a[k, i]) if a[k, i] > 0 else None) for k, n in enumerate(m.layout.names) for i, t in enumerate(m.layout.time)]
    return spark.createDataFrame(rows, "coefficient string, t double, held_width double, refitted_width double, ratio double")


def covariance_sensitivity(spark: SparkSession, fits: dict[str, MixedFit | Exception], reference: str) -> DataFrame:
    """Coefficient functions of declared covariance structures against a reference: differences and ratios of errors; failures keep a row."""
    base, rows = fits[reference], []
    for name, m in fits.items():
        if isinstance(m, Exception):
            rows.append((name, None, None, None, None, None, str(m)))
            continue
        d, r = m.functions - base.functions, m.errors / np.maximum(base.errors, 1e-300)
        rows += [(name, n, float(t), float(d[k, i]), float(r[k, i]), float(m.loss - base.loss), None) for k, n in enumerate(m.layout.names) for i, t in enumerate(m.layout.time)]
    return spark.createDataFrame(rows, "model string, coefficient string, t double, difference double, error_ratio double, loss_difference double, failure string")
