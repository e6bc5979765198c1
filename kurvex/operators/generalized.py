"""Generalised function-on-scalar models: binary, count and grouped-binomial curves on scalar predictors with a spline in time.

Independence estimating equations by iterated weighted least squares: a pass adds up score and information of coefficients x
basis size in every task, participants give the sandwich, and bootstrap replicates (counts of whole participants) are
fitted all at once in the same passes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import clamped_spline, draws, normal_quantile, simultaneous
from ..functions.sums import add_up, matrix, scalars


@dataclass(frozen=True)
class GeneralizedFit:
    """Basis (times x size), coefficients (coefficients x size), their robust covariance, names, family, range of each predictor."""

    time: np.ndarray
    basis: np.ndarray
    gamma: np.ndarray
    covariance: np.ndarray
    names: tuple[str, ...]
    family: str
    ranges: tuple[tuple[float, float], ...]
    participants: int
    iterations: int

    @property
    def functions(self) -> np.ndarray:
        return self.gamma @ self.basis.T

    @property
    def errors(self) -> np.ndarray:
        k = self.basis.shape[1]
        blocks = [self.covariance[j * k : (j + 1) * k, j * k : (j + 1) * k] for j in range(len(self.names))]
        return np.sqrt(np.maximum([np.einsum("ti,ij,tj->t", self.basis, b, self.basis) for b in blocks], 0))


def model_rows(arrays: DataFrame, predictors: list[str], participant: str, exposure: str | None = None, denominator: str | None = None) -> DataFrame:
    """(u: participant's hash, x: 1 and predictors, y, m): ``m`` the array of exposures or binomial denominators, 1 without either."""
    more = F.col(exposure or denominator) if exposure or denominator else F.transform("values", lambda v: F.lit(1.0))
    x = F.concat(F.array(F.lit(1.0)), scalars(*predictors))
    return arrays.select(F.xxhash64(participant).alias("u"), x.alias("x"), F.col("values").alias("y"), more.alias("m"))


def _mean(family: str, eta: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the response: counts of m trials (binomial), or counts at exposure m (poisson)."""
    if family == "binomial":
        p = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
        return m * p, m * p * (1 - p)
    mu = m * np.exp(np.clip(eta, -30, 30))
    return mu, mu


def _check(rows: DataFrame, family: str) -> None:
    good = F.forall("y", lambda v: v.isNotNull() & (v >= 0) & (v == F.floor(v))) & F.forall("m", lambda v: v > 0)
    if family == "binomial":
        good = good & F.forall(F.zip_with("y", "m", lambda y, m: y <= m), lambda v: v)
    if not rows.where(~F.coalesce(good, F.lit(False))).isEmpty():
        raise ValueError(f"responses don't suit the {family} family")


def _passes(rows: DataFrame, basis: np.ndarray, family: str, start: np.ndarray, replicates: int, seed: int, iterations: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Coefficients of all replicates (replicates x size; one with unit weights if ``replicates`` is 0) and their information."""
    r = max(1, replicates)
    gamma, p, k = np.tile(start.ravel(), (r, 1)), start.shape[0], basis.shape[1]
    size = p * k
    for turn in range(iterations):
        now = gamma.reshape(r, p, k).copy()

        def run(batches, now=now):
            total = None
            for b in batches:
                if not len(b):
                    continue
                x, y, m = (matrix(b.column(i)) for i in (1, 2, 3))
                w = draws(np.asarray(b.column(0)), replicates, seed, "poisson") if replicates else np.ones((len(x), 1))
                if total is None:
                    total = np.zeros((r, size + size * size))
                for j in range(r):
                    mu, v = _mean(family, x @ (now[j] @ basis.T), m)
                    score = (x * w[:, j, None]).T @ ((y - mu) @ basis)
                    info = np.einsum("np,nq,nt,ta,tb->paqb", x * w[:, j, None], x, v, basis, basis, optimize=True)
                    total[j, :size] += score.ravel()
                    total[j, size:] += info.reshape(size, size).ravel()
            if total is not None:
                for j in range(r):
                    yield pa.RecordBatch.from_arrays([pa.array([j]), pa.array([total[j].tolist()], pa.list_(pa.float64()))], ["rep", "s"])

        info, moved = np.zeros((r, size, size)), 0.0
        for row in add_up(rows.mapInArrow(run, "rep long, s array<double>"), ["rep"]).collect():
            s = np.asarray(row.s)
            info[row.rep] = s[size:].reshape(size, size)
            step = np.linalg.solve(info[row.rep] + 1e-9 * np.eye(size), s[:size])
            gamma[row.rep] += np.clip(step, -8, 8)
            moved = max(moved, float(np.abs(step).max()))
        if moved < tolerance:
            break
    return gamma, info, turn + 1


def fit(rows: DataFrame, time: np.ndarray, names: list[str], family: str, basis_size: int = 5, degree: int = 3, iterations: int = 50, tolerance: float = 1e-8, check: bool = True) -> GeneralizedFit:
    """Estimating equations with working independence; the covariance is the participants' sandwich."""
    if family not in ("binomial", "poisson"):
        raise ValueError("the family is binomial or poisson")
    if check:
        _check(rows, family)
    basis = clamped_spline(time, basis_size, degree)
    p, k = len(names) + 1, basis_size
    gamma, info, turns = _passes(rows, basis, family, np.zeros((p, k)), 0, 0, iterations, tolerance)
    g = gamma[0].reshape(p, k)

    def scores(batches):
        for b in batches:
            if len(b):
                x, y, m = (matrix(b.column(i)) for i in (1, 2, 3))
                mu, _ = _mean(family, x @ (g @ basis.T), m)
                s = np.einsum("np,nk->npk", x, (y - mu) @ basis).reshape(len(x), -1)
                u, inv = np.unique(np.asarray(b.column(0)), return_inverse=True)
                total = np.zeros((len(u), s.shape[1]))
                np.add.at(total, inv, s)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(total.tolist(), pa.list_(pa.float64()))], ["u", "s"])

    per = add_up(rows.mapInArrow(scores, "u long, s array<double>"), ["u"])

    def outer(batches):
        total, n = 0.0, 0
        for b in batches:
            m = matrix(b.column(0))
            total, n = total + m.T @ m, n + len(m)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["n", "m"])

    meat = add_up(per.select("s").mapInArrow(outer, "n long, m array<double>")).first()
    inverse = np.linalg.inv(info[0])
    ends = rows.agg(*(f(F.col("x")[j]) for j in range(1, p) for f in (F.min, F.max))).first()
    ranges = tuple((float(ends[2 * j]), float(ends[2 * j + 1])) for j in range(p - 1))
    return GeneralizedFit(np.asarray(time, float), basis, g, inverse @ np.asarray(meat.m).reshape(p * k, -1) @ inverse, ("intercept", *names), family, ranges, int(meat.n), turns)


def bootstrap(rows: DataFrame, model: GeneralizedFit, replicates: int = 100, seed: int = 0, iterations: int = 30) -> np.ndarray:
    """Coefficient functions (replicates x coefficients x times) refitted on counts of whole participants, all replicates in the same passes."""
    gamma, _, _ = _passes(rows, model.basis, model.family, model.gamma, replicates, seed, iterations, 1e-7)
    out = gamma.reshape(replicates, *model.gamma.shape) @ model.basis.T
    if not np.isfinite(out).all():
        raise RuntimeError("a bootstrap replicate didn't converge")
    return out


def coefficient_frame(spark: SparkSession, model: GeneralizedFit, draws_: np.ndarray | None = None, level: float = 0.95, scope: str = "each") -> DataFrame:
    """Coefficient functions on the link scale with robust errors and, with draws, simultaneous bands."""
    f, e = model.functions, model.errors
    c = simultaneous(draws_, f, e, level, scope) if draws_ is not None else np.full(len(f), normal_quantile((1 + level) / 2))
    rows = [(n, float(t), float(f[k, i]), float(e[k, i]), float(c[k]), float(f[k, i] - c[k] * e[k, i]), float(f[k, i] + c[k] * e[k, i]), draws_ is not None) for k, n in enumerate(model.names) for i, t in enumerate(model.time)]
    return spark.createDataFrame(rows, "coefficient string, t double, estimate double, se double, critical double, lower double, upper double, simultaneous boolean")


def exposure_frame(arrays: DataFrame, exposure: str) -> DataFrame:
    """Least, largest, mean and total exposure of every curve."""
    one = F.explode(exposure).alias("e")
    return arrays.select("curve_id", one).groupBy("curve_id").agg(F.min("e").alias("least"), F.max("e").alias("largest"), F.avg("e").alias("mean"), F.sum("e").alias("total"))


def _inverse(family: str, eta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(eta, -30, 30))) if family == "binomial" else np.exp(np.clip(eta, -30, 30))


def predict(model: GeneralizedFit, profiles: pd.DataFrame, draws_: np.ndarray | None = None, level: float = 0.95, scope: str = "each") -> pd.DataFrame:
    """Mean functions of declared profiles (profile_id and one column per predictor): link, probability or rate, errors, bands.

    Bands come from the robust covariance pointwise, or with draws from the largest deviation over time, per profile or over
    all; their ends are mapped through the link.  Profiles outside a predictor's fitted range are marked.
    """
    x = np.column_stack((np.ones(len(profiles)), *(profiles[n].to_numpy(float) for n in model.names[1:])))
    eta = x @ model.functions
    var = np.zeros_like(eta)
    for i in range(len(x)):
        d = np.einsum("p,tk->tpk", x[i], model.basis).reshape(len(model.time), -1)
        var[i] = np.einsum("ti,ij,tj->t", d, model.covariance, d)
    se = np.sqrt(np.maximum(var, 0))
    if draws_ is None:
        c = np.full(len(x), normal_quantile((1 + level) / 2))
    else:
        c = simultaneous(np.einsum("ip,rpt->rit", x, draws_), eta, se, level, scope)
    mean = _inverse(model.family, eta)
    slope = mean * (1 - mean) if model.family == "binomial" else mean
    outside = np.array([any(not lo <= v <= hi for v, (lo, hi) in zip(row, model.ranges, strict=True)) for row in x[:, 1:]], bool)
    lo, hi = _inverse(model.family, eta - c[:, None] * se), _inverse(model.family, eta + c[:, None] * se)
    rows = [(profiles["profile_id"].iloc[i], float(t), eta[i, j], se[i, j], mean[i, j], slope[i, j] * se[i, j], c[i], lo[i, j], hi[i, j], bool(outside[i])) for i in range(len(x)) for j, t in enumerate(model.time)]
    return pd.DataFrame(rows, columns=["profile_id", "t", "link", "link_se", "mean", "mean_se", "critical", "lower", "upper", "extrapolated"])


def mean_difference(model: GeneralizedFit, profiles: pd.DataFrame, a: str, b: str, draws_: np.ndarray, level: float = 0.95, contrast: str = "difference") -> pd.DataFrame:
    """Simultaneous band over time of one declared contrast of two profiles: ``difference`` of means, or ``log_ratio``."""
    at = profiles.set_index("profile_id")
    x = np.array([[1.0, *(float(at.loc[i, n]) for n in model.names[1:])] for i in (a, b)])
    value = lambda f: (lambda m: np.log(m[..., 0, :]) - np.log(m[..., 1, :]) if contrast == "log_ratio" else m[..., 0, :] - m[..., 1, :])(_inverse(model.family, x @ f))
    centre, reps = value(model.functions), value(draws_)
    se = reps.std(0, ddof=1)
    c = simultaneous(reps[:, None], centre[None], se[None], level, "family")[0]
    return pd.DataFrame({"t": model.time, "contrast": centre, "se": se, "critical": c, "lower": centre - c * se, "upper": centre + c * se})
