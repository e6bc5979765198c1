"""Models of repeated curves: scalar-on-function regression, mixed effects by profile likelihood, cross-validation, influence, local maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decomposition import Decomposition, component_similarity, fit_fpca, match_components, moments, reconstruction_error, trapezoid_weights


def scalar_on_function(scored: DataFrame, response: str, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Least squares of a scalar on the first k scores (column ``scores``): coefficients, covariance, residual variance."""
    z = [F.lit(1.0), *(F.col("scores")[i] for i in range(k))]
    y, p = F.col(response).cast("double"), k + 1
    r = scored.agg(F.count(F.lit(1)), F.sum(y * y), *(F.sum(a * y) for a in z), *(F.sum(a * b) for a in z for b in z)).first()
    n, yy, xy, xx = r[0], r[1], np.array(r[2 : 2 + p]), np.array(r[2 + p :]).reshape(p, p)
    beta = np.linalg.solve(xx, xy)
    s2 = float((yy - beta @ xy) / (n - p))
    return beta, s2 * np.linalg.inv(xx), s2


def slope_function(fit: Decomposition, beta: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coefficient function and its pointwise standard error from score coefficients."""
    c = fit.components[: len(beta) - 1]
    return beta[1:] @ c, np.sqrt(np.maximum(np.einsum("ki,kl,li->i", c, cov[1:, 1:], c), 0))


def fold_of(keys: str, folds: int, seed: int = 0):
    """A fold number that is a function of the key alone."""
    return F.pmod(F.xxhash64(keys, F.lit(seed)), F.lit(folds)).cast("int")


def cross_validate_reconstruction(arrays: DataFrame, time: np.ndarray, candidates: list[int], folds: int = 5, seed: int = 0) -> pd.DataFrame:
    """Held-out reconstruction error per fold and number of components; the moments of the folds are added up once."""
    dealt = arrays.withColumn("fold", fold_of("curve_id", folds, seed)).cache()
    parts = [moments(dealt.where(F.col("fold") == f)) for f in range(folds)]
    w = trapezoid_weights(time)
    root, rows = np.sqrt(w), []
    for f in range(folds):
        n, s, g = (sum(p[i] for j, p in enumerate(parts) if j != f) for i in range(3))
        mean = s / n
        ev, vec = np.linalg.eigh((g - n * np.outer(mean, mean)) / (n - 1) * np.outer(root, root))
        comp = (vec[:, ::-1] / root[:, None]).T
        for k in candidates:
            fit = Decomposition(mean, comp[:k], ev[::-1][:k], ev[::-1][:k], w, n)
            e = reconstruction_error(dealt.where(F.col("fold") == f), fit).agg(F.avg(F.col("rmse") * F.col("rmse"))).first()[0]
            rows.append((f, k, float(np.sqrt(e))))
    dealt.unpersist()
    return pd.DataFrame(rows, columns=["fold", "n_components", "rmse"])


def select_components(cv: pd.DataFrame, rule: str = "minimum") -> int:
    """The number of least mean error, or the least number within one standard error of it."""
    s = cv.groupby("n_components")["rmse"].agg(["mean", "std", "count"])
    best = s["mean"].idxmin()
    if rule == "minimum":
        return int(best)
    return int(s.index[s["mean"] <= s.loc[best, "mean"] + s.loc[best, "std"] / np.sqrt(s.loc[best, "count"])].min())


def group_influence(arrays: DataFrame, group: str, time: np.ndarray, n_components: int) -> DataFrame:
    """One minus the least similarity of the components without each group to all; moments per group, subtracted from the whole."""
    import pyarrow as pa

    whole = fit_fpca(arrays, time, n_components)
    w = whole.weights
    root = np.sqrt(w)

    def add(batches):
        acc: dict = {}
        group_kind = None
        for b in batches:
            group_kind = b.column(0).type
            g = np.asarray(b.column(0).to_pandas())
            m = np.asarray(b.column(1).flatten(), float).reshape(len(b), -1)
            for k in pd.unique(g):
                x = m[g == k]
                n, s, q = acc.get(k, (0, 0.0, 0.0))
                acc[k] = (n + len(x), s + x.sum(0), q + x.T @ x)
        for k, (n, s, q) in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], group_kind), pa.array([n]), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([q.ravel().tolist()], pa.list_(pa.float64()))], ["k", "n", "s", "q"])

    n0, s0, g0 = moments(arrays)
    kind = dict(arrays.dtypes)[group]

    def refit(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s, g = n0 - pdf["n"].sum(), s0 - np.sum(np.stack(pdf["s"]), 0), g0 - np.sum(np.stack(pdf["q"]), 0).reshape(len(s0), -1)
        mean = s / n
        _, vec = np.linalg.eigh((g - n * np.outer(mean, mean)) / (n - 1) * np.outer(root, root))
        comp = (vec[:, ::-1][:, :n_components] / root[:, None]).T
        sim = component_similarity(whole, Decomposition(mean, comp, np.zeros(0), np.zeros(0), w, n))
        at = match_components(sim)
        return pd.DataFrame({"grp": [pdf["k"].iloc[0]], "influence": [1 - min(float(sim[i, j]) for i, j in enumerate(at))]})

    parts = arrays.select(F.col(group), "values").where(F.col(group).isNotNull()).mapInArrow(add, f"k {kind}, n long, s array<double>, q array<double>")
    return parts.groupBy("k").applyInPandas(refit, f"grp {kind}, influence double")


def random_intercept_fit(rows: DataFrame, y: str, predictors: list[str], group: str) -> dict:
    """Linear mixed model with a random intercept by profile REML: group sums in Spark, one bounded search on the variance ratio.

    The driver gets the distinct (size, sums) statistics only through sums over a grid of ratios.
    """
    cols = [F.lit(1.0), *(F.col(p).cast("double") for p in predictors)]
    p, v = len(cols), F.col(y).cast("double")
    g = rows.groupBy(group).agg(F.count(F.lit(1)).alias("k"), F.sum(v).alias("sy"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(cols))).cache()
    t = rows.agg(F.count(F.lit(1)), F.sum(v * v), *(F.sum(c * v) for c in cols), *(F.sum(a * b) for a in cols for b in cols)).first()
    n, yy, xy, xx = t[0], t[1], np.array(t[2 : 2 + p]), np.array(t[2 + p :]).reshape(p, p)

    def loss(ratios: list[float]) -> list[tuple[float, np.ndarray, float]]:
        terms = []
        for r in ratios:
            c = F.lit(r) / (1 + F.lit(r) * F.col("k"))
            terms += [F.sum(F.log(1 + F.lit(r) * F.col("k"))), F.sum(c * F.col("sy") * F.col("sy")), *(F.sum(c * F.col(f"s{i}") * F.col("sy")) for i in range(p)), *(F.sum(c * F.col(f"s{i}") * F.col(f"s{j}")) for i in range(p) for j in range(p))]
        row, out = list(g.agg(*terms).first()), []
        size = 2 + p + p * p
        for i in range(len(ratios)):
            q = row[i * size : (i + 1) * size]
            a, b, c = xx - np.array(q[2 + p :]).reshape(p, p), xy - np.array(q[2 : 2 + p]), yy - q[1]
            beta = np.linalg.solve(a, b)
            s2 = float(c - beta @ b) / (n - p)
            out.append(((n - p) * np.log(s2) + q[0] + np.linalg.slogdet(a)[1], beta, s2))
        return out

    lo, hi = -8.0, 6.0
    for _ in range(6):  # a grid search that shrinks around the least loss, all ratios of a round in one pass
        grid = np.linspace(lo, hi, 9)
        values = loss([float(np.exp(x)) for x in grid])
        k = int(np.argmin([x[0] for x in values]))
        lo, hi = grid[max(0, k - 1)], grid[min(8, k + 1)]
    ratio, (value, beta, s2) = float(np.exp(grid[k])), values[k]
    g.unpersist()
    return {"beta": beta, "residual_variance": s2, "intercept_variance": ratio * s2, "reml": value}


def local_return_map(crossings: np.ndarray, reference: np.ndarray, k: int) -> dict:
    """Affine map of crossings to their successors around a reference (k nearest): Jacobian, eigenvalues, spectral radius."""
    x, y = crossings[:-1], crossings[1:]
    near = np.argsort(np.linalg.norm(x - reference, axis=1), kind="stable")[:k]
    a = np.column_stack((np.ones(len(near)), x[near] - reference))
    coef, *_ = np.linalg.lstsq(a, y[near], rcond=None)
    ev = np.linalg.eigvals(coef[1:].T)
    radius = float(np.abs(ev).max())
    return {"jacobian": coef[1:].T, "eigenvalues": ev, "spectral_radius": radius, "verdict": "stable" if radius < 1 - 1e-6 else "unstable" if radius > 1 + 1e-6 else "neutral"}
