"""Regression of a scalar outcome on functional scores: cross-validation, nested selection, bootstrap and prediction intervals.

Every fit is algebra of one Gram matrix of (1, curve values, outcome, covariates): its size is the grid's.  Folds are added
up once and combined on the driver, bootstrap replicates are Gram matrices with reproducible counts of whole units.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import simultaneous, uniforms
from ..functions.sums import add_up, gram, grams, matrix, replicate_grams, scalars, vector
from .decomposition import Decomposition, factor, trapezoid_weights


@dataclass(frozen=True)
class ScoreModel:
    """A decomposition and the coefficients (intercept, scores, covariates) of the outcome."""

    fit: Decomposition
    beta: np.ndarray
    sse: float
    n: float

    @property
    def k(self) -> int:
        return len(self.fit.components)

    @property
    def slope(self) -> np.ndarray:
        """The coefficient function: predictions are linear in centred curve values times this, weighted."""
        return self.beta[1 : 1 + self.k] @ self.fit.components / np.square(self.fit.scale)

    def functional(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Prediction = constant + values @ place coefficients + covariates @ rest."""
        place = self.fit.basis @ self.beta[1 : 1 + self.k]
        return float(self.beta[0] - self.fit.mean @ place), place, self.beta[1 + self.k :]


def _rows(arrays: DataFrame, outcome: str, covariates: tuple[str, ...]):
    return vector("values", scalars(outcome, *covariates))


def fit_scores(g: np.ndarray, weights: np.ndarray, k: int) -> ScoreModel:
    """Least squares of the outcome on the first k scores and the covariates, all from one Gram matrix of ``_rows``."""
    p = len(weights)
    fit = factor(g[0, 0], g[0, 1 : p + 1], g[1 : p + 1, 1 : p + 1], weights, k)
    if len(fit.components) < k:
        raise ValueError("there are too few curves for so many components")
    q = g.shape[0] - p - 2
    lift = np.zeros((g.shape[0], 1 + k + q))  # design = rows @ lift: scores are linear in the values
    lift[0, 0], lift[0, 1 : k + 1], lift[1 : p + 1, 1 : k + 1] = 1, -fit.mean @ fit.basis, fit.basis
    lift[p + 2 :, k + 1 :] = np.eye(q)
    xx, xy, yy = lift.T @ g @ lift, lift.T @ g[:, p + 1], g[p + 1, p + 1]
    if np.linalg.matrix_rank(xx) < len(xx):
        raise ValueError("the design is rank deficient")
    beta = np.linalg.solve(xx, xy)
    return ScoreModel(fit, beta, float(yy - beta @ xy), float(g[0, 0]))


def held_out(model: ScoreModel, g: np.ndarray) -> float:
    """Root-mean-square error of a model on the rows of another Gram matrix."""
    p = len(model.fit.mean)
    c, place, rest = model.functional()
    a = np.concatenate(([c], place, [-1.0], rest))
    return float(np.sqrt(max(0.0, a @ g @ a) / g[0, 0])) if len(a) == p + 2 + len(rest) else float("nan")


def fold_number(unit: str, folds: int, seed: int = 0):
    """A fold that is a function of the unit alone: whole participants stay together."""
    return F.pmod(F.xxhash64(unit, F.lit(seed)), F.lit(folds))


def _fold_grams(arrays: DataFrame, outcome: str, covariates: tuple[str, ...], key) -> dict[int, np.ndarray]:
    rows = grams(arrays, _rows(arrays, outcome, covariates), key).collect()
    size = int(round(len(rows[0].gram) ** 0.5)) if rows else 0
    return {r.key: np.asarray(r.gram).reshape(size, size) for r in rows}


def cross_validate(arrays: DataFrame, time: np.ndarray, outcome: str, candidates: list[int], folds: int = 5, unit: str = "curve_id", covariates: tuple[str, ...] = (), loss: str = "rmse", dims: int = 1, seed: int = 0) -> pd.DataFrame:
    """Held-out loss per fold and number of components, the decomposition refitted in every fold.

    ``rmse`` needs one pass in all; ``mae`` one more, in which every fold's models predict the rows of their fold.
    """
    w = np.repeat(trapezoid_weights(time), dims)
    parts = _fold_grams(arrays, outcome, covariates, fold_number(unit, folds, seed))
    total = sum(parts.values())
    models = {(f, k): fit_scores(total - g, w, k) for f, g in parts.items() for k in candidates}
    if loss == "rmse":
        rows = [(f, k, held_out(m, parts[f])) for (f, k), m in models.items()]
    elif loss == "mae":
        rows = _absolute(arrays, models, fold_number(unit, folds, seed), outcome, covariates)
    else:
        raise ValueError("the loss is rmse or mae; see cross_validate_binary for binary outcomes")
    return pd.DataFrame(sorted(rows), columns=["fold", "n_components", "loss"])


def _absolute(arrays: DataFrame, models: dict, fold, outcome: str, covariates: tuple[str, ...]) -> list[tuple]:
    flat = {key: np.concatenate(([c], place, [-1.0], rest)) for key, m in models.items() for c, place, rest in [m.functional()]}

    def run(batches):
        for b in batches:
            f, m = np.asarray(b.column(0)), matrix(b.column(1))
            out = [(x, k, float(np.abs(m[f == x] @ a).sum()), float((f == x).sum())) for (x, k), a in flat.items() if (f == x).any()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["fold", "k", "s", "n"])

    parts = arrays.select(fold.cast("long").alias("fold"), _rows(arrays, outcome, covariates).alias("v")).where("v is not null")
    return [(r.fold, r.k, r.s / r.n) for r in add_up(parts.mapInArrow(run, "fold long, k long, s double, n double"), ["fold", "k"]).collect()]


def summarise(cv: DataFrame | pd.DataFrame, value: str = "loss") -> DataFrame | pd.DataFrame:
    """Mean, deviation, folds and standard error of the fold losses of each number of components."""
    if isinstance(cv, pd.DataFrame):
        s = cv.groupby("n_components")[value].agg(["mean", "std", "count"]).fillna({"std": 0.0}).reset_index()
        s["se"] = s["std"] / np.sqrt(s["count"])
        return s
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return cv.groupBy("n_components").agg(F.avg(value).alias("mean"), sd.alias("std"), F.count(F.lit(1)).alias("count"), (sd / F.sqrt(F.count(F.lit(1)))).alias("se"))


def select(cv: pd.DataFrame, rule: str = "minimum", value: str = "loss") -> int:
    """The number of least mean loss, or (``one_se``) the least number within one standard error of it."""
    s = summarise(cv, value).sort_values("n_components")
    best = s.loc[s["mean"].idxmin()]
    if rule == "minimum":
        return int(best["n_components"])
    if rule != "one_se":
        raise ValueError("the rule is minimum or one_se")
    return int(s.loc[s["mean"] <= best["mean"] + best["se"], "n_components"].min())


def nested_cross_validate(arrays: DataFrame, time: np.ndarray, outcome: str, candidates: list[int], outer: int = 5, inner: int = 4, rule: str = "minimum", unit: str = "curve_id", covariates: tuple[str, ...] = (), dims: int = 1, seed: int = 0) -> pd.DataFrame:
    """Outer loss with the number of components chosen by inner folds: one pass adds up outer x inner cells, the rest is algebra."""
    w = np.repeat(trapezoid_weights(time), dims)
    cell = fold_number(unit, outer, seed) * inner + fold_number(unit, inner, seed + 1)
    cells = _fold_grams(arrays, outcome, covariates, cell)
    rows = []
    for o in range(outer):
        train = {c: g for c, g in cells.items() if c // inner != o}
        test = [g for c, g in cells.items() if c // inner == o]
        if not test or not train:
            continue
        total, losses = sum(train.values()), []
        for i in range(inner):
            held = [g for c, g in train.items() if c % inner == i]
            if held:
                losses += [(i, k, held_out(fit_scores(total - sum(held), w, k), sum(held))) for k in candidates]
        k = select(pd.DataFrame(losses, columns=["fold", "n_components", "loss"]), rule)
        rows.append((o, k, held_out(fit_scores(total, w, k), sum(test)), float(sum(test)[0, 0])))
    return pd.DataFrame(rows, columns=["fold", "n_components", "loss", "n"])


def logistic_scores(arrays: DataFrame, fits: dict, outcome: str, covariates: tuple[str, ...] = (), keep: dict | None = None, fold=None, iterations: int = 30) -> dict:
    """Coefficients of binary outcomes on several score designs at once, by iterated weighted least squares.

    ``fits`` has a decomposition per name, ``keep`` the folds whose rows it learns from (all, if not given).  A pass adds up
    the score and information of every model; it ends when none moves any more.
    """
    names = list(fits)
    q = len(covariates)
    beta = {m: np.zeros(1 + len(fits[m].components) + q) for m in names}
    rows = arrays.select((F.lit(0) if fold is None else fold).cast("long").alias("fold"), vector("values", scalars(*covariates)) if q else vector("values"), F.col(outcome).cast("double").alias("y")).toDF("fold", "v", "y").where("v is not null and y is not null")
    for _ in range(iterations):
        now = dict(beta)

        def run(batches, now=now):
            total: dict = {}
            for b in batches:
                f, m, y = np.asarray(b.column(0)), matrix(b.column(1)), np.asarray(b.column(2))
                for name in names:
                    fit = fits[name]
                    use = np.isin(f, list(keep[name])) if keep else np.ones(len(f), bool)
                    p = len(fit.mean)
                    x = np.column_stack((np.ones(use.sum()), (m[use, 1 : p + 1] - fit.mean) @ fit.basis, m[use, p + 1 :]))
                    mu = 1 / (1 + np.exp(-np.clip(x @ now[name], -30, 30)))
                    part = np.concatenate((x.T @ (y[use] - mu), ((x * (mu * (1 - mu))[:, None]).T @ x).ravel()))
                    total[name] = total.get(name, 0.0) + part
            for i, name in enumerate(names):
                if name in total:
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([total[name].tolist()], pa.list_(pa.float64()))], ["model", "s"])

        step = 0.0
        for r in add_up(rows.mapInArrow(run, "model long, s array<double>"), ["model"]).collect():
            name, s = names[r.model], np.asarray(r.s)
            d = len(beta[name])
            move = np.linalg.solve(s[d:].reshape(d, d) + 1e-10 * np.eye(d), s[:d])
            beta[name] = beta[name] + np.clip(move, -8, 8)
            step = max(step, float(np.abs(move).max()))
        if step < 1e-8:
            break
    return beta


def cross_validate_binary(arrays: DataFrame, time: np.ndarray, outcome: str, candidates: list[int], folds: int = 5, unit: str = "curve_id", loss: str = "log_loss", dims: int = 1, seed: int = 0) -> pd.DataFrame:
    """Held-out log loss or Brier score per fold and number of components for a binary outcome."""
    w, fold = np.repeat(trapezoid_weights(time), dims), fold_number(unit, folds, seed)
    parts = {r.key: np.asarray(r.gram) for r in grams(arrays, vector("values"), fold).collect()}
    size = len(w) + 1
    total = sum(parts.values())
    fits, keep = {}, {}
    for f, g in parts.items():
        rest = (total - g).reshape(size, size)
        for k in candidates:
            fits[f, k] = factor(rest[0, 0], rest[0, 1:], rest[1:, 1:], w, k)
            keep[f, k] = [x for x in parts if x != f]
    beta = logistic_scores(arrays, fits, outcome, (), keep, fold)

    def run(batches):
        for b in batches:
            f, m, y = np.asarray(b.column(0)), matrix(b.column(1)), np.asarray(b.column(2))
            out = []
            for (x, k), fit in fits.items():
                use = f == x
                if use.any():
                    z = np.column_stack((np.ones(use.sum()), (m[use] - fit.mean) @ fit.basis)) @ beta[x, k]
                    mu, t = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-12, 1 - 1e-12), y[use]
                    e = -(t * np.log(mu) + (1 - t) * np.log(1 - mu)) if loss == "log_loss" else (t - mu) ** 2
                    out.append((x, k, float(e.sum()), float(use.sum())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["fold", "k", "s", "n"])

    rows = arrays.select(fold.cast("long").alias("fold"), "values", F.col(outcome).cast("double").alias("y")).where("y is not null")
    got = add_up(rows.mapInArrow(run, "fold long, k long, s double, n double"), ["fold", "k"]).collect()
    return pd.DataFrame(sorted((r.fold, r.k, r.s / r.n) for r in got), columns=["fold", "n_components", "loss"])


def bootstrap_regression(arrays: DataFrame, time: np.ndarray, outcome: str, k: int, replicates: int = 200, unit: str = "curve_id", dims: int = 1, seed: int = 0) -> DataFrame:
    """Paired bootstrap: per replicate the intercept, slope function and mean of a complete refit (rep, constant, place, slope).

    ``constant`` and ``place`` give a curve's prediction as constant + values . place; units are resampled whole.
    """
    w = np.repeat(trapezoid_weights(time), dims)
    size = len(w) + 2

    def refit(batches):
        for b in batches:
            out = []
            for rep, flat in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                m = fit_scores(np.asarray(flat.values, float).reshape(size, size), w, k)
                c, place, _ = m.functional()
                out.append((rep, c, place.tolist(), m.slope.tolist()))
            if out:
                kinds = (pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["rep", "constant", "place", "slope"])

    g = replicate_grams(arrays, _rows(arrays, outcome, ()), unit, replicates, seed)
    return g.select("rep", "gram").mapInArrow(refit, "rep long, constant double, place array<double>, slope array<double>")


def slope_uncertainty(boot: DataFrame, model: ScoreModel, level: float = 0.95) -> DataFrame:
    """Pointwise percentile interval of the slope function: (place, slope, se, lower, upper)."""
    estimate = boot.sparkSession.createDataFrame(list(enumerate(map(float, model.slope))), "place int, slope double")
    cells = boot.select("rep", F.posexplode("slope").alias("place", "value"))
    per = cells.groupBy("place").agg(F.stddev_samp("value").alias("se"), F.percentile("value", (1 - level) / 2).alias("lower"), F.percentile("value", (1 + level) / 2).alias("upper"))
    return estimate.join(per, "place")


def slope_band(boot: DataFrame, model: ScoreModel, level: float = 0.95, scope: str = "global", dims: int = 1) -> pd.DataFrame:
    """Simultaneous band of the slope function over the grid, of all dimensions together or of each: (place, dimension, slope, se, lower, upper)."""
    draws_ = np.stack(boot.select("rep", "slope").toPandas().sort_values("rep")["slope"])  # replicates times grid, both declared
    se = draws_.std(0, ddof=1)
    split = lambda x: np.swapaxes(x.reshape(*x.shape[:-1], -1, dims), -1, -2)  # noqa: E731  by dimension
    c = simultaneous(split(draws_), split(model.slope), split(se), level, "family" if scope == "global" else "each")
    half = np.tile(c, len(se) // dims) * se
    return pd.DataFrame({"place": np.arange(len(se)), "dimension": np.arange(len(se)) % dims, "slope": model.slope, "se": se, "lower": model.slope - half, "upper": model.slope + half, "critical": np.tile(c, len(se) // dims)})


def prediction_uncertainty(boot: DataFrame, model: ScoreModel, targets: DataFrame, level: float = 0.95, residuals: np.ndarray | None = None, seed: int = 0) -> DataFrame:
    """Mean prediction of each target with its bootstrap spread; with ``residuals`` (a bounded sample or the quantiles of the centred
    training residuals) intervals of a future outcome instead: each replicate adds a residual drawn by target and replicate."""
    rows = boot.select("rep", "constant", "place").toPandas().sort_values("rep")
    constant, place = rows["constant"].to_numpy(), np.stack(rows["place"])
    c0, p0, _ = model.functional()
    tails = [(1 - level) / 2, 0.5, (1 + level) / 2]

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            m = matrix(b.column(2))
            z = m @ place.T + constant
            if residuals is not None:
                z = z + residuals[(uniforms(np.asarray(b.column(1)), z.shape[1], seed) * len(residuals)).astype(int)]
            q = np.quantile(z, tails, axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in (m @ p0 + c0, z.std(1, ddof=1), *q))], ["curve_id", "prediction", "se", "lower", "median", "upper"])

    kind = dict(targets.dtypes)["curve_id"]
    return targets.select("curve_id", F.xxhash64("curve_id"), "values").mapInArrow(run, f"curve_id {kind}, prediction double, se double, lower double, median double, upper double")


def centred_residuals(arrays: DataFrame, model: ScoreModel, outcome: str, points: int = 999) -> np.ndarray:
    """Quantiles of the centred training residuals, equally spaced: what future outcomes draw from."""
    c, place, _ = model.functional()
    residual = F.col(outcome).cast("double") - F.lit(c) - F.aggregate(F.zip_with("values", F.array(*(F.lit(float(x)) for x in place)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    e = arrays.select(residual.alias("e")).where("e is not null")
    r = e.agg(F.avg("e").alias("m"), F.percentile("e", F.array(*(F.lit((i + 0.5) / points) for i in range(points)))).alias("q")).first()
    return np.asarray(r.q) - r.m


def train(arrays: DataFrame, time: np.ndarray, outcome: str, k: int, covariates: tuple[str, ...] = (), dims: int = 1) -> ScoreModel:
    """The model of all curves."""
    return fit_scores(gram(arrays, _rows(arrays, outcome, covariates)), np.repeat(trapezoid_weights(time), dims), k)

