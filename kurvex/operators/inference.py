"""Regression and inference on curves: pointwise OLS, mean bands, conformal p-values, robust scores, wild bootstrap, GEE."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import simultaneous
from ..functions.sums import add_up, gram, scalars, vector, wild_sums
from .stability import higher


def function_on_scalar(samples: DataFrame, predictor: str, value: str = "x") -> DataFrame:
    """Pointwise least squares of the value on one predictor: intercept, slope, HC1 standard error of the slope."""
    fit = samples.groupBy("t_idx").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(value, predictor).alias("slope"), F.regr_intercept(value, predictor).alias("intercept"), F.avg(predictor).alias("mz"), F.regr_sxx(value, predictor).alias("sxx"))
    e = samples.join(F.broadcast(fit), "t_idx").withColumn("h", (F.col(predictor) - F.col("mz")) * (F.col(value) - F.col("intercept") - F.col("slope") * F.col(predictor)))
    return e.groupBy("t_idx").agg(F.first("n").alias("n"), F.first("intercept").alias("intercept"), F.first("slope").alias("slope"), F.sqrt(F.first("n") / (F.first("n") - 2) * F.sum(F.col("h") * F.col("h")) / F.pow(F.first("sxx"), 2)).alias("slope_se"))


def design_regression(arrays: DataFrame, design: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (predictors x grid) and (X'X)^-1 for many predictors; X'X and X'Y are one Gram matrix."""
    g, p = gram(arrays, F.concat(scalars(*design), F.col("values"))), len(design)
    inverse = np.linalg.inv(g[:p, :p])
    return inverse @ g[:p, p:], inverse


def mean_function(samples: DataFrame, value: str = "x") -> DataFrame:
    """Pointwise mean and standard error over curves."""
    return samples.groupBy("t_idx").agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))


def unit_means(arrays: DataFrame, unit: str) -> DataFrame:
    """Mean values of each unit's curves (curve_id: the unit's hash), pre-aggregated in every task."""
    parts = arrays.select(F.xxhash64(unit).alias("curve_id"), F.lit(1.0).alias("n"), "values")
    return add_up(parts, ["curve_id"]).select("curve_id", F.transform("values", lambda v: v / F.col("n")).alias("values"))


def multiplier_mean_band(arrays: DataFrame, replicates: int = 200, level: float = 0.95, seed: int = 0, unit: str | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, standard error and the simultaneous critical value from Gaussian multipliers of curves, or of ``unit`` (the mean of unit means).

    The draws are a function of the unit, so tasks add up; points without variance don't count, the quantile isn't interpolated.
    """
    from .decomposition import moments

    rows = arrays if unit is None else unit_means(arrays, unit)
    n, s, g = moments(rows)
    mean, se = s / n, np.sqrt(np.maximum(np.diag(g) / n - (s / n) ** 2, 0) * n / (n - 1) / n)
    z = wild_sums(rows, F.array(F.lit(1.0)), vector("values"), "curve_id", replicates, "normal", seed)[:, 0]
    return mean, se, float(simultaneous(((z[:, 1:] - z[:, :1] * mean) / n)[:, None], np.zeros((1, len(mean))), se[None], level, "family")[0])


def conformal_p_values(calibration: DataFrame, target: DataFrame, buckets: int = 64) -> DataFrame:
    """(1 + number of calibration scores at or above the target's) / (n + 1).

    Scores are dealt to buckets of about equal size by approximate quantiles, ranked inside a bucket, and offset by the
    counts of the buckets above: ranks are exact, and no task gets all rows.
    """
    cuts = calibration.agg(F.percentile_approx("score", [k / buckets for k in range(1, buckets)], 10_000).alias("q")).first().q or []
    bucket = sum(((F.col("score") >= float(c)).cast("int") for c in sorted(set(cuts))), F.lit(0))
    kind = dict(target.dtypes)["curve_id"]
    both = calibration.select(F.lit(None).cast(kind).alias("curve_id"), F.col("score").cast("double").alias("score"), F.lit(1).alias("c")).union(target.select("curve_id", F.col("score").cast("double"), F.lit(0)))
    both = both.withColumn("bucket", bucket)
    counts = both.where("c = 1").groupBy("bucket").agg(F.count(F.lit(1)).alias("k"))
    inside = F.sum("c").over(Window.partitionBy("bucket").orderBy(F.desc("score"), F.desc("c")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = both.withColumn("inside", inside).where("c = 0")
    above = ranked.select("bucket").distinct().join(F.broadcast(counts.toDF("other", "k")), F.col("other") > F.col("bucket"), "left").groupBy("bucket").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("above"))
    n = calibration.agg(F.count(F.lit(1)).alias("n"))
    out = ranked.join(F.broadcast(above), "bucket").crossJoin(F.broadcast(n))
    return out.select("curve_id", "score", ((1 + F.col("inside") + F.col("above")) / (1 + F.col("n"))).alias("p_value"))


def robust_z(rows: DataFrame, value: str) -> DataFrame:
    """0.6745 (x - median) / MAD over all rows; 0 where the MAD is 0."""
    med = rows.agg(F.percentile(value, 0.5).alias("med"))
    dev = rows.crossJoin(F.broadcast(med))
    mad = dev.agg(F.percentile(F.abs(F.col(value) - F.col("med")), 0.5).alias("mad"))
    return dev.crossJoin(F.broadcast(mad)).withColumn("z", F.when(F.col("mad") > 0, 0.67448975 * (F.col(value) - F.col("med")) / F.col("mad")).otherwise(0.0)).drop("med", "mad")


def wild_slope_bootstrap(rows: DataFrame, y: str, x: str, replicates: int, seed: int = 0) -> DataFrame:
    """Wild bootstrap of a scalar slope under the null: replicate slopes from sign-flipped null residuals."""
    m = rows.agg(F.avg(y).alias("my"), F.avg(x).alias("mx"), F.regr_sxx(y, x).alias("sxx"))
    h = rows.crossJoin(F.broadcast(m)).select("unit", ((F.col(x) - F.col("mx")) * (F.col(y) - F.col("my")) / F.col("sxx")).alias("h"))
    total = wild_sums(h, F.array(F.lit(1.0)), F.array("h"), "unit", replicates, "rademacher", seed)[:, 0, 0]
    return rows.sparkSession.createDataFrame([(r, float(v)) for r, v in enumerate(total)], "rep int, slope double")


def bootstrap_means(rows: DataFrame, value: str, replicates: int, seed: int = 0) -> DataFrame:
    """Poisson bootstrap replicates of the mean over units."""
    total = wild_sums(rows.where(F.col(value).isNotNull()), F.array(F.lit(1.0)), F.array(F.lit(1.0), F.col(value).cast("double")), "unit", replicates, "poisson", seed)[:, 0]
    return rows.sparkSession.createDataFrame([(r, float(v[1] / v[0])) for r, v in enumerate(total) if v[0] > 0], "rep int, mean double")


def simultaneous_band(estimate: DataFrame, replicates: DataFrame, level: float = 0.95) -> DataFrame:
    """Bands estimate ± c * se with c the level's quantile (not interpolated) of max |draw - estimate| / se; (t_idx, estimate) and (rep, t_idx, value)."""
    e = replicates.join(F.broadcast(estimate), "t_idx")
    se = e.groupBy("t_idx").agg(F.stddev_samp("value").alias("se"))
    top = e.join(F.broadcast(se), "t_idx").groupBy("rep").agg(F.max(F.when(F.col("se") > 0, F.abs(F.col("value") - F.col("estimate")) / F.col("se")).otherwise(0.0)).alias("m"))
    c = top.agg(higher("m", level).alias("c"))
    return estimate.join(se, "t_idx").crossJoin(F.broadcast(c)).select("t_idx", "estimate", "se", (F.col("estimate") - F.col("c") * F.col("se")).alias("lower"), (F.col("estimate") + F.col("c") * F.col("se")).alias("upper"))


def logistic_gee(rows: DataFrame, y: str, predictors: list[str], cluster: str, iterations: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Independence-working GEE for a binary response: IRLS sums in Spark, the cluster sandwich from per-cluster scores."""
    beta = np.zeros(len(predictors))
    cols = [F.col(p).cast("double") for p in predictors]
    for _ in range(iterations):
        eta = sum((c * float(b) for c, b in zip(cols, beta, strict=True)), F.lit(0.0))
        mu = 1 / (1 + F.exp(-eta))
        s = rows.select(mu.alias("mu"), F.col(y).cast("double").alias("y"), *(c.alias(f"x{k}") for k, c in enumerate(cols)))
        n = len(cols)
        r = s.agg(*(F.sum(F.col(f"x{k}") * (F.col("y") - F.col("mu"))).alias(f"g{k}") for k in range(n)), *(F.sum(F.col(f"x{j}") * F.col(f"x{k}") * F.col("mu") * (1 - F.col("mu"))).alias(f"h{j}_{k}") for j in range(n) for k in range(n))).first()
        g, h = np.array(r[:n]), np.array(r[n:]).reshape(n, n)
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    eta = sum((c * float(b) for c, b in zip(cols, beta, strict=True)), F.lit(0.0))
    res = F.col(y).cast("double") - 1 / (1 + F.exp(-eta))
    u = rows.groupBy(cluster).agg(*(F.sum(c * res).alias(f"u{k}") for k, c in enumerate(cols)))
    m = np.array(u.agg(*(F.sum(F.col(f"u{j}") * F.col(f"u{k}")) for j in range(n) for k in range(n))).first()).reshape(n, n)
    inv = np.linalg.inv(h)
    return beta, inv @ m @ inv


def variance_components(rows: DataFrame, value: str, group: str) -> DataFrame:
    """One-way random effects by moments: overall mean, between and within variance, intraclass correlation."""
    g = rows.groupBy(group).agg(F.count(value).alias("k"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    a = g.agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("q"), F.sum(F.col("k") * F.col("m")).alias("s"), F.sum((F.col("k") - 1) * F.coalesce("v", F.lit(0.0))).alias("ssw"), F.sum(F.col("k") * F.col("m") * F.col("m")).alias("sb"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    msw = F.col("ssw") / (F.col("n") - F.col("q"))
    msb = (F.col("sb") - F.col("s") * F.col("s") / F.col("n")) / (F.col("q") - 1)
    k0 = (F.col("n") - F.col("kk") / F.col("n")) / (F.col("q") - 1)
    between = F.greatest(F.lit(0.0), (msb - msw) / k0)
    return a.select((F.col("s") / F.col("n")).alias("mean"), between.alias("between"), msw.alias("within"), (between / (between + msw)).alias("icc"))


def family_test(observed: dict[str, float], replicates: dict[str, list[float]]) -> list[dict]:
    """Max-t test of a family: each target's own p-value and the one adjusted by the largest studentised replicate."""
    names = list(observed)
    r = np.stack([np.asarray(replicates[k], float) for k in names])
    sd = r.std(1, ddof=1)
    z, t = np.abs(r / sd[:, None]), np.abs(np.array([observed[k] for k in names]) / sd)
    top, n = z.max(0), r.shape[1]
    return [{"target": k, "statistic": float(t[i]), "p_value": float((1 + (z[i] >= t[i]).sum()) / (n + 1)), "adjusted_p": float((1 + (top >= t[i]).sum()) / (n + 1))} for i, k in enumerate(names)]


def monte_carlo_interval(exceedances: int, replicates: int, z: float = 1.959964) -> tuple[float, float]:
    """Wilson interval of a Monte Carlo p-value."""
    p, n = exceedances / replicates, replicates
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return float(max(0, mid - half)), float(min(1, mid + half))


def gee_predictions(rows: DataFrame, predictors: list[str], beta: np.ndarray, cov: np.ndarray, z: float = 1.959964) -> DataFrame:
    """Mean predictions with pointwise bands on the link scale (logit)."""
    x = [F.col(p).cast("double") for p in predictors]
    eta = sum((c * float(b) for c, b in zip(x, beta, strict=True)), F.lit(0.0))
    var = sum((x[i] * x[j] * float(cov[i, j]) for i in range(len(x)) for j in range(len(x))), F.lit(0.0))
    mean = lambda e: 1 / (1 + F.exp(-e))
    return rows.withColumns({"mean": mean(eta), "lower": mean(eta - z * F.sqrt(var)), "upper": mean(eta + z * F.sqrt(var))})


def percentile_interval(replicates: DataFrame, value: str, keys: list[str], level: float = 0.95) -> DataFrame:
    """Percentile interval of bootstrap replicates."""
    return replicates.groupBy(*keys).agg(F.percentile(value, (1 - level) / 2).alias("lower"), F.percentile(value, 0.5).alias("median"), F.percentile(value, (1 + level) / 2).alias("upper"))


def residual_acf(residuals: DataFrame, max_lag: int) -> DataFrame:
    """Lag correlation and semivariogram of residuals (curve_id, t_idx, e), over all pairs of a lag within curves."""
    w = Window.partitionBy("curve_id").orderBy("t_idx")
    r = residuals.withColumns({f"l{k}": F.lead("e", k).over(w) for k in range(1, max_lag + 1)})
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"l{k}").alias("f")) for k in range(1, max_lag + 1)))).alias("z")
    p = r.select("e", rows).select("e", "z.lag", "z.f").where("f is not null")
    return p.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), F.corr("e", "f").alias("correlation"), (F.avg(F.pow(F.col("e") - F.col("f"), 2)) / 2).alias("semivariance"))
