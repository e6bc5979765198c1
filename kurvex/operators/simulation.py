"""Known-truth simulation: curves from declared components, one reproducible stream of draws per curve, made on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fourier_basis(t: np.ndarray, k: int) -> np.ndarray:
    """The first k orthonormal sines and cosines on [0, 1]."""
    return np.stack([np.sqrt(2) * (np.sin if i % 2 == 0 else np.cos)(2 * np.pi * (i // 2 + 1) * t) for i in range(k)])


def simulate_functional_process(spark: SparkSession, n_curves: int, n_time: int, variances: list[float], noise: float = 0.0, seed: int = 0, dropout: float = 0.0, sparse: int | None = None) -> DataFrame:
    """curve_id, t_idx, t, x, truth scores: mean sin(pi t), given score variances, noise, missing at random, or ``sparse`` random times."""
    grid = np.linspace(0, 1, n_time)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b["id"]:
                rng = np.random.default_rng([seed, int(i)])
                t = np.sort(rng.uniform(0, 1, sparse)) if sparse else grid
                s = rng.standard_normal(len(variances)) * np.sqrt(variances)
                x = np.sin(np.pi * t) + s @ fourier_basis(t, len(variances)) + noise * rng.standard_normal(len(t))
                keep = rng.uniform(size=len(t)) >= dropout
                yield pd.DataFrame({"curve_id": i, "t_idx": np.arange(len(t)), "t": t, "x": np.where(keep, x, np.nan), "scores": [s.tolist()] * len(t)}).assign(x=lambda d: d["x"].astype(object).where(d["x"].notna(), None).astype("Float64"))

    return spark.range(n_curves).mapInPandas(run, "curve_id long, t_idx long, t double, x double, scores array<double>").withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def scenarios(grid: dict[str, list]) -> list[dict]:
    """The Cartesian product of declared parameter values."""
    out: list[dict] = [{}]
    for k, values in grid.items():
        out = [{**s, k: v} for s in out for v in values]
    return out


def recovery(truth: DataFrame, estimate: DataFrame) -> DataFrame:
    """Correlation and root-mean-square error of estimated and true scores (curve_id, value), the sign free."""
    j = truth.select("curve_id", F.col("value").alias("a")).join(estimate.select("curve_id", F.col("value").alias("b")), "curve_id")
    m = j.agg(F.corr("a", "b").alias("r"), F.avg(F.pow(F.col("a") - F.col("b"), 2)).alias("p"), F.avg(F.pow(F.col("a") + F.col("b"), 2)).alias("q"), F.count(F.lit(1)).alias("n"))
    return m.select("n", F.abs("r").alias("correlation"), F.sqrt(F.least("p", "q")).alias("rmse"))


def simulate_process(spark: SparkSession, spec: dict, seed: int = 0) -> DataFrame:
    """Curves with exact truth, each a function of seed, participant and trial alone: (curve_id, participant, trial, t_idx, t, x, truth, scores, warp).

    ``spec``: participants, trials, and, all optional, n_time (the dense grid) or samples (random times per curve, ``design``
    uniform or clustered), participant and trial (variances of the components at either level), noise, dropout (missing
    at random), phase (deviation of a power warp), tails (degrees of freedom of t scores; normal without).
    """
    p = {"trials": 1, "n_time": 31, "samples": None, "design": "uniform", "participant": [], "trial": [1.0], "noise": 0.0, "dropout": 0.0, "phase": 0.0, "tails": None} | spec
    grid, k = np.linspace(0, 1, p["n_time"]), max(len(p["participant"]), len(p["trial"]))

    def score(rng: np.random.Generator, variances: list[float]) -> np.ndarray:
        v = np.zeros(k)
        v[: len(variances)] = variances
        z = rng.standard_normal(k) if p["tails"] is None else rng.standard_t(p["tails"], k) / np.sqrt(p["tails"] / (p["tails"] - 2))
        return z * np.sqrt(v)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b["id"]:
                person, trial = divmod(int(i), p["trials"])
                own, rng = np.random.default_rng([seed, 1, person]), np.random.default_rng([seed, 2, int(i)])
                s = score(own, p["participant"]) + score(rng, p["trial"])
                t = grid
                if p["samples"]:
                    t = np.sort(rng.uniform(size=p["samples"]) if p["design"] == "uniform" else rng.beta(0.6, 0.6, p["samples"]))
                power = float(np.exp(p["phase"] * rng.standard_normal()))
                truth = np.sin(np.pi * t**power) + s @ fourier_basis(t**power, k)
                x = truth + p["noise"] * rng.standard_normal(len(t))
                keep = rng.uniform(size=len(t)) >= p["dropout"]
                yield pd.DataFrame({"curve_id": i, "participant": person, "trial": trial, "t_idx": np.arange(len(t)), "t": t, "x": np.where(keep, x, np.nan), "truth": truth, "scores": [s.tolist()] * len(t), "warp": t**power})

    kind = "curve_id long, participant long, trial long, t_idx long, t double, x double, truth double, scores array<double>, warp double"
    return spark.range(p["participants"] * p["trials"]).mapInPandas(run, kind).withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def simulate_planar(spark: SparkSession, participants: int = 20, trials: int = 6, n_time: int = 61, seed: int = 42) -> DataFrame:
    """Repeated planar paths: a common loop, a shift and scale of every participant, smooth deviations of every trial."""
    grid = np.linspace(0, 1, n_time)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b["id"]:
                person = int(i) // trials
                own, rng = np.random.default_rng([seed, 1, person]), np.random.default_rng([seed, 2, int(i)])
                scale, shift = 1 + 0.15 * own.standard_normal(), 0.3 * own.standard_normal(2)
                path = scale * np.stack((np.cos(2 * np.pi * grid), np.sin(4 * np.pi * grid) / 2)) + shift[:, None] + 0.2 * rng.standard_normal((2, 3)) @ fourier_basis(grid, 3) / np.sqrt(2)
                yield pd.DataFrame({"curve_id": i, "participant": person, "t_idx": np.arange(n_time), "t": grid, "x": path[0], "y": path[1]})

    return spark.range(participants * trials).mapInPandas(run, "curve_id long, participant long, t_idx long, t double, x double, y double")


def simulate_compositions(spark: SparkSession, curves: int = 80, n_time: int = 41, parts: int = 4, seed: int = 17) -> DataFrame:
    """Smooth shares that are positive and add up to one at every time: (curve_id, t_idx, t, p0, p1, ...)."""
    grid = np.linspace(0, 1, n_time)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b["id"]:
                rng = np.random.default_rng([seed, int(i)])
                z = np.exp(rng.standard_normal((parts, 1)) / 2 + rng.standard_normal((parts, 4)) @ fourier_basis(grid, 4) / 3)
                yield pd.DataFrame({"curve_id": i, "t_idx": np.arange(n_time), "t": grid} | {f"p{k}": row for k, row in enumerate(z / z.sum(0))})

    return spark.range(curves).mapInPandas(run, "curve_id long, t_idx long, t double, " + ", ".join(f"p{k} double" for k in range(parts)))


def informative_retention(samples: DataFrame, intercept: float = 0.8, slope: float = -2.4, seed: int = 166) -> DataFrame:
    """An explicit missingness process on complete truth: a candidate is observed with a logistic probability of its time."""
    chance = 1 / (1 + F.exp(-(F.lit(intercept) + slope * F.col("t"))))
    u = F.pmod(F.xxhash64("curve_id", "t_idx", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    seen = u < chance
    return samples.withColumns({"chance": chance, "observed": seen.cast("int"), "x": F.when(seen, F.col("x"))})


def observation_process(samples: DataFrame) -> DataFrame:
    """Candidates of a simulation with whether they were observed: the explicit denominator."""
    return samples.select("curve_id", "participant", "t_idx", "t", F.col("x").isNotNull().cast("int").alias("observed"), "x")


def score_variances(samples: DataFrame) -> DataFrame:
    """Realised score variances of curves, participants (their means) and trials (deviations from them): (level, component, variance)."""
    one = samples.where("t_idx = 0").select("curve_id", "participant", F.posexplode("scores").alias("k", "s"))
    mean = one.groupBy("participant", "k").agg(F.avg("s").alias("m"))
    rows = one.join(mean, ["participant", "k"])
    curve = rows.groupBy("k").agg(F.var_samp("s").alias("v")).select(F.lit("curve").alias("level"), "k", "v")
    trial = rows.groupBy("k").agg(F.var_samp(F.col("s") - F.col("m")).alias("v")).select(F.lit("trial"), "k", "v")
    person = mean.groupBy("k").agg(F.var_samp("m").alias("v")).select(F.lit("participant"), "k", "v")
    return curve.union(person).union(trial).select("level", (F.col("k") + 1).alias("component"), F.col("v").alias("variance"))


#: What recovery values mean, by their names.
METRICS = {
    "mean_ise": "integrated squared error of the mean", "component_ise": "integrated squared error of a matched component, its sign free",
    "eigenvalue_ratio": "estimated over true eigenvalue", "least_cosine": "least cosine of the principal angles of the component spaces", "score_correlation": "correlation of matched scores, the sign free",
    "covariance_ise": "integrated squared error of the covariance surface", "noise_ratio": "estimated over true noise variance", "warp_ise": "mean integrated squared error of the warps", "function_ise": "integrated squared error of a coefficient or variance function",
}


def metric_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(METRICS.items()), "metric string, meaning string")


def value_key(metric: str, component: int | None = None, channel: str | None = None) -> str:
    """A flat name of one recovery value."""
    return "/".join(x for x in (metric, None if component is None else f"component {component}", channel) if x)


def evaluate_components(mean: np.ndarray, components: np.ndarray, eigenvalues: np.ndarray, weights: np.ndarray, truth: dict, cov: np.ndarray | None = None, noise: float | None = None) -> list[tuple]:
    """Recovery of a decomposition (any grid, any channels): rows (metric, component, value); components are matched and their signs free.

    ``truth`` has mean, components, eigenvalues on the same places, and may have cov and noise.
    """
    from ..functions.numeric import assign

    ise = lambda d: float((d * d * weights).sum())
    sim = (truth["components"] * weights) @ components.T
    at = assign(np.abs(sim))
    rows = [("mean_ise", None, ise(mean - truth["mean"]))]
    for i, j in enumerate(at):
        sign = -1.0 if sim[i, j] < 0 else 1.0
        rows += [("component_ise", i + 1, ise(sign * components[j] - truth["components"][i])), ("eigenvalue_ratio", i + 1, float(eigenvalues[j] / truth["eigenvalues"][i]))]
    rows.append(("least_cosine", None, float(np.linalg.svd(sim, compute_uv=False).min())))
    if cov is not None and "cov" in truth:
        rows.append(("covariance_ise", None, float((np.square(cov - truth["cov"]) * np.outer(weights, weights)).sum())))
    if noise is not None and truth.get("noise"):
        rows.append(("noise_ratio", None, float(noise / truth["noise"])))
    return rows


def evaluate_functions(estimate: dict[str, np.ndarray], truth: dict[str, np.ndarray], weights: np.ndarray) -> list[tuple]:
    """Integrated squared errors of named functions (coefficients, variance functions): rows (metric: name, None, value)."""
    return [(f"function_ise/{k}", None, float((np.square(estimate[k] - v) * weights).sum())) for k, v in truth.items()]


def evaluate_warps(estimate: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean integrated squared error over curves of warps (curve_id, t, warped) on one grid, trapezoid weights."""
    from pyspark.sql import Window

    from ..functions.analytic import trapezoid_weight

    j = estimate.join(truth.select("curve_id", "t", F.col("warped").alias("true_warp")), ["curve_id", "t"])
    j = j.withColumn("w", trapezoid_weight(F.col("t"), Window.partitionBy("curve_id").orderBy("t")))
    return j.groupBy("curve_id").agg(F.sum(F.col("w") * F.pow(F.col("warped") - F.col("true_warp"), 2)).alias("e")).agg(F.avg("e").alias("warp_ise"))


def expand_scenarios(base: dict, factors: dict[str, list], replicates: int = 1, seed: int = 0, seed_policy: str = "shared") -> list[dict]:
    """Named scenarios of a Cartesian product; replicates have the same seeds in every scenario (``shared``) or seeds of their own."""
    out = []
    for i, values in enumerate(scenarios(factors)):
        name = ",".join(f"{k}={v}" for k, v in values.items()) or "base"
        first = seed if seed_policy == "shared" else seed + i * replicates
        out.append({"name": name, "spec": base | values, "seeds": [first + r for r in range(replicates)]})
    return out


def qualification_scenarios(replicates: int = 3, seed: int = 202_800) -> list[dict]:
    """A small suite with known truth: dense, noisy, sparse and two-level designs."""
    base = {"participants": 60, "trial": [2.0, 0.5]}
    kinds = {"dense": {}, "noisy": {"noise": 0.3}, "sparse": {"samples": 10, "noise": 0.1}, "levels": {"participants": 20, "trials": 3, "participant": [1.0]}}
    return [{"name": k, "spec": base | v, "seeds": [seed + r for r in range(replicates)]} for k, v in kinds.items()]


def stress_scenarios(replicates: int = 10, seed: int = 204_000) -> list[dict]:
    """Regimes without thresholds: few curves, much noise, heavy tails, near ties, very sparse, clustered times, missing values, phase."""
    base = {"participants": 60, "trial": [2.0, 0.5], "noise": 0.1}
    kinds = {"few": {"participants": 8}, "noise": {"noise": 1.5}, "tails": {"tails": 3}, "ties": {"trial": [1.0, 0.98]}, "very_sparse": {"samples": 3}, "clustered": {"samples": 8, "design": "clustered"}, "missing": {"dropout": 0.4}, "phase": {"phase": 0.3}}
    return [{"name": k, "spec": base | v, "seeds": [seed + r for r in range(replicates)]} for k, v in kinds.items()]


def scenario_frame(spark: SparkSession, suites: dict[str, list[dict]]) -> DataFrame:
    """One row per scenario of the named suites: its design and seeds."""
    import json

    return spark.createDataFrame([(s, x["name"], json.dumps(x["spec"], sort_keys=True), len(x["seeds"]), x["seeds"][0]) for s, xs in suites.items() for x in xs], "suite string, scenario string, spec string, replicates int, first_seed long")


def run_scenarios(spark: SparkSession, suite: list[dict], estimator, assess, failure: str = "raise") -> DataFrame:
    """Fits every replicate without its truth and assesses it: (scenario, seed, metric, component, value, failure).

    ``estimator`` gets samples without truth columns, ``assess`` its result and the spec and returns rows (metric, component, value).
    """
    rows = []
    for s in suite:
        for seed in s["seeds"]:
            try:
                data = simulate_process(spark, s["spec"], seed)
                found = assess(estimator(data.drop("truth", "scores", "warp")), s["spec"])
                rows += [(s["name"], seed, m, c, float(v), None) for m, c, v in found]
            except (ValueError, RuntimeError) as e:
                if failure == "raise":
                    raise
                rows.append((s["name"], seed, None, None, None, str(e)))
    return spark.createDataFrame(rows, "scenario string, seed long, metric string, component int, value double, failure string")


def recovery_summary(results: DataFrame) -> DataFrame:
    """Per scenario, metric and component: replicates, mean, deviation, Monte Carlo error, median and 90 % range."""
    v = F.col("value")
    r = results.where("failure is null").groupBy("scenario", "metric", "component")
    return r.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("mc_se"), F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.05).alias("lower"), F.percentile(v, 0.95).alias("upper"))


def failure_frame(results: DataFrame) -> DataFrame:
    """Per scenario: replicates, failures, their share and its Monte Carlo error."""
    per = results.groupBy("scenario", "seed").agg(F.max(F.col("failure").isNotNull().cast("int")).alias("f"))
    share = F.avg(F.col("f").cast("double"))
    return per.groupBy("scenario").agg(F.count(F.lit(1)).alias("replicates"), F.sum("f").alias("failures"), share.alias("share"), F.sqrt(share * (1 - share) / F.count(F.lit(1))).alias("mc_se"))
