"""Texts, figures, simulations, recovery and the workflows of the models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kurvex.operators import decomposition as dec
from kurvex.operators import distances as dist
from kurvex.operators import geometry as geo
from kurvex.operators import simulation as sim
from kurvex.plans import figures, models, texts
from kurvex.plans import workflows as wf

NAMES = {"coefficient", "profile_id", "model", "failure", "curve_id", "component", "status", "metric", "left", "right", "verdict", "parameters", "target", "scenario", "suite", "block", "channel", "group"}
FLAGS = {"extrapolated", "error_outlier", "score_outlier", "outlier", "rejected", "anomalous"}


def table(spark, columns):
    """Two rows with every column that is asked for."""
    cell = lambda c, k: bool(k) if c in FLAGS else f"{c}{k}" if c in NAMES else 0.5 + k
    kind = lambda c: "boolean" if c in FLAGS else "string" if c in NAMES else "double"
    return spark.createDataFrame([tuple(cell(c, k) for c in columns) for k in (0, 1)], ", ".join(f"`{c}` {kind(c)}" for c in columns))


def test_every_text_is_filled(spark):
    for name in texts.result_names():
        columns = sorted(texts.columns_of(name))
        text = texts.reporting_text(name, table(spark, columns), level=0.95)
        assert "{" not in text and "Declared: level 0.95." in text, name
    assert "undefined" in texts.reporting_text("rqa", table(spark, sorted(texts.columns_of("rqa"))).limit(0))


def test_every_figure_has_data(spark, tmp_path):
    import re

    for name, f in figures.FIGURES.items():
        columns = sorted(set(re.findall(r"[a-z_0-9]+", " ".join(x for x in (f.x, f.y, f.by, f.low, f.high, f.value) if x))) - {"concat_ws"})
        data = figures.figure_data(name, table(spark, [c for c in columns if not c.isdigit()]))
        assert {"group", "x", "y"} <= set(data.columns), name
    data = figures.figure_data("functional_mean_band", spark.createDataFrame([(i, float(i), i - 1.0, i + 1.0) for i in range(5)], "t_idx int, mean double, lower double, upper double"))
    path = figures.save_figure("functional_mean_band", data, f"{tmp_path}/f.svg")
    assert "<polygon" in open(path).read() and "<svg" in figures.svg("functional_mean_band", data.limit(0))
    with pytest.raises(ValueError):
        figures.svg("functional_mean_band", data, max_points=2)


def test_simulated_truth(spark):
    s = sim.simulate_process(spark, {"participants": 30, "trials": 4, "participant": [1.0], "trial": [0.5, 0.25], "noise": 0.1, "dropout": 0.1}, 3).cache()
    assert s.count() == 120 * 31 and 0.05 < s.where("x is null").count() / s.count() < 0.15
    assert s.agg(F.avg(F.abs(F.col("x") - F.col("truth")))).first()[0] == pytest.approx(0.1 * np.sqrt(2 / np.pi), rel=0.1)
    v = {(r.level, r.component): r.variance for r in sim.score_variances(s).collect()}
    assert v["trial", 2] == pytest.approx(0.25 * 0.75, rel=0.4) and v["participant", 1] > v["participant", 2]
    again = sim.simulate_process(spark, {"participants": 30, "trials": 4, "participant": [1.0], "trial": [0.5, 0.25], "noise": 0.1, "dropout": 0.1}, 3)
    assert s.exceptAll(again).isEmpty()
    kept = sim.informative_retention(s.where("x is not null"), 0.8, -2.4)
    share = {r.late: r.o for r in kept.groupBy((F.col("t") > 0.5).alias("late")).agg(F.avg("observed").alias("o")).collect()}
    assert share[False] > share[True] + 0.1 and sim.observation_process(s).where("observed = 0").count() == s.where("x is null").count()
    shares = sim.simulate_compositions(spark, 5, 11)
    geo.validate_simplex(shares, ("p0", "p1", "p2", "p3"))
    with pytest.raises(ValueError):
        geo.validate_simplex(shares.withColumn("p0", F.col("p0") + 0.1), ("p0", "p1", "p2", "p3"))
    assert sim.simulate_planar(spark, 3, 2, 11).count() == 66


def test_recovery_suite(spark):
    def estimate(data):
        return dec.fit_fpca(dist.curve_arrays(data), np.linspace(0, 1, 31), 2)

    def assess(fit, spec):
        t = np.linspace(0, 1, 31)
        truth = {"mean": np.sin(np.pi * t), "components": sim.fourier_basis(t, 2), "eigenvalues": np.array([2.0, 0.5])}
        return sim.evaluate_components(fit.mean, fit.components, fit.explained_variance, fit.weights, truth)

    suite = [s for s in sim.qualification_scenarios(2) if s["name"] in ("dense", "noisy")]
    r = sim.run_scenarios(spark, suite, estimate, assess).cache()
    s = {(x.scenario, x.metric, x.component): x for x in sim.recovery_summary(r).collect()}
    assert s["dense", "eigenvalue_ratio", 1].mean == pytest.approx(1, abs=0.4) and s["dense", "least_cosine", None].mean > 0.95
    failed = sim.run_scenarios(spark, suite[:1], lambda d: dec.fit_fpca(dist.curve_arrays(d).limit(1), np.linspace(0, 1, 31), 2), assess, "retain")
    assert sim.failure_frame(failed).first().failures == 2
    assert sim.scenario_frame(spark, {"q": sim.qualification_scenarios(), "s": sim.stress_scenarios()}).count() == 12
    grid = sim.expand_scenarios({"participants": 5}, {"noise": [0, 1]}, 2, 10, "own")
    assert [g["seeds"] for g in grid] == [[10, 11], [12, 13]] and sim.metric_frame(spark).count() == len(sim.METRICS)
    assert sim.value_key("component_ise", 2, "x") == "component_ise/component 2/x"


def test_registered_curves(spark):
    rows = [(c, i, i / 10, (i / 10) ** (1 + c), 1.0) for c in range(2) for i in range(11)]
    s = spark.createDataFrame(rows, "curve_id long, t_idx int, t double, x double, y double")
    warps = s.select("curve_id", "t", F.sqrt("t").alias("warped"))
    got = geo.register(s, warps, ("x",)).where("curve_id = 0").orderBy("t").collect()
    assert all(r.x == pytest.approx(np.sqrt(r.t)) for r in got)
    assert geo.phase_curves(warps).where("t = 0.25 and x <> 0.25").count() == 0
    true = warps.withColumn("warped", F.col("warped") + 0.1)
    assert sim.evaluate_warps(warps, true).first().warp_ise == pytest.approx(0.01)
    own = spark.createDataFrame([(0, 0.5, 0.0), (1, 0.25, 1.0)], "curve_id long, landmark_x double, landmark_y double")
    assert geo.center_on_landmark(s, landmarks=own).where("curve_id = 1 and t_idx = 10").first().x == 0.75
    with pytest.raises(ValueError):
        geo.center_on_landmark(s, landmarks=own.limit(1))
    geo.validate_missing(s, ("x",), 0.1)
    with pytest.raises(ValueError):
        geo.validate_missing(s.withColumn("x", F.when(F.col("t") > 0.5, F.col("x"))), ("x",), 0.1)
    assert geo.union_interval(s).first().end == 1


def test_distance_specifications(spark):
    a = spark.createDataFrame([(i, [float(i * i), float(i)]) for i in range(8)], "curve_id long, values array<double>")
    one = dist.l2_distances(dist.curve_pairs(a, a), [1.0, 0.0])
    two = dist.l2_distances(dist.curve_pairs(a, a), [0.0, 1.0])
    overall, local = dist.compare_specifications({"p": one, "q": two, "same": one}, 2)
    got = {(r.left, r.right): r for r in overall.collect()}
    assert got["p", "same"].spearman == pytest.approx(1) and got["p", "same"].mean_jaccard == 1 and got["p", "q"].spearman < 1
    assert local.count() == 24
    d = one.toPandas()
    ranks = dist.ranked(one).toPandas().merge(d, on=["a", "b"])
    assert np.allclose(ranks["rank"], ranks["distance_x"].rank())


def test_model_workflows(spark, tmp_path):
    s = sim.simulate_process(spark, {"participants": 12, "trials": 3, "participant": [0.5], "trial": [1.0], "n_time": 9, "noise": 0.2}, 5).withColumn("z", F.col("participant") % 3 / 3.0).cache()
    a = dist.curve_arrays(s).join(s.select("curve_id", "participant", "z").distinct(), "curve_id")
    grid = np.linspace(0, 1, 9)
    w = models.response_workflow(a, ["z"], replicates=30)
    assert w.tables["coefficients"].count() == 18 and w.tables["residuals"].count() == 36
    up = a.withColumn("values", F.transform("values", lambda v: F.when(v > 0, 1.0).otherwise(0.0)))
    g = models.generalized_workflow(up, grid, ["z"], participant="participant", family="binomial", basis_size=4, replicates=10, profiles=pd.DataFrame({"profile_id": ["a"], "z": [0.5]}))
    assert g.tables["predictions"].count() == 9
    m = models.mixed_workflow(a, grid, ["z"], participant="participant", replicates=20, fixed_size=4, random_size=2)
    assert {"coefficients", "random_effects", "variances", "residuals", "residual_dependence"} == set(m.tables)
    p = models.sparse_workflow(s, grid, 1, mean_bandwidths=[0.4], covariance_bandwidths=[0.5], noise=0.04)
    assert p.tables["scores"].count() == 36 and p.tables["covariance"].count() == 81
    lv = models.sparse_multilevel_workflow(s, grid, participant="participant", between=1, within=1, mean_bandwidth=0.4, covariance_bandwidth=0.5, noise=0.04)
    assert lv.tables["trial_scores"].count() == 36
    parts = [s.where(F.col("curve_id") % 3 == k) for k in range(3)]
    f = models.sparse_prediction_workflow(*parts, grid, 1, mean_bandwidth=0.4, covariance_bandwidth=0.5, cutoff=0.5, alpha=0.2, noise=0.04)
    assert f.tables["bands"].count() == 12 * 4
    with pytest.raises(ValueError):
        models.sparse_prediction_workflow(parts[0], parts[0], parts[2], grid, 1, mean_bandwidth=0.4, covariance_bandwidth=0.5, cutoff=0.5)
    assert models.summary_frame(spark, w).first().steps == 2 and "spark" in models.environment(spark)
    models.export_bundle(w, spark, f"file://{tmp_path}/bundle")
    assert models.contract("fit_fpca")[0] == "components" and models.contract_frame(spark).count() == len(models.CONTRACTS)
    assert models.curve_summary(s, ("x",)).first().n_curves == 36 and "steps took" in texts.reporting_text("workflow", w.frame(spark, "steps"))
    for bad in (lambda: models.positive_integer(True, "n"), lambda: models.checked_grid([1, 1]), lambda: models.candidates([0.0], "h"), lambda: models.no_preprocessing([1]), lambda: models.config_json({"a": float("nan")})):
        with pytest.raises(ValueError):
            bad()
    assert wf.render_report(w).startswith("# function_on_scalar")
