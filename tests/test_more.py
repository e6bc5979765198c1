"""Kernels, models, portable results, workflows and streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kurvex.operators import decomposition as dec
from kurvex.operators import distances as dist
from kurvex.operators import mixed, simulation, smoothing, sparse, sparse_fit
from kurvex.plans import workflows as wf
from kurvex.sources import portable
from kurvex.streaming import live


@pytest.fixture(scope="module")
def curves(spark):
    return simulation.simulate_functional_process(spark, 300, 31, [2.0, 0.5], noise=0.05, seed=3).cache()


def test_simulated_components_are_found(spark, curves):
    t = np.linspace(0, 1, 31)
    a = dist.curve_arrays(curves)
    fit = dec.fit_fpca(a, t, 2)
    assert fit.explained_variance[0] == pytest.approx(2.0, rel=0.25) and fit.explained_variance[1] == pytest.approx(0.5, rel=0.25)
    assert np.allclose((fit.components * fit.weights) @ fit.components.T, np.eye(2), atol=1e-10)
    truth = curves.groupBy("curve_id").agg(F.first("scores")[0].alias("value"))
    got = dec.scores(a, fit).select("curve_id", F.col("scores")[0].alias("value"))
    r = simulation.recovery(truth, got).first()
    assert r.n == 300 and r.correlation > 0.98
    assert dec.reconstruction_error(a, fit).agg(F.max("rmse")).first()[0] < 0.2
    cv = mixed.cross_validate_reconstruction(a, t, [1, 2, 3])
    assert mixed.select_components(cv, "one_standard_error") in (2, 3) and set(cv["fold"]) == set(range(5))
    influence = mixed.group_influence(a.withColumn("grp", F.col("curve_id") % 6), "grp", t, 2).toPandas()
    assert len(influence) == 6 and influence["influence"].max() < 0.1
    y = dec.scores(a, fit).withColumn("y", 3 + 2 * F.col("scores")[0])
    beta, cov, s2 = mixed.scalar_on_function(y, "y", 2)
    assert np.allclose(beta, [3, 2, 0], atol=1e-6) and s2 < 1e-9
    assert mixed.slope_function(fit, beta, cov)[0].shape == (31,)


def test_sparse_scores(spark):
    s = simulation.simulate_functional_process(spark, 250, 0, [2.0], noise=0.1, seed=5, sparse=10).cache()
    grid = spark.range(21).select(F.col("id").alias("g_idx"), (F.col("id") / 20).alias("g"))
    m = sparse.local_linear_mean(s, grid, 0.15).orderBy("g_idx").toPandas()
    assert np.abs(m["mean"] - np.sin(np.pi * m["g"])).max() < 0.5
    fit = sparse_fit.fit(s, m["g"].to_numpy(), 1, 0.15, 0.2)
    got = sparse_fit.pace_scores(s, fit).select("curve_id", F.col("scores")[0].alias("value"))
    truth = s.groupBy("curve_id").agg(F.first("scores")[0].alias("value"))
    assert simulation.recovery(truth, got).first().correlation > 0.9


def test_random_intercept(spark):
    r = np.random.default_rng(1)
    rows = [(g, float(x), float(1 + 2 * x + b + 0.5 * e)) for g in range(120) for b in [r.normal()] for x, e in zip(r.uniform(size=6), r.normal(size=6), strict=True)]
    fit = mixed.random_intercept_fit(spark.createDataFrame(rows, "g long, x double, y double"), "y", ["x"], "g")
    assert fit["beta"][1] == pytest.approx(2, abs=0.25) and fit["residual_variance"] == pytest.approx(0.25, rel=0.2) and fit["intercept_variance"] == pytest.approx(1, rel=0.35)


def test_pchip_and_filters():
    t, v = np.array([0, 1, 2, 3.0]), np.array([0, 1, 1, 2.0])
    out = smoothing.pchip(t, v, np.array([-1, 0, 0.5, 1.5, 3]))
    assert np.isnan(out[0]) and out[1] == 0 and 0 < out[2] < 1 and out[3] == 1 and out[4] == 2
    x = np.linspace(-1, 1, 25)
    assert np.allclose(smoothing.savgol(x**2, 7, 2), x**2) and np.allclose(smoothing.gaussian(np.ones(9), 2.0), 1)


def test_surrogates_keep_values():
    v = np.random.default_rng(0).normal(size=(64, 2))
    s = smoothing.iaaft(v, np.random.default_rng(1))
    assert np.allclose(np.sort(s, 0), np.sort(v, 0))


def test_smoothing_keeps_missing(spark):
    df = spark.createDataFrame([(1, i, float(i), None if i == 4 else float(i)) for i in range(12)], "curve_id long, t_idx int, t double, x double")
    out = smoothing.smooth(df, ("x",), "savgol", 5, 2).orderBy("t_idx").toPandas()["x"]
    assert np.isnan(out[4]) and np.allclose(out.drop(4), [i for i in range(12) if i != 4])
    g = smoothing.resample_pchip(df, np.array([3.5, 20.0]), max_gap=1.5).collect()
    assert [r.x for r in g] == [None, None]


def test_return_map():
    a = np.array([[0.5, 0.1], [0, 0.4]])
    x = [np.array([1.0, 1.0])]
    for _ in range(8):
        x.append(a @ x[-1])
    fit = mixed.local_return_map(np.array(x), np.zeros(2), 8)
    assert np.allclose(fit["jacobian"], a, atol=1e-8) and fit["verdict"] == "stable"


def test_portable_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 1.5)], "k long, s string, v double")
    portable.export_result({"t": df}, f"file://{tmp_path}/r", {"imputed": False})
    tables, manifest = portable.load_result(spark, f"file://{tmp_path}/r")
    assert sorted(tables["t"].collect(), key=str) == sorted(df.collect(), key=str) and manifest["provenance"] == {"imputed": False}
    with pytest.raises(ValueError):
        portable.export_result({"u": df}, f"file://{tmp_path}/q", {"x": float("nan")})


def test_workflow(spark, curves):
    w = wf.recurrence_workflow(curves.where("curve_id < 5"), radius=0.1, window=10, step=10)
    assert w.tables["rqa"].count() == 5 and [s["step"] for s in w.steps][0] == "preflight"
    assert "## rqa" in wf.render_report(w) and wf.render_report(w, "html").startswith("<!DOCTYPE")
    assert "n_curves = 5" in wf.reporting_text("Preflight", w.tables["preflight"])
    grid = wf.sensitivity(lambda s, **p: wf.recurrence_workflow(s, **p), curves.where("curve_id < 3"), "rqa", [{"radius": 0.1}, {"radius": 0.2}])
    assert grid.count() == 6
    f = wf.fpca_workflow(curves, np.linspace(0, 1, 31), n_components=2)
    assert f.tables["scores"].count() == 300 and wf.plot_data(f.tables["spectrum"], "component", "ratio").count() == 2
    assert wf.preprocess(curves, [{"step": "normalize_time"}]).agg(F.max("t")).first()[0] == 1


def test_streams(spark, tmp_path):
    rows = pd.DataFrame({"curve_id": [1, 1, 1, 2], "ts": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:10", "2024-01-01 05:00", "2024-01-01 00:05"]), "x": [1.0, 3.0, 5.0, 7.0]})
    df = spark.createDataFrame(rows)
    df.write.parquet(f"{tmp_path}/in")
    for name, make, mode in (("sessions", live.session_curves, "append"), ("sliding", live.sliding_summary, "append"), ("last", live.last_observed, "append")):
        q = make(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    last = {(r.curve_id, r.x): (r.last_x, r.seen) for r in spark.table("last").collect()}
    assert last == {(1, 1.0): (None, 0), (1, 3.0): (1.0, 1), (1, 5.0): (3.0, 2), (2, 7.0): (None, 0)}
    assert {(r.curve_id, r.n) for r in spark.table("sessions").collect()} >= {(1, 2), (2, 1)}
