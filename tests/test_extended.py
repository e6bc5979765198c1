"""Multilevel, sparse planar, prediction, neighbours and family inference."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kurvex.operators import decomposition as dec
from kurvex.operators import distances as dist
from kurvex.operators import inference as inf
from kurvex.operators import neighbours as nbr
from kurvex.operators import recurrence as rec
from kurvex.operators import simulation, sparse


@pytest.fixture(scope="module")
def curves(spark):
    return simulation.simulate_functional_process(spark, 120, 21, [2.0, 0.5], noise=0.05, seed=4).cache()


def test_multilevel_parts_add_up(spark, curves):
    s = curves.withColumn("participant", F.col("curve_id") % 12)
    between, within = dec.multilevel_fpca(s, np.linspace(0, 1, 21), 2, 2)
    assert len(within.components) == 2 and within.explained_variance[0] > between.explained_variance[0]
    same = dec.compare_fits(within, within)
    assert [c["matched"] for c in same] == [1, 2] and same[0]["similarity"] == pytest.approx(1)
    band = dec.spectrum_uncertainty(dist.curve_arrays(curves), np.linspace(0, 1, 21), 2, 50)
    assert band[0, 0] < 2.0 < band[2, 0] * 1.3


def test_radius_reaches_rate(spark, curves):
    s = curves.where("curve_id < 3").drop("scores")
    r = nbr.radius_for_rate(s, ("x",), 0.2)
    pairs = s.alias("a").join(s.alias("b"), F.expr("a.curve_id = b.curve_id and a.t_idx < b.t_idx")).select("a.curve_id", F.abs(F.col("a.x") - F.col("b.x")).alias("d"))
    got = pairs.join(r, "curve_id").groupBy("curve_id").agg(F.avg((F.col("d") <= F.col("radius")).cast("double")).alias("share"))
    assert all(0.2 <= x.share <= 0.215 for x in got.collect())


def test_false_neighbours_of_a_sine(spark):
    df = spark.range(200).select(F.lit(1).cast("long").alias("curve_id"), F.col("id").cast("int").alias("t_idx"), (F.col("id") * 0.17).alias("t"), F.sin(F.col("id") * 0.17).alias("x"))
    share = {r.dimension: r.false_share for r in nbr.false_neighbours(df, "x", 9, 2, 5).collect()}
    assert share[1] > share[2] and share[2] < 0.05


def test_conformal_radius(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 20)], "score double")
    assert sparse.conformal_radius(df, 0.1) == 18 and sparse.conformal_radius(df, 0.01) == float("inf")


def test_family_and_intervals(spark):
    r = np.random.default_rng(0).normal(size=(2, 199))
    t = inf.family_test({"a": 0.0, "b": 9.0}, {"a": r[0].tolist(), "b": r[1].tolist()})
    assert t[0]["p_value"] == 1 and t[1]["adjusted_p"] == pytest.approx(1 / 200) and all(x["adjusted_p"] >= x["p_value"] for x in t)
    lo, hi = inf.monte_carlo_interval(5, 100)
    assert 0 < lo < 0.05 < hi < 0.15
    res = spark.createDataFrame([(1, i, float((-1) ** i)) for i in range(20)], "curve_id long, t_idx int, e double")
    acf = {r.lag: r.correlation for r in inf.residual_acf(res, 2).collect()}
    assert acf[1] == pytest.approx(-1) and acf[2] == pytest.approx(1)
    p = inf.gee_predictions(spark.createDataFrame([(1.0, 0.0)], "one double, z double"), ["one", "z"], np.zeros(2), np.eye(2) * 0.01).first()
    assert p["mean"] == 0.5 and p["lower"] < 0.5 < p["upper"]
