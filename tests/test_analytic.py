"""Hand-checkable answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kurvex.operators import decomposition as dec
from kurvex.operators import distances as dist
from kurvex.operators import geometry as geo
from kurvex.operators import information as info
from kurvex.operators import recurrence as rec
from kurvex.sources.curves import ContractError, from_long


def series(spark, values, curve=1):
    return spark.createDataFrame([(curve, i, float(i), float(v)) for i, v in enumerate(values)], "curve_id long, t_idx int, t double, x double")


def test_recurrence_count(spark):
    s = series(spark, [0, 0.1, 1, 0.05])
    assert rec.recurrence_pairs(s, ("x",), 0.15, 0).count() == 3


def test_rqa_by_hand(spark):
    s = series(spark, [0, 1, 0, 1, 0])
    m = rec.rqa_metrics(s, rec.recurrence_pairs(s, ("x",), 0.5, 0)).first()
    assert m.n_pairs == 4 and m.recurrence_rate == pytest.approx(8 / 25)
    assert m.determinism == pytest.approx(0.75) and m.max_diagonal == 3 and m.laminarity == 0


def test_network_triangle_tail_isolate(spark):
    pairs = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 2), (1, 2, 3)], "curve_id long, i int, j int")
    nodes = rec.network_nodes(series(spark, range(5)), pairs)
    assert {r.t_idx: (r.degree, r.triangles) for r in nodes.collect()} == {0: (2, 1), 1: (2, 1), 2: (3, 1), 3: (1, 0), 4: (0, 0)}
    assert rec.network_summary(nodes).first().transitivity == pytest.approx(3 / 5)


def test_windows_drop_the_tail(spark):
    w = rec.windows(series(spark, range(23)), 10, 6)
    assert sorted(r[0] for r in w.select("window_start").distinct().collect()) == [0, 6, 12]
    assert w.groupBy("window_start").count().where("count <> 10").count() == 0


def test_transfer_entropy_value(spark):
    source, target = [0, 1, 1, 1, 1, 0, 0, 0, 0], [0, 0, 1, 1, 1, 1, 0, 0, 0]
    s = spark.createDataFrame([(1, i, a, b, 0) for i, (a, b) in enumerate(zip(source, target))], "curve_id long, t_idx int, source int, target int, condition int")
    te = info.transfer_entropy(s, 2, 1, 1).first()
    assert te.transfer_entropy == pytest.approx(0.6792696431662097) and te.n_terms == 7
    assert info.transfer_entropy(s, 2, 1, 1, condition_history=1).first().transfer_entropy == pytest.approx(0.6792696431662097)
    back = s.select("curve_id", "t_idx", F.col("source").alias("target"), F.col("target").alias("source"))
    assert info.transfer_entropy(back, 2, 1, 1).first().transfer_entropy == pytest.approx(0, abs=1e-12)


def test_frechet_and_dtw():
    a, b = np.array([[0.0], [1], [2]]), np.array([[0.0], [2]])
    assert dist.discrete_frechet(a, b) == 1
    assert dist.dtw(a, b) == (1.0, 0.2)
    assert dist.dtw(a, b, "symmetric2")[0] == 1


def test_gradient_is_numpys(spark):
    t = np.array([0, 0.3, 1.0, 1.1, 2.0, 4.0])
    v = np.sin(t)
    df = spark.createDataFrame([(1, i, float(a), float(b), float(b) ** 2) for i, (a, b) in enumerate(zip(t, v))], "curve_id long, t_idx int, t double, x double, y double")
    got = [r.x for r in geo.differentiate(df).orderBy("t_idx").collect()]
    assert np.allclose(got, np.gradient(v, t, edge_order=2), atol=1e-12)


def test_circle_curvature(spark):
    a = np.linspace(0, 2 * np.pi, 400)
    df = spark.createDataFrame([(1, i, float(x), float(np.cos(x)), float(np.sin(x))) for i, x in enumerate(a)], "curve_id long, t_idx int, t double, x double, y double")
    k = [r.curvature for r in geo.kinematics(df).orderBy("t_idx").collect()][5:-5]
    assert np.allclose(k, 1, atol=2e-3)


def test_stationary_is_undefined(spark):
    df = series(spark, [1, 1, 1]).withColumn("y", F.lit(1.0))
    assert all(r.heading is None and r.curvature is None for r in geo.kinematics(df).collect())
    assert geo.tortuosity(df).first().tortuosity is None


def test_rank_one_spectrum(spark):
    t, amp = np.array([0, 0.25, 1.0]), [-3, -1, 1, 3]
    phi = np.ones(3)
    rows = [(i, (a * phi).tolist()) for i, a in enumerate(amp)]
    fit = dec.fit_fpca(spark.createDataFrame(rows, "curve_id long, values array<double>"), t, 1)
    assert fit.explained_variance[0] == pytest.approx(20 / 3) and abs((fit.components[0] * phi) @ fit.weights) == pytest.approx(1)


def test_trapezoid():
    assert dec.trapezoid_weights(np.array([0, 0.2, 0.7, 1])).sum() == pytest.approx(1)
    with pytest.raises(ValueError):
        dec.trapezoid_weights(np.array([0, 0.5, 0.5]))


def test_contracts_fail_closed(spark):
    rows = [("a", 0.0, 1.0), ("a", 1.0, 2.0), ("b", 0.0, 1.0), ("b", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "c string, t double, x double")
    with pytest.raises(ContractError, match="no_common_grid"):
        from_long(df, curve_columns=["c"], time_column="t", value_columns=["x"])
    assert from_long(df, curve_columns=["c"], time_column="t", value_columns=["x"], require_common_grid=False).samples.count() == 4
    with pytest.raises(ContractError, match="duplicate_time"):
        from_long(df.union(df.limit(1)), curve_columns=["c"], time_column="t", value_columns=["x"], require_common_grid=False)
    with pytest.raises(ContractError, match="null_keys"):
        from_long(df.union(spark.createDataFrame([("a", None, 1.0)], df.schema)), curve_columns=["c"], time_column="t", value_columns=["x"])
    with pytest.raises(ContractError, match="missing_columns"):
        from_long(df, curve_columns=["c"], time_column="t")
