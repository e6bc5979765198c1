"""Band depth over all pairs of curves, fences, robust outlyingness; buckets of any size, values that many curves share."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kurvex.operators import outliers as out

T = np.array([0.0, 0.1, 0.4, 1.0, 1.1])


def values(n=25):
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(size=(n, 5)), 1)
    v[: n // 3, 2] = 0.3  # a value that a third of the curves share
    v[3] += 6
    v[4, 1] = -9
    return v


def frame(spark, v, t=T):
    return spark.createDataFrame([(f"c{i}", j, float(t[j]), float(x)) for i, row in enumerate(v) for j, x in enumerate(row)], "curve_id string, t_idx int, t double, x double").repartition(3)


def weights():
    w = np.convolve(np.diff(T), [0.5, 0.5])
    return w / w.sum()


def brute_depth(v):
    pairs = list(combinations(range(len(v)), 2))
    return np.array([np.mean([((np.minimum(v[a], v[b]) <= x) & (x <= np.maximum(v[a], v[b]))) @ weights() for a, b in pairs]) for x in v])


@pytest.mark.parametrize("held", [4, 50_000])
def test_depth_fences_and_flags(spark, monkeypatch, held):
    monkeypatch.setattr(out, "HELD", held)  # many buckets, or one
    v = values()
    depth = brute_depth(v)
    got = {r.curve_id: r.depth for r in out.modified_band_depth(frame(spark, v)).collect()}
    assert np.allclose([got[f"c{i}"] for i in range(25)], depth)
    fences, curves = out.functional_boxplot(frame(spark, v))
    inner = depth >= np.sort(depth)[::-1][12] - 1e-12
    lo, hi = v[inner].min(0), v[inner].max(0)
    outside = ((v < lo - 1.5 * (hi - lo)) | (v > hi + 1.5 * (hi - lo))).sum(1)
    rows = {r.curve_id: r for r in curves.collect()}
    assert [rows[f"c{i}"].times_outside for i in range(25)] == outside.tolist() and [rows[f"c{i}"].central for i in range(25)] == inner.tolist()
    assert rows["c3"].outlier and np.allclose([r.upper for r in fences.orderBy("t_idx").collect()], hi)


@pytest.mark.parametrize("held", [4, 50_000])
def test_medians_and_outlyingness(spark, monkeypatch, held):
    monkeypatch.setattr(out, "HELD", held)
    for n in (24, 25):
        v = values(n)
        got = {r.t_idx: r["median"] for r in out.medians(frame(spark, v), "x", ("t_idx",)).collect()}
        m = np.median(v, 0)
        assert np.allclose([got[j] for j in range(5)], m)
    sd = np.median(np.abs(v - m), 0) / out.MAD_SCALE
    o, w = (v - m) / sd, weights()
    got = {r.curve_id: r for r in out.directional_outlyingness(frame(spark, v)).collect()}
    assert np.allclose([got[f"c{i}"].magnitude for i in range(n)], o @ w) and np.allclose([got[f"c{i}"]["shape"] for i in range(n)], (o**2) @ w - (o @ w) ** 2)
    flagged = {r.curve_id for r in out.magnitude_shape_outliers(frame(spark, v)).where("outlier").collect()}
    assert {"c3", "c4"} <= flagged and len(flagged) < 10


def test_ranks_without_keys_and_contracts(spark):
    rows = spark.createDataFrame([(float(x),) for x in (3, 1, 1, 1, 7, 5)] + [(None,)], "x double")
    c = out.cumulative(rows, "x")
    assert [out.at_rank(c, "x", F.lit(k)).first().x for k in range(1, 7)] == [1, 1, 1, 3, 5, 7] and c.where("n <> 6").count() == 0
    v = values()
    for bad in (frame(spark, v).where("curve_id <> 'c1' or t_idx > 0"), frame(spark, v).withColumn("x", F.when(F.col("t_idx") > 0, F.col("x")))):
        with pytest.raises(ValueError):
            out.modified_band_depth(bad)
    with pytest.raises(ValueError):
        out.functional_boxplot(frame(spark, v), factor=0.0)
    with pytest.raises(ValueError):
        out.directional_outlyingness(frame(spark, np.zeros((5, 5))))
