"""Surrogates of many curves at once against those of one curve at a time."""

import numpy as np
import pytest

from kurvex.operators import smoothing


def test_many_surrogates_are_those_of_one():
    rng = np.random.default_rng(0)
    for n, columns in ((8, 1), (31, 2), (40, 2)):
        v = rng.exponential(5, (4, n, columns))
        starts = np.stack([[np.random.default_rng([7, c, k]).permutation(n) for k in range(5)] for c in range(4)])
        got = smoothing.iaaft_many(v, starts)
        for c in range(4):
            for k in range(5):
                assert np.array_equal(got[c, k], smoothing.iaaft(v[c], np.random.default_rng([7, c, k])))


def test_a_transform_takes_many_surrogates(spark, monkeypatch):
    """Calls of the transform follow the rounds, not the surrogates."""
    calls, rfft = [], np.fft.rfft
    monkeypatch.setattr(np.fft, "rfft", lambda *a, **k: (calls.append(1), rfft(*a, **k))[1])
    v = np.random.default_rng(1).normal(size=(6, 30, 2))
    smoothing.iaaft_many(v, np.stack([[np.random.default_rng(k).permutation(30) for k in range(19)]] * 6))
    assert len(calls) <= 202


@pytest.mark.parametrize("held", [1 << 16, 300, 100])
def test_curves_of_unlike_lengths(spark, monkeypatch, held):
    monkeypatch.setattr(smoothing, "HELD", held)
    rng = np.random.default_rng(2)
    curves = {f"c{k}": rng.normal(size=n) for k, n in enumerate((12, 12, 20, 5, 9, 8))}
    curves["c4"][3], curves["c5"][0] = np.nan, np.nan
    rows = [(c, i, None if np.isnan(x) else float(x)) for c, v in curves.items() for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "curve_id string, t_idx int, x double").repartition(3)
    hashes = {r[0]: r[1] for r in frame.selectExpr("curve_id", "xxhash64(curve_id) h").distinct().collect()}
    got = {r.curve_id: (r.observed, r.p_value) for r in smoothing.surrogate_test(frame, ("x",), smoothing.time_reversal).collect()}
    assert got.keys() == curves.keys() and got["c3"] == got["c5"] == (None, None)
    for c in ("c0", "c1", "c2", "c4"):
        v = curves[c][~np.isnan(curves[c])][:, None]
        r = np.random.default_rng([0, hashes[c] & 0x7FFFFFFF])
        null = [smoothing.time_reversal(smoothing.iaaft(v, r)) for _ in range(19)]
        assert got[c] == (pytest.approx(smoothing.time_reversal(v)), (1 + sum(x >= smoothing.time_reversal(v) for x in null)) / 20)
