"""Nearest neighbours and target-rate radii against all pairs, on states that repeat, cluster, lie far out or are missing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kurvex.operators import neighbours as nbr


def walk(rng, n, kind, d=2):
    if kind == "walk":
        return np.cumsum(rng.normal(size=(n, d)), 0)
    if kind == "grid":  # few states, many of them equal
        return rng.integers(0, 4, (n, d)).astype(float)
    if kind == "hot":  # a third in one state, a dense cluster, and one point far out
        x = np.concatenate((np.zeros((n // 3, d)), 1 + 1e-6 * rng.normal(size=(n - n // 3 - 1, d)), np.full((1, d), 1e5)))
        return x[rng.permutation(n)]
    return rng.normal(size=(n, d))


def frame(spark, curves, dims):
    rows = [(str(c), i, *(None if np.isnan(v) else float(v) for v in p)) for c, x in curves.items() for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "curve_id string, t_idx int, " + ", ".join(f"{k} double" for k in dims)).repartition(3)


def far(p, q, metric="euclidean"):
    d = np.abs(p[:, None] - q[None])
    return {"euclidean": np.sqrt((d**2).sum(2)), "chebyshev": d.max(2), "cityblock": d.sum(2)}[metric]


@pytest.mark.parametrize("d", [1, 2, 4])
def test_nearest_neighbours_are_exact(spark, d):
    rng, dims = np.random.default_rng(d), tuple("xyzu"[:d])
    curves = {k: walk(rng, 60 + 10 * n, k, d) for n, k in enumerate(("walk", "grid", "hot", "cloud"))} | {"a|b": np.ones((5, d)), "two": np.arange(2 * d, dtype=float).reshape(2, d)}
    curves["cloud"][7, 0] = np.nan
    for theiler in (0, 3):
        got = {(r.curve_id, r.i): (r.j, r.d) for r in nbr.nearest_neighbours(frame(spark, curves, dims), dims, theiler).collect()}
        want = {}
        for c, x in curves.items():
            dist, gap = far(x, x), np.abs(np.subtract.outer(np.arange(len(x)), np.arange(len(x))))
            for i in range(len(x)):
                ok = (gap[i] > theiler) & (dist[i] > 0)
                if ok.any():
                    want[c, i] = dist[i][ok].min()
        assert got.keys() == want.keys() and all(np.isclose(got[k][1], want[k]) for k in want)
        for (c, i), (j, v) in got.items():
            assert abs(i - j) > theiler and np.isclose(np.sqrt(((curves[c][i] - curves[c][j]) ** 2).sum()), v)


@pytest.mark.parametrize(("metric", "d"), [("euclidean", 2), ("chebyshev", 4), ("cityblock", 1)])
def test_radius_is_the_distance_of_a_rank(spark, metric, d, monkeypatch):
    monkeypatch.setattr(nbr, "HELD", 20)  # several histograms
    rng, dims = np.random.default_rng(d), tuple("xyzu"[:d])
    curves = {k: walk(rng, 50 + 10 * n, k, d) for n, k in enumerate(("walk", "grid", "hot", "cloud"))}
    curves["cloud"][3, 0] = np.nan
    for rate, theiler in ((0.01, 0), (0.3, 2), (0.999, 40)):
        got = {r.curve_id: r.radius for r in nbr.radius_for_rate(frame(spark, curves, dims), dims, rate, theiler, metric).collect()}
        for c, x in curves.items():
            i, j = np.triu_indices(len(x), theiler + 1)
            v = np.sort(far(x, x, metric)[i, j])
            v = v[~np.isnan(v)]
            assert np.isclose(got[c], v[max(1, int(np.ceil(rate * len(v) - 1e-9))) - 1]), (c, rate)


def test_cross_radius(spark):
    rng = np.random.default_rng(0)
    a, b = {"p": walk(rng, 40, "walk"), "q": walk(rng, 30, "hot")}, {"p": walk(rng, 55, "grid"), "q": walk(rng, 25, "cloud")}
    left, right = (frame(spark, x, ("x", "y")).withColumnRenamed("curve_id", "pair") for x in (a, b))
    for rate in (0.02, 0.5):
        got = {r.pair: r.radius for r in nbr.cross_radius_for_rate(left, right, ("x", "y"), rate).collect()}
        for k in a:
            v = np.sort(far(a[k], b[k]).ravel())
            assert np.isclose(got[k], v[int(np.ceil(rate * len(v) - 1e-9)) - 1])


def test_what_has_no_radius_is_an_error(spark):
    for x, theiler, rate in ((np.zeros((9, 1)), 0, 0.5), (np.arange(4.0)[:, None], 3, 0.5), (np.arange(4.0)[:, None], 0, 1.0)):
        with pytest.raises(ValueError):
            nbr.radius_for_rate(frame(spark, {"c": x}, ("x",)), ("x",), rate, theiler)


def test_no_step_meets_all_pairs(spark):
    """Joins of samples have a cell in their keys; the work of a long walk is near linear in its length."""
    s = frame(spark, {"w": walk(np.random.default_rng(3), 400, "walk")}, ("x", "y"))
    near = nbr.near_pairs(s, s, ("x", "y"), F.lit(0.5), "euclidean", ("curve_id",))
    assert "cell" in near._jdf.queryExecution().optimizedPlan().toString().split("Join")[1][:600]
