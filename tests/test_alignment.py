"""Time warping and Fréchet distances and paths against all monotone paths, declared ties, bands and weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kurvex.operators import distances as dist


def every_path(n, m):
    open_, out = [[(0, 0)]], []
    while open_:
        p = open_.pop()
        i, j = p[-1]
        if (i, j) == (n - 1, m - 1):
            out.append(p)
        open_ += [[*p, (i + x, j + y)] for x, y in ((1, 1), (1, 0), (0, 1)) if i + x < n and j + y < m]
    return out


def cost(path, a, b, kind, w):
    local = [np.sqrt((((a[i] - b[j]) ** 2) * w).sum()) for i, j in path]
    if kind == "frechet":
        return max(local)
    twice = [True, *((p[0] - q[0]) * (p[1] - q[1]) == 1 for p, q in zip(path[1:], path, strict=False))]
    return sum(c * (2 if kind == "symmetric2" and t else 1) for c, t in zip(local, twice, strict=True))


@pytest.mark.parametrize("kind", ["frechet", "symmetric1", "symmetric2"])
def test_distances_and_paths_of_all_monotone_paths(kind):
    rng = np.random.default_rng(0)
    for n, m, window, w in ((1, 1, None, (1, 1)), (5, 4, None, (1, 1)), (4, 6, None, (0, 3)), (6, 5, 1, (1, 0.5)), (1, 5, None, (1, 1)), (5, 1, None, (2, 1))):
        if kind == "frechet" and window is not None:
            continue
        a, b, w = rng.normal(size=(n, 2)), rng.normal(size=(m, 2)), np.array(w, float)
        paths = [p for p in every_path(n, m) if window is None or all(abs(i - j) <= window for i, j in p)]
        best = min(cost(p, a, b, kind, w) for p in paths)
        al = dist._Alignment(a, b, kind, window, w)
        value, path = al.path()
        assert np.isclose(al.distance(), best) and np.isclose(value, best) and [tuple(x) for x in path] in paths and np.isclose(cost([tuple(x) for x in path], a, b, kind, w), best)


@pytest.mark.parametrize("kind", ["frechet", "symmetric1", "symmetric2"])
def test_long_paths_and_ties(kind):
    """Against a full table of costs whose steps are chosen in the declared order, on values with many ties."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, (70, 1)).astype(float), rng.integers(0, 3, (53, 1)).astype(float)
    both = 2.0 if kind == "symmetric2" else 1.0
    c, back = np.full((70, 53), np.inf), {}
    for i in range(70):
        for j in range(53):
            d = abs(a[i, 0] - b[j, 0])
            if i == j == 0:
                c[0, 0] = d if kind == "frechet" else both * d
                continue
            ways = [(c[i - x, j - y] if kind == "frechet" else c[i - x, j - y] + d * (both if x and y else 1), (i - x, j - y)) for x, y in ((1, 1), (1, 0), (0, 1)) if i >= x and j >= y]
            value, back[i, j] = min(ways, key=lambda x: x[0])
            c[i, j] = max(value, d) if kind == "frechet" else value
    path = [(69, 52)]
    while path[-1] != (0, 0):
        path.append(back[path[-1]])
    value, got = dist._Alignment(a, b, kind).path()
    assert value == c[69, 52] and [tuple(x) for x in got] == path[::-1]


def test_fixed_values_and_contracts():
    a, b = np.array([[0.0], [1], [2]]), np.array([[0.0], [2]])
    assert dist.discrete_frechet(a, b) == 1 and dist.dtw(a, b) == (1.0, 0.2) and dist.dtw(a, b, "symmetric2") == (1.0, 0.2)
    assert dist.dtw(a + 1, a, "symmetric2")[0] == 3.0 and dist.dtw(a[:1] + 1, a[:1], "symmetric2")[0] == 2.0
    for bad in (lambda: dist.dtw(a, b[:1], window=1), lambda: dist.dtw(a, b, weights=[0.0]), lambda: dist.dtw(a, b, weights=[1.0, 1.0]), lambda: dist.dtw(a, b * np.nan), lambda: dist._Alignment(a, b, "frechet", 2), lambda: dist._Alignment(a, b, "other"), lambda: dist.dtw(a, b[:0])):
        with pytest.raises(ValueError):
            bad()


def test_path_tables(spark):
    rng = np.random.default_rng(2)
    curves = spark.createDataFrame([(f"c|{i}", rng.normal(size=2 * (9 + i)).tolist()) for i in range(5)], "curve_id string, values array<double>")
    pairs = dist.curve_pairs(curves, curves.where("curve_id in ('c|0', 'c|3')"))
    for kind, total in (("symmetric2", F.sum(F.col("weight") * F.col("cost"))), ("symmetric1", F.sum(F.col("weight") * F.col("cost"))), ("frechet", F.max("cost"))):
        paths = dist.alignment_paths(pairs, kind, 2, weights=[1.0, 2.0])
        both = paths.groupBy("a", "b").agg(total.alias("t"), F.count(F.lit(1)).alias("n"), F.max("step").alias("last")).join(dist.alignment_distances(pairs, kind, 2, weights=[1.0, 2.0]), ["a", "b"])
        assert both.count() == 8 and both.where("abs(t - distance) > 1e-9 or n <> last + 1").count() == 0
    assert dist.l2_distances(dist.curve_pairs(curves.where("curve_id < 'c|1'").union(curves.where("curve_id < 'c|1'").withColumn("curve_id", F.lit("d")))), [0.5] * 18).first().distance == 0.0
