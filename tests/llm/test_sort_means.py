"""Sort-means against the definition: every distance, Python integers, ties to the smaller number."""

import hashlib

import numpy as np

from kurvex.llm import sort_means as sm


def lloyd(rows, k, rounds, dimensions, scale=256, seed=2):
    kept = []
    for i, x in rows:
        if x is not None and len(x) == dimensions and all(c is not None and np.isfinite(c) and abs(c) <= sm.LIMIT / scale for c in x):
            kept.append((i, [int(np.floor(scale * float(c))) for c in x]))
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in named[:k]]
    if not c:
        return []
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for r in range(rounds + 1):
        found = [nearest(v) for _, v in kept]
        if r < rounds:
            members = [[v for (_, v), (_, j) in zip(kept, found, strict=True) if j == m] for m in range(len(c))]
            c = [[sum(col) // len(vs) for col in zip(*vs, strict=True)] if vs else old for old, vs in zip(c, members, strict=True)]
    by = [sum(d for d, j in found if j == m) for m in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    key = lambda r: (r[0] is not None, r)
    return sorted(((i, j, d, by[j], sum(by), sha[j]) for (i, _), (d, j) in zip(kept, found, strict=True)), key=key)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r))


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "c", "c") for i, x in rows], "vec_id long, embedding array<double>, v string, cluster string").repartition(3)


def test_ties_repeats_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-3, 4, 4) / 256).tolist()) for i in range(150)]  # few values: many ties and equal vectors
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (200, None), (201, []), (202, [0.0] * 3), (203, [0.0] * 5), (204, [0.0, None, 0.0, 0.0])]
    rows += [(205, [float("nan")] + [0.0] * 3), (206, [float("inf")] + [0.0] * 3), (207, [1e30] * 4), (208, [-262144.0] * 4), (209, [262144.0] * 4)]
    for k in (1, 7, 40, 500):
        assert rows_of(sm.sort_means(frame(spark, rows), k, 3, 4)) == lloyd(rows, k, 3, 4)


def test_hot_vector_and_empty_clusters(spark):
    rows = [(i, [0.5, 0.25]) for i in range(60)] + [(100 + i, [float(i), -float(i)]) for i in range(9)]
    assert rows_of(sm.sort_means(frame(spark, rows), 8, 5, 2)) == lloyd(rows, 8, 5, 2)


def test_nothing_to_cluster(spark):
    for rows in ([], [(1, None)], [(None, [0.0, 0.0])]):
        out = sm.sort_means(frame(spark, rows), dimensions=2)
        assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_scan_stops_and_misses_nothing():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (30, 8))
    v = np.repeat(centres, 40, 0) + rng.integers(-60, 60, (1200, 8))
    gaps, order = sm.sorted_centroids(centres)
    best, d, work = sm.nearest(v, np.repeat(np.arange(30), 40), centres, gaps, order)
    full = ((v[:, None] - centres[None]) ** 2).sum(2)
    assert (best == full.argmin(1)).all() and (d == full.min(1)).all() and work < 3 * len(v)
    best, d, _ = sm.nearest(v, rng.integers(0, 30, 1200), centres, gaps, order)
    assert (best == full.argmin(1)).all() and (d == full.min(1)).all()
