"""Centroid clustering by sort-means on integer vectors, exact in every tie.

Each round the other centroids are ordered by their distance from each centroid.  A vector scans that order from its previous
assignment and stops where a centroid lies strictly beyond twice its distance from that assignment: by the
triangle inequality none from there on can be nearer, or as near with a smaller number.  A round is one pass over the vectors and
one aggregation to a row per centroid; only centroids reach the driver and the tasks.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import drop, store, tidy

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Largest size of a component: four times a squared distance of such vectors still is a 64-bit integer.
LIMIT = 1 << 26
_POINT = "vec_id long, v array<int>, cluster int, distance long"


def integer_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, cluster 0, distance 0) of the rows whose vector has ``dimensions`` finite components."""
    x = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where(F.size("x") == dimensions)
    whole = x.where(F.expr(f"forall(x, c -> c is not null and abs(c) <= {LIMIT} / {scale}D)"))  # NaN is larger than all
    return whole.select("vec_id", F.expr(f"transform(x, c -> cast(floor({scale}D * c) as int))").alias("v"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))


def first_centroids(points: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of their id, in that order."""
    named = points.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return np.array([r.v for r in named.orderBy("h", "v").limit(k).collect()], np.int64)


def squared(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)


def sorted_centroids(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances between centroids, and for each centroid the others by that distance."""
    gaps = np.stack([squared(c - x) for x in c])
    order = np.argsort(gaps, 1, kind="stable")
    return gaps, np.array([row[row != k] for k, row in enumerate(order)], np.int64).reshape(len(c), len(c) - 1)


def nearest(v: np.ndarray, previous: np.ndarray, c: np.ndarray, gaps: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: the smaller number) and squared distance of each vector; how many distances were computed."""
    start = squared(v - c[previous])
    best, distance, active, work = previous.copy(), start.copy(), np.arange(len(v)), len(v)
    for k in range(len(c) - 1):
        j = order[previous[active], k]
        near = gaps[previous[active], j] <= 4 * start[active]
        active, j = active[near], j[near]
        if not len(active):
            break
        work += len(active)
        d = squared(v[active] - c[j])
        better = (d < distance[active]) | ((d == distance[active]) & (j < best[active]))
        best[active[better]], distance[active[better]] = j[better], d[better]
    return best, distance, work


def _assign(c: np.ndarray):
    gaps, order = sorted_centroids(c)

    def run(batches):
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(b), c.shape[1])
            best, distance, _ = nearest(v, b.column(2).to_numpy().astype(np.int64), c, gaps, order)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "v", "cluster", "distance"])

    return tidy(run)


def moved(points: DataFrame, c: np.ndarray) -> np.ndarray:
    """Centroids after a round: componentwise floor of the mean, those without vectors as before."""
    sums = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(c.shape[1])))
    out = c.copy()
    for r in sums.collect():
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(c.shape[1])]
    return out


def sort_means(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of the final centroids.

    Vectors of another length, null ones and those with a null, NaN or infinite component are left out; so are those with a
    component beyond 262144 in size, whose distances no 64-bit integer holds.  Rows of one vec_id are vectors of
    their own (equal ones share their fate), and may each be a first centroid, the smaller vector first; rows without
    a vec_id are clustered, but never start a centroid.  With fewer than ``k`` vectors that have an id each is a centroid;
    without any there is no row, like for an empty table.  Other columns are ignored, whatever their names.
    """
    points = store(integer_vectors(embeddings, dimensions, scale), "vectors")
    c = first_centroids(points, k, seed)
    if not len(c):
        return points.where(F.lit(False)).select("vec_id", "cluster", "distance", F.col("distance").alias("cluster_inertia"), F.col("distance").alias("inertia"), F.lit("").alias("centroid_sha256"))
    for r in range(rounds + 1):
        before, points = points, store(points.mapInArrow(_assign(c), _POINT), "assigned")
        drop(before)
        if r < rounds:
            c = moved(points, c)
    spread = {r.cluster: r.s for r in points.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    inertia = reduce(int.__add__, spread.values(), 0)
    return points.select("vec_id", "cluster", "distance", of([spread.get(x, 0) for x in range(len(c))]).cast("long").alias("cluster_inertia"), F.lit(inertia).cast("long").alias("inertia"), of(digest).alias("centroid_sha256"))
