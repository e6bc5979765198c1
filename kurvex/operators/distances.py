"""Distances between curves: L2 on a common grid in SQL, alignments (Fréchet, time warping) in NumPy kernels on pairs of arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

CURVE = "curve_id"
#: Queries that are broadcast at most; beyond it, the number of blocks that they are dealt to.
BROADCAST_CURVES, BLOCKS = 10_000, 256


def curve_arrays(samples: DataFrame, dims: tuple[str, ...] = ("x",)) -> DataFrame:
    """One row per curve: its values in time order, dimensions interleaved."""
    rows = samples.groupBy(CURVE).agg(F.array_sort(F.collect_list(F.struct("t_idx", F.array(*dims).alias("v")))).alias("s"))
    return rows.select(CURVE, F.flatten(F.col("s.v")).alias("values"))


def curve_pairs(arrays: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Pairs of a declared query set with all curves, or all pairs a < b of a declared small set.

    The queries are broadcast only if their number is at most ``BROADCAST_CURVES``; beyond it they meet all curves in blocks.
    """
    queries_ = arrays if queries is None else queries
    a = queries_.select(F.col(CURVE).alias("a"), F.col("values").alias("va"))
    b = arrays.select(F.col(CURVE).alias("b"), F.col("values").alias("vb"))
    if queries_.limit(BROADCAST_CURVES + 1).count() <= BROADCAST_CURVES:
        a = F.broadcast(a)
    else:
        a = a.withColumn("_k", F.pmod(F.xxhash64("a"), F.lit(BLOCKS)))
        b = b.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))))
        return a.join(b, "_k").where(F.col("a") < F.col("b") if queries is None else F.col("a") != F.col("b")).drop("_k")
    return a.join(b, F.col("a") < F.col("b") if queries is None else F.col("a") != F.col("b"))


def l2_distances(pairs: DataFrame, weights: list[float]) -> DataFrame:
    """Weighted L2 distance of each pair, by built-in functions on the arrays; even weights are factored out."""
    even = len(set(weights)) == 1
    squares = F.zip_with("va", "vb", lambda p, q: (p - q) * (p - q))
    if not even:
        squares = F.zip_with(squares, F.array(*(F.lit(float(w)) for w in weights)), lambda d, w: d * w)
    total = F.aggregate(squares, F.lit(0.0), lambda s, d: s + d)
    return pairs.select("a", "b", F.sqrt(total * F.lit(float(weights[0])) if even else total).alias("distance"))


def nearest(distances: DataFrame, k: int) -> DataFrame:
    """The k nearest curves b of each a; ties by b."""
    r = F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))
    return distances.withColumn("rank", r).where(F.col("rank") <= k)


class _Alignment:
    """The dynamic programme of a pair of (n, d) arrays by anti-diagonals, of which two are kept; ties prefer a step in both, then in a, then in b."""

    def __init__(self, a: np.ndarray, b: np.ndarray, kind: str, window: int | None = None, weights: np.ndarray | None = None):
        if kind not in ("frechet", "symmetric1", "symmetric2"):
            raise ValueError("the kind is frechet, symmetric1 or symmetric2")
        if not len(a) or not len(b) or a.shape[1] != b.shape[1] or not (np.isfinite(a).all() and np.isfinite(b).all()):
            raise ValueError("an alignment needs two finite curves of the same dimensions")
        if window is not None and (window < 0 or kind == "frechet"):
            raise ValueError("a window is not negative, and of time warping only")
        w = np.ones(a.shape[1]) if weights is None else np.asarray(weights, float)
        if w.shape != (a.shape[1],) or (w < 0).any() or not (w > 0).any() or not np.isfinite(w).all():
            raise ValueError("weights are one for each dimension, not negative and not all zero")
        self.a, self.b, self.kind, self.window, self.weights = a, b, kind, window, w
        self.turned = b[::-1]
        self.both = 2.0 if kind == "symmetric2" else 1.0

    def local(self, i, j):
        return np.sqrt((((self.a[i] - self.b[j]) ** 2) * self.weights).sum(-1))

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        """The diagonal before the first one, and the first one: costs by the place in a."""
        before, here = np.full(len(self.a) + 1, np.inf), np.full(len(self.a) + 1, np.inf)
        here[1] = self.both * self.local(0, 0) if self.kind != "frechet" else self.local(0, 0)
        return before, here

    def next(self, s: int, before: np.ndarray, last: np.ndarray, steps: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Costs of diagonal ``s`` (i + j) and, if asked for, the steps that lead there: 0 in both, 1 in a, 2 in b.  Place i stands at index i + 1."""
        m = len(self.b)
        lo, hi = max(0, s - m + 1), min(len(self.a) - 1, s)
        if self.window is not None:
            lo, hi = max(lo, -((self.window - s) // 2)), min(hi, (s + self.window) // 2)
        here, step = np.full(len(self.a) + 1, np.inf), np.full(len(self.a), -1, np.int8) if steps else None
        if lo > hi:
            return here, step
        gap = self.a[lo : hi + 1] - self.turned[m - 1 - s + lo : m - s + hi]
        d = np.sqrt((gap * gap) @ self.weights)
        both, in_a, in_b = before[lo : hi + 1], last[lo : hi + 1], last[lo + 1 : hi + 2]
        if self.kind != "frechet":
            both, in_a, in_b = both + self.both * d, in_a + d, in_b + d
        cost = np.minimum(both, np.minimum(in_a, in_b))
        here[lo + 1 : hi + 2] = np.maximum(cost, d) if self.kind == "frechet" else cost
        if steps:
            step[lo : hi + 1] = np.where(both == cost, 0, np.where(in_a == cost, 1, 2))
        return here, step

    def distance(self) -> float:
        before, last = self.first()
        for s in range(1, len(self.a) + len(self.b) - 1):
            before, last = last, self.next(s, before, last)[0]
        return self._checked(float(last[-1]))

    def _checked(self, cost: float) -> float:
        if not np.isfinite(cost):
            raise ValueError("no path inside the window reaches the end")
        return cost

    def path(self) -> tuple[float, np.ndarray]:
        """Distance and path (steps, 2).  Steps are made anew between diagonals that are kept at every root of their number."""
        count = len(self.a) + len(self.b) - 1
        every = max(2, int(np.sqrt(count)))
        before, last = self.first()
        kept = {0: (before, last)}
        for s in range(1, count):
            before, last = last, self.next(s, before, last)[0]
            if s % every == 0:
                kept[s] = before, last
        cost, i, s, out = self._checked(float(last[-1])), len(self.a) - 1, count - 1, [(len(self.a) - 1, len(self.b) - 1)]
        for start in sorted(kept, reverse=True):
            before, last = kept[start]
            steps = []
            for t in range(start + 1, min(start + every, count - 1) + 1):
                here, step = self.next(t, before, last, True)
                before, last = last, here
                steps.append(step)
            while s > start:
                step = steps[s - start - 1][i]
                if step == 0 and s - 1 == start and start > 0:  # jumps over the kept diagonal, into the block before
                    i, s = i - 1, s - 2
                    out.append((i, s - i))
                    break
                i, s = (i - 1, s - 2) if step == 0 else (i - 1, s - 1) if step == 1 else (i, s - 1)
                out.append((i, s - i))
        return cost, np.array(out[::-1])


def discrete_frechet(a: np.ndarray, b: np.ndarray, weights: np.ndarray | None = None) -> float:
    """Discrete Fréchet distance of two (n, d) arrays."""
    return _Alignment(a, b, "frechet", None, weights).distance()


def dtw(a: np.ndarray, b: np.ndarray, step: str = "symmetric1", window: int | None = None, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Dynamic time warping distance and its value over len(a) + len(b); symmetric2 counts steps in both, the first one too, twice.

    ``window`` bounds the difference of the places (a Sakoe-Chiba band); an error if no path stays inside.
    """
    total = _Alignment(a, b, step, window, weights).distance()
    return total, total / (len(a) + len(b))


def alignment_distances(pairs: DataFrame, kind: str, dims: int = 1, window: int | None = None, weights: list[float] | None = None, normalize: bool = False) -> DataFrame:
    """Fréchet ("frechet") or time-warping ("symmetric1", "symmetric2") distance of each pair; ``normalize`` (symmetric2): over both lengths."""
    if normalize and kind != "symmetric2":
        raise ValueError("only symmetric2 can be normalised")

    @pandas_udf("double")
    def run(va: pd.Series, vb: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(va, vb, strict=True):
            a, b = np.asarray(p, float).reshape(-1, dims), np.asarray(q, float).reshape(-1, dims)
            out.append(_Alignment(a, b, kind, window, weights).distance() / (len(a) + len(b) if normalize else 1))
        return pd.Series(out, dtype=float)

    return pairs.select("a", "b", run("va", "vb").alias("distance"))


def alignment_paths(pairs: DataFrame, kind: str, dims: int = 1, window: int | None = None, weights: list[float] | None = None) -> DataFrame:
    """(a, b, step, i, j, weight, cost): a best path of each pair, with the weight and the local distance of every step.

    The weighted costs of time warping add up to the distance, a Fréchet path's greatest cost is it.  Ties prefer a step in both
    curves, then one in a, then one in b.  A task holds a root of the steps of one pair at a time.
    """
    kinds = dict(pairs.dtypes)

    def run(batches):
        for b in batches:
            for k in range(len(b)):
                p, q = (np.asarray(b.column(c)[k].values, float).reshape(-1, dims) for c in (2, 3))
                al = _Alignment(p, q, kind, window, weights)
                _, path = al.path()
                twice = np.concatenate(([True], (np.diff(path, axis=0) == 1).all(1))) if kind == "symmetric2" else np.zeros(len(path), bool)
                n = pa.array(np.full(len(path), k))
                yield pa.RecordBatch.from_arrays([b.column(0).take(n), b.column(1).take(n), pa.array(np.arange(len(path), dtype=np.int32)), *(pa.array(path[:, c].astype(np.int32)) for c in (0, 1)), pa.array(1.0 + twice), pa.array(al.local(path[:, 0], path[:, 1]))], ["a", "b", "step", "i", "j", "weight", "cost"])

    return pairs.select("a", "b", "va", "vb").mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}, step int, i int, j int, weight double, cost double")


def score_distances(scored: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """Euclidean distances of the first k scores: of a declared query set to all curves, or of all pairs of a small set."""
    values = F.slice("scores", 1, k).alias("values")
    return l2_distances(curve_pairs(scored.select(CURVE, values), None if queries is None else queries.select(CURVE, values)), [1.0] * k)


def ranked(distances: DataFrame, column: str = "distance", buckets: int = 64) -> DataFrame:
    """Average ranks of a distance over all pairs: buckets by approximate quantiles, ranks inside, offsets of the buckets below."""
    cuts = distances.agg(F.percentile_approx(column, [i / buckets for i in range(1, buckets)], 10_000).alias("q")).first().q or []
    b = distances.withColumn("_b", sum(((F.col(column) >= float(c)).cast("int") for c in sorted(set(cuts))), F.lit(0)))
    counts = b.groupBy("_b").agg(F.count(F.lit(1)).alias("c"))
    below = counts.join(counts.select(F.col("_b").alias("o"), F.col("c").alias("n")), F.col("o") < F.col("_b"), "left").groupBy("_b").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_below"))
    inside = F.rank().over(Window.partitionBy("_b").orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy("_b", column)) - 1) / 2
    return b.join(F.broadcast(below), "_b").withColumn("rank", inside + F.col("_below")).drop("_b", "_below")


def distance_sensitivity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Spearman correlation of two distance tables over their pairs (average ranks)."""
    a = ranked(left).select("a", "b", F.col("rank").alias("p"))
    return a.join(ranked(right).select("a", "b", F.col("rank").alias("q")), ["a", "b"]).agg(F.corr("p", "q").alias("spearman"))


def compare_specifications(tables: dict[str, DataFrame], k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Distance specifications compared by pairs: (left, right, spearman, mean_jaccard), and per curve a: (a, left, right, jaccard, tie).

    Neighbourhoods are the k nearest of each a; ``tie`` tells that the k-th distance isn't separated from the next in either.
    """
    names, overall, local = list(tables), None, None
    w = Window.partitionBy("a").orderBy("distance", "b")
    sets = {}
    for n, t in tables.items():
        r = t.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
        last, after = F.max(F.when(F.col("r") == k, F.col("distance"))), F.max(F.when(F.col("r") == k + 1, F.col("distance")))
        sets[n] = r.groupBy("a").agg(F.collect_set(F.when(F.col("r") <= k, F.col("b"))).alias("near"), (F.abs(after - last) <= 1e-12 * F.abs(last)).alias("tie"))
    for i, left in enumerate(names):
        for right in names[i + 1 :]:
            j = sets[left].toDF("a", "p", "tp").join(sets[right].toDF("a", "q", "tq"), "a")
            jaccard = F.size(F.array_intersect("p", "q")) / F.size(F.array_union("p", "q"))
            one = j.select("a", F.lit(left).alias("left"), F.lit(right).alias("right"), jaccard.alias("jaccard"), (F.coalesce("tp", F.lit(False)) | F.coalesce("tq", F.lit(False))).alias("tie"))
            row = distance_sensitivity(tables[left], tables[right]).crossJoin(one.agg(F.avg("jaccard").alias("mean_jaccard"))).select(F.lit(left).alias("left"), F.lit(right).alias("right"), "spearman", "mean_jaccard")
            overall, local = (row, one) if overall is None else (overall.union(row), local.union(one))
    return overall, local
