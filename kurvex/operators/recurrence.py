"""Embedding, recurrence quantification, recurrence networks, divergence and sections (nearest neighbours: ``neighbours``).

Pairs within a radius meet in cells: states are dealt to a grid of cells as wide as the radius, and a cell only
meets its neighbours, an equi-join on (curve, cell).  So neither work nor skew follows the square of a curve's length,
but for states that really are that near.  ``pairs`` is (curve_id, i, j) with i < j; line measures read them once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analytic import along
from ..functions.shared import stored
from ..functions.tiles import Tile, over_curves, split

CURVE = "curve_id"


def delay_embed(samples: DataFrame, dims: tuple[str, ...], m: int, delay: int) -> DataFrame:
    """States of ``m`` delays (current sample first, lag-major): curve_id, t_idx, t, state array; the first (m-1)*delay rows have none."""
    w = along(CURVE)
    parts = [F.lag(d, l * delay).over(w) if l else F.col(d) for l in range(m) for d in dims]
    return samples.select(CURVE, "t_idx", "t", F.array(*parts).alias("state")).where(F.col("t_idx") >= (m - 1) * delay)


def autocorrelation(samples: DataFrame, dim: str, max_lag: int) -> DataFrame:
    """acf(lag) of each curve, of the deviations from the curve's mean."""
    w = Window.partitionBy(CURVE)
    c = samples.select(CURVE, "t_idx", (F.col(dim) - F.avg(dim).over(w)).alias("c"))
    c = c.withColumns({f"p{l}": F.col("c") * F.lead("c", l).over(along(CURVE)) if l else F.col("c") * F.col("c") for l in range(max_lag + 1)})
    rows = F.explode(F.array(*(F.struct(F.lit(l).alias("lag"), F.col(f"p{l}").alias("p")) for l in range(max_lag + 1)))).alias("z")
    terms = c.select(CURVE, rows).select(CURVE, "z.lag", "z.p")
    acf = terms.groupBy(CURVE, "lag").agg(F.sum("p").alias("p"))
    return acf.withColumn("acf", F.col("p") / F.sum(F.when(F.col("lag") == 0, F.col("p"))).over(w)).select(CURVE, "lag", "acf")


def mutual_information(samples: DataFrame, dim: str, lag: int, bins: int = 8) -> DataFrame:
    """Average mutual information (nats) at a lag with equal-width bins over the curve's range, the last bin closed."""
    w = Window.partitionBy(CURVE)
    lo, hi = F.min(dim).over(w), F.max(dim).over(w)
    b = samples.withColumn("b", F.least(F.floor((F.col(dim) - lo) / (hi - lo) * bins), F.lit(bins - 1))).withColumn("b2", F.lead("b", lag).over(along(CURVE))).where("b2 is not null")
    n = b.groupBy(CURVE, "b", "b2").agg(F.count(F.lit(1)).alias("c"))
    n = n.withColumns({"cx": F.sum("c").over(Window.partitionBy(CURVE, "b")), "cy": F.sum("c").over(Window.partitionBy(CURVE, "b2")), "n": F.sum("c").over(w)})
    return n.groupBy(CURVE).agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))).alias("ami"))


def distance(a: str, b: str, dims: tuple[str, ...], metric: str = "euclidean") -> Column:
    d = [F.abs(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in dims]
    if metric == "chebyshev":
        return F.greatest(*d) if len(d) > 1 else d[0]
    if metric == "cityblock":
        return reduce(lambda p, q: p + q, d)
    return F.sqrt(reduce(lambda p, q: p + q, [x * x for x in d])) if len(d) > 1 else d[0]


def cell_of(dims: tuple[str, ...], width: float | Column, around: bool = False) -> Column:
    """Cell of a state on a grid of that width, as an array; with ``around`` an array of its own and all neighbouring cells."""
    own = [F.floor(F.col(d) / (width * (1 + 1e-9))).cast("long") for d in dims]  # a little wider: distances are rounded
    if not around:
        return F.array(*own)
    moves = [()]
    for _ in own:
        moves = [(*m, k) for m in moves for k in (-1, 0, 1)]
    return F.array(*(F.array(*(c + k for c, k in zip(own, m, strict=True))) for m in moves))


def near_pairs(a: DataFrame, b: DataFrame, dims: tuple[str, ...], radius: float | Column, metric: str, keys: tuple[str, ...], also: Column | None = None) -> DataFrame:
    """Pairs of a's and b's samples at a distance of at most ``radius``, with keys, i, j and d; ``also`` is a condition on (i, j).

    ``radius`` may be an expression of columns that both have: each group of the keys has a radius, above zero, of its own.
    Cells have one, two or three dimensions at most (the first ones): any more multiply neighbours without pruning much.
    """
    grid = dims[:3]
    known = lambda x: x.where(reduce(lambda p, q: p & q, [F.col(d).isNotNull() for d in dims]))
    within = radius if isinstance(radius, Column) else F.lit(float(radius))
    if isinstance(radius, Column) or radius > 0:
        left = known(a).select(*keys, F.col("t_idx").alias("i"), F.struct(*dims).alias("p"), within.alias("_within"), F.explode(cell_of(grid, radius, around=True)).alias("cell"))
        right = known(b).select(*keys, F.col("t_idx").alias("j"), F.struct(*dims).alias("q"), cell_of(grid, radius).alias("cell"))
    else:  # only equal states
        cell = F.array(*(F.col(d).cast("double") for d in grid)).alias("cell")
        left = known(a).select(*keys, F.col("t_idx").alias("i"), F.struct(*dims).alias("p"), within.alias("_within"), cell)
        right = known(b).select(*keys, F.col("t_idx").alias("j"), F.struct(*dims).alias("q"), cell)
    both = left.join(right, [*keys, "cell"])
    both = both if also is None else both.where(also)
    return both.withColumn("d", distance("p", "q", dims, metric)).where("d <= _within").select(*keys, "i", "j", "d")


def recurrence_pairs(samples: DataFrame, dims: tuple[str, ...], radius: float, theiler: int = 0, metric: str = "euclidean", keys: tuple[str, ...] = (CURVE,)) -> DataFrame:
    """Recurrent pairs i < j with j - i > theiler and distance <= radius (inclusive); missing states have none."""
    return near_pairs(samples, samples, dims, radius, metric, keys, F.col("j") - F.col("i") > theiler).select(*keys, "i", "j")


def cross_recurrence_pairs(a: DataFrame, b: DataFrame, dims: tuple[str, ...], radius: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, j) of the samples within the radius of declared pairs of curves: rows of a and b with equal keys."""
    return near_pairs(a, b, dims, radius, "euclidean", keys).select(*keys, "i", "j")


def eligible_pairs(samples: DataFrame, theiler: int, keys: tuple[str, ...] = (CURVE,)) -> DataFrame:
    """Number of samples and of pairs with j - i > theiler of every curve, by the formula."""
    m = F.col("n") - theiler
    n = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("eligible", F.when(m > 1, (m * (m - 1) / 2).cast("long")).otherwise(F.lit(0).cast("long")))


def radius_profile(samples: DataFrame, dims: tuple[str, ...], radii: list[float], theiler: int = 0) -> DataFrame:
    """Per curve and radius: pairs within it and their share of the eligible pairs; one pass over the pairs within the largest radius."""
    p = near_pairs(samples, samples, dims, max(radii), "euclidean", (CURVE,), F.col("j") - F.col("i") > theiler)
    counts = p.groupBy(CURVE).agg(*(F.count(F.when(F.col("d") <= r, 1)).alias(f"c{k}") for k, r in enumerate(radii)))
    rows = F.explode(F.array(*(F.struct(F.lit(float(r)).alias("radius"), F.coalesce(F.col(f"c{k}"), F.lit(0)).alias("n_pairs")) for k, r in enumerate(radii)))).alias("z")
    out = eligible_pairs(samples, theiler).where("eligible > 0").join(counts, CURVE, "left").select(CURVE, "eligible", rows)
    return out.select(CURVE, "z.radius", "z.n_pairs", (F.col("z.n_pairs") / F.col("eligible")).alias("rate"))


def line_lengths(pairs: DataFrame, keys: tuple[str, ...], symmetric: bool = True) -> DataFrame:
    """Histogram of unbroken lines: keys, family (0 diagonal, 1 vertical), length, lines, and the lines' offsets times lengths.

    Each pair is read once and stands in its diagonal and, ``symmetric``, in two columns of the full matrix.
    """
    row = lambda family, fixed, run: F.struct(F.lit(family).alias("family"), fixed.cast("long").alias("fixed"), run.cast("long").alias("run"))
    i, j = F.col("i"), F.col("j")
    cells = [row(0, j - i, i), row(1, j, i)] + ([row(1, i, j)] if symmetric else [])
    p = pairs.select(*keys, F.explode(F.array(*cells)).alias("z")).select(*keys, "z.family", "z.fixed", "z.run")
    island = F.col("run") - F.row_number().over(Window.partitionBy(*keys, "family", "fixed").orderBy("run"))
    lines = p.withColumn("island", island).groupBy(*keys, "family", "fixed", "island").agg(F.count(F.lit(1)).alias("length"))
    return lines.groupBy(*keys, "family", "length").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("fixed") * F.col("length")).alias("offsets"))


def line_measures(histogram: DataFrame, keys: tuple[str, ...], min_diagonal: int = 2, min_vertical: int = 2) -> DataFrame:
    """All line measures of a histogram by one aggregate: shares, means, longest lines and the entropy of diagonal lengths (nats)."""
    length, lines = F.col("length"), F.col("lines")
    diagonal, vertical = F.col("family") == 0, F.col("family") == 1
    d, v = diagonal & (length >= min_diagonal), vertical & (length >= min_vertical)
    total = lambda cond, value: F.sum(F.when(cond, value))
    a = histogram.groupBy(*keys).agg(
        total(diagonal, length * lines).alias("n_pairs"), total(diagonal, F.col("offsets")).alias("lag_sum"), total(vertical, length * lines).alias("_v"),
        F.coalesce(total(d, length * lines), F.lit(0)).alias("_dl"), total(d, lines).alias("_dn"), F.max(F.when(d, length)).alias("max_diagonal"), total(d, lines * F.log(lines)).alias("_de"),
        F.coalesce(total(v, length * lines), F.lit(0)).alias("_vl"), total(v, lines).alias("_vn"), F.max(F.when(v, length)).alias("max_vertical"),
    )
    return a.withColumns({
        "determinism": F.col("_dl") / F.col("n_pairs"), "mean_diagonal": F.when(F.col("_dn") > 0, F.col("_dl") / F.col("_dn")), "diagonal_lines": F.coalesce("_dn", F.lit(0)),
        "diagonal_entropy": F.when(F.col("_dn") > 0, F.log("_dn") - F.col("_de") / F.col("_dn")),
        "laminarity": F.col("_vl") / F.col("_v"), "trapping_time": F.when(F.col("_vn") > 0, F.col("_vl") / F.col("_vn")),
    }).drop("_v", "_dl", "_dn", "_de", "_vl", "_vn")


def rqa_metrics(samples: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = (CURVE,), min_diagonal: int = 2, min_vertical: int = 2) -> DataFrame:
    """Recurrence rate, determinism, mean and longest diagonal, diagonal entropy, laminarity, trapping time, longest vertical.

    The rate is over all n*n cells; curves without pairs have rate 0 and NULL line measures.
    """
    k = list(keys)
    n = samples.groupBy(*k).agg(F.count(F.lit(1)).alias("n"))
    out = n.join(line_measures(line_lengths(pairs, keys), keys, min_diagonal, min_vertical), k, "left")
    rate = 2 * F.coalesce("n_pairs", F.lit(0)) / (F.col("n") * F.col("n"))
    return out.select(*k, "n", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), rate.alias("recurrence_rate"), "determinism", "mean_diagonal", "max_diagonal", "diagonal_entropy", "laminarity", "trapping_time", "max_vertical", (100 * F.col("lag_sum") / ((F.col("n") - 1) * F.col("n_pairs"))).alias("corm"))


def cross_rqa_metrics(a: DataFrame, b: DataFrame, pairs: DataFrame, min_diagonal: int = 2, min_vertical: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """The line measures of cross recurrences (i of a, j of b), a row for each declared pair; all cells count, both triangles apart."""
    one = lambda x: x if keys else x.withColumn("_one", F.lit(1))
    k = list(keys) or ["_one"]
    measures = line_measures(line_lengths(one(pairs), tuple(k), False), tuple(k), min_diagonal, min_vertical)
    size = one(a).groupBy(*k).agg(F.count(F.lit(1)).alias("n_a")).join(one(b).groupBy(*k).agg(F.count(F.lit(1)).alias("n_b")), k)
    out = size.join(measures, k, "left")
    return out.select(*keys, "n_a", "n_b", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), (F.coalesce("n_pairs", F.lit(0)) / (F.col("n_a") * F.col("n_b"))).alias("recurrence_rate"), "determinism", "mean_diagonal", "max_diagonal", F.coalesce("diagonal_lines", F.lit(0)).alias("diagonal_lines"), "diagonal_entropy", "laminarity", "trapping_time", "max_vertical")


def windows(samples: DataFrame, window: int, step: int) -> DataFrame:
    """Samples of each full window (window_start); a tail shorter than the window has none."""
    last = F.floor((F.count(F.lit(1)).over(Window.partitionBy(CURVE)) - window) / step) * step
    lo = F.greatest(F.lit(0), F.ceil((F.col("t_idx") - window + 1) / step) * step)
    hi = F.least(last, F.floor(F.col("t_idx") / step) * step)
    s = samples.withColumns({"_lo": lo.cast("int"), "_hi": hi.cast("int")}).where("_lo <= _hi")
    return s.withColumn("window_start", F.explode(F.sequence("_lo", "_hi", F.lit(step)))).drop("_lo", "_hi")


def windowed_rqa(samples: DataFrame, dims: tuple[str, ...], radius: float, window: int, step: int, theiler: int = 0) -> DataFrame:
    keys = (CURVE, "window_start")
    w = windows(samples, window, step)
    centre = w.groupBy(*keys).agg(((F.min("t") + F.max("t")) / 2).alias("centre"))
    return rqa_metrics(w, recurrence_pairs(w, dims, radius, theiler, keys=keys), keys).join(centre, list(keys))


def joint_pairs(*pairs: DataFrame) -> DataFrame:
    """Pairs recurrent in every system."""
    return reduce(lambda a, b: a.join(b, [CURVE, "i", "j"]), pairs)


def network_nodes(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Degree, triangles and local clustering of every node of the recurrence network."""
    both = pairs.select(CURVE, F.col("i").alias("t_idx"), F.col("j").alias("o")).union(pairs.select(CURVE, "j", "i"))
    degree = both.groupBy(CURVE, "t_idx").agg(F.count(F.lit(1)).alias("degree"))
    # Edges point from the node of lower degree (ties: the earlier one), so no node has more than a root of the edges to pair up.
    of = lambda k: degree.select(CURVE, F.col("t_idx").alias(k), F.col("degree").alias(f"_{k}"))
    forward = (F.col("_i") < F.col("_j")) | ((F.col("_i") == F.col("_j")) & (F.col("i") < F.col("j")))
    out = pairs.select(CURVE, "i", "j").join(of("i"), [CURVE, "i"]).join(of("j"), [CURVE, "j"])
    out = out.select(CURVE, F.when(forward, F.col("i")).otherwise(F.col("j")).alias("k"), F.when(forward, F.col("j")).otherwise(F.col("i")).alias("o"))
    wedges = out.withColumnRenamed("o", "i").join(out.withColumnRenamed("o", "j"), [CURVE, "k"]).where("i < j")
    closed = wedges.join(pairs.select(CURVE, "i", "j"), [CURVE, "i", "j"]).select(CURVE, F.explode(F.array("i", "j", "k")).alias("t_idx"))
    triangles = closed.groupBy(CURVE, "t_idx").agg(F.count(F.lit(1)).alias("triangles"))
    out = samples.select(CURVE, "t_idx").join(degree, [CURVE, "t_idx"], "left").join(triangles, [CURVE, "t_idx"], "left").fillna(0, ["degree", "triangles"])
    return out.withColumn("clustering", F.when(F.col("degree") > 1, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def network_summary(nodes: DataFrame) -> DataFrame:
    triples = F.sum(F.col("degree") * (F.col("degree") - 1) / 2)
    return nodes.groupBy(CURVE).agg(F.count(F.lit(1)).alias("n_nodes"), (F.sum("degree") / 2).alias("n_edges"), F.avg("degree").alias("mean_degree"), F.avg("clustering").alias("mean_clustering"), (F.sum("triangles") / 3).alias("n_triangles"), F.when(triples > 0, F.sum("triangles") / triples).alias("transitivity"))


def kantz_curve(samples: DataFrame, dims: tuple[str, ...], radius: float, theiler: int, max_horizon: int, min_neighbours: int = 2) -> DataFrame:
    """Log of the mean distance to all neighbours within the radius after k steps, averaged over references with enough of them."""
    short, long = split(samples, whole=True)

    def kernel(tile: Tile):
        d, known = tile.between(), tile.present[:, :, None] & tile.present[:, None, :]
        near, there = (d <= radius) & tile.apart(theiler) & known, tile.inside[:, :, None] & tile.inside[:, None, :]
        out = []
        for k in range(min(max_horizon + 1, d.shape[1])):
            n = d.shape[1] - k
            pair = near[:, :n, :n] & there[:, k:, k:]
            count, valued = pair.sum(2), pair & known[:, k:, k:]
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = np.where(valued, d[:, k:, k:], 0).sum(2) / valued.sum(2)
                ok = (count >= min_neighbours) & valued.any(2) & ~(mean <= 0)
                total, refs = np.where(ok, np.log(mean), 0).sum(1), ok.sum(1)
            at = np.flatnonzero(refs)
            out.append((at, np.full(len(at), k), total[at] / refs[at], refs[at]))
        at, k, mean, refs = (np.concatenate(x) for x in zip(*out, strict=True))
        return at, [pa.array(k.astype(np.int32)), pa.array(mean), pa.array(refs)]

    out = over_curves(short, dims, kernel, "k int, mean_log double, n long")
    return out if long is None else out.unionByName(_kantz_by_cells(long, dims, radius, theiler, max_horizon, min_neighbours))


def _kantz_by_cells(samples: DataFrame, dims: tuple[str, ...], radius: float, theiler: int, max_horizon: int, min_neighbours: int) -> DataFrame:
    """``kantz_curve`` of long curves."""
    p = recurrence_pairs(samples, dims, radius, theiler)
    both = p.union(p.select(CURVE, "j", "i")).select(CURVE, "i", "j", F.explode(F.sequence(F.lit(0), F.lit(max_horizon))).alias("k"))
    a = samples.select(CURVE, F.col("t_idx").alias("ai"), F.struct(*dims).alias("p"))
    b = samples.select(CURVE, F.col("t_idx").alias("bj"), F.struct(*dims).alias("q"))
    m = both.withColumns({"ai": F.col("i") + F.col("k"), "bj": F.col("j") + F.col("k")}).join(a, [CURVE, "ai"]).join(b, [CURVE, "bj"])
    per = m.groupBy(CURVE, "i", "k").agg(F.avg(distance("p", "q", dims)).alias("d"), F.count(F.lit(1)).alias("c")).where((F.col("c") >= min_neighbours) & (F.col("d") > 0))
    return per.groupBy(CURVE, "k").agg(F.avg(F.log("d")).alias("mean_log"), F.count(F.lit(1)).alias("n"))


def lyapunov_slope(curve: DataFrame, fit_start: int, fit_end: int) -> DataFrame:
    """Slope, intercept and R2 of the divergence over the declared horizons."""
    c = curve.where(F.col("k").between(fit_start, fit_end))
    return c.groupBy(CURVE).agg(F.regr_slope("mean_log", "k").alias("slope"), F.regr_intercept("mean_log", "k").alias("intercept"), F.regr_r2("mean_log", "k").alias("r2"), F.count(F.lit(1)).alias("n_points")).where("n_points >= 3")


def poincare_crossings(samples: DataFrame, section: str, value: float, direction: str, dims: tuple[str, ...]) -> DataFrame:
    """Linear crossings of section = value: positive a < 0 <= b, negative a > 0 >= b."""
    w = along(CURVE)
    s = samples.withColumns({"_a": F.col(section) - value, "_t": F.lead("t").over(w), **{f"_{d}": F.lead(d).over(w) for d in dims}}).withColumn("_b", F.lead("_a").over(w))
    hit = (F.col("_a") < 0) & (F.col("_b") >= 0) if direction == "positive" else (F.col("_a") > 0) & (F.col("_b") <= 0)
    f = F.col("_a") / (F.col("_a") - F.col("_b"))
    return s.where(hit).select(CURVE, F.col("t_idx").alias("i"), (F.col("t") + f * (F.col("_t") - F.col("t"))).alias("t"), *((F.col(d) + f * (F.col(f"_{d}") - F.col(d))).alias(d) for d in dims))


def components_within(samples: DataFrame, dims: tuple[str, ...], radius: float, theiler: int = 0) -> DataFrame:
    """``network_components`` of the recurrences within a radius: short curves in tiles, by the same hooking and jumping."""
    short, long = split(samples)

    def kernel(tile: Tile):
        edge = (tile.between() <= radius) & tile.apart(theiler)
        n = edge.shape[1]
        label = np.broadcast_to(np.arange(n, dtype=np.int16), edge.shape[:2])
        while True:
            fresh = np.minimum(label, np.where(edge, label[:, None, :], np.int16(n)).min(2))
            fresh = np.minimum(fresh, np.take_along_axis(fresh, fresh, 1))
            if (fresh == label).all():
                break
            label = fresh
        curve, node = np.nonzero(tile.inside)
        sizes = np.bincount(curve * n + label[curve, node], minlength=len(label) * n).reshape(-1, n)
        return np.arange(len(label)), [pa.array((sizes > 0).sum(1)), pa.array(sizes.max(1))]

    out = over_curves(short, dims, kernel, "n_components long, largest_component long")
    return out if long is None else out.union(network_components(long, recurrence_pairs(long, dims, radius, theiler)))


def network_components(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Connected components of every curve's recurrence network: how many, and the size of the largest.

    Labels fall to the least of a node's neighbours and of their labels (hooking and pointer jumping), so the rounds grow
    with the logarithm of a network's diameter; every round is stored.
    """
    both = stored(pairs.select(CURVE, F.col("i").alias("a"), F.col("j").alias("b")).union(pairs.select(CURVE, "j", "i")), "edges")
    labels = stored(samples.select(CURVE, F.col("t_idx").cast("long").alias("node"), F.col("t_idx").cast("long").alias("label")), "labels")
    while True:
        near = both.join(labels.select(CURVE, F.col("node").alias("b"), "label"), [CURVE, "b"]).groupBy(CURVE, F.col("a").cast("long").alias("node")).agg(F.min("label").alias("m"))
        hooked = labels.join(near, [CURVE, "node"], "left").select(CURVE, "node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        onward = hooked.select(CURVE, F.col("node").alias("label"), F.col("label").alias("jump"))
        fresh = stored(hooked.join(onward, [CURVE, "label"]).select(CURVE, "node", "old", F.least("label", "jump").alias("label")), "labels")
        done = fresh.where("label <> old").isEmpty()
        labels = fresh.select(CURVE, "node", "label")
        if done:
            break
    sizes = labels.groupBy(CURVE, "label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(CURVE).agg(F.count(F.lit(1)).alias("n_components"), F.max("n").alias("largest_component"))


def joint_components(pairs: dict[str, DataFrame], joint: DataFrame) -> DataFrame:
    """Pairs of each system, of all together, and the share of a system's pairs that are joint: (curve_id, system, n_pairs, joint_share)."""
    shared = joint.groupBy(CURVE).agg(F.count(F.lit(1)).alias("joint"))
    out = None
    for name, p in pairs.items():
        row = p.groupBy(CURVE).agg(F.count(F.lit(1)).alias("n_pairs")).join(shared, CURVE, "left").select(CURVE, F.lit(name).alias("system"), "n_pairs", (F.coalesce("joint", F.lit(0)) / F.col("n_pairs")).alias("joint_share"))
        out = row if out is None else out.union(row)
    return out


def metric_arrays(windowed: DataFrame, metric: str) -> DataFrame:
    """A windowed measure as curves (curve_id, values in window order); an error unless all curves have the same windows and no missing value."""
    rows = windowed.groupBy(CURVE).agg(F.array_sort(F.collect_list(F.struct("window_start", F.col(metric).cast("double").alias("v")))).alias("s"), F.count(metric).alias("n"))
    seen = rows.agg(F.min(F.xxhash64("s.window_start")).alias("a"), F.max(F.xxhash64("s.window_start")).alias("b"), F.max(F.size("s") - F.col("n")).alias("missing")).first()
    if seen.a != seen.b:
        raise ValueError("curves differ in their windows")
    if seen.missing:
        raise ValueError(f"{metric} is missing in some window")
    return rows.select(CURVE, F.col("s.v").alias("values"))


def windowed_mean_band(windowed: DataFrame, metric: str, replicates: int = 500, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Simultaneous band of a windowed measure's mean over curves that share their windows: (window, mean, se, lower, upper)."""
    from .inference import multiplier_mean_band

    mean, se, c = multiplier_mean_band(metric_arrays(windowed, metric), replicates, level, seed)
    return windowed.sparkSession.createDataFrame([(i, float(m), float(s), float(m - c * s), float(m + c * s)) for i, (m, s) in enumerate(zip(mean, se, strict=True))], "window int, mean double, se double, lower double, upper double")
