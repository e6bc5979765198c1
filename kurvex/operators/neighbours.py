"""Exact nearest neighbours and order statistics of distances: short curves in tiles, many at once, longer ones by cells.

By cells, no step meets all pairs of a curve.
Nearest neighbours are searched in cells that widen fourfold for the samples that are still open; a search ends where the
neighbour found is nearer than anything outside the cells searched.  The radius of a recurrence rate is the distance of
a rank: counts per cell bound it from above, and only pairs within that bound are made, refined by histograms.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analytic import along
from ..functions.shared import dropped, stored
from ..functions.tiles import Tile, distances, over_curves, split
from .recurrence import CURVE, cell_of, distance, near_pairs

#: Cells have at most so many dimensions; the widths that are tried first, a quarter each, and pairs per state that a width may make.
GRID, LEVELS, CROWD = 3, 7, 16
#: Cells of the count grid that bounds a distance, bins of a histogram, and distances that are sorted in the end.
CELLS, BINS, HELD = 1 << 16, 256, 4096


def _known(samples: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    return samples.where(reduce(lambda p, q: p & q, [F.col(d).isNotNull() & ~F.isnan(d) for d in dims]))


def nearest_places(tile: Tile, theiler: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a tile's samples, curve by curve, the place of the nearest neighbour and its distance; those without one are False in the last array."""
    n, known = tile.times.shape[1], tile.present & ~np.isnan(tile.values).any(1)
    d = tile.between()
    equal = (tile.values[:, :, :, None] == tile.values[:, :, None, :]).all(1) & known[:, None, :]
    first, last = equal.argmax(2), n - 1 - equal[:, :, ::-1].argmax(2)
    t = tile.times[:, :, None]
    early, late = (np.take_along_axis(tile.times, x, 1)[:, None, :] for x in (first, last))
    j = np.where(early < t - theiler, first[:, None, :], np.where(late > t + theiler, last[:, None, :], n))
    ok = (j < n) & (d > 0) & known[:, :, None] & known[:, None, :]
    d[~ok] = np.inf
    least = d.min(2)
    j[~(ok & (d == least[:, :, None]))] = n
    return j.min(2), least, ok.any(2)


def nearest_neighbours(samples: DataFrame, dims: tuple[str, ...], theiler: int, keys: tuple[str, ...] = (CURVE,)) -> DataFrame:
    """(keys, i, j, d): the nearest state at a distance above zero that is further than ``theiler`` in time.

    Of equally near states the one with the least index j counts; j is the state's first occurrence if that is far enough in
    time, else its last.  Samples with a missing coordinate have no neighbour and are none; samples without any are left out.
    """
    short, long = split(samples, keys)

    def kernel(tile: Tile):
        j, d, found = nearest_places(tile, theiler)
        curve, i = np.nonzero(found)
        return curve, [pa.array(tile.times[curve, i]), pa.array(tile.times[curve, j[curve, i]]), pa.array(d[curve, i])]

    out = over_curves(short, dims, kernel, "i long, j long, d double", keys)
    return out if long is None else out.union(nearest_by_cells(long, dims, theiler, keys))


def nearest_by_cells(samples: DataFrame, dims: tuple[str, ...], theiler: int, keys: tuple[str, ...] = (CURVE,)) -> DataFrame:
    """``nearest_neighbours`` of long curves."""
    k, grid = list(keys), dims[:GRID]
    known = _known(samples, dims).select(*k, F.col("t_idx").cast("long").alias("i"), *dims)
    # Equal states are one row with their first and last time, so a state that recurs often is no hot cell.
    states = known.groupBy(*k, *dims).agg(F.min("i").alias("first"), F.max("i").alias("last"))
    spread = F.greatest(*(F.max(d) - F.min(d) for d in grid), F.lit(0.0))
    wide = states.groupBy(*k).agg(spread.alias("spread"), F.count(F.lit(1)).alias("n"))
    wide = wide.withColumn("top", F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0) / F.ceil(F.pow("n", F.lit(1 / len(grid)))))
    states = stored(states.join(wide, k), "states")
    level = states.select(*k, "n", *dims, F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"), "top").withColumn("width", F.col("top") / F.pow(F.lit(4.0), "level"))
    cells = level.groupBy(*k, "n", "level", "width", cell_of(grid, F.col("width")).alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    crowd = cells.groupBy(*k, "n", "level", "width").agg(F.sum(F.col("c") * F.col("c")).alias("pairs"))
    # the widest cells that aren't crowded, else the narrowest
    fits = F.max(F.when(F.col("pairs") <= CROWD * F.col("n"), F.col("width")))
    widths = stored(crowd.groupBy(*k).agg(F.coalesce(fits, F.min("width")).alias("width")), "widths")
    left, found = stored(known.join(widths, k), "open"), None
    spent = [widths]
    while True:
        at = F.explode(cell_of(grid, F.col("width"), around=True)).alias("cell")
        query = left.select(*k, "i", "width", F.struct(*dims).alias("p"), at)
        width = left.select(*k, "width").distinct()
        known_states = states.join(width, k).select(*k, "spread", "first", "last", F.struct(*dims).alias("q"), cell_of(grid, F.col("width")).alias("cell"))
        j = F.when(F.col("first") < F.col("i") - theiler, F.col("first")).when(F.col("last") > F.col("i") + theiler, F.col("last"))
        pairs = query.join(known_states, [*k, "cell"]).select(*k, "i", "width", "spread", j.alias("j"), distance("p", "q", dims).alias("d")).where("j is not null and d > 0")
        best = pairs.groupBy(*k, "i").agg(F.min(F.struct("d", "j")).alias("m"), F.first("width").alias("width"), F.first("spread").alias("spread"))
        near = stored(best.where("m.d <= width or width >= spread").select(*k, "i", "m.j", "m.d"), "near")
        found = near if found is None else found.union(near)
        # those that aren't found go on with wider cells, unless the last cells held everything
        more = left.join(near.select(*k, "i"), [*k, "i"], "left_anti").join(states.select(*k, "spread").distinct(), k).where("width < spread")
        before, left = left, stored(more.select(*k, "i", *dims, (F.col("width") * 4).alias("width")), "open")
        spent.append(before)
        if left.isEmpty():
            dropped(*spent, left, states)
            return found


def _count_bound(grids: list[np.ndarray], steps: np.ndarray, rest: float, metric: str, rank: float) -> float:
    """A distance within which at least ``rank`` ordered pairs lie, from the counts of cells with sides ``steps``."""
    shape = [2 * s for s in grids[0].shape]
    transform = [np.fft.rfftn(g, shape) for g in grids]
    pairs = np.rint(np.fft.irfftn(transform[0].conj() * transform[-1], shape))  # by offset between cells
    offsets = np.meshgrid(*(np.minimum(np.arange(s), s - np.arange(s)) for s in shape), indexing="ij")
    sides = np.stack([(o.ravel() + 1) * h for o, h in zip(offsets, steps, strict=True)])
    if metric == "chebyshev":
        far = np.maximum(sides.max(0), rest)
    else:
        far = sides.sum(0) + rest if metric == "cityblock" else np.sqrt((sides**2).sum(0) + rest * rest)
    order = np.argsort(far, kind="stable")
    reached = np.searchsorted(np.cumsum(pairs.ravel()[order]), rank - 0.5)
    return float(far[order[min(reached, len(order) - 1)]]) * (1 + 1e-9)


def _bounds(sides: list[DataFrame], ranks: DataFrame, keys: list[str], dims: tuple[str, ...], metric: str) -> DataFrame:
    """Per group a distance that its rank's distance doesn't exceed: (keys, rank, hi).  A group sends its cells' counts alone."""
    grid = dims[:GRID]
    per = max(2, int(CELLS ** (1 / len(grid))) if len(grid) > 1 else 4096)
    every = reduce(DataFrame.unionByName, [s.select(*keys, *dims, F.lit(n).alias("side")) for n, s in enumerate(sides)])
    ends = every.groupBy(*keys).agg(*(f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)))
    with_ends = every.join(ends, keys)
    wide = [(F.col(f"max_{d}") - F.col(f"min_{d}")) for d in dims]
    cell = F.array(*(F.when(w > 0, F.least(F.floor((F.col(d) - F.col(f"min_{d}")) / F.when(w > 0, w) * per), F.lit(per - 1))).otherwise(0).cast("int") for d, w in zip(grid, wide, strict=False)))
    counts = with_ends.groupBy(*keys, "side", cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"), *(F.first(w).alias(f"w{n}") for n, w in enumerate(wide)))
    counts = counts.join(ranks.select(*keys, "rank", "ordered"), keys)
    kinds = dict(counts.dtypes)
    two = len(sides) > 1

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.array([pdf[f"w{n}"].iloc[0] for n in range(len(dims))], float)
        cells = np.stack(pdf["cell"])
        grids = []
        for side in range(1 + two):
            g = np.zeros([per] * len(grid))
            own = (pdf["side"] == side).to_numpy()
            g[tuple(cells[own].T)] = pdf["c"][own]
            grids.append(g)
        rest = w[len(grid) :]
        left = 0.0 if not len(rest) else float(rest.max() if metric == "chebyshev" else rest.sum() if metric == "cityblock" else np.sqrt((rest**2).sum()))
        hi = _count_bound(grids, np.maximum(w[: len(grid)], 0) / per, left, metric, float(pdf["ordered"].iloc[0]))
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), int(pdf["rank"].iloc[0]), hi]], columns=[*keys, "rank", "hi"])

    return counts.groupBy(*keys).applyInPandas(bound, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "rank long, hi double"]))


def _distance_of_rank(a: DataFrame, b: DataFrame, ranks: DataFrame, keys: list[str], dims: tuple[str, ...], metric: str, also=None) -> DataFrame:
    """Per group the distance with its rank among the pairs of a's and b's samples: (keys, radius)."""
    sides = [a] if a is b else [a, b]
    bounds = _bounds(sides, ranks, keys, dims, metric)
    if not bounds.where("hi <= 0").isEmpty():
        raise ValueError("a target rate needs states that are not all the same")
    state = stored(bounds.select(*keys, "rank", F.lit(0.0).alias("lo"), "hi", F.lit(None).cast("long").alias("n")), "ranks")

    def pairs(of: DataFrame) -> DataFrame:
        edges = of.select(*keys, F.col("hi").alias("radius"))
        near = near_pairs(a.join(edges, keys), b.join(edges, keys), dims, F.col("radius"), metric, tuple(keys), also)
        return near.join(of, keys).where("d between lo and hi")

    done = None
    while True:
        bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))).otherwise(0)
        counted = pairs(state).groupBy(*keys, "rank", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
        placed = counted.withColumn("upto", upto).where("upto >= rank and upto - n < rank")
        state = stored(placed.select(*keys, (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "lo", "hi", "n"), "ranks")
        ready = state.where(f"lo = hi or n <= {HELD}")
        done = ready if done is None else done.union(ready)
        state = state.where(f"lo < hi and n > {HELD}")
        if state.isEmpty():
            break
    few = done.where("lo < hi")
    chosen = pairs(few).groupBy(*keys).agg(F.element_at(F.sort_array(F.collect_list("d")), F.first("rank").cast("int")).alias("radius"))
    return done.where("lo = hi").select(*keys, F.col("lo").alias("radius")).union(chosen)


def _rank(total, rate: float):
    """The least number of pairs whose share of ``total`` reaches the rate."""
    return F.greatest(F.lit(1), F.ceil(total * F.lit(rate) - 1e-9)).cast("long")


def _checked(rate: float) -> None:
    if not 0 < rate < 1:
        raise ValueError("the target rate lies strictly between 0 and 1")


def radius_for_rate(samples: DataFrame, dims: tuple[str, ...], rate: float, theiler: int = 0, metric: str = "euclidean", keys: tuple[str, ...] = (CURVE,)) -> DataFrame:
    """Per curve the least radius at which the share of eligible pairs (j - i > theiler) reaches ``rate``: (keys, radius).

    It is the distance of a pair, exactly.  Samples with a missing coordinate take no part; an error if some curve has no
    eligible pair, or if all of its states are the same.
    """
    _checked(rate)
    short, long = split(samples, keys)

    def kernel(tile: Tile):
        known = tile.present & ~np.isnan(tile.values).any(1)
        i, j = np.triu_indices(known.shape[1], 1)
        ok = known[:, i] & known[:, j] & (tile.times[:, j] - tile.times[:, i] > theiler)
        d = distances(tile.values[:, :, i], tile.values[:, :, j], metric)
        d[~ok] = np.inf
        d.sort(1)
        eligible = ok.sum(1)
        rank = np.maximum(1, np.ceil(eligible * rate - 1e-9)).astype(int)
        high, low = (f(np.where(known[:, None], tile.values, -e), 2, initial=-e) for f, e in ((np.max, np.inf), (np.min, -np.inf)))
        at = np.flatnonzero(known.any(1))
        radius = [None if not eligible[c] else d[c, rank[c] - 1] for c in at]
        return at, [pa.array(eligible[at]), pa.array((low == high).all(1)[at]), pa.array(radius, pa.float64())]

    tiled = stored(over_curves(short, dims, kernel, "eligible long, same boolean, radius double", keys), "radii")
    if not tiled.where("eligible <= 0").isEmpty():
        raise ValueError("the Theiler window leaves a curve without eligible pairs")
    if not tiled.where("same").isEmpty():
        raise ValueError("a target rate needs states that are not all the same")
    out = tiled.select(*keys, "radius")
    return out if long is None else out.union(_radius_by_cells(long, dims, rate, theiler, metric, keys))


def _radius_by_cells(samples: DataFrame, dims: tuple[str, ...], rate: float, theiler: int, metric: str, keys: tuple[str, ...]) -> DataFrame:
    """``radius_for_rate`` of long curves."""
    k, known = list(keys), _known(samples, dims)
    later = Window.partitionBy(*k).orderBy(F.col("t_idx").cast("long")).rangeBetween(theiler + 1, Window.unboundedFollowing)
    n = known.select(*k, F.count(F.lit(1)).over(later).alias("later")).groupBy(*k).agg(F.count(F.lit(1)).alias("n"), F.sum("later").alias("eligible"))
    n = stored(n, "eligible")
    if not n.where("eligible <= 0").isEmpty():
        raise ValueError("the Theiler window leaves a curve without eligible pairs")
    # Counts of cells know no times: they hold every sample with itself, and pairs that are too near in time.
    ranks = n.select(*k, _rank(F.col("eligible"), rate).alias("rank"), "n", "eligible")
    ranks = ranks.withColumn("ordered", F.col("n") * F.col("n") - 2 * (F.col("eligible") - F.col("rank")))
    return _distance_of_rank(known, known, ranks, k, dims, metric, F.col("j") - F.col("i") > theiler)


def cross_radius_for_rate(a: DataFrame, b: DataFrame, dims: tuple[str, ...], rate: float, metric: str = "euclidean", keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """Per declared pair of curves (rows of a and b with equal keys) the least radius at which ``rate`` of all cells recur: (keys, radius)."""
    _checked(rate)
    k, a, b = list(keys), _known(a, dims), _known(b, dims)
    size = [x.groupBy(*k).agg(F.count(F.lit(1)).alias(n)) for x, n in ((a, "m"), (b, "n"))]
    total = size[0].join(size[1], k).withColumn("all", F.col("m") * F.col("n"))
    ranks = total.select(*k, _rank(F.col("all"), rate).alias("rank")).withColumn("ordered", F.col("rank"))
    return _distance_of_rank(a, b, ranks, k, dims, metric)


def divergence_curve(samples: DataFrame, dims: tuple[str, ...], theiler: int, max_horizon: int) -> DataFrame:
    """Mean log distance of nearest neighbours after k steps, pairs of distance zero counted apart."""
    nn = nearest_neighbours(samples, dims, theiler).select(CURVE, "i", "j", F.explode(F.sequence(F.lit(0), F.lit(max_horizon))).alias("k"))
    a = samples.select(CURVE, F.col("t_idx").alias("ai"), F.struct(*dims).alias("p"))
    b = samples.select(CURVE, F.col("t_idx").alias("bj"), F.struct(*dims).alias("q"))
    m = nn.withColumns({"ai": F.col("i") + F.col("k"), "bj": F.col("j") + F.col("k")}).join(a, [CURVE, "ai"]).join(b, [CURVE, "bj"])
    d = distance("p", "q", dims)
    return m.withColumn("d", d).groupBy(CURVE, "k").agg(F.avg(F.when(F.col("d") > 0, F.log("d"))).alias("mean_log"), F.count(F.when(F.col("d") > 0, 1)).alias("n"), F.count(F.when(F.col("d") == 0, 1)).alias("zeros"))


def false_neighbours(samples: DataFrame, dim: str, delay: int, max_dimension: int, theiler: int = 0, rtol: float = 10.0, atol: float = 2.0) -> DataFrame:
    """Per curve and embedding dimension m: share of nearest neighbours that part in dimension m + 1.

    A neighbour is false if the new coordinate's distance is over ``rtol`` times the distance, or the joint
    distance is over ``atol`` population deviations of the curve.
    """
    short, long = split(samples)

    def kernel(tile: Tile):
        x, n = tile.values[:, 0], tile.times.shape[1]
        with np.errstate(invalid="ignore", divide="ignore"):
            there = tile.present.sum(1)
            mean = np.where(tile.present, x, 0).sum(1) / there
            sd = np.sqrt((np.where(tile.present, x - mean[:, None], 0) ** 2).sum(1) / there)
        rows: list[tuple] = []
        for m in range(1, max_dimension + 1):
            back = [slice(max(0, (m - l) * delay), max(0, n - l * delay)) for l in range(m + 1)]  # states that have m delays
            if not len(range(*back[0].indices(n))):
                break
            e = np.stack([x[:, b] for b in back[:m]], 1)
            there = tile.present[:, back[m]] & tile.inside[:, back[0]]
            for b in back[:m]:
                there = there & tile.present[:, b]
            j, d, found = nearest_places(Tile(tile.times[:, back[0]], e, there, there), theiler)
            curve, i = np.nonzero(found)
            new = x[:, back[m]]
            g, d = np.abs(new[curve, i] - new[curve, j[curve, i]]), d[curve, i]
            false = ~(g / d <= rtol) | ~(np.sqrt(d * d + g * g) / sd[curve] <= atol)
            count, hits = np.bincount(curve, minlength=len(x)), np.bincount(curve, false, minlength=len(x))
            rows += [(c, m, hits[c] / count[c], int(count[c])) for c in np.flatnonzero(count)]
        at, dimension, share, count = zip(*rows, strict=True) if rows else ((), (), (), ())
        return np.array(at, int), [pa.array(dimension, pa.int32()), pa.array(share, pa.float64()), pa.array(count, pa.int64())]

    out = over_curves(short, (dim,), kernel, "dimension int, false_share double, n long")
    return out if long is None else out.unionByName(_false_by_cells(long, dim, delay, max_dimension, theiler, rtol, atol))


def _false_by_cells(samples: DataFrame, dim: str, delay: int, max_dimension: int, theiler: int, rtol: float, atol: float) -> DataFrame:
    """``false_neighbours`` of long curves."""
    w = along(CURVE)
    sd = samples.groupBy(CURVE).agg(F.stddev_pop(dim).alias("sd"))
    out = None
    for m in range(1, max_dimension + 1):
        cols = [(F.lag(dim, l * delay).over(w) if l else F.col(dim)).alias(f"e{l}") for l in range(m + 1)]
        s = samples.select(CURVE, "t_idx", *cols).where(F.col(f"e{m}").isNotNull())
        near = nearest_by_cells(s, tuple(f"e{l}" for l in range(m)), theiler)
        new = s.select(CURVE, F.col("t_idx").alias("i"), F.col(f"e{m}").alias("p")), s.select(CURVE, F.col("t_idx").alias("j"), F.col(f"e{m}").alias("q"))
        j = near.join(new[0], [CURVE, "i"]).join(new[1], [CURVE, "j"]).join(sd, CURVE).withColumn("g", F.abs(F.col("p") - F.col("q")))
        false = (F.col("g") / F.col("d") > rtol) | (F.sqrt(F.col("d") * F.col("d") + F.col("g") * F.col("g")) / F.col("sd") > atol)
        row = j.groupBy(CURVE).agg(F.lit(m).alias("dimension"), F.avg(false.cast("double")).alias("false_share"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out
