"""Functional outliers without pairs of curves: band depths from counts, fences of a functional boxplot, directional outlyingness.

All statistics of order are counts of smaller and equal values.  Values are counted first (so that a value that many curves
share is one row), dealt to buckets between approximate cuts that grow in number with the data, and summed up inside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import stored

CURVE = "curve_id"
#: Distinct values that a bucket is to hold, about.
HELD = 50_000
#: The normal distribution's third quartile: a median absolute deviation over it is a standard deviation.
MAD_SCALE = 0.6744897501960817


def cumulative(rows: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, value, count, below, n): of each distinct value how many rows have it, and how many of the n have a smaller one."""
    k = list(keys)
    counts = stored(rows.where(F.col(value).isNotNull()).groupBy(*k, value).agg(F.count(F.lit(1)).alias("count")), "counts")
    size = counts.groupBy(*k).agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("distinct"))
    largest = size.agg(F.max("distinct")).first()[0] or 1
    buckets = max(1, -(-largest // HELD))
    if buckets == 1:
        dealt = counts.withColumn("_bucket", F.lit(0))
    else:
        cuts = counts.groupBy(*k).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 20 * buckets).alias("_cuts"))
        cut = counts.join(cuts, k) if k else counts.crossJoin(F.broadcast(cuts))  # without keys the cuts are one row
        dealt = cut.withColumn("_bucket", F.aggregate("_cuts", F.lit(0), lambda s, c: s + (F.col(value) >= c).cast("int"))).drop("_cuts")
    sums = dealt.groupBy(*k, "_bucket").agg(F.sum("count").alias("_in"))
    order = Window.partitionBy(*k).orderBy("_bucket") if k else Window.orderBy("_bucket")
    before = sums.select(*k, "_bucket", (F.sum("_in").over(order) - F.col("_in")).alias("_before"))
    inside = F.sum("count").over(Window.partitionBy(*k, "_bucket").orderBy(value)) - F.col("count")
    out = dealt.withColumn("_inside", inside).join(before, [*k, "_bucket"])
    out = out.join(size.select(*k, "n"), k) if k else out.crossJoin(F.broadcast(size.select("n")))
    return out.select(*k, value, "count", (F.col("_before") + F.col("_inside")).alias("below"), "n")


def at_rank(counts: DataFrame, value: str, rank: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, value) with the given rank (from 1) among ``cumulative`` counts."""
    return counts.where((F.col("below") < rank) & (rank <= F.col("below") + F.col("count"))).select(*keys, value)


def medians(rows: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, median): exact, the mean of the two middle values of an even number."""
    c = cumulative(rows, value, keys)
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    middle = F.when((F.col("below") < low) & (low <= F.col("below") + F.col("count")), F.col(value) / 2)
    other = F.when((F.col("below") < high) & (high <= F.col("below") + F.col("count")), F.col(value) / 2)
    return c.groupBy(*keys).agg((F.sum(middle) + F.sum(other)).alias("median"))


def _time_weights(samples: DataFrame) -> DataFrame:
    """Trapezoid weights of the common grid, summing to one: (t_idx, w); the grid's size doesn't follow the number of curves."""
    grid = samples.groupBy("t_idx").agg(F.min("t").alias("t"))
    w = Window.orderBy("t_idx")
    width = (F.coalesce(F.lead("t").over(w), F.col("t")) - F.coalesce(F.lag("t").over(w), F.col("t"))) / 2
    return grid.select("t_idx", width.alias("w")).withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy()))


def modified_band_depth(samples: DataFrame, dim: str = "x") -> DataFrame:
    """(curve_id, depth): share of time that a curve spends inside the bands of two curves, over all pairs of curves.

    At each time the pairs that don't hold a value are those with both values below it or both above, so counts of
    smaller and greater values are enough.  Curves share their grid and are complete, else an error.
    """
    n = samples.select(CURVE).distinct().count()
    shape = samples.groupBy("t_idx").agg(F.count(dim).alias("c")).agg(F.min("c"), F.max("c")).first()
    if n and (shape[0] != n or shape[1] != n):
        raise ValueError("band depth needs complete curves on a common grid")
    pairs = lambda c: c * (c - 1) / 2
    counts = cumulative(samples, dim, ("t_idx",))
    above = F.col("n") - F.col("below") - F.col("count")
    inside = counts.select("t_idx", dim, (1 - (pairs(F.col("below")) + pairs(above)) / pairs(F.col("n"))).alias("share"))
    held = samples.select(CURVE, "t_idx", dim).join(inside, ["t_idx", dim]).join(F.broadcast(_time_weights(samples)), "t_idx")
    return held.groupBy(CURVE).agg(F.sum(F.col("share") * F.col("w")).alias("depth"))


def functional_boxplot(samples: DataFrame, dim: str = "x", factor: float = 1.5, central: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Fences by time (t_idx, t, lower, upper, low_fence, high_fence) and curves (curve_id, depth, central, times_outside, outlier).

    The central region spans the deepest curves, ``central`` of all (ties with the last of them included); fences lie ``factor``
    times its height beyond it.  A curve is an outlier if it leaves the fences anywhere: a flag for review, nothing is removed.
    """
    if factor <= 0 or not 0 < central < 1:
        raise ValueError("factor is positive and the central share between 0 and 1")
    depth = stored(modified_band_depth(samples, dim), "depth")
    counts = cumulative(depth.select((-F.col("depth")).alias("minus")), "minus")
    cut = at_rank(counts, "minus", F.ceil(F.col("n") * F.lit(central))).select((-F.col("minus")).alias("cut"))
    inner = depth.crossJoin(F.broadcast(cut)).select(CURVE, "depth", (F.col("depth") >= F.col("cut")).alias("central"))  # one row
    region = samples.join(inner.where("central").select(CURVE), CURVE, "left_semi").groupBy("t_idx").agg(F.min("t").alias("t"), F.min(dim).alias("lower"), F.max(dim).alias("upper"))
    height = (F.col("upper") - F.col("lower")) * factor
    fences = stored(region.select("*", (F.col("lower") - height).alias("low_fence"), (F.col("upper") + height).alias("high_fence")), "fences")
    outside = (F.col(dim) < F.col("low_fence")) | (F.col(dim) > F.col("high_fence"))
    seen = samples.join(F.broadcast(fences), "t_idx").groupBy(CURVE).agg(F.count(F.when(outside, 1)).alias("times_outside"))
    return fences, inner.join(seen, CURVE).withColumn("outlier", F.col("times_outside") > 0)


def directional_outlyingness(samples: DataFrame, dim: str = "x") -> DataFrame:
    """(curve_id, magnitude, shape): mean and variance over time of a value's distance from the median in robust deviations.

    A time at which more than half of the values are equal has no deviation; it is left out, and an error if all are.
    """
    middle = medians(samples, dim, ("t_idx",))
    away = samples.select(CURVE, "t_idx", "t", dim).join(F.broadcast(middle), "t_idx").withColumn("d", F.col(dim) - F.col("median"))
    spread = medians(away.withColumn("a", F.abs("d")), "a", ("t_idx",)).select("t_idx", (F.col("median") / MAD_SCALE).alias("sd")).where("sd > 0")
    if spread.isEmpty() and not samples.isEmpty():
        raise ValueError("at no time more than half of the values differ")
    o = away.join(F.broadcast(spread.join(_time_weights(samples), "t_idx")), "t_idx").withColumn("o", F.col("d") / F.col("sd"))
    mean, total = F.sum(F.col("o") * F.col("w")), F.sum("w")
    return o.groupBy(CURVE).agg((mean / total).alias("magnitude"), (F.sum(F.col("o") * F.col("o") * F.col("w")) / total - (mean / total) * (mean / total)).alias("shape"))


def magnitude_shape_outliers(samples: DataFrame, dim: str = "x", alpha: float = 0.993) -> DataFrame:
    """``directional_outlyingness`` with its robust squared distance, the chi-square cutoff and the verdict."""
    from .stability import chi_square_quantile, mahalanobis, score_covariance

    points = stored(directional_outlyingness(samples, dim).withColumn("scores", F.array("magnitude", "shape")), "outlyingness")
    centre, cov = score_covariance(points, 2, True)
    cut = chi_square_quantile(alpha, 2)
    out = points.withColumns({"distance": mahalanobis(centre, cov), "cutoff": F.lit(cut)})
    return out.select(CURVE, "magnitude", "shape", "distance", "cutoff", (F.col("distance") > F.col("cutoff")).alias("outlier"))
