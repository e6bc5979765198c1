"""Row-wise transforms and planar geometry of curves; every function maps samples to samples or to one row per curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analytic import along, gradient, hypot

CURVE = "curve_id"


def sampling_summary(samples: DataFrame, dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Per curve: samples, first and last time, median and largest interval, share of missing values."""
    step = samples.withColumn("dt", F.col("t") - F.lag("t").over(along(CURVE)))
    missing = sum((F.col(d).isNull().cast("double") for d in dims), F.lit(0.0)) / len(dims)
    return step.groupBy(CURVE).agg(F.count(F.lit(1)).alias("n_samples"), F.min("t").alias("start"), F.max("t").alias("end"), F.percentile("dt", 0.5).alias("median_interval"), F.max("dt").alias("max_interval"), F.avg(missing).alias("missing_fraction"))


def common_overlap_interval(samples: DataFrame) -> DataFrame:
    """The interval that every curve covers: start, end and whether it isn't empty."""
    per = samples.groupBy(CURVE).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return per.agg(F.max("a").alias("start"), F.min("b").alias("end")).withColumn("valid", F.col("end") > F.col("start"))


def union_interval(samples: DataFrame) -> DataFrame:
    """The interval from the first to the last time of any curve."""
    return samples.agg(F.min("t").alias("start"), F.max("t").alias("end")).withColumn("valid", F.col("end") > F.col("start"))


def make_common_grid(interval: DataFrame, n_time: int) -> DataFrame:
    """``n_time`` equally spaced times over the interval (start, end): that of ``common_overlap_interval``, ``union_interval`` or a declared one."""
    i = F.explode(F.sequence(F.lit(0), F.lit(n_time - 1))).alias("g_idx")
    return interval.select("start", "end", i).select("g_idx", (F.col("start") + F.col("g_idx") * (F.col("end") - F.col("start")) / (n_time - 1)).alias("g"))


def resample_linear(samples: DataFrame, grid: DataFrame, dims: tuple[str, ...] = ("x", "y"), max_gap: float | None = None) -> DataFrame:
    """Values at the grid by linear interpolation between the bracketing samples; NULL outside a curve and inside gaps over ``max_gap``.

    Grid points and samples are put in one sorted stream per curve, so the bracket is two window functions and no range join.
    The grid is one small declared table (its size doesn't follow the data).
    """
    points = samples.select(CURVE).distinct().crossJoin(F.broadcast(grid)).select(CURVE, "g_idx", F.col("g").alias("t"), *(F.lit(None).cast("double").alias(d) for d in dims), F.lit(0).alias("is_sample"))
    both = samples.select(CURVE, F.lit(None).cast("int").alias("g_idx"), "t", *dims, F.lit(1).alias("is_sample")).unionByName(points)
    back = Window.partitionBy(CURVE).orderBy("t", F.desc("is_sample")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(CURVE).orderBy("t", "is_sample").rowsBetween(0, Window.unboundedFollowing)
    out = both
    for d in dims:
        s = F.when((F.col("is_sample") == 1) & F.col(d).isNotNull(), F.struct(F.col("t").alias("t"), F.col(d).alias("v")))
        out = out.withColumn(f"_b{d}", F.last(s, True).over(back)).withColumn(f"_a{d}", F.first(s, True).over(ahead))
    return out.where("is_sample = 0").select(CURVE, "g_idx", "t", *(_blend(F.col(f"_b{d}"), F.col(f"_a{d}"), F.col("t"), max_gap).alias(d) for d in dims))


def _blend(b: Column, a: Column, t: Column, max_gap: float | None) -> Column:
    gap = a["t"] - b["t"]
    v = F.when(gap == 0, b["v"]).otherwise(b["v"] + (a["v"] - b["v"]) * (t - b["t"]) / gap)
    return v if max_gap is None else F.when((gap <= max_gap) | (t == b["t"]) | (t == a["t"]), v)


def interpolate_short_gaps(samples: DataFrame, dim: str, max_gap: float) -> DataFrame:
    """Missing values between samples at most ``max_gap`` apart, filled linearly; all else stays missing."""
    s = F.when(F.col(dim).isNotNull(), F.struct(F.col("t").alias("t"), F.col(dim).alias("v")))
    w = along(CURVE)
    b = F.last(s, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    a = F.first(s, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    filled = samples.withColumn("_b", b).withColumn("_a", a)
    v = F.when(F.col(dim).isNotNull(), F.col(dim)).otherwise(_blend(F.col("_b"), F.col("_a"), F.col("t"), max_gap))
    return filled.withColumn("filled", F.col(dim).isNull() & v.isNotNull()).withColumn(dim, v).drop("_a", "_b")


def normalize_time(samples: DataFrame, start: float = 0.0, end: float = 1.0, per_curve: bool = True) -> DataFrame:
    """Times mapped linearly to [start, end], from each curve's range or from that of all curves (one row, broadcast)."""
    if per_curve:
        w = Window.partitionBy(CURVE)
        lo, hi, rows = F.min("t").over(w), F.max("t").over(w), samples
    else:
        rows = samples.crossJoin(F.broadcast(samples.agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))))
        lo, hi = F.col("_lo"), F.col("_hi")
    return rows.withColumn("t", F.lit(start) + (F.col("t") - lo) / (hi - lo) * (end - start)).drop("_lo", "_hi")


def normalize_coordinates(samples: DataFrame, width: float, height: float, x: str = "x", y: str = "y") -> DataFrame:
    return samples.withColumns({x: F.col(x) / width, y: F.col(y) / height})


def center_on_landmark(samples: DataFrame, landmark_x: float | None = None, landmark_y: float | None = None, x: str = "x", y: str = "y", landmarks: DataFrame | None = None) -> DataFrame:
    """Coordinates relative to one landmark, or to each curve's own (``landmarks``: curve_id, landmark_x, landmark_y; a curve without one is an error)."""
    if landmarks is None:
        return samples.withColumns({x: F.col(x) - landmark_x, y: F.col(y) - landmark_y})
    if not samples.select(CURVE).distinct().join(landmarks, CURVE, "left_anti").isEmpty():
        raise ValueError("a curve has no landmark")
    rows = samples.join(landmarks.select(CURVE, "landmark_x", "landmark_y"), CURVE)
    return rows.withColumns({x: F.col(x) - F.col("landmark_x"), y: F.col(y) - F.col("landmark_y")}).drop("landmark_x", "landmark_y")


def differentiate(samples: DataFrame, dims: tuple[str, ...] = ("x", "y"), order: int = 1) -> DataFrame:
    """Time derivatives of the dims; curves need three samples (else NULL)."""
    for _ in range(order):
        samples = samples.withColumns({d: gradient(F.col(d), F.col("t"), along(CURVE)) for d in dims})
    return samples


def kinematics(samples: DataFrame, min_speed: float = 0.0) -> DataFrame:
    """Velocity, acceleration, speed, heading, signed curvature, turning rate and cumulative path of planar curves.

    Direction measures are NULL at or below ``min_speed`` (undefined, not zero).
    """
    w = along(CURVE)
    v = samples.withColumns({f"v{d}": gradient(F.col(d), F.col("t"), w) for d in "xy"})
    a = v.withColumns({f"a{d}": gradient(F.col(f"v{d}"), F.col("t"), w) for d in "xy"})
    step = hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    a = a.withColumn("speed", hypot(F.col("vx"), F.col("vy"))).withColumn("acceleration", hypot(F.col("ax"), F.col("ay"))).withColumn("_step", F.coalesce(step, F.lit(0.0)))
    moving = F.col("speed") > min_speed
    cross = F.col("vx") * F.col("ay") - F.col("vy") * F.col("ax")
    return a.withColumns({
        "heading": F.when(moving, F.atan2("vy", "vx")),
        "curvature": F.when(moving, cross / F.pow("speed", 3)),
        "turning_rate": F.when(moving, cross / (F.col("speed") * F.col("speed"))),
        "path": F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)),
    }).drop("_step")


def tortuosity(samples: DataFrame, min_displacement: float = 0.0) -> DataFrame:
    """Path length over end-to-end distance per curve; NULL where the distance isn't above ``min_displacement``."""
    w = along(CURVE)
    step = hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    per = samples.withColumn("_s", step).groupBy(CURVE).agg(F.sum("_s").alias("path_length"), hypot(F.max_by("x", "t_idx") - F.min_by("x", "t_idx"), F.max_by("y", "t_idx") - F.min_by("y", "t_idx")).alias("displacement"))
    return per.withColumn("tortuosity", F.when(F.col("displacement") > min_displacement, F.col("path_length") / F.col("displacement")))


def distance_to_landmark(samples: DataFrame, lx: float, ly: float) -> DataFrame:
    return samples.withColumn("distance", hypot(F.col("x") - lx, F.col("y") - ly))


def alr(parts: DataFrame, dims: tuple[str, ...], reference: str, epsilon: float = 1e-8) -> DataFrame:
    """Additive log-ratios of compositions: floored at epsilon, closed again, against the reference part."""
    floor = {d: F.greatest(F.col(d), F.lit(epsilon)) for d in dims}
    total = sum(floor.values(), F.lit(0.0))
    return parts.withColumns({f"alr_{d}": F.log((floor[d] / total) / (floor[reference] / total)) for d in dims if d != reference})


def inverse_alr(logs: DataFrame, dims: tuple[str, ...], reference: str) -> DataFrame:
    total = sum((F.exp(f"alr_{d}") for d in dims if d != reference), F.lit(1.0))
    return logs.withColumns({d: (F.lit(1.0) if d == reference else F.exp(f"alr_{d}")) / total for d in dims})


def landmark_warp(grid: DataFrame, observed: DataFrame, reference: DataFrame) -> DataFrame:
    """Piecewise-linear warps h_i(t): grid (t), observed (curve_id, k, at) and reference landmarks (k, at), ends included."""
    w, r = Window.partitionBy(CURVE).orderBy("k"), Window.partitionBy().orderBy("k")
    ref = reference.select("k", F.col("at").alias("r0"), F.lead("at").over(r).alias("r1"))
    obs = observed.select(CURVE, "k", F.col("at").alias("o0"), F.lead("at").over(w).alias("o1"))
    seg = obs.join(F.broadcast(ref), "k").where("r1 is not null")
    last = reference.agg(F.max("at").alias("m"))
    hit = seg.join(F.broadcast(grid.crossJoin(last)), (F.col("t") >= F.col("r0")) & ((F.col("t") < F.col("r1")) | ((F.col("t") == F.col("m")) & (F.col("r1") == F.col("m")))))
    return hit.select(CURVE, "t", (F.col("o0") + (F.col("o1") - F.col("o0")) * (F.col("t") - F.col("r0")) / (F.col("r1") - F.col("r0"))).alias("warped"))


def phase_summary(warps: DataFrame) -> DataFrame:
    d = F.col("warped") - F.col("t")
    return warps.groupBy(CURVE).agg(F.avg(F.abs(d)).alias("mean_abs_displacement"), F.max(F.abs(d)).alias("max_abs_displacement"), F.avg(d).alias("mean_displacement"))


def simplex_violations(parts: DataFrame, dims: tuple[str, ...], tolerance: float = 1e-7) -> DataFrame:
    """How many compositions have a negative part or don't sum to one (absolute tolerance, and 1e-5 relative): one row."""
    total = sum((F.col(d) for d in dims), F.lit(0.0))
    count = lambda c: F.count(F.when(c, 1))
    return parts.agg(F.count(F.lit(1)).alias("n_points"), count(F.least(*dims) < -tolerance).alias("negative"), count(F.abs(total - 1) > tolerance + 1e-5).alias("not_closed"))


def validate_simplex(parts: DataFrame, dims: tuple[str, ...], tolerance: float = 1e-7) -> None:
    v = simplex_violations(parts, dims, tolerance).first()
    if v.negative or v.not_closed:
        raise ValueError(f"{v.negative} compositions have a negative part, {v.not_closed} don't sum to one")


def validate_missing(samples: DataFrame, dims: tuple[str, ...], max_fraction: float) -> None:
    """Fails when a curve's share of samples with any missing dimension is over the tolerance."""
    missing = F.lit(False)
    for d in dims:
        missing = missing | F.col(d).isNull()
    bad = samples.groupBy(CURVE).agg(F.avg(missing.cast("double")).alias("share")).where(F.col("share") > max_fraction)
    found = [r[CURVE] for r in bad.orderBy(CURVE).limit(5).collect()]
    if found:
        raise ValueError(f"curves miss more than {max_fraction:g} of their samples: {found}")


def require_defined(samples: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """The samples, if no direction measure is undefined anywhere (speed at or below its bound); else an error."""
    bad = F.lit(False)
    for m in measures:
        bad = bad | F.col(m).isNull()
    if not samples.where(bad).isEmpty():
        raise ValueError(f"undefined: {', '.join(measures)}")
    return samples


def register(samples: DataFrame, warps: DataFrame, dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Curves resampled through their warps: value at grid time t is the curve's at h(t), by linear interpolation.

    ``warps`` has curve_id, t, warped.  Warped times and samples are put in one sorted stream per curve, as in ``resample_linear``.
    """
    points = warps.select(CURVE, F.col("warped").alias("s"), F.col("t").alias("grid_t"), *(F.lit(None).cast("double").alias(d) for d in dims), F.lit(0).alias("is_sample"))
    both = samples.select(CURVE, F.col("t").alias("s"), F.lit(None).cast("double").alias("grid_t"), *dims, F.lit(1).alias("is_sample")).unionByName(points)
    back = Window.partitionBy(CURVE).orderBy("s", F.desc("is_sample")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(CURVE).orderBy("s", "is_sample").rowsBetween(0, Window.unboundedFollowing)
    for d in dims:
        v = F.when((F.col("is_sample") == 1) & F.col(d).isNotNull(), F.struct(F.col("s").alias("t"), F.col(d).alias("v")))
        both = both.withColumn(f"_b{d}", F.last(v, True).over(back)).withColumn(f"_a{d}", F.first(v, True).over(ahead))
    w = Window.partitionBy(CURVE).orderBy("t")
    out = both.where("is_sample = 0").select(CURVE, F.col("grid_t").alias("t"), *(_blend(F.col(f"_b{d}"), F.col(f"_a{d}"), F.col("s"), None).alias(d) for d in dims))
    return out.withColumn("t_idx", F.row_number().over(w) - 1)


def phase_curves(warps: DataFrame, kind: str = "displacement") -> DataFrame:
    """Warps as curves of one dimension (curve_id, t_idx, t, x): the displacement h(t) - t, or h(t) itself."""
    w = Window.partitionBy(CURVE).orderBy("t")
    value = F.col("warped") - F.col("t") if kind == "displacement" else F.col("warped")
    return warps.select(CURVE, (F.row_number().over(w) - 1).alias("t_idx"), "t", value.alias("x"))


def landmark_frame(observed: DataFrame, reference: DataFrame) -> DataFrame:
    """Each curve's landmarks beside the reference's, with their shift."""
    return observed.join(F.broadcast(reference.select("k", F.col("at").alias("reference"))), "k").select(CURVE, "k", "at", "reference", (F.col("at") - F.col("reference")).alias("shift"))
