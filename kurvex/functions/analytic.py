"""Window and column building blocks shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def along(*keys: str, order: str = "t_idx") -> WindowSpec:
    """Rows of one curve in time order."""
    return Window.partitionBy(*keys).orderBy(order)


def gradient(value: Column, time: Column, w: WindowSpec) -> Column:
    """Second-order finite differences on a non-uniform grid, three-point and one-sided at both ends."""
    v1, v2, u1, u2 = F.lag(value, 1).over(w), F.lag(value, 2).over(w), F.lead(value, 1).over(w), F.lead(value, 2).over(w)
    s1, s2, r1, r2 = F.lag(time, 1).over(w), F.lag(time, 2).over(w), F.lead(time, 1).over(w), F.lead(time, 2).over(w)
    hb, hf = time - s1, r1 - time
    inner = (hb * hb * u1 + (hf * hf - hb * hb) * value - hf * hf * v1) / (hb * hf * (hb + hf))
    a, b = r1 - time, r2 - r1
    first = -(2 * a + b) / (a * (a + b)) * value + (a + b) / (a * b) * u1 - a / (b * (a + b)) * u2
    c, d = s1 - s2, time - s1
    last = d / (c * (c + d)) * v2 - (c + d) / (c * d) * v1 + (2 * d + c) / (d * (c + d)) * value
    return F.when(s1.isNull(), first).when(r1.isNull(), last).otherwise(inner)


def hypot(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def trapezoid_weight(time: Column, w: WindowSpec) -> Column:
    """Trapezoid quadrature weight of each grid point."""
    before, after = F.lag(time).over(w), F.lead(time).over(w)
    return (F.coalesce(after - time, F.lit(0.0)) + F.coalesce(time - before, F.lit(0.0))) / 2


def epanechnikov(u: Column) -> Column:
    return F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0)


def average_rank(value: Column, *keys: str) -> Column:
    """Average rank of ties within the keys."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / F.lit(2.0)


def finite(value: Column) -> Column:
    """NaN and infinities as NULL: missing values are NULL throughout."""
    v = value.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)
