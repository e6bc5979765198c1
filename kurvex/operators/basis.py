"""Projection of irregular and incomplete curves on a declared basis by least squares.

Every task adds up the normal equations of its own samples, so a curve travels as one small row per task however
many samples it has; curves are solved in batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamped_spline
from ..functions.sums import add_up, matrix

CURVE = "curve_id"
#: Largest condition of normal equations that are solved.
CONDITION = 1e12


def basis_values(t: np.ndarray, kind: str, size: int, domain: tuple[float, float], order: int = 4) -> np.ndarray:
    """(times, size): B-splines of an order with equally spaced knots, or the orthonormal Fourier basis 1, sin, cos, ... of the domain's period."""
    lo, hi = domain
    t = np.asarray(t, float)
    if kind == "bspline":
        return clamped_spline(t, size, order - 1, domain)
    length, out = hi - lo, np.empty((len(t), size))
    for k in range(size):
        phase = 2 * np.pi * ((k + 1) // 2) * (t - lo) / length
        out[:, k] = 1 / np.sqrt(length) if k == 0 else np.sqrt(2 / length) * (np.sin(phase) if k % 2 else np.cos(phase))
    return out


def _checked(kind: str, size: int, domain: tuple[float, float], order: int) -> None:
    if kind not in ("bspline", "fourier"):
        raise ValueError("the basis is bspline or fourier")
    if size < 2 or order < 1 or kind == "bspline" and size < order:
        raise ValueError("a basis has two functions or more, and no fewer than its order")
    if kind == "fourier" and size % 2 == 0:
        raise ValueError("a Fourier basis has an odd number of functions: the constant, and a sine and a cosine of each frequency")
    if not domain[0] < domain[1]:
        raise ValueError("the domain is an interval")


def project(samples: DataFrame, kind: str, size: int, domain: tuple[float, float], dim: str = "x", order: int = 4) -> DataFrame:
    """(curve_id, n, coefficients, rmse, failure): least squares of each curve's samples inside the domain.

    Missing values take no part, so curves may be irregular and incomplete.  A curve with fewer samples than functions
    (``too_few_samples``) or with equations that are as good as singular (``rank_deficient``) has no coefficients; it keeps its row, and
    so does one without any sample in the domain.
    """
    _checked(kind, size, domain, order)
    curve_kind = dict(samples.dtypes)[CURVE]
    v = F.col(dim).cast("double")
    rows = samples.where(v.isNotNull() & ~F.isnan(v) & F.col("t").between(*map(float, domain))).select(CURVE, F.col("t").cast("double").alias("t"), v.alias("v"))

    def sums(batches):
        for b in batches:
            if not len(b):
                continue
            code = b.column(0).dictionary_encode()
            own, y = np.asarray(code.indices), np.asarray(b.column(2))
            phi = basis_values(np.asarray(b.column(1)), kind, size, domain, order)
            parts = np.concatenate((np.einsum("np,nq->npq", phi, phi).reshape(len(phi), -1), phi * y[:, None], (y * y)[:, None]), 1)
            total = np.zeros((len(code.dictionary), parts.shape[1]))
            np.add.at(total, own, parts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * total.shape[1]), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([code.dictionary, pa.array(np.bincount(own, minlength=len(total)).astype(float)), lists], [CURVE, "n", "s"])

    total = add_up(rows.mapInArrow(sums, f"{CURVE} {curve_kind}, n double, s array<double>"), [CURVE])

    def solve(batches):
        for b in batches:
            n, s = np.asarray(b.column(1)), matrix(b.column(2))
            g, r = s[:, : size * size].reshape(-1, size, size), s[:, size * size : -1]
            value = np.linalg.eigvalsh(g)
            few, singular = n < size, value[:, 0] * CONDITION <= value[:, -1]
            good = ~few & ~singular
            c = np.zeros((len(n), size))
            c[good] = np.linalg.solve(g[good], r[good][:, :, None])[:, :, 0]
            rest = s[:, -1] - 2 * (c * r).sum(1) + np.einsum("ni,nij,nj->n", c, g, c)
            keep = lambda x: [v if ok else None for v, ok in zip(x.tolist(), good, strict=True)]
            failure = ["too_few_samples" if f else "rank_deficient" if d else None for f, d in zip(few, singular, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), pa.array(keep(c), pa.list_(pa.float64())), pa.array(keep(np.sqrt(np.maximum(rest, 0) / np.maximum(n, 1))), pa.float64()), pa.array(failure, pa.string())], [CURVE, "n", "coefficients", "rmse", "failure"])

    solved = total.mapInArrow(solve, f"{CURVE} {curve_kind}, n long, coefficients array<double>, rmse double, failure string")
    every = samples.select(CURVE).distinct().join(solved, CURVE, "left")
    none = F.col("n").isNull()
    return every.select(CURVE, F.coalesce("n", F.lit(0)).alias("n"), "coefficients", "rmse", F.when(none, F.lit("too_few_samples")).otherwise(F.col("failure")).alias("failure"))


def evaluate(projected: DataFrame, time: np.ndarray, kind: str, domain: tuple[float, float], order: int = 4) -> DataFrame:
    """(curve_id, values) of the projections at declared times inside the domain; curves without coefficients have none."""
    time = np.asarray(time, float)
    if (time < domain[0]).any() or (time > domain[1]).any():
        raise ValueError("times lie outside the domain")

    def run(batches):
        for b in batches:
            if len(b):
                c = matrix(b.column(1))
                values = c @ basis_values(time, kind, c.shape[1], domain, order).T
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.tolist(), pa.list_(pa.float64()))], [CURVE, "values"])

    return projected.where("failure is null").select(CURVE, "coefficients").mapInArrow(run, f"{CURVE} {dict(projected.dtypes)[CURVE]}, values array<double>")
