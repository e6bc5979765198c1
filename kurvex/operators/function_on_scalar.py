"""Curves as responses: pointwise least squares on several predictors, robust errors, wild bootstrap and simultaneous bands."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import simultaneous
from ..functions.sums import add_up, gram, matrix, scalars, wild_sums


@dataclass(frozen=True)
class ResponseFit:
    """Coefficient functions (coefficients x places), HC1 standard errors, (X'X)^-1, number of units and names."""

    beta: np.ndarray
    se: np.ndarray
    inverse: np.ndarray
    n: int
    names: tuple[str, ...]


def design(arrays: DataFrame, predictors: list[str], unit: str | None = None) -> DataFrame:
    """Rows (unit, x: 1 and the predictors, values); with ``unit`` the means of its curves, whose predictors mustn't vary."""
    x = F.concat(F.array(F.lit(1.0)), scalars(*predictors))
    rows = arrays.select(F.xxhash64(unit or "curve_id").alias("unit"), x.alias("x"), "values").where(F.forall("x", lambda v: v.isNotNull()))
    if unit is None:
        return rows
    varying = arrays.groupBy(unit).agg(*(F.countDistinct(p).alias(p) for p in predictors)).where(" or ".join(f"`{p}` > 1" for p in predictors))
    if not varying.isEmpty():
        raise ValueError("a predictor varies within a unit")
    sums = add_up(rows.withColumn("n", F.lit(1.0)), ["unit"])
    mean = lambda c: F.transform(c, lambda v: v / F.col("n"))
    return sums.select("unit", mean("x").alias("x"), mean("values").alias("values"))


def fit(rows: DataFrame, names: list[str]) -> ResponseFit:
    """Least squares of every place on the shared design, with HC1 errors from whole-function residuals: two passes."""
    q = len(names) + 1
    g = gram(rows, F.concat("x", "values"))
    n = g[0, 0]
    if n <= q or np.linalg.matrix_rank(g[:q, :q]) < q:
        raise ValueError("the design is rank deficient")
    inverse = np.linalg.inv(g[:q, :q])
    beta = inverse @ g[:q, q:]

    def run(batches):
        total = 0.0
        for b in batches:
            x, y = matrix(b.column(0)), matrix(b.column(1))
            total = total + ((x @ inverse) ** 2).T @ (y - x @ beta) ** 2
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["s"])

    s = np.asarray(add_up(rows.select("x", "values").mapInArrow(run, "s array<double>")).first().s).reshape(q, -1)
    return ResponseFit(beta, np.sqrt(n / (n - q) * s), inverse, int(round(n)), ("intercept", *names))


def bootstrap(rows: DataFrame, model: ResponseFit, replicates: int = 500, multiplier: str = "rademacher", seed: int = 0) -> np.ndarray:
    """Coefficient functions of wild replicates (replicates x coefficients x places): whole residual functions share their unit's draw."""
    q = len(model.names)

    def less(residual, k: int):
        """What is left of the values without one predictor times its coefficient function."""
        return F.zip_with(residual, F.array(*(F.lit(float(v)) for v in model.beta[k])), lambda a, b: a - F.col("x")[k] * b)

    residual = F.col("values")
    for k in range(q):
        residual = less(residual, k)
    s = wild_sums(rows.withColumn("e", residual), F.col("x"), F.col("e"), "unit", replicates, multiplier, seed)
    return model.beta + model.inverse @ s


def coefficient_frame(spark: SparkSession, model: ResponseFit, draws: np.ndarray | None = None, level: float = 0.95, scope: str = "each") -> DataFrame:
    """One row per coefficient and place: estimate, se and, with ``draws``, the simultaneous band (of each coefficient or the family)."""
    rows, c = [], None
    if draws is not None:
        c = simultaneous(draws, model.beta, model.se, level, scope)
    for k, name in enumerate(model.names):
        for i, (b, s) in enumerate(zip(model.beta[k], model.se[k], strict=True)):
            half = float(c[k] * s) if c is not None else None
            rows.append((name, i, float(b), float(s), None if c is None else float(c[k]), None if half is None else float(b) - half, None if half is None else float(b) + half))
    return spark.createDataFrame(rows, "coefficient string, place int, estimate double, se double, critical double, lower double, upper double")


def fitted(rows: DataFrame, model: ResponseFit) -> DataFrame:
    """Fitted and residual functions of every unit."""

    def run(batches):
        for b in batches:
            if len(b):
                y = matrix(b.column(1)) @ model.beta
                lists = lambda m: pa.array(m.tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists(y), lists(matrix(b.column(2)) - y)], ["unit", "fitted", "residual"])

    return rows.select("unit", "x", "values").mapInArrow(run, "unit long, fitted array<double>, residual array<double>")
