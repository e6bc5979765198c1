"""Sums of vectors and Gram matrices over tasks: partial sums in every task, two shuffles, one row per key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numeric import draws

#: Partial sums of one key are spread over so many groups before their last sum.
FAN = 32
#: Bytes of partial sums that a task holds before it sends them on.
HELD = 64 << 20


def add_up(parts: DataFrame, keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row per key: every other column (numbers, arrays element by element) summed over the rows."""
    kinds = dict(parts.dtypes)
    keys = list(keys)
    sums = [c for c in parts.columns if c not in keys]
    lists = {c for c in sums if kinds[c].startswith("array")}

    def adder(names: list[str]):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            out = dict(zip(names, key, strict=True))
            cols = {}
            for c in sums:
                col = table.column(c).combine_chunks()
                cols[c] = pa.array([np.asarray(col.flatten(), float).reshape(len(col), -1).sum(0).tolist()], pa.list_(pa.float64())) if c in lists else pa.compute.sum(col).cast(col.type).as_py()
            keyed = {k: pa.array([v.as_py()], v.type) for k, v in out.items() if k in keys}
            return pa.table(keyed | {c: v if isinstance(v, pa.Array) else pa.array([v], table.column(c).type) for c, v in cols.items()})

        return run

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, *sums])
    spread = parts.withColumn("_spread", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    half = spread.groupBy(*keys, "_spread").applyInArrow(adder([*keys, "_spread"]), schema)
    whole = half if keys else half.withColumn("_spread", F.lit(0))
    return whole.groupBy(*(keys or ["_spread"])).applyInArrow(adder(keys or ["_spread"]), schema)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column as a matrix."""
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def vector(*parts):
    """One array column of a leading 1 and the given columns, arrays or numbers, in order."""
    cols = [p if not isinstance(p, str) else F.col(p) for p in parts]
    return F.concat(F.array(F.lit(1.0)), *cols)


def scalars(*columns: str):
    """Numbers as one array column."""
    return F.array(*(F.col(c).cast("double") for c in columns))


def grams(rows: DataFrame, column, key=None) -> DataFrame:
    """(key, gram): Gram matrices (flattened) of an array column's rows, of all rows or for each value of ``key`` (a long column)."""
    data = rows.select((F.lit(0) if key is None else key).cast("long").alias("key"), column.alias("v")).where("v is not null")

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            k, m = np.asarray(b.column(0)), matrix(b.column(1))
            for x in np.unique(k):
                part = m[k == x]
                held[x] = held.get(x, 0.0) + part.T @ part
            if held and len(held) * next(iter(held.values())).nbytes > HELD:
                yield _gram_batch(held)
                held = {}
        if held:
            yield _gram_batch(held)

    return add_up(data.mapInArrow(run, "key long, gram array<double>"), ["key"])


def _gram_batch(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([g.ravel().tolist() for g in held.values()], pa.list_(pa.float64()))], ["key", "gram"])


def gram(rows: DataFrame, column) -> np.ndarray:
    """The Gram matrix of all rows: one row of vector length squared reaches the driver."""
    r = grams(rows, column).first()
    if r is None:
        raise ValueError("there are no rows")
    p = int(round(len(r.gram) ** 0.5))
    return np.asarray(r.gram).reshape(p, p)


def replicate_grams(rows: DataFrame, column, unit, replicates: int, seed: int = 0) -> DataFrame:
    """(rep, gram): Gram matrices with Poisson bootstrap counts of ``unit`` (whole units: a participant with all their curves).

    Counts are a function of unit, replicate and seed, so the data are read once and never copied.
    """
    data = rows.select(F.xxhash64(unit).alias("u"), column.alias("v")).where("v is not null")

    def run(batches):
        total = None
        for b in batches:
            w, m = draws(np.asarray(b.column(0)), replicates, seed, "poisson"), matrix(b.column(1))
            if total is None:
                total = np.zeros((replicates, m.shape[1], m.shape[1]))
            for r in range(replicates):
                k = w[:, r] > 0
                part = m[k]
                total[r] += (part * w[k, r, None]).T @ part
        if total is not None:
            for r in range(replicates):
                yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([total[r].ravel().tolist()], pa.list_(pa.float64()))], ["rep", "gram"])

    return add_up(data.mapInArrow(run, "rep long, gram array<double>"), ["rep"])


def wild_sums(rows: DataFrame, left, right, unit, replicates: int, kind: str, seed: int = 0) -> np.ndarray:
    """Sums of multiplier * left x right (replicates x left x right) over the rows, by reproducible multipliers of ``unit``."""
    data = rows.select(F.xxhash64(unit).alias("u"), left.alias("a"), right.alias("b"))

    def run(batches):
        total = 0.0
        for b in batches:
            w, x, y = draws(np.asarray(b.column(0)), replicates, seed, kind), matrix(b.column(1)), matrix(b.column(2))
            total = total + np.einsum("nr,np,nq->rpq", w, x, y, optimize=True)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.shape[1]]), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["p", "s"])

    parts = data.mapInArrow(run, "p long, s array<double>")
    r = add_up(parts, ["p"]).first()
    return np.asarray(r.s).reshape(replicates, r.p, -1)
