"""Curve tables from long tables: explicit columns, checked contracts, no repair and no inference.

``samples`` has curve_id, t_idx (0-based place in time), t (double) and one column per dimension;
missing values are NULL.  A violated contract raises ``ContractError`` with a code.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.analytic import finite


class ContractError(ValueError):
    """A declared property of the input doesn't hold."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class CurveSet:
    """Samples, one metadata row per curve, the dimensions and what was declared and done."""

    samples: DataFrame
    curves: DataFrame
    dimensions: tuple[str, ...]
    common_grid: bool
    coordinate_system: str = "unknown"
    time_unit: str = "unknown"
    provenance: dict = field(default_factory=dict)

    def noting(self, samples: DataFrame, **what) -> CurveSet:
        return CurveSet(samples, self.curves, what.pop("dimensions", self.dimensions), what.pop("common_grid", self.common_grid), self.coordinate_system, what.pop("time_unit", self.time_unit), self.provenance | what)


def curve_key(columns: Sequence[str]) -> Column:
    """One column as it is; several as a string, joined by ``|``, in which ``\\`` stands before each ``|`` and ``\\`` of a part."""
    if len(columns) == 1:
        return F.col(columns[0])
    part = lambda c: F.coalesce(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\\N"))
    return F.concat_ws("|", *map(part, columns))


def _indexed(data: DataFrame, curve_columns: Sequence[str], time_column: str, value_columns: Sequence[str]) -> DataFrame:
    key = curve_key(curve_columns)
    rows = data.select(key.alias("curve_id"), F.col(time_column).cast("double").alias("t"), *(finite(F.col(c)).alias(c) for c in value_columns))
    return rows.withColumn("t_idx", F.row_number().over(Window.partitionBy("curve_id").orderBy("t")) - 1)


def from_long(data: DataFrame, *, curve_columns: Sequence[str], time_column: str, value_columns: Sequence[str] = ("x", "y"), metadata_columns: Sequence[str] = (), require_common_grid: bool = True, min_samples: int = 2, coordinate_system: str = "unknown", time_unit: str = "unknown", check: bool = True) -> CurveSet:
    """A curve set; with ``require_common_grid`` all curves must share their times, otherwise they keep their own."""
    missing = [c for c in [*curve_columns, time_column, *value_columns, *metadata_columns] if c not in data.columns]
    if missing:
        raise ContractError("missing_columns", str(missing))
    samples = _indexed(data, curve_columns, time_column, value_columns)
    key = curve_key(curve_columns)
    curves = data.select(key.alias("curve_id"), *metadata_columns).distinct()
    if check:
        bad_key = F.lit(False)
        for c in [*curve_columns, time_column]:
            bad_key = bad_key | F.col(c).isNull()
        if not data.where(bad_key).isEmpty():
            raise ContractError("null_keys", "curve or time columns hold nulls")
        per = samples.groupBy("curve_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("k"), F.xxhash64(F.sort_array(F.collect_list("t"))).alias("grid"))
        seen = per.agg(F.min("n"), F.max(F.col("n") - F.col("k")), F.countDistinct("grid"), F.count(F.lit(1))).first()
        if seen[3] == 0:
            raise ContractError("empty", "there are no curves")
        if seen[0] < min_samples:
            raise ContractError("too_few_samples", f"a curve has fewer than {min_samples} samples")
        if seen[1]:
            raise ContractError("duplicate_time", "a curve has two samples of one time")
        if require_common_grid and seen[2] > 1:
            raise ContractError("no_common_grid", "curves differ in their times")
        if curves.count() != seen[3]:
            raise ContractError("varying_metadata", "metadata vary within a curve")
    return CurveSet(samples, curves, tuple(value_columns), require_common_grid, coordinate_system, time_unit, {"interpolated": False, "imputed": False, "smoothed": False})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as irregular planar curves: one per user, t in hours from the user's first event, x = value, y = props.k."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "value", "event_type", F.get_json_object("props", "$.k").cast("double").alias("y"))
    w = Window.partitionBy("user_id").orderBy("ts")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    first = F.first(micros).over(w)
    code = F.expr("array_position(array('click', 'error', 'purchase', 'signup', 'view'), event_type) - 1").cast("int")
    return e.select(F.col("user_id").alias("curve_id"), (F.row_number().over(w) - 1).alias("t_idx"), ((micros - first) / F.lit(3.6e9)).alias("t"), F.col("value").alias("x"), "y", code.alias("state"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("observed"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as common-grid curves of one dimension: 64 samples at t = 0..1, the label as participant."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e = v.select(F.col("vec_id").alias("curve_id"), F.col("label").alias("participant"), F.posexplode("embedding").alias("t_idx", "v"))
    return e.select("curve_id", "participant", "t_idx", (F.col("t_idx") / F.lit(63.0)).alias("t"), F.col("v").cast("double").alias("x"))
