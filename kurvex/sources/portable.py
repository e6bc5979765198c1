"""Portable results: named tables as Parquet with a JSON manifest of schemas, row counts and digests, all through Spark's writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def digest(df: DataFrame) -> str:
    """Order-free digest of a table's rows."""
    h = F.xxhash64(*(F.to_json(F.struct(F.col(c).alias("v"))) for c in sorted(df.columns)))
    r = df.select(h.alias("h")).agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum((F.col("h") % 1_000_003).cast("long"))).first()
    return f"{r[0]}-{r[1] or 0}-{r[2] or 0}"


def export_result(tables: dict[str, DataFrame], path: str, provenance: dict | None = None) -> dict:
    """Writes every table and the manifest; non-finite numbers in the provenance are refused."""
    manifest = {"schema_version": SCHEMA_VERSION, "provenance": json.loads(json.dumps(provenance or {}, allow_nan=False)), "tables": {}}
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        back = spark.read.parquet(f"{path}/{name}")
        manifest["tables"][name] = {"schema": df.schema.simpleString(), "digest": digest(back)}
    if spark is not None:
        spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/_manifest_json")
    return manifest


def load_result(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables and manifest; a table that differs from its digest raises."""
    manifest = json.loads(spark.read.text(f"{path}/_manifest_json").first()[0])
    if manifest["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"schema version {manifest['schema_version']} isn't {SCHEMA_VERSION}")
    out = {}
    for name, m in manifest["tables"].items():
        out[name] = spark.read.parquet(f"{path}/{name}")
        if digest(out[name]) != m["digest"]:
            raise ValueError(f"table {name} doesn't match its manifest")
    return out, manifest
