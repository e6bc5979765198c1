"""Observation process: candidate samples with a 0/1 flag, history, risk sets, support and associations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analytic import along, average_rank

CURVE = "curve_id"


def longest_missing_runs(process: DataFrame) -> DataFrame:
    """Per curve: candidates, observed ones and the longest run of unobserved ones."""
    run = F.col("t_idx") - F.row_number().over(Window.partitionBy(CURVE, "observed").orderBy("t_idx"))
    runs = process.withColumn("run", run).groupBy(CURVE, "observed", "run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(CURVE).agg(F.sum("n").alias("n_candidates"), F.sum(F.when(F.col("observed") == 1, F.col("n")).otherwise(0)).alias("n_observed"), F.coalesce(F.max(F.when(F.col("observed") == 0, F.col("n"))), F.lit(0)).alias("longest_missing"))


def history_state(process: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Past-only predictors: the last observed value of each dim, steps since it, and whether the step before was observed."""
    past = along(CURVE).rowsBetween(Window.unboundedPreceding, -1)
    out = process.withColumns({f"last_{d}": F.last(F.when(F.col("observed") == 1, F.col(d)), True).over(past) for d in dims})
    seen = F.last(F.when(F.col("observed") == 1, F.col("t_idx")), True).over(past)
    return out.withColumn("since_observed", F.col("t_idx") - seen).withColumn("previous_observed", F.lag("observed").over(along(CURVE)))


def risk_set(process: DataFrame, kind: str = "previous_observed") -> DataFrame:
    """All candidates, or those whose predecessor was observed."""
    return process if kind == "all_candidates" else process.withColumn("_p", F.lag("observed").over(along(CURVE))).where("_p = 1").drop("_p")


def time_bin_support(process: DataFrame, edges: list[float]) -> DataFrame:
    """Candidates, observed ones and curves in right-closed time bins, the first bin with its left edge."""
    b = F.lit(None).cast("int")
    for k in range(len(edges) - 1, 0, -1):
        b = F.when(F.col("t") <= edges[k], k - 1).otherwise(b)
    rows = process.withColumn("bin", F.when(F.col("t") >= edges[0], b)).where("bin is not null")
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n_candidates"), F.sum("observed").alias("n_observed"), F.countDistinct(CURVE).alias("n_curves"))


def standardized_difference(process: DataFrame, predictor: str) -> DataFrame:
    """Difference of the predictor's means between observed and unobserved candidates over the pooled deviation."""
    on, off = F.col("observed") == 1, F.col("observed") == 0
    p = F.col(predictor)
    a = process.agg(F.avg(F.when(on, p)).alias("m1"), F.avg(F.when(off, p)).alias("m0"), F.var_samp(F.when(on, p)).alias("v1"), F.var_samp(F.when(off, p)).alias("v0"))
    sd = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    return a.select("m1", "m0", F.when(sd > 0, (F.col("m1") - F.col("m0")) / sd).alias("smd"))


def spearman_association(process: DataFrame, predictor: str) -> DataFrame:
    """Per curve: correlation of the predictor's average ranks with the observed flag."""
    ranked = process.withColumn("_r", average_rank(F.col(predictor), CURVE))
    return ranked.groupBy(CURVE).agg(F.corr("_r", F.col("observed").cast("double")).alias("association"))
