"""Transfer entropy of coded state sequences: plug-in counts by window functions, shifts by index arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analytic import along

CURVE = "curve_id"


def _history(col: str, k: int, first: int) -> list:
    w = along(CURVE)
    return [F.lag(col, first + h).over(w) for h in range(k)]


def local_transfer_entropy(states: DataFrame, target_history: int, source_history: int, source_lag: int, condition_history: int = 0, condition_lag: int = 1, keys: Sequence[str] = (CURVE,)) -> DataFrame:
    """Local terms log2(p(x|y,z)/p(x|y)) of (curve_id, t_idx, source, target[, condition]); histories start ``lag`` steps back.

    Rows whose histories aren't complete have no term.
    """
    w = Window.partitionBy(*keys).orderBy("t_idx")
    lagged = lambda c, k, first: F.array(*(F.lag(c, first + h).over(w) for h in range(k)))
    s = states.select(*keys, "t_idx", F.col("target").alias("x"), lagged("target", target_history, 1).alias("y"), lagged("source", source_history, source_lag).alias("z"), *([lagged("condition", condition_history, condition_lag).alias("c")] if condition_history else []))
    past = ["y", "c"] if condition_history else ["y"]
    complete = [F.forall(c, lambda v: v.isNotNull()) for c in [*past, "z"]]
    for c in complete:
        s = s.where(c)
    n = lambda *cols: F.count(F.lit(1)).over(Window.partitionBy(*keys, *cols))
    return s.withColumn("local", F.log2(n("x", *past, "z") * n(*past) / (n(*past, "z") * n("x", *past))))


def transfer_entropy(states: DataFrame, *args, keys: Sequence[str] = (CURVE,), **kwargs) -> DataFrame:
    """Mean local term in bits and number of terms per curve."""
    local = local_transfer_entropy(states, *args, keys=keys, **kwargs)
    return local.groupBy(*keys).agg(F.avg("local").alias("transfer_entropy"), F.count(F.lit(1)).alias("n_terms"))


def shifted(states: DataFrame, shifts: Sequence[int]) -> DataFrame:
    """The source rolled circularly by each shift; the target (and condition) stay."""
    n = F.count(F.lit(1)).over(Window.partitionBy(CURVE))
    s = states.withColumn("n", n).select("*", F.explode(F.array(*map(F.lit, shifts))).alias("shift"))
    source = s.select(CURVE, "shift", F.pmod(F.col("t_idx") + F.col("shift"), F.col("n")).alias("t_idx"), "source")
    return s.drop("source", "n").join(source, [CURVE, "shift", "t_idx"])


def circular_shift_test(states: DataFrame, shifts: Sequence[int], *args, **kwargs) -> DataFrame:
    """Plus-one upper-tail p-value of the observed transfer entropy against circular shifts of the source."""
    observed = transfer_entropy(states, *args, **kwargs).select(CURVE, F.col("transfer_entropy").alias("observed"))
    null = transfer_entropy(shifted(states, shifts), *args, keys=(CURVE, "shift"), **kwargs)
    tail = null.join(observed, CURVE).groupBy(CURVE, "observed").agg(F.count(F.when(F.col("transfer_entropy") >= F.col("observed") - 1e-12, 1)).alias("k"), F.count(F.lit(1)).alias("n_shifts"))
    return tail.select(CURVE, "observed", "n_shifts", ((1 + F.col("k")) / (1 + F.col("n_shifts"))).alias("p_value"))


def parameter_sensitivity(states: DataFrame, target_histories: Sequence[int], source_histories: Sequence[int], source_lags: Sequence[int]) -> DataFrame:
    """Transfer entropy over the declared grid of histories and lags."""
    out = None
    for k in target_histories:
        for l in source_histories:
            for lag in source_lags:
                te = transfer_entropy(states, k, l, lag).select(CURVE, F.lit(k).alias("target_history"), F.lit(l).alias("source_history"), F.lit(lag).alias("source_lag"), "transfer_entropy", "n_terms")
                out = te if out is None else out.unionByName(te)
    return out
