"""Structured Streaming over event curves: watermarked sliding summaries, session curves, and the last observed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding_summary(stream: DataFrame, window: str = "1 hour", slide: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Samples, mean and range of each curve (curve_id, ts, x) in sliding windows; rows later than the watermark are left out."""
    return stream.withWatermark("ts", late).groupBy("curve_id", F.window("ts", window, slide)).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"), (F.max("x") - F.min("x")).alias("range_x"))


def session_curves(stream: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Each run of samples without a pause over ``gap`` as a curve of its own."""
    return stream.withWatermark("ts", late).groupBy("curve_id", F.session_window("ts", gap).alias("session")).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"))


def last_observed(stream: DataFrame, late: str = "2 hours", forget_hours: float = 24.0) -> DataFrame:
    """For every row the last value seen before it on its curve and the samples so far (state: three numbers a curve).

    A trigger's rows are taken in time order.  A row that is older than one already seen has no known predecessor: last_x and
    seen are NULL, and the state stays.  A curve that is quiet for ``forget_hours`` of event time is forgotten.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last, newest = state.get if state.exists else (0, None, None)
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts, x in rows[["ts", "x"]].itertuples(index=False):
            at = int(ts.timestamp() * 1000)
            if newest is not None and at < newest:
                out.append((key[0], ts, x, None, None))
                continue
            out.append((key[0], ts, x, last, n))
            n, newest = n + 1, at
            last = x if pd.notna(x) else last
        state.update((n, last, newest))
        if newest is not None:
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + int(forget_hours * 3_600_000) + 1)
        yield pd.DataFrame(out, columns=["curve_id", "ts", "x", "last_x", "seen"]).astype({"seen": "Int64"})

    rows = stream.select("curve_id", F.col("ts").cast("timestamp").alias("ts"), "x").where("ts is not null").withWatermark("ts", late)
    return rows.groupBy("curve_id").applyInPandasWithState(step, "curve_id long, ts timestamp, x double, last_x double, seen long", "n long, last double, newest long", "append", GroupStateTimeout.EventTimeTimeout)
