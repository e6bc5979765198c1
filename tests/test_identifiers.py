"""Curves of two-part keys stay apart, and operators take ids of any type, with separators in them too."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kurvex.operators import decomposition as dec
from kurvex.operators import distances as dist
from kurvex.operators import geometry as geo
from kurvex.operators import mixed, neighbours, smoothing
from kurvex.operators import recurrence as rec
from kurvex.sources.curves import from_long

KEYS = [("a|b", "c"), ("a", "b|c"), ("a\\", "b"), ("a", "\\b"), ("a\\|b", "c"), ("é", ""), ("", "é")]


@pytest.fixture(scope="module")
def curves(spark):
    rng = np.random.default_rng(0)
    rows = [(p, q, i / 11, float(np.sin(i * 0.9 + k) + 0.3 * rng.normal()), float(np.cos(i + k))) for k, (p, q) in enumerate(KEYS) for i in range(12)]
    return from_long(spark.createDataFrame(rows, "p string, q string, t double, x double, y double"), curve_columns=["p", "q"], time_column="t", metadata_columns=["p"])


def test_keys_stay_apart(spark, curves):
    assert curves.curves.select("curve_id").distinct().count() == len(KEYS) and curves.samples.groupBy("curve_id").count().where("count <> 12").count() == 0
    nulls = spark.createDataFrame([("a", None, 0.0, 1.0), ("a", "\\N", 0.0, 1.0), ("a", None, 1.0, 1.0), ("a", "\\N", 1.0, 1.0)], "p string, q string, t double, x double")
    assert from_long(nulls, curve_columns=["p", "q"], time_column="t", value_columns=["x"], check=False).samples.select("curve_id").distinct().count() == 2


OPERATORS = {
    "resample_pchip": lambda s: smoothing.resample_pchip(s, np.linspace(0, 1, 5)),
    "resample_linear": lambda s: geo.resample_linear(s, geo.make_common_grid(geo.common_overlap_interval(s), 5), ("x",)),
    "smooth": lambda s: smoothing.smooth(s, ("x",), "savgol"),
    "surrogate_test": lambda s: smoothing.surrogate_test(s, ("x",), smoothing.time_reversal, 5),
    "kinematics": lambda s: geo.kinematics(s),
    "tortuosity": lambda s: geo.tortuosity(s),
    "sampling_summary": lambda s: geo.sampling_summary(s),
    "arrays": lambda s: dist.curve_arrays(s),
    "acf": lambda s: rec.autocorrelation(s, "x", 3),
    "ami": lambda s: rec.mutual_information(s, "x", 1),
    "rqa": lambda s: rec.rqa_metrics(s, rec.recurrence_pairs(s, ("x",), 0.5)),
    "network": lambda s: rec.network_nodes(s, rec.recurrence_pairs(s, ("x",), 0.5)),
    "components": lambda s: rec.network_components(s, rec.recurrence_pairs(s, ("x",), 0.5)),
    "neighbours": lambda s: neighbours.nearest_neighbours(s, ("x", "y"), 1),
    "radius": lambda s: neighbours.radius_for_rate(s, ("x", "y"), 0.2),
    "scores": lambda s: dec.scores(dist.curve_arrays(s), dec.fit_fpca(dist.curve_arrays(s), np.linspace(0, 1, 12), 2)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_take_such_ids(curves, name):
    out = OPERATORS[name](curves.samples)
    assert dict(out.dtypes)["curve_id"] == "string" and out.select("curve_id").distinct().count() == len(KEYS)


def test_groups_take_such_ids(curves):
    a = dist.curve_arrays(curves.samples).join(curves.curves, "curve_id")
    out = mixed.group_influence(a, "p", np.linspace(0, 1, 12), 1)
    assert dict(out.dtypes)["grp"] == "string" and out.count() == len({p for p, _ in KEYS}) and out.where("influence is null").count() == 0


def test_windows_of_a_band_are_the_same_in_all_curves(curves):
    w = rec.windowed_rqa(curves.samples, ("x",), 0.5, 4, 4)
    assert rec.metric_arrays(w, "recurrence_rate").where(F.size("values") != 3).count() == 0
    with pytest.raises(ValueError):
        rec.metric_arrays(w.where(~(F.col("curve_id").startswith("a") & (F.col("window_start") == 4))), "recurrence_rate")
