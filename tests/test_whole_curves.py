"""Registered curve queries use all samples and return all curves."""

import pytest

from kurvex.plans import catalog

D = "/root/testdata/sf0.001"


def test_grids_span_all_samples(spark, monkeypatch):
    from kurvex.operators import sparse_fit

    last, grids = catalog.events(spark, D).agg({"t": "max"}).first()[0], []
    fit = sparse_fit.fit
    monkeypatch.setattr(sparse_fit, "fit", lambda e, g, *rest, **more: (grids.append(g), fit(e, g, *rest, **more))[1])
    out = catalog.pace_scores(spark, D).toPandas()
    assert grids[0][-1] == last and out.notna().all().all() and set(out.curve_id) == {r.curve_id for r in catalog.events(spark, D).select("curve_id").distinct().collect()}
    assert catalog.resample_pchip(spark, D).agg({"t": "max"}).first()[0] == pytest.approx(last)


def test_every_curve_has_an_anomaly_p_value(spark):
    ids = [r.curve_id for r in catalog.embeddings(spark, D).select("curve_id").distinct().collect()]
    got = catalog.fpca_conformal_anomaly(spark, D).collect()
    assert sorted(r.curve_id for r in got) == sorted(ids) and all(0 < r.p_value <= 1 for r in got)


def test_plot_data_has_all_groups(spark):
    from kurvex.plans import workflows

    t = spark.createDataFrame([(float(i), 1.0, None if i == 30 else f"g{i}") for i in range(31)], "x double, y double, g string")
    assert workflows.plot_data(t, "x", "y", "g").count() == 31 and workflows.plot_data(t, "x", "y", "g", 5).count() == 5
