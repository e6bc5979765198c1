"""Projections against dense least squares, on irregular and incomplete curves; what has no projection keeps its row."""

import numpy as np
import pytest

from kurvex.operators import basis as ba

DOMAIN = (1.0, 4.0)


def data(rng):
    out = {}
    for c in range(7):
        t = np.sort(rng.uniform(0.5, 4.5, 40 if c < 5 else 6))
        v = np.sin(2 * t) + c + 0.1 * rng.normal(size=len(t))
        v[rng.random(len(t)) < 0.15] = np.nan
        out[f"c|{c}"] = (t, v)
    out["one time"] = (np.full(30, 2.0) + 1e-12 * np.arange(30), np.arange(30.0))
    out["outside"] = (np.array([9.0, 10.0]), np.array([1.0, 2.0]))
    return out


def frame(spark, curves):
    rows = [(k, i, float(a), None if np.isnan(b) else float(b)) for k, (t, v) in curves.items() for i, (a, b) in enumerate(zip(t, v, strict=True))]
    return spark.createDataFrame(rows, "curve_id string, t_idx int, t double, x double").repartition(4)


@pytest.mark.parametrize(("kind", "size"), [("fourier", 5), ("bspline", 7)])
def test_least_squares(spark, kind, size):
    curves = data(np.random.default_rng(0))
    projected = ba.project(frame(spark, curves), kind, size, DOMAIN)
    got = {r.curve_id: r for r in projected.collect()}
    grid = np.linspace(*DOMAIN, 9)
    values = {r.curve_id: r["values"] for r in ba.evaluate(projected, grid, kind, DOMAIN).collect()}
    for k, (t, v) in curves.items():
        ok = ~np.isnan(v) & (t >= DOMAIN[0]) & (t <= DOMAIN[1])
        phi = ba.basis_values(t[ok], kind, size, DOMAIN)
        if ok.sum() < size or np.linalg.matrix_rank(phi) < size:
            assert got[k].coefficients is None and got[k].failure == ("too_few_samples" if ok.sum() < size else "rank_deficient") and k not in values
            continue
        c, *_ = np.linalg.lstsq(phi, v[ok], rcond=None)
        assert got[k].n == ok.sum() and np.allclose(got[k].coefficients, c, atol=1e-6) and np.isclose(got[k].rmse, np.sqrt(np.mean((phi @ c - v[ok]) ** 2)), atol=1e-6)
        assert np.allclose(values[k], ba.basis_values(grid, kind, size, DOMAIN) @ c, atol=1e-6)
    assert got["one time"].failure == "rank_deficient" and got["outside"].n == 0 and len(got) == len(curves)


def test_bases():
    t = np.linspace(*DOMAIN, 2001)
    f = ba.basis_values(t, "fourier", 5, DOMAIN)
    assert np.allclose(np.trapezoid(f[:, :, None] * f[:, None], t, axis=0), np.eye(5), atol=1e-6)
    b = ba.basis_values(t, "bspline", 6, DOMAIN)
    assert np.allclose(b.sum(1), 1) and (b >= 0).all()


@pytest.mark.parametrize("how", [("wavelet", 5, DOMAIN), ("fourier", 4, DOMAIN), ("bspline", 3, DOMAIN), ("fourier", 1, DOMAIN), ("fourier", 5, (2.0, 2.0))])
def test_contracts(spark, how):
    with pytest.raises(ValueError):
        ba.project(spark.createDataFrame([("c", 0, 1.0, 1.0)], "curve_id string, t_idx int, t double, x double"), *how)
