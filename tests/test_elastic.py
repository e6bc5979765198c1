"""Elastic alignment: warps against all chains on tiny grids, re-timed curves, rotations, components of known shapes."""

import numpy as np
import pytest

from kurvex.operators import elastic as el

T = np.linspace(0, 1, 41)


def chains(n, moves):
    """All chains of moves from (0, 0) to (n, n)."""
    out, open_ = [], [[(0, 0)]]
    while open_:
        c = open_.pop()
        if c[-1] == (n, n):
            out.append(c)
            continue
        open_ += [[*c, (c[-1][0] + k, c[-1][1] + m)] for k, m in moves if c[-1][0] + k <= n and c[-1][1] + m <= n]
    return out


def cost_of(chain, mean, q, lam):
    n, total = len(mean) - 1, 0.0
    for (i, j), (a, b) in zip(chain, chain[1:], strict=False):
        k, m = a - i, b - j
        for s in range(k + 1):
            at = j + s * m / k
            value = np.array([np.interp(at, np.arange(n + 1), q[:, d]) for d in range(q.shape[1])])
            total += (0.5 if s in (0, k) else 1) / n * ((mean[i + s] - np.sqrt(m / k) * value) ** 2).sum()
        total += lam * k / n * (1 - np.sqrt(m / k)) ** 2
    return total


@pytest.mark.parametrize("lam", [0.0, 0.3])
def test_warps_are_the_best_chains(lam):
    rng = np.random.default_rng(1)
    mean, q = rng.normal(size=(6, 2)), rng.normal(size=(5, 6, 2))
    warps, cost = el.align(mean, q, lam, 3)
    every = chains(5, el.steps(3))
    for c in range(5):
        best = min(every, key=lambda x: cost_of(x, mean, q[c], lam))
        assert np.isclose(cost[c], cost_of(best, mean, q[c], lam))
        knots = np.array(best) / 5
        assert np.allclose(warps[c], np.interp(np.linspace(0, 1, 6), knots[:, 0], knots[:, 1]))


def shapes(n, seed=0):
    rng = np.random.default_rng(seed)
    size = 1 + 0.4 * rng.normal(size=n)
    power = np.exp(0.3 * rng.normal(size=n))
    u = T[None] ** power[:, None]
    return size, power, np.stack((u * 3, size[:, None] * np.sin(2 * np.pi * u)), 2)


def frame(spark, curves):
    return spark.createDataFrame([(f"c|{i}", [float(v) for v in c.ravel()]) for i, c in enumerate(curves)], "curve_id string, values array<double>").repartition(3)


def test_a_retimed_curve_aligns_to_itself():
    _, _, x = shapes(1)
    still = np.stack((T * 3, np.sin(2 * np.pi * T)), 1)[None]
    moved = np.stack((T**1.5 * 3, np.sin(2 * np.pi * T**1.5)), 1)[None]
    q, r = (el.square_root_velocity(c, T) for c in (still, moved))
    warps, cost = el.align(q[0], r)
    assert cost[0] < 0.02 * ((q - r) ** 2).sum() / 40 and np.abs(el.at_warp(moved, warps) - still).max() < 0.12


def test_components_are_of_shape_not_of_timing(spark):
    size, power, x = shapes(60)
    rows = frame(spark, x)
    fit = el.fit_elastic_fpca(rows, T, 2, rounds=30, tolerance=1e-4)
    out = {r.curve_id: r for r in el.elastic_scores(rows, fit).collect()}
    first = np.array([out[f"c|{i}"].scores[0] for i in range(60)])
    half = np.array([out[f"c|{i}"].warp[20] for i in range(60)])
    assert len(out) == 60 and fit.components.ratio[0] > 0.8 and abs(np.corrcoef(first, size)[0, 1]) > 0.98
    assert abs(np.corrcoef(half, 0.5 ** (1 / power))[0, 1]) > 0.95 and abs(np.mean(half) - 0.5) < 0.06  # warps are centred
    plain = np.stack([c.ravel() for c in x]).reshape(60, 41, 2)
    aligned = np.stack([np.asarray(out[f"c|{i}"].aligned).reshape(41, 2) for i in range(60)])
    assert aligned[:, :, 0].std(0).mean() < 0.3 * plain[:, :, 0].std(0).mean()


def test_rotation_and_scale(spark):
    _, _, x = shapes(30)
    angle = np.random.default_rng(4).uniform(-0.5, 0.5, 30)
    turn = np.stack([np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]) for a in angle])
    turned = np.einsum("bij,btj->bti", turn, x) * np.random.default_rng(5).uniform(0.5, 2, 30)[:, None, None]
    kept = el.fit_elastic_fpca(frame(spark, turned), T, 1, rounds=40, tolerance=0.02)
    gone = el.fit_elastic_fpca(frame(spark, turned), T, 1, rounds=40, tolerance=0.02, rotation=True, scale_curves=True)
    spread = lambda f: f.components.explained_variance[0] / f.components.ratio[0] / (f.template**2).sum()
    assert spread(gone) < 0.35 * spread(kept)


def test_contracts(spark):
    _, _, x = shapes(4)
    rows = frame(spark, x)
    for arrays, time, more in ((rows, T, {"dims": 1}), (rows, T**2, {}), (rows, T, {"lam": -1.0}), (rows, T, {"n_components": 0}), (frame(spark, x[:, :-1]), T, {}), (rows.where("false"), T, {})):
        with pytest.raises(ValueError):
            el.fit_elastic_fpca(arrays, time, **({"n_components": 2} | more))
    with pytest.raises(RuntimeError):
        el.fit_elastic_fpca(rows, T, 1, rounds=1)
