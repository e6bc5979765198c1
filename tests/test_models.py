"""Models of curves against direct computations with all data in one array."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kurvex.functions import numeric, sums
from kurvex.operators import decomposition as dec
from kurvex.operators import function_on_scalar as fos
from kurvex.operators import functional_mixed as fm
from kurvex.operators import generalized as gen
from kurvex.operators import recurrence as rec
from kurvex.operators import score_regression as sr
from kurvex.operators import sparse_fit as sf
from kurvex.operators import stability as stab
from kurvex.operators import wild

T = np.linspace(0, 1, 11)
W = dec.trapezoid_weights(T)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n = 48
    person = np.arange(n) // 4
    z = np.stack((np.sin(np.pi * T), np.cos(np.pi * T)))
    a = rng.normal(size=(n, 2)) * [1.5, 0.6] + rng.normal(size=(12, 2))[person] * 0.7
    x = 1 + a @ z + rng.normal(size=(n, len(T))) * 0.1
    y = 2 + x @ (W * np.sin(np.pi * T)) * 3 + rng.normal(size=n) * 0.3
    c = rng.normal(size=n)
    return pd.DataFrame({"curve_id": np.arange(n), "participant": person, "values": list(x), "y": y, "c": c, "b": (y > np.median(y)).astype(float)})


@pytest.fixture(scope="module")
def curves(spark, data):
    rows = [(int(r.curve_id), int(r.participant), [float(v) for v in r["values"]], float(r.y), float(r.c), float(r.b)) for _, r in data.iterrows()]
    return spark.createDataFrame(rows, "curve_id long, participant long, values array<double>, y double, c double, b double").repartition(3)


def hashes(spark, values):
    rows = spark.createDataFrame([(int(v),) for v in values], "v long").select("v", F.xxhash64("v").alias("h")).collect()
    found = {r.v: r.h for r in rows}
    return np.array([found[int(v)] for v in values])


def test_numbers():
    assert numeric.beta_cdf(0.3, 2, 3) == pytest.approx(0.3483) and numeric.chi_square_quantile(0.99, 2) == pytest.approx(-2 * np.log(0.01))
    assert numeric.clopper_pearson(0, 10)[0] == 0 and numeric.clopper_pearson(3, 10) == pytest.approx((0.06673951, 0.65245285))
    b = numeric.clamped_spline(T, 6)
    assert np.allclose(b.sum(1), 1) and b[0, 0] == b[-1, -1] == 1 and np.linalg.matrix_rank(b) == 6
    g = np.random.default_rng(0).random((4, 6))
    from itertools import permutations

    assert numeric.assign(g) == list(max(permutations(range(6), 4), key=lambda p: sum(g[i, j] for i, j in enumerate(p))))


def test_grams(spark, curves, data):
    x = np.column_stack((np.ones(len(data)), np.stack(data["values"])))
    assert np.allclose(sums.gram(curves, sums.vector("values")), x.T @ x)
    w = numeric.draws(hashes(spark, data.participant), 3, 5, "poisson")
    for r in sums.replicate_grams(curves, sums.vector("values"), "participant", 3, 5).collect():
        assert np.allclose(np.asarray(r.gram).reshape(12, 12), (x * w[:, r.rep, None]).T @ x)
    got = sums.wild_sums(curves, F.array("y"), F.col("values"), "curve_id", 4, "normal", 2)
    m = numeric.draws(hashes(spark, data.curve_id), 4, 2, "normal")
    assert np.allclose(got[:, 0], m.T @ (data.y.to_numpy()[:, None] * x[:, 1:]))


def direct_scores(x, train, k):
    mean = x[train].mean(0)
    ev, vec = np.linalg.eigh(np.cov(x[train].T) * np.outer(np.sqrt(W), np.sqrt(W)))
    return (x - mean) @ (vec[:, ::-1][:, :k] * np.sqrt(W)[:, None])


def test_regression_cross_validation(spark, curves, data):
    x, y = np.stack(data["values"]), data.y.to_numpy()
    fold = {r.curve_id: r.f for r in curves.select("curve_id", sr.fold_number("participant", 3).alias("f")).collect()}
    f = np.array([fold[i] for i in data.curve_id])
    for loss, error in (("rmse", lambda e: np.sqrt((e * e).mean())), ("mae", lambda e: np.abs(e).mean())):
        cv = sr.cross_validate(curves, T, "y", [1, 2, 3], 3, "participant", ("c",), loss)
        for r in cv.itertuples():
            train = f != r.fold
            d = np.column_stack((np.ones(len(y)), direct_scores(x, train, r.n_components), data.c))
            beta = np.linalg.lstsq(d[train], y[train], rcond=None)[0]
            assert r.loss == pytest.approx(error((y - d @ beta)[~train]))
    assert sr.select(cv) in (1, 2, 3) and sr.select(cv, "one_se") <= sr.select(cv)
    nested = sr.nested_cross_validate(curves, T, "y", [1, 2], 3, 2)
    assert set(nested.n_components) <= {1, 2} and (nested.loss < 2).all() and nested.n.sum() == len(y)


def test_binary_scores(curves, data):
    fit = dec.fit_fpca(curves, T, 2)
    beta = sr.logistic_scores(curves, {"m": fit}, "b")["m"]
    d = np.column_stack((np.ones(len(data)), (np.stack(data["values"]) - fit.mean) @ fit.basis))
    p = 1 / (1 + np.exp(-d @ beta))
    assert np.abs(d.T @ (data.b - p)).max() < 1e-5
    cv = sr.cross_validate_binary(curves, T, "b", [1, 2], 3, loss="brier")
    assert ((cv.loss > 0) & (cv.loss < 0.25)).all()


def test_regression_bootstrap(spark, curves, data):
    model = sr.train(curves, T, "y", 2)
    boot = sr.bootstrap_regression(curves, T, "y", 2, 60, "participant")
    assert boot.count() == 60
    pred = sr.prediction_uncertainty(boot, model, curves).toPandas().sort_values("curve_id")
    future = sr.prediction_uncertainty(boot, model, curves, residuals=sr.centred_residuals(curves, model, "y")).toPandas().sort_values("curve_id")
    assert np.corrcoef(pred.prediction, data.y)[0, 1] > 0.95 and (future.upper - future.lower).mean() > (pred.upper - pred.lower).mean()
    band, point = sr.slope_band(boot, model), sr.slope_uncertainty(boot, model).toPandas().sort_values("place")
    assert (band.upper - band.lower > 1.5 * band.se).all() and np.allclose(point.se, band.se)


def test_stability(spark, curves):
    fit = dec.fit_fpca(curves, T, 2)
    boot = dec.bootstrap_fits(curves, T, 2, 40, "participant").cache()
    s = {r.component: r for r in stab.summarise_stability(boot).collect()}
    assert s[1].median_similarity > 0.9 and s[1].lower <= s[1].median_similarity <= s[1].upper
    e = stab.component_envelopes(boot).toPandas()
    assert len(e) == 22 and (e.lower <= e.upper).all()
    for scope in ("component", "family"):
        b = stab.component_bands(boot, fit, scope=scope).toPandas().sort_values(["component", "place"])
        assert np.allclose(b.estimate, fit.components.ravel()) and (b.critical > 1.5).all()
    u = stab.spectrum_uncertainty(boot, fit).toPandas()
    assert set(u.measure) == {"eigenvalue", "ratio", "cumulative"} and len(u) == 6
    q = stab.score_uncertainty(boot, fit, curves).toPandas()
    assert len(q) == 96 and (q.lower <= q.upper).all() and (q.se > 0).all()
    a = stab.subspace_stability(boot).toPandas()
    assert (a.normalized_distance.between(0, 1)).all() and len(stab.summarise_subspace_stability(stab.subspace_stability(boot)).collect()) == 4
    out = stab.diagnose_outliers(dec.reconstruction_error(curves, fit), dec.scores(curves, fit), 2).toPandas()
    assert len(out) == 48 and out.outlier.mean() < 0.3
    assert dec.select_n_components(dec.fit_fpca(curves, T, 4), 0.9) <= 2 and len(dec.component_trajectories(fit, 1)) == 55
    rc = dec.reconstruction_curve(curves, fit).toPandas().sort_values("n_components")
    assert rc.mean_rmse.is_monotonic_decreasing


def test_wild_projection(spark, curves, data):
    fit = dec.fit_fpca(curves, T, 3)
    scored = dec.scores(curves, fit).join(curves.select("curve_id", "y"), "curve_id")
    z = (np.stack(data["values"]) - fit.mean) @ fit.basis
    targets = pd.DataFrame({"curve_id": [0, 1], "scores": list(z[:2])})
    got = wild.wild_projection(scored, "y", targets, 2, 3, 25, "mammen", seed=4)
    v, y, n = numeric.draws(hashes(spark, data.curve_id), 25, 4, "mammen"), data.y.to_numpy(), len(data)
    ols = lambda k, t: np.linalg.lstsq(np.column_stack((np.ones(n), z[:, :k])), t, rcond=None)[0]
    fitted = lambda k, t: np.column_stack((np.ones(n), z[:, :k])) @ ols(k, t)

    def error(residual):
        s = z * residual[:, None]
        d = z[:2] @ np.linalg.inv(z.T @ z / n)
        return np.sqrt(np.einsum("ti,ij,tj->t", d, np.cov(s.T), d) / n)

    e = y - fitted(2, y)
    assert np.allclose(got.estimate, z[:2] @ ols(3, y)[1:]) and np.allclose(got.se, error(e))
    for r in range(25):
        star = fitted(2, y) + e * v[:, r]
        root = z[:2] @ ols(3, star)[1:] - z[:2, :2] @ ols(2, y)[1:]
        assert np.allclose(got.roots[r], root / error(star - fitted(2, star)))
    frame = wild.projection_frame(spark, got).toPandas()
    both = wild.simultaneous_interval(spark, got).toPandas()
    assert (both.family_critical >= frame.critical - 1e-12).all()
    tests = wild.family_test(spark, got)
    t = tests.toPandas()
    assert (t.adjusted_p >= t.p_value).all() and wild.monte_carlo_diagnostics(tests, 25).count() == 4
    scan = wild.scan_truncations(scored, "y", targets, 1, [1, 2, 3], replicates=25)
    assert scan.count() == 6 and wild.select_truncation(scan, 10.0, 10.0, 1).toPandas().h.tolist() == [1, 1]


def test_function_on_scalar(spark, curves, data):
    x, y = np.column_stack((np.ones(48), data.c, data.y)), np.stack(data["values"])
    rows = fos.design(curves, ["c", "y"])
    model = fos.fit(rows, ["c", "y"])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    h, e = x @ np.linalg.inv(x.T @ x), y - x @ beta
    assert np.allclose(model.beta, beta) and np.allclose(model.se, np.sqrt(48 / 45 * (h**2).T @ e**2))
    draws = fos.bootstrap(rows, model, 20)
    w = numeric.draws(hashes(spark, hashes(spark, data.curve_id)), 20, 0, "rademacher")
    assert np.allclose(draws[3], beta + h.T @ (e * w[:, 3, None]))
    for scope in ("each", "family"):
        frame = fos.coefficient_frame(spark, model, draws, scope=scope).toPandas()
        assert len(frame) == 33 and (frame.upper >= frame.lower).all()
    with pytest.raises(ValueError):
        fos.design(curves, ["c"], "participant")


def expanded(x, basis):
    return np.einsum("np,tk->ntpk", x, basis).reshape(x.shape[0] * len(basis), -1)


@pytest.mark.parametrize("family", ["binomial", "poisson"])
def test_generalized(spark, data, family):
    rng = np.random.default_rng(3)
    x = np.column_stack((np.ones(48), data.c))
    eta = x @ np.stack((np.sin(2 * T), 0.5 * T))
    m = rng.integers(1, 5, (48, 11)).astype(float)
    y = rng.binomial(m.astype(int), 1 / (1 + np.exp(-eta))) if family == "binomial" else rng.poisson(m * np.exp(eta))
    rows = spark.createDataFrame([(int(i), int(p), [float(v) for v in a], [float(v) for v in b], float(c)) for i, p, a, b, c in zip(data.curve_id, data.participant, y, m, data.c, strict=True)], "curve_id long, participant long, values array<double>, m array<double>, c double")
    fitted = gen.fit(gen.model_rows(rows, ["c"], "participant", "m"), T, ["c"], family, 4)
    d, basis = expanded(x, fitted.basis), fitted.basis
    mu, v = gen._mean(family, (d @ fitted.gamma.ravel()).reshape(48, 11), m)
    assert np.abs(d.T @ (y - mu).ravel()).max() < 1e-4
    s = np.einsum("np,nk->npk", x, (y - mu) @ basis).reshape(48, -1)
    per = np.stack([s[data.participant == p].sum(0) for p in range(12)])
    inv = np.linalg.inv((d * v.ravel()[:, None]).T @ d)
    assert np.allclose(fitted.covariance, inv @ per.T @ per @ inv) and fitted.participants == 12
    draws = gen.bootstrap(gen.model_rows(rows, ["c"], "participant", "m"), fitted, 20)
    frame = gen.coefficient_frame(spark, fitted, draws).toPandas()
    assert len(frame) == 22 and frame.simultaneous.all()
    profiles = pd.DataFrame({"profile_id": ["a", "b"], "c": [0.0, 99.0]})
    p = gen.predict(fitted, profiles, draws)
    assert p[p.profile_id == "b"].extrapolated.all() and not p[p.profile_id == "a"].extrapolated.any() and ((p.lower <= p["mean"]) & (p["mean"] <= p.upper)).all()
    assert len(gen.mean_difference(fitted, profiles.assign(c=[0.0, 1.0]), "a", "b", draws)) == 11 and gen.exposure_frame(rows, "m").count() == 48
    with pytest.raises(ValueError):
        gen.fit(gen.model_rows(rows.withColumn("values", F.transform("values", lambda q: q + 0.5)), ["c"], "participant"), T, ["c"], "poisson", 4)


def dense_loss(lay, theta, x, y, person, reml):
    factor, cov = lay.unpack(theta)[0], lay.within(theta)
    g, total, info, score, cache = factor @ factor.T, 0.0, 0, 0, []
    for p in np.unique(person):
        xs, ys = x[person == p], y[person == p].ravel()
        d, z = expanded(xs, lay.fixed), expanded(xs[:, lay.at], lay.random)
        v = z @ g @ z.T + np.kron(np.eye(len(xs)), cov)
        vi = np.linalg.inv(v)
        total += np.linalg.slogdet(v)[1]
        info, score = info + d.T @ vi @ d, score + d.T @ vi @ ys
        cache.append((d, ys, vi, z))
    beta = np.linalg.solve(info, score)
    quad = sum((ys - d @ beta) @ vi @ (ys - d @ beta) for d, ys, vi, _ in cache)
    n, k = y.size, len(beta)
    loss = 0.5 * (total + quad + ((np.linalg.slogdet(info)[1] + (n - k) * np.log(2 * np.pi)) if reml else n * np.log(2 * np.pi)))
    return loss, beta, info, [g @ z.T @ vi @ (ys - d @ beta) for d, ys, vi, z in cache]


@pytest.mark.parametrize("how", [{}, {"random_slope": "c", "correlation": "ar1"}, {"trial_size": 2, "correlation": "exponential"}])
def test_mixed_likelihood(spark, curves, data, how):
    lay = fm.layout(T, ["c"], 4, 3, **how)
    x, y = np.column_stack((np.ones(48), data.c)), np.stack(data["values"])
    stats = fm.participant_sums(curves, ["c"], "participant")
    theta = np.random.default_rng(1).normal(size=sum(lay.sizes) + 1) * 0.3
    for reml in (True, False):
        f = fm._Likelihood(lay, stats, (y.T @ y)[None], np.array([48.0]), reml)
        losses, states = f(np.stack((theta, theta + 0.1)), np.zeros(2, int))
        for j in range(2):
            loss, beta, info, _ = dense_loss(lay, theta + 0.1 * j, x, y, data.participant.to_numpy(), reml)
            assert losses[j] == pytest.approx(loss) and np.allclose(states[j][0], beta) and np.allclose(states[j][1], info)


@pytest.mark.parametrize("how", [{}, {"random_slope": "c", "correlation": "ar1"}, {"trial_size": 2, "correlation": "exponential"}])
def test_mixed_gradient(spark, curves, data, how):
    lay = fm.layout(T, ["c"], 4, 3, **how)
    y = np.stack(data["values"])
    stats = fm.participant_sums(curves, ["c"], "participant")
    theta = np.random.default_rng(1).normal(size=sum(lay.sizes) + 1) * 0.3
    for reml in (True, False):
        f = fm._Likelihood(lay, stats, (y.T @ y)[None], np.array([48.0]), reml)
        d = len(theta)
        losses = f(np.concatenate((theta + 1e-5 * np.eye(d), theta - 1e-5 * np.eye(d))), np.zeros(2 * d, int))[0]
        got = f.gradients(theta[None], f(theta[None], np.zeros(1, int))[1], np.zeros(1, int))[0]
        assert np.allclose(got, (losses[:d] - losses[d:]) / 2e-5, rtol=1e-4, atol=1e-3)


@pytest.mark.parametrize("reml", [True, False])
def test_mixed_random_intercept_in_closed_form(spark, reml):
    """One constant random effect per participant on a balanced design: the variance components of the analysis of variance."""
    rng = np.random.default_rng(2)
    p, n, t = 30, 5, 4
    y = 40 + 25 * rng.normal(size=(p, 1, 1)) + 3 * rng.normal(size=(p, n, t))
    rows = spark.createDataFrame([(i * n + j, i, y[i, j].tolist()) for i in range(p) for j in range(n)], "curve_id long, participant long, values array<double>")
    one = np.ones((t, 1))
    m = fm.fit(rows, fm.Layout(np.arange(t, dtype=float), ("intercept",), one, one), "participant", reml)
    mean = y.mean((1, 2))
    within = ((y - mean[:, None, None]) ** 2).sum() / (p * (n * t - 1))
    between = n * t * ((mean - mean.mean()) ** 2).sum() / (p - 1 if reml else p)
    factor, _, sd, _ = m.layout.unpack(m.theta)
    assert sd**2 == pytest.approx(within, rel=1e-3) and factor[0, 0] ** 2 == pytest.approx((between - within) / (n * t), rel=1e-3)
    assert m.beta[0, 0] == pytest.approx(y.mean()) and m.decrement < 1e-6 and m.errors[0, 0] ** 2 == pytest.approx((between if reml else between) / (p * n * t), rel=1e-3)


def test_mixed_fit_is_an_optimum_at_any_scale(spark, curves, data):
    lay, rng = fm.layout(T, ["c"], 4, 2), np.random.default_rng(0)
    x, y, person = np.column_stack((np.ones(48), data.c)), np.stack(data["values"]), data.participant.to_numpy()
    for scale in (1.0, 1e-3, 50.0):
        m = fm.fit(curves.withColumn("values", F.transform("values", lambda v: v * scale)), lay, "participant")
        loss = lambda v, s=scale: dense_loss(lay, v, x, s * y, person, True)[0]
        assert m.loss == pytest.approx(loss(m.theta)) and m.decrement < 1e-6
        assert all(loss(m.theta + size * rng.normal(size=len(m.theta))) > m.loss - 1e-5 for size in (1.0, 0.3, 0.1, 0.01) for _ in range(12))
    with pytest.raises(RuntimeError):
        fm.fit(curves, lay, "participant", iterations=1)
    with pytest.raises(ValueError):  # the slope's predictor is one number per participant
        fm.fit(curves.withColumn("own", F.col("participant") * 0.5), fm.layout(T, ["own"], 4, 2, random_slope="own"), "participant")


def test_mixed_fit(spark, curves, data):
    lay = fm.layout(T, ["c"], 4, 3)
    m = fm.fit(curves, lay, "participant")
    x, y = np.column_stack((np.ones(48), data.c)), np.stack(data["values"])
    loss, beta, _, blups = dense_loss(lay, m.theta, x, y, data.participant.to_numpy(), True)
    assert m.loss == pytest.approx(loss, rel=1e-6) and np.allclose(m.beta.ravel(), beta)
    start = dense_loss(lay, fm._start(lay, float(y.std())), x, y, data.participant.to_numpy(), True)[0]
    assert m.loss < start - 20
    own = {r.u: r["values"] for r in fm.random_effects(m).collect()}
    h = hashes(spark, np.unique(data.participant))
    assert all(np.allclose(own[h[i]], lay.random @ b) for i, b in enumerate(blups))
    r = fm.residuals(curves, m, "participant").toPandas().set_index("curve_id")
    assert np.allclose(r.loc[5, "residual"], y[5] - x[5] @ m.functions - own[h[data.participant[5]]])
    assert len(fm.residuals(curves, m, "participant", "whitened").limit(1).collect()[0].residual) == 11
    diag = {lev: fm.residual_diagnostics(fm.residuals(curves, m, "participant"), 3, lev) for lev in ("trial", "participant", "overall")}
    assert [diag[k].count() for k in diag] == [192, 48, 4] and {r.lag: r for r in diag["overall"].collect()}[0].autocorrelation == pytest.approx(1)
    assert fm.residual_pairs(fm.residuals(curves, m, "participant"), 2).count() == 48 * 9
    assert fm.compare_diagnostics(diag["overall"], diag["overall"]).where("abs(delta_semivariance) > 1e-12").count() == 0
    draws = fm.bootstrap(m, 50)
    refit, thetas = fm.full_refit(m, curves, "participant", 3)
    assert draws.shape == (50, 2, 11) and refit.shape == (3, 2, 11)
    audit = fm.refit_audit(m, curves, "participant", 3)
    n = fm.refit_trial_audit(curves, "participant", audit).agg(F.sum("count")).first()[0]
    w = numeric.draws(hashes(spark, hashes(spark, np.unique(data.participant))), 3, 0, "poisson")
    assert n == 4 * w.sum()
    assert fm.coefficient_frame(spark, m, draws).count() == 22 and fm.compare_bootstraps(spark, m, draws, refit).count() == 22
    assert fm.variance_decomposition(spark, m).count() == 22 and fm.variance_frame(spark, lay, thetas).count() == 6
    assert fm.covariance_sensitivity(spark, {"a": m, "b": ValueError("no")}, "a").where("failure is not null").count() == 1


@pytest.fixture(scope="module")
def sparse(spark):
    rng = np.random.default_rng(11)
    rows = []
    for p in range(20):
        between = rng.normal()
        for c in range(3):
            a = rng.normal(size=2) * [1.0, 0.5]
            t = np.sort(rng.random(rng.integers(6, 12)))
            f = 0.8 * between * np.ones_like(t) + a[0] * np.sin(np.pi * t) + a[1] * np.cos(np.pi * t)
            x, y = 1 + f + rng.normal(size=len(t)) * 0.2, -f + rng.normal(size=len(t)) * 0.3
            for k, v in enumerate(t):
                rows.append((p * 3 + c, p, k, float(v), float(x[k]), float(y[k]) if rng.random() < 0.7 else None))
    return spark.createDataFrame(rows, "curve_id long, participant long, t_idx int, t double, x double, y double"), pd.DataFrame(rows, columns=["curve_id", "participant", "t_idx", "t", "x", "y"])


GRID = np.linspace(0, 1, 9)


def test_pair_moments_are_those_of_all_pairs(sparse):
    df, pdf = sparse
    kernel = lambda u: np.where(np.abs(u) < 1, 0.75 * (1 - u * u), 0)
    got = sf.pair_moments(df.withColumns({"ex": F.col("x"), "ey": F.col("y")}), GRID, 0.3, ("ex", "ey"), 4)
    for (p, q), names in {(0, 0): "xx", (0, 1): "xy"}.items():
        want = {k: np.zeros((9, 9)) for k in got[p, q]}
        for _, c in pdf.groupby("curve_id"):
            t, u, v = c.t.to_numpy(), c[names[0]].to_numpy(), c[names[1]].to_numpy()
            for i in range(len(t)):
                for j in range(len(t)):
                    if i != j and np.isfinite(u[i]) and np.isfinite(v[j]):
                        ds, dt = t[i] - GRID, t[j] - GRID
                        k = np.outer(kernel(ds / 0.3), kernel(dt / 0.3))
                        for key in want:
                            want[key] += np.outer(np.abs(ds) < 0.3, np.abs(dt) < 0.3) if key == ("n",) else k * np.outer(ds ** key[1], dt ** key[2]) * (u[i] * v[j] if key[0] == "e" else 1)
        assert all(np.allclose(got[p, q][k], want[k]) for k in want)


def interpolation(t):
    i = np.minimum(np.searchsorted(GRID[1:], t, "right"), len(GRID) - 2)
    f = (t - GRID[i]) / np.diff(GRID)[i]
    a = np.zeros((len(t), len(GRID)))
    a[np.arange(len(t)), i], a[np.arange(len(t)), i + 1] = 1 - f, f
    return a


def test_sparse_fit_and_scores(sparse):
    df, pdf = sparse
    fit = sf.fit(df, GRID, 2, 0.25, 0.35)
    assert 0.01 < fit.noise[0, 0] < 0.2 and len(fit.eigenvalues) == 2
    assert np.allclose((fit.phi[:, 0] * dec.trapezoid_weights(GRID)) @ fit.phi[:, 0].T, np.eye(2))
    scores = {r.curve_id: r for r in sf.pace_scores(df, fit).collect()}
    for c, rows in list(pdf.groupby("curve_id"))[:6]:
        a = interpolation(rows.t.to_numpy())
        phi = a @ fit.phi[:, 0].T
        v = np.linalg.inv(a @ fit.cov @ a.T + fit.noise[0, 0] * np.eye(len(rows)))
        r = rows.x.to_numpy() - a @ fit.mean[0]
        assert np.allclose(scores[c].scores, fit.eigenvalues * (phi.T @ v @ r), atol=1e-6)
        lam = np.diag(fit.eigenvalues)
        assert np.allclose(np.asarray(scores[c].covariance).reshape(2, 2), lam - lam @ phi.T @ v @ phi @ lam, atol=1e-6)
    assert sf.score_frame(sf.pace_scores(df, fit)).count() == 120
    few = sf.pace_scores(df.where("curve_id > 2 or t_idx = 0"), fit)
    assert few.where("status = 'too_few_samples' and scores is null").count() == 3
    p = {r.t: r for r in sf.partial_prediction(df.where("curve_id = 5"), fit, 0.5).collect()}
    rows = pdf[(pdf.curve_id == 5) & (pdf.t <= 0.5)]
    a = interpolation(rows.t.to_numpy())
    v = np.linalg.inv(a @ fit.cov @ a.T + fit.noise[0, 0] * np.eye(len(rows)))
    centre = fit.mean[0] + fit.cov @ a.T @ v @ (rows.x.to_numpy() - a @ fit.mean[0])
    assert all(p[g].prediction == pytest.approx(centre[k], abs=1e-6) for k, g in enumerate(GRID) if g > 0.5)
    loss, n = sf.held_out_loss(df.where("curve_id = 5"), fit)
    rows = pdf[pdf.curve_id == 5]
    a = interpolation(rows.t.to_numpy())
    s = a @ fit.cov @ a.T + fit.noise[0, 0] * np.eye(len(rows))
    r = rows.x.to_numpy() - a @ fit.mean[0]
    assert n == len(rows) and loss == pytest.approx(0.5 * (len(rows) * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + r @ np.linalg.solve(s, r)))


def test_sparse_channels(sparse):
    df, pdf = sparse
    fit = sf.fit(df, GRID, 2, 0.3, 0.4, ("x", "y"), noise=[[0.04, 0.01], [0.01, 0.09]])
    assert fit.cov.shape == (18, 18) and np.allclose(fit.cov, fit.cov.T) and np.linalg.eigvalsh(fit.cov)[0] > -1e-8
    scores = {r.curve_id: r.scores for r in sf.pace_scores(df, fit).collect()}
    for c, rows in list(pdf.groupby("curve_id"))[:4]:
        a, have = interpolation(rows.t.to_numpy()), np.isfinite(rows.y.to_numpy())
        big = np.zeros((len(rows) + have.sum(), 18))
        big[: len(rows), :9], big[len(rows) :, 9:] = a, a[have]
        noise = np.diag(np.r_[np.full(len(rows), 0.04), np.full(have.sum(), 0.09)])
        for j, i in enumerate(np.flatnonzero(have)):
            noise[i, len(rows) + j] = noise[len(rows) + j, i] = 0.01
        r = np.r_[rows.x.to_numpy() - a @ fit.mean[0], (rows.y.to_numpy() - a @ fit.mean[1])[have]]
        want = fit.eigenvalues * ((big @ fit.phi.reshape(2, -1).T).T @ np.linalg.solve(big @ fit.cov @ big.T + noise, r))
        assert np.allclose(scores[c], want, atol=1e-6)


def test_sparse_levels(sparse):
    df, pdf = sparse
    m = sf.fit_multilevel(df, GRID, "participant", 1, 2, 0.3, 0.4, noise=0.05)
    people, trials = sf.multilevel_scores(df, m, "participant")
    people, trials = {r.participant: r.scores for r in people.collect()}, {r.curve_id: r.scores for r in trials.collect()}
    for p, rows in list(pdf.groupby("participant"))[:4]:
        a = interpolation(rows.t.to_numpy())
        same = rows.curve_id.to_numpy()[:, None] == rows.curve_id.to_numpy()[None, :]
        s = a @ m.between.cov @ a.T + np.where(same, a @ m.within.cov @ a.T, 0) + 0.05 * np.eye(len(rows))
        v = np.linalg.solve(s, rows.x.to_numpy() - a @ m.between.mean[0])
        assert np.allclose(people[p], m.between.eigenvalues * (m.between.phi[:, 0] @ a.T @ v), atol=1e-6)
        for c in rows.curve_id.unique():
            k = (rows.curve_id == c).to_numpy()
            assert np.allclose(trials[c], m.within.eigenvalues * (m.within.phi[:, 0] @ a[k].T @ v[k]), atol=1e-6)


def test_sparse_bandwidths_and_conformal(sparse):
    df, _ = sparse
    table = sf.select_bandwidths(df, GRID, 1, [0.3], [0.01, 0.4], 2, noise=0.05)
    assert sf.best_bandwidths(table) == (0.3, 0.4) and table[table.covariance_bandwidth == 0.01].failure.notna().all()
    fit = sf.fit(df, GRID, 2, 0.3, 0.4, noise=0.05)
    on_grid = df.withColumn("t", F.round(F.col("t") * 8) / 8)
    c = sf.calibrate_conformal(on_grid, fit, 0.4, 0.2)
    assert c > 0 and sf.conformal_band(df, fit, 0.4, c).where("upper < lower").count() == 0
    with pytest.raises(ValueError):
        sf.calibrate_conformal(on_grid.where("curve_id < 3"), fit, 0.4, 0.05)


def test_cross_recurrence_measures(spark):
    four = spark.createDataFrame([(0, i, float(i), float(i)) for i in range(4)], "curve_id long, t_idx int, t double, x double")
    pairs = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "i int, j int")
    m = rec.cross_rqa_metrics(four, four, pairs).first()
    assert m.recurrence_rate == 3 / 16 and m.determinism == 1 and m.mean_diagonal == m.max_diagonal == 3 and m.diagonal_lines == 1
    assert m.diagonal_entropy == 0 and m.laminarity == 0 and m.trapping_time is None


def test_near_pairs_are_all_pairs_within(spark):
    rng = np.random.default_rng(5)
    rows = [(c, i, float(i), *map(float, rng.normal(size=2) * 3)) for c in range(3) for i in range(40)]
    s = spark.createDataFrame(rows, "curve_id long, t_idx int, t double, x double, y double")
    for dims, radius in ((("x",), 0.7), (("x", "y"), 1.1), (("x", "y"), 0.0)):
        got = {(r.curve_id, r.i, r.j) for r in rec.recurrence_pairs(s, dims, radius, 1).collect()}
        v = {(c, i): np.array(p)[: len(dims)] for c, i, _, *p in rows}
        assert got == {(c, i, j) for c in range(3) for i in range(40) for j in range(i + 2, 40) if np.linalg.norm(v[c, i] - v[c, j]) <= radius}


def test_network_components(spark):
    s = spark.createDataFrame([(0, i, float(i)) for i in range(6)] + [(1, 0, 0.0)], "curve_id long, t_idx int, t double")
    pairs = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 4, 5)], "curve_id long, i int, j int")
    got = {r.curve_id: (r.n_components, r.largest_component) for r in rec.network_components(s, pairs).collect()}
    assert got == {0: (3, 3), 1: (1, 1)}
