"""Dense helpers of grid or replicate size: quadrature, spline bases, quantiles, assignments, tail probabilities, reproducible draws."""

from __future__ import annotations

import math

import numpy as np


def higher_quantile(values: np.ndarray, level: float, axis: int | None = None) -> np.ndarray:
    """The least value with at least ``level`` of the others below it: no interpolation, so a band never gets too narrow."""
    return np.quantile(values, level, axis=axis, method="higher")


def clamped_spline(t: np.ndarray, size: int, degree: int = 3, ends: tuple[float, float] | None = None) -> np.ndarray:
    """B-spline basis (times x size) with equally spaced inner knots, clamped at both ends, by the Cox-de Boor recursion."""
    if size < degree + 1 or degree < 0:
        raise ValueError("a basis needs more functions than its degree")
    t = np.asarray(t, float)
    lo, hi = ends or (float(t[0]), float(t[-1]))
    inner = np.linspace(lo, hi, size - degree + 1)
    knots = np.concatenate((np.full(degree, lo), inner, np.full(degree, hi)))
    place = np.clip(np.searchsorted(inner, t, "right") - 1, 0, len(inner) - 2) + degree  # the last interval is closed
    basis = np.zeros((len(t), len(knots) - 1))
    basis[np.arange(len(t)), place] = 1.0
    for d in range(1, degree + 1):
        up = np.zeros((len(t), basis.shape[1] - 1))
        for j in range(up.shape[1]):
            left, right = knots[j + d] - knots[j], knots[j + d + 1] - knots[j + 1]
            if left > 0:
                up[:, j] += (t - knots[j]) / left * basis[:, j]
            if right > 0:
                up[:, j] += (knots[j + d + 1] - t) / right * basis[:, j + 1]
        basis = up
    return basis


def assign(gain: np.ndarray) -> list[int]:
    """The column of each row of the assignment with the greatest total gain, by shortest augmenting paths in cubic time."""
    n, m = gain.shape
    if n > m:
        raise ValueError("there are fewer columns than rows")
    cost = float(gain.max(initial=0)) - np.asarray(gain, float)
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for i in range(n):
        least, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, via = i, -1
        while True:
            reduced = cost[row] - row_price[row] - col_price
            better = ~done & (reduced < least)
            least[better], back[better] = reduced[better], via
            j = int(np.where(done, np.inf, least).argmin())
            step = least[j]
            row_price[i] += step
            for c in np.flatnonzero(done):
                row_price[owner[c]] += step
            col_price[done] -= step
            least[~done] -= step
            done[j], via = True, j
            if owner[j] < 0:
                break
            row = owner[j]
        while via >= 0:
            before = back[via]
            owner[via] = owner[before] if before >= 0 else i
            via = before
    out = [0] * n
    for j, i in enumerate(owner):
        if i >= 0:
            out[i] = j
    return out


def _bisect(f, target: float, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < target else (lo, mid)
    return (lo + hi) / 2


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    safe = lambda v: v if abs(v) > 1e-300 else 1e-300
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / safe(1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 1000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / safe(1 + k * d)
            c = safe(1 + k / c)
            f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * f


def beta_quantile(p: float, a: float, b: float) -> float:
    return _bisect(lambda x: beta_cdf(x, a, b), p, 0.0, 1.0)


def clopper_pearson(hits: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact interval of a binomial share."""
    tail = (1 - level) / 2
    return (0.0 if hits == 0 else beta_quantile(tail, hits, n - hits + 1), 1.0 if hits == n else beta_quantile(1 - tail, hits + 1, n - hits))


def gamma_cdf(x: float, a: float) -> float:
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 1000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return front * total
    b, c = x + 1 - a, 1e300
    d = f = 1 / b
    for i in range(1, 1000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b)
        c = b + k / c
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return 1 - front * f


def chi_square_quantile(p: float, df: float) -> float:
    return _bisect(lambda x: gamma_cdf(x / 2, df / 2), p, 0.0, df + 40 * math.sqrt(2 * df) + 40)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return _bisect(normal_cdf, p, -40.0, 40.0)


def uniforms(unit: np.ndarray, replicates: int, seed: int, lane: int = 0) -> np.ndarray:
    """Uniform numbers (units x replicates), a function of unit, replicate, seed and lane alone (splitmix64)."""
    r = (np.arange(replicates, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    start = np.uint64((seed * 0x632BE59BD9B4E019 + lane * 0x85EBCA6B27D4EB4F) % 2**64)
    with np.errstate(over="ignore"):
        x = (unit.astype(np.int64).view(np.uint64)[:, None] ^ start) * np.uint64(0xD6E8FEB86659FD93) + r[None, :]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2**53


def draws(unit: np.ndarray, replicates: int, seed: int, kind: str) -> np.ndarray:
    """Bootstrap counts or multipliers (units x replicates) of 64-bit unit hashes: poisson, rademacher, normal or mammen.

    They depend on nothing but their arguments, so tasks and passes agree on them without sending any.
    """
    u = uniforms(unit, replicates, seed, 0)
    if kind == "poisson":
        return np.searchsorted(np.cumsum(math.exp(-1) / np.array([math.factorial(k) for k in range(12)], float)), u.ravel()).reshape(u.shape).astype(float)
    if kind == "rademacher":
        return np.where(u < 0.5, -1.0, 1.0)
    if kind == "normal":
        return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * uniforms(unit, replicates, seed, 1))
    if kind == "mammen":
        root = math.sqrt(5)
        return np.where(u < (root + 1) / (2 * root), (1 - root) / 2, (1 + root) / 2)
    raise ValueError(f"unknown draws: {kind}")


def simultaneous(values: np.ndarray, centre: np.ndarray, se: np.ndarray, level: float, scope: str) -> np.ndarray:
    """Critical values of max |draw - centre| / se over the points: one per leading index (``each``), or one for all (``family``).

    ``values`` (replicates x k x points), ``centre`` and ``se`` (k x points); points without spread don't count.
    """
    z = np.abs(values - centre)
    z = np.divide(z, se, out=np.zeros_like(z), where=se > np.finfo(float).eps)
    if scope == "each":
        return higher_quantile(z.max(2), level, 0)
    if scope != "family":
        raise ValueError("the scope is each or family")
    return np.full(len(centre), higher_quantile(z.max((1, 2)), level))
