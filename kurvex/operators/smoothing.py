"""Per-curve numeric kernels that SQL can't express: monotone cubic resampling, smoothing of valid runs, phase surrogates."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tiles import floats, tasks

CURVE = "curve_id"
#: Values of surrogates that are made at once.
HELD = 1 << 16


def pchip(t: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fritsch-Carlson monotone cubic interpolation; NaN outside the samples."""
    h, n = np.diff(t), len(t)
    out = np.full(len(at), np.nan)
    inside = (at >= t[0]) & (at <= t[-1])
    if n == 2:
        out[inside] = np.interp(at[inside], t, v)
        return out
    s = np.diff(v) / h
    d = np.zeros(n)
    ok = s[:-1] * s[1:] > 0
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        d[1:-1] = np.where(ok, (w1 + w2) / (w1 / s[:-1] + w2 / s[1:]), 0.0)

    def end(h0, h1, s0, s1):
        e = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
        return 0.0 if np.sign(e) != np.sign(s0) else 3 * s0 if np.sign(s0) != np.sign(s1) and abs(e) > 3 * abs(s0) else e

    d[0], d[-1] = end(h[0], h[1], s[0], s[1]), end(h[-1], h[-2], s[-1], s[-2])
    k = np.clip(np.searchsorted(t, at[inside], "right") - 1, 0, n - 2)
    x = (at[inside] - t[k]) / h[k]
    out[inside] = (1 + 2 * x) * (1 - x) ** 2 * v[k] + x * (1 - x) ** 2 * h[k] * d[k] + x * x * (3 - 2 * x) * v[k + 1] + x * x * (x - 1) * h[k] * d[k + 1]
    return out


def savgol(v: np.ndarray, window: int, order: int) -> np.ndarray:
    """Savitzky-Golay smoothing; the first and last half windows come from the end fits."""
    m = window // 2
    a = np.vander(np.arange(-m, m + 1), order + 1, increasing=True)
    pinv = np.linalg.pinv(a)
    out = np.convolve(v, pinv[0][::-1], "same")
    for part, at in ((slice(0, window), slice(0, m)), (slice(len(v) - window, len(v)), slice(len(v) - m, len(v)))):
        fit = pinv @ v[part]
        x = np.arange(-m, 0) if at.start == 0 else np.arange(1, m + 1)
        out[at] = np.vander(x, order + 1, increasing=True) @ fit
    return out


def gaussian(v: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian filter cut at four sigma, edges repeated."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(v, r, "edge"), k / k.sum(), "valid")


def smooth(samples: DataFrame, dims: tuple[str, ...], method: str, window: int = 5, order: int = 2, sigma: float = 1.0) -> DataFrame:
    """Each run of valid samples smoothed by itself; missing stay missing, runs shorter than the window stay as they are."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t_idx").reset_index(drop=True)
        for d in dims:
            v = pdf[d].to_numpy(float, copy=True)
            ok = np.isfinite(v)
            edges = np.flatnonzero(np.diff(np.concatenate(([0], ok.astype(int), [0]))))
            for a, b in edges.reshape(-1, 2):
                if method == "savgol" and b - a >= window:
                    v[a:b] = savgol(v[a:b], window, order)
                elif method == "gaussian" and ok.sum() >= 3:
                    v[a:b] = gaussian(v[a:b], sigma)
            pdf[d] = v
        return pdf

    s = samples.select(CURVE, "t_idx", "t", *dims)
    return s.groupBy(CURVE).applyInPandas(run, s.schema)


def resample_pchip(samples: DataFrame, grid: np.ndarray, dim: str = "x", max_gap: float | None = None) -> DataFrame:
    """Monotone cubic values at the grid, missing outside a curve and inside gaps over ``max_gap``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[[CURVE, "t", dim]].dropna().sort_values("t")
        t, v = p["t"].to_numpy(), p[dim].to_numpy()
        out = pchip(t, v, grid) if len(t) > 1 else np.full(len(grid), np.nan)
        if max_gap is not None and len(t) > 1:
            k = np.clip(np.searchsorted(t, grid, "right") - 1, 0, len(t) - 2)
            out[(t[k + 1] - t[k] > max_gap) & (grid > t[k]) & (grid < t[k + 1])] = np.nan
        return pd.DataFrame({CURVE: pdf[CURVE].iloc[0], "g_idx": np.arange(len(grid)), "t": grid, dim: [None if np.isnan(x) else x for x in out]})

    return samples.select(CURVE, "t", dim).groupBy(CURVE).applyInPandas(run, f"curve_id {dict(samples.dtypes)[CURVE]}, g_idx int, t double, {dim} double")


def iaaft(v: np.ndarray, rng: np.random.Generator, iterations: int = 200, tolerance: float = 1e-8) -> np.ndarray:
    """Amplitude-adjusted Fourier surrogate: the values of v with nearly its spectrum; columns keep their phase offsets."""
    v = np.atleast_2d(v.T).T
    ranked, amp = np.sort(v, 0), np.abs(np.fft.rfft(v, axis=0))
    offset = np.angle(np.fft.rfft(v, axis=0)) - np.angle(np.fft.rfft(v[:, :1], axis=0))
    s, before = v[rng.permutation(len(v))], np.inf
    for _ in range(iterations):
        phase = np.angle(np.fft.rfft(s[:, :1], axis=0)) + offset
        f = np.fft.irfft(amp * np.exp(1j * phase), len(v), axis=0)
        s = np.take_along_axis(ranked, np.argsort(np.argsort(f, 0, kind="stable"), 0, kind="stable"), 0)
        gap = float(np.mean((np.abs(np.fft.rfft(s, axis=0)) - amp) ** 2))
        if abs(before - gap) < tolerance:
            break
        before = gap
    return s


def iaaft_many(v: np.ndarray, starts: np.ndarray, iterations: int = 200, tolerance: float = 1e-8) -> np.ndarray:
    """``iaaft`` of many matrices of one length at once: v (curves, samples, columns), starts (curves, surrogates, samples) are permutations.

    Each surrogate stops by itself; the result is (curves, surrogates, samples, columns).
    """
    n, shape = v.shape[1], (*starts.shape, v.shape[2])
    spectrum = np.fft.rfft(v, axis=1)
    turn = np.exp(1j * (np.angle(spectrum) - np.angle(spectrum[:, :, :1])))
    each = lambda x: np.repeat(x, starts.shape[1], axis=0)
    ranked, amp, push = each(np.sort(v, 1)), each(np.abs(spectrum)), each(np.abs(spectrum) * turn)
    s = np.take_along_axis(each(v), starts.reshape(-1, n, 1), 1)
    out, before, open_ = np.empty_like(s), np.full(len(s), np.inf), np.arange(len(s))
    held = np.fft.rfft(s, axis=1)
    for _ in range(iterations):
        first = held[:, :, :1]
        size = np.abs(first)
        phase = np.divide(first, size, out=np.ones_like(first), where=size > 0)
        order = np.argsort(np.fft.irfft(push * phase, n, axis=1), 1, kind="stable")
        s = np.empty_like(ranked)
        np.put_along_axis(s, order, ranked, 1)
        held = np.fft.rfft(s, axis=1)
        gap = ((np.abs(held) - amp) ** 2).mean((1, 2))
        done = np.abs(before - gap) < tolerance
        if done.any():
            out[open_[done]] = s[done]
            s, held, gap, ranked, amp, push, open_ = (x[~done] for x in (s, held, gap, ranked, amp, push, open_))
            if not len(open_):
                break
        before = gap
    out[open_] = s
    return out.reshape(shape)


def surrogate_test(samples: DataFrame, dims: tuple[str, ...], statistic, n_surrogates: int = 19, seed: int = 0, min_samples: int = 8) -> DataFrame:
    """Plus-one p-value of each curve's statistic (a function of the value matrix) against its own surrogates.

    Curves with fewer than ``min_samples`` complete samples have too few phases to surrogate: their row has NULLs.  Curves of one
    length are surrogated together, at most ``HELD`` values at a time (one surrogate at least).
    """
    rows = samples.select(CURVE, F.xxhash64(CURVE).alias("_hash"), F.struct("t_idx", *(F.col(d).cast("double").alias(f"d{k}") for k, d in enumerate(dims))).alias("s"))
    arrays = rows.groupBy(CURVE, "_hash").agg(F.array_sort(F.collect_list("s")).alias("s"))
    arrays = arrays.select(CURVE, "_hash", *(F.col(f"s.d{k}").alias(f"d{k}") for k in range(len(dims)))).repartition(tasks(samples))

    def run(batches):
        for b in batches:
            ends = np.asarray(b.column(2).offsets) - b.column(2).offsets[0].as_py()
            flat = np.stack([floats(b.column(k)) for k in range(2, b.num_columns)], 1)
            values = [x[~np.isnan(x).any(1)] for x in np.split(flat, ends[1:-1])] if len(b) else []
            size, hashes = np.array([len(x) for x in values], int), np.asarray(b.column(1))
            observed, p = [None] * len(b), [None] * len(b)
            for n in np.unique(size[size >= min_samples]):
                same = np.flatnonzero(size == n)
                some = max(1, HELD // (n * len(dims) * n_surrogates))
                for at in (same[k : k + some] for k in range(0, len(same), some)):
                    draw = [np.random.default_rng([seed, int(hashes[c]) & 0x7FFFFFFF]) for c in at]
                    seen, hits = [float(statistic(values[c])) for c in at], np.zeros(len(at), int)
                    group = max(1, HELD // (n * len(dims) * len(at)))
                    for k in range(0, n_surrogates, group):
                        starts = np.stack([[rng.permutation(n) for _ in range(min(group, n_surrogates - k))] for rng in draw])
                        null = iaaft_many(np.stack([values[c] for c in at]), starts)
                        hits += [sum(statistic(x) >= o for x in surrogates) for o, surrogates in zip(seen, null, strict=True)]
                    for c, o, h in zip(at, seen, hits, strict=True):
                        observed[c], p[c] = o, (1 + int(h)) / (n_surrogates + 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(observed, pa.float64()), pa.array(p, pa.float64())], [CURVE, "observed", "p_value"])

    return arrays.mapInArrow(run, f"curve_id {dict(samples.dtypes)[CURVE]}, observed double, p_value double")


def time_reversal(v: np.ndarray) -> float:
    """Asymmetry under time reversal of the first column, a statistic of nonlinearity."""
    d = np.diff(v[:, 0])
    return float(abs((d**3).mean()) / max(float((d**2).mean()) ** 1.5, 1e-300))
