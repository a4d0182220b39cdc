"""Reconstruction residuals (inventory DET14, DET15).

Subspace models are learnt from the Gram matrix of the train windows; the periodic and spectral ones need no training.  Every score is one
value per window and goes back to the points by centre padding or overlap averaging.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...plans.chunks import over_windows, solve_per_key, unpack, window_moments
from ...session import cut
from ..scale import split_zscore
from ..windows import centre_pad, overlap_mean
from .forecast import ridge
from .linear import eigen, pick_rank

KEYS = ("series_id",)


def _flat(w: np.ndarray) -> np.ndarray:
    return w.reshape(len(w), -1)


SUBSPACE = "mean array<double>, v array<double>, k int, k2 int, noise array<double>"


def subspace_fit(
    train: DataFrame, channels: Sequence[str], window: int, prep: Callable, rank: int | float, second: int | float | None = None,
    keys: Sequence[str] = KEYS, size=None,
) -> DataFrame:
    """Mean, leading axes (rank and a second, smaller rank) and the residual variance per element."""
    m = window_moments(train, channels, window, lambda w, _m: prep(w), keys, size=size)

    def solve(row):
        n, mean, cov = unpack(row["m"])
        values, v = eigen(cov)
        # a full basis would rebuild everything: leave at least one direction out
        k = min(pick_rank(values, rank, n), max(len(values) - 1, 1))
        k2 = min(pick_rank(values, second, n), k) if second is not None else k
        rest = np.diag(cov) - ((v[:, :k] ** 2) * values[:k]).sum(1)
        return {"mean": mean.tolist(), "v": v[:, :k].ravel().tolist(), "k": k, "k2": k2, "noise": np.maximum(rest, 1e-6).tolist()}

    return cut(solve_per_key(m, solve, SUBSPACE, keys))


def _project(x: np.ndarray, m: dict, k: int | None = None) -> np.ndarray:
    mean = np.asarray(m["mean"])
    v = np.asarray(m["v"]).reshape(len(mean), -1)
    v = v if k is None else v[:, :k]
    return (x - mean) @ v @ v.T + mean


def _scored(df, train, channels, window, prep, rank, fn, keys, size, second=None, normalise=True, stride=1):
    base = df if train is None else train
    if normalise:
        base, df = split_zscore(base, channels, keys), split_zscore(df, channels, keys)
    model = subspace_fit(base, channels, window, prep, rank, second, keys, size)
    return over_windows(df, channels, window, lambda w, t, m: {"score": fn(prep(w), m, w)}, "score double", keys, stride, size, model)


def row_minmax_np(w: np.ndarray) -> np.ndarray:
    x = _flat(w)
    lo, hi = x.min(1, keepdims=True), x.max(1, keepdims=True)
    return np.divide(x - lo, hi - lo, out=np.zeros_like(x), where=hi > lo)


def autoencoder(df, channels, window: int = 100, rank: int | float = 0.9, train=None, keys=KEYS, size=None) -> DataFrame:
    """Norm of the rank-k residual.  One channel: windows; several channels: one vector per time point."""
    w = window if len(channels) == 1 else 1

    def fn(x, m, _w):
        return np.sqrt(((x - _project(x, m)) ** 2).sum(1))

    out = _scored(df, train, channels, w, row_minmax_np, rank, fn, keys, size, normalise=False)
    return centre_pad(df, out, w, keys) if w > 1 else out


def two_stage(df, channels, window: int = 5, rank: int | float = 0.9, second: int | float = 0.6, train=None, keys=KEYS, size=None):
    """0.1 of the first and 0.9 of the second reconstruction error, mean over the cells."""
    def fn(x, m, _w):
        one = _project(x, m)
        two = _project(one, m, int(m["k2"]))
        return (0.1 * (one - x) ** 2 + 0.9 * (two - x) ** 2).mean(1)

    return centre_pad(df, _scored(df, train, channels, window, _flat, rank, fn, keys, size, second), window, keys)


def window_subspace(df, channels, window: int = 100, rank: int | float = 0.9, train=None, keys=KEYS, size=None) -> DataFrame:
    """Mean squared error over all cells of a window."""
    def fn(x, m, _w):
        return ((x - _project(x, m)) ** 2).mean(1)

    return centre_pad(df, _scored(df, train, channels, window, _flat, rank, fn, keys, size), window, keys)


def last_step(df, channels, window: int = 10, strength: float = 1e-3, train=None, keys=KEYS, size=None) -> DataFrame:
    """Ridge regression of the last row on the window, with a second pass that also sees the error of the step before."""
    d = len(channels)
    base = split_zscore(df if train is None else train, channels, keys)
    test = split_zscore(df, channels, keys)
    one = window_moments(base, channels, window - 1, lambda w, _m: _flat(w), keys, size=size)
    one = cut(solve_per_key(one, lambda r: {"c1": ridge(r["m"], d, strength).ravel().tolist()}, "c1 array<double>", keys))

    def second(w, m):
        c = np.asarray(m["c1"]).reshape(-1, d)
        before = _flat(w[:, : window - 2]) @ c[:-1] + c[-1] - w[:, window - 2]
        return np.concatenate([_flat(w[:, 1 : window - 1]), before, w[:, -1]], axis=1)

    two = window_moments(base, channels, window, second, keys, size=size, models=one)
    two = solve_per_key(two, lambda r: {"c2": ridge(r["m"], d, strength).ravel().tolist()}, "c2 array<double>", keys)
    model = cut(two.join(one, list(keys)))

    def score(w, t, m):
        rows = second(w, m)
        c = np.asarray(m["c2"]).reshape(-1, d)
        return {"score": ((rows[:, :-d] @ c[:-1] + c[-1] - rows[:, -d:]) ** 2).mean(1)}

    scored = over_windows(test, channels, window, score, "score double", keys, size=size, models=model)
    return centre_pad(df, scored, window, keys)


def probabilistic(df, channels, window: int = 100, rank: int | float = 0.8, train=None, keys=KEYS, size=None) -> DataFrame:
    """Sum over the channels of the Gaussian negative log-likelihood of the last row; series shorter than a window score 0."""
    d = len(channels)

    def fn(x, m, _w):
        err, var = (x - _project(x, m))[:, -d:], np.asarray(m["noise"])[-d:]
        return (0.5 * np.log(2 * np.pi * var) + err**2 / (2 * var)).sum(1)

    out = centre_pad(df, _scored(df, train, channels, window, _flat, rank, fn, keys, size), window, keys)
    return out.fillna(0.0, ["score"])


def _instance(w: np.ndarray, ddof: int):
    mu = w.mean(1, keepdims=True)
    sd = np.sqrt(w.var(1, keepdims=True, ddof=ddof) + 1e-5)
    return (w - mu) / sd, mu, sd


def phase_mean(df, channels, window: int = 96, periods: int = 2, train=None, keys=KEYS, size=None) -> DataFrame:
    """Error of the last step against the amplitude-weighted phase means of the strongest periods of the window."""
    def score(w, t, m):
        z, mu, sd = _instance(w, 0)
        amp = np.abs(np.fft.rfft(z, axis=1)).mean(2)
        amp[:, 0] = -1.0
        top = np.argsort(-np.round(amp, 9), axis=1, kind="stable")[:, :periods]
        weight = np.take_along_axis(amp, top, 1)
        total = weight.sum(1, keepdims=True)
        weight = np.divide(weight, total, out=np.full_like(weight, 1.0 / periods), where=total > 0)
        rebuilt = np.zeros(z[:, -1].shape)
        for j in range(periods):
            length = window // np.maximum(top[:, j], 1)
            for p in np.unique(length):
                rows = length == p
                rebuilt[rows] += weight[rows, j][:, None] * z[rows][:, (window - 1) % p :: p].mean(1)
        err = rebuilt * sd[:, 0] + mu[:, 0] - w[:, -1]
        return {"score": (err**2).mean(1)}

    df = split_zscore(df, channels, keys)
    scored = over_windows(df, channels, window, score, "score double", keys, size=size)
    return centre_pad(df, scored, window, keys)


def association(
    df, channels, window: int = 100, rank: int | float = 0.9, sigma: float = 3.0, temperature: float = 50.0, train=None,
    keys=KEYS, size=None,
) -> DataFrame:
    """Reconstruction error of the last step, weighted by how closely its associations follow the time distance."""
    d = len(channels)
    gap = np.abs(np.arange(window)[:, None] - np.arange(window)[None])
    prior = np.exp(-(gap**2) / (2 * sigma**2))
    prior /= prior.sum(1, keepdims=True)

    def fn(x, m, w):
        series = np.einsum("nid,njd->nij", w, w) / np.sqrt(d)
        series = np.exp(series - series.max(2, keepdims=True))
        series /= series.sum(2, keepdims=True)
        a, b = series + 1e-4, prior[None] + 1e-4
        kl = (a * (np.log(a) - np.log(b))).sum(2) + (b * (np.log(b) - np.log(a))).sum(2)
        score = -temperature * kl / window
        score = np.exp(score - score.max(1, keepdims=True))
        score /= score.sum(1, keepdims=True)
        err = ((x - _project(x, m)).reshape(w.shape) ** 2).mean(2)
        return (score * err)[:, -1]

    return centre_pad(df, _scored(df, train, channels, window, _flat, rank, fn, keys, size), window, keys)


def row_subspace(df, channels, window: int = 100, rank: int | float = 0.8, train=None, keys=KEYS, size=None) -> DataFrame:
    """Per-row channel subspace on raw values; last-step error, averaged over the windows that cover a point."""
    def fn(x, m, _w):
        return ((x - _project(x, m)) ** 2).mean(1)

    rows = _scored(df, train, channels, 1, _flat, rank, fn, keys, size, normalise=False)
    # the last step of the window that begins at b is row b + w - 1
    shifted = rows.select(*keys, (F.col("t") - (window - 1)).alias("t"), "score").filter("t >= 0")
    return overlap_mean(df, shifted, window, keys=keys, size=size)


def _segments(w: np.ndarray, segment: int) -> np.ndarray:
    out = np.empty_like(w)
    for a in range(0, w.shape[1], segment):
        out[:, a : a + segment] = _instance(w[:, a : a + segment], 0)[0]
    return out


def segment_subspace(
    df, channels, window: int = 100, segment: int = 25, rank: int | float = 0.9, train=None, keys=KEYS, size=None
) -> DataFrame:
    """Windows normalised segment by segment; rank-k last-step error, averaged over the covering windows."""
    d = len(channels)

    def fn(x, m, _w):
        return ((x - _project(x, m))[:, -d:] ** 2).mean(1)

    scored = _scored(df, train, channels, window, lambda w: _flat(_segments(w, segment)), rank, fn, keys, size)
    return overlap_mean(df, scored, window, keys=keys, size=size)


def low_pass_row(window: int, cutoff: int) -> np.ndarray:
    """Last row of the projection on the frequencies below ``cutoff``."""
    j = np.arange(window)
    out = np.full(window, 1.0 / window)
    for f in range(1, min(cutoff, window // 2 + 1)):
        factor = 1.0 if 2 * f == window else 2.0
        out += factor / window * np.cos(2 * np.pi * f * (window - 1 - j) / window)
    return out


def spectral(df, channels, window: int = 100, cutoff: int | None = None, train=None, keys=KEYS, size=None) -> DataFrame:
    """Error of the last step after keeping only the low frequencies of the instance-normalised window."""
    row = low_pass_row(window, cutoff or max(2, window // 8))

    def score(w, t, m):
        z, mu, sd = _instance(w, 1)
        rebuilt = np.einsum("nwd,w->nd", z, row) * sd[:, 0] + mu[:, 0]
        return {"score": ((rebuilt - w[:, -1]) ** 2).mean(1)}

    scored = over_windows(df, channels, window, score, "score double", keys, size=size)
    return centre_pad(df, scored, window, keys)

