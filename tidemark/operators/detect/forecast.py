"""Forecast residuals (inventory DET13): linear autoregressions learnt from sums over the train windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from ...plans.chunks import over_windows, solve_per_key, unpack, window_moments
from ...session import cut
from ..scale import split_zscore
from ..windows import front_pad

KEYS = ("series_id",)


def dilated_lags(window: int) -> list[int]:
    """1, 2, 4, ... up to the window."""
    out, lag = [], 1
    while lag <= window:
        out.append(lag)
        lag *= 2
    return out


def _dilated(w: np.ndarray) -> np.ndarray:
    n = w.shape[1] - 1
    return np.concatenate([w[:, n - lag] for lag in dilated_lags(n)], axis=1)


def _full(w: np.ndarray, decays=(0.5, 0.9)) -> np.ndarray:
    n = w.shape[1] - 1
    past = w[:, :n]
    states = [np.einsum("ijk,j->ik", past, (1 - a) * a ** np.arange(n - 1, -1, -1)) for a in decays]
    return np.concatenate([past.reshape(len(w), -1), *states], axis=1)


FEATURES = {"dilated": _dilated, "full": _full}


def ridge(m: np.ndarray, targets: int, strength: float) -> np.ndarray:
    """Coefficients (features + 1, targets) of centred ridge regression from packed moments of [features, targets]."""
    n, mean, cov = unpack(m)
    q = len(mean) - targets
    a = cov[:q, :q] + strength * np.eye(q)
    coef = np.linalg.solve(a, cov[:q, q:])
    return np.vstack([coef, mean[q:] - mean[:q] @ coef])


def forecast_fit(
    train: DataFrame, channels: Sequence[str], window: int, features: str = "dilated", strength: float = 1e-3,
    keys: Sequence[str] = KEYS, size=None,
) -> DataFrame:
    make = FEATURES[features]
    d = len(channels)
    m = window_moments(
        train, channels, window + 1, lambda w, _m: np.concatenate([make(w), w[:, -1]], axis=1), keys, size=size
    )
    return cut(solve_per_key(m, lambda row: {"coef": ridge(row["m"], d, strength).ravel().tolist()}, "coef array<double>", keys))


def forecast_score(
    df: DataFrame, channels: Sequence[str], window: int = 100, features: str = "dilated", train: DataFrame | None = None,
    strength: float = 1e-3, keys: Sequence[str] = KEYS, size=None,
) -> DataFrame:
    """(keys, t, score): mean over the channels of the squared error of the next row, shifted by the window."""
    make = FEATURES[features]
    d = len(channels)
    base = split_zscore(df if train is None else train, channels, keys)
    test = split_zscore(df, channels, keys)
    model = forecast_fit(base, channels, window, features, strength, keys, size)

    def score(w, t, m):
        coef = np.asarray(m["coef"]).reshape(-1, d)
        err = make(w) @ coef[:-1] + coef[-1] - w[:, -1]
        return {"score": (err**2).mean(1)}

    scored = over_windows(test, channels, window + 1, score, "score double", keys, size=size, models=model)
    return front_pad(df, scored, window + 1, 0, keys)
