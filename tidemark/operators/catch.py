"""The 22 canonical time-series characteristics (Lubba et al., 2019) and their spread over the channels (inventory AGG23).

A series is first cut to its middle 25 000 rows and short ones are repeated, both in Spark, so that a group (one channel of one series) is
bounded.  The features of all groups are computed in parallel and summarised by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.chunks import key_schema
from .clean import centre_cut, drop_constant, melt, nan_inf_to_zero, repeat_short

KEYS = ("series_id",)

# Published names; fixed values.
NAMES = (
    "DN_HistogramMode_5", "DN_HistogramMode_10", "CO_f1ecac", "CO_FirstMin_ac", "CO_HistogramAMI_even_2_5", "CO_trev_1_num",
    "MD_hrv_classic_pnn40", "SB_BinaryStats_mean_longstretch1", "SB_TransitionMatrix_3ac_sumdiagcov", "PD_PeriodicityWang_th0_01",
    "CO_Embed2_Dist_tau_d_expfit_meandiff", "IN_AutoMutualInfoStats_40_gaussian_fmmi", "FC_LocalSimple_mean1_tauresrat",
    "DN_OutlierInclude_p_001_mdrmd", "DN_OutlierInclude_n_001_mdrmd", "SP_Summaries_welch_rect_area_5_1",
    "SB_BinaryStats_diff_longstretch0", "SB_MotifThree_quantile_hh", "SC_FluctAnal_2_rsrangefit_50_1_logi_prop_r1",
    "SC_FluctAnal_2_dfa_50_1_2_logi_prop_r1", "SP_Summaries_welch_rect_centroid", "FC_LocalSimple_mean3_stderr",
)


def _acf(y: np.ndarray) -> np.ndarray:
    z = y - y.mean()
    size = 1 << (2 * len(z) - 1).bit_length()
    f = np.fft.rfft(z, size)
    a = np.fft.irfft(f * np.conj(f), size)[: len(z)]
    return a / a[0] if a[0] > 0 else np.zeros(len(z))


def _first_zero(ac: np.ndarray) -> int:
    below = np.flatnonzero(ac <= 0)
    return int(below[0]) if len(below) else len(ac)


def _mode(y: np.ndarray, bins: int) -> float:
    n, edges = np.histogram(y, bins)
    centres = (edges[:-1] + edges[1:]) / 2
    return float(centres[n == n.max()].mean())


def _gap(stop: np.ndarray) -> int:
    """Longest distance between stops, the first and the last position included."""
    at = np.concatenate([[0], np.flatnonzero(stop), [len(stop) - 1]])
    return int(np.diff(at).max()) if len(at) > 1 else 0


def _thirds(y: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.quantile(y, [1 / 3, 2 / 3]), y, side="left")


def _transition(y: np.ndarray, ac: np.ndarray) -> float:
    z = _thirds(y[:: max(_first_zero(ac), 1)])
    if len(z) < 3:
        return 0.0
    t = np.zeros((3, 3))
    np.add.at(t, (z[:-1], z[1:]), 1)
    return float(np.var(t / (len(z) - 1), axis=0, ddof=1).sum())


def _mutual(y: np.ndarray) -> float:
    lo, step = y.min() - 0.1, (np.ptp(y) + 0.2) / 5
    b = np.floor((y - lo) / step).astype(int)
    p = np.zeros((5, 5))
    np.add.at(p, (b[:-2], b[2:]), 1)
    p /= p.sum()
    outer = p.sum(1)[:, None] * p.sum(0)[None]
    on = p > 0
    return float((p[on] * np.log(p[on] / outer[on])).sum())


def _periodicity(y: np.ndarray) -> float:
    n = len(y)
    t = np.linspace(0, 1, n)
    basis = np.stack([np.ones(n), t, t**2, t**3, np.maximum(t - 0.5, 0) ** 3], axis=1)
    z = y - basis @ np.linalg.lstsq(basis, y, rcond=None)[0]
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(z, size)
    top = -(-n // 3)
    ac = np.fft.irfft(f * np.conj(f), size)[1 : top + 1] / (n - np.arange(1, top + 1))
    rise = np.diff(ac)
    trough = None
    for i in range(1, len(ac) - 1):
        if rise[i - 1] < 0 < rise[i]:
            trough = i
        elif rise[i - 1] > 0 > rise[i] and trough is not None and ac[i] >= 0 and ac[i] - ac[trough] >= 0.01:
            return float(i)
    return 0.0


def _embedding(y: np.ndarray, ac: np.ndarray) -> float:
    tau = max(1, min(_first_zero(ac), len(y) // 10))
    a = np.diff(y)
    d = np.sqrt(a[: len(a) - tau] ** 2 + a[tau:] ** 2)
    mean, sd = d.mean(), d.std(ddof=1)
    if mean <= 0 or sd < 1e-3:
        return 0.0
    bins = max(1, int(np.ceil(np.ptp(d) / (3.5 * sd / len(d) ** (1 / 3)))))
    n, edges = np.histogram(d, bins)
    centre = (edges[:-1] + edges[1:]) / 2
    return float(np.abs(n / len(d) - np.exp(-centre / mean) / mean).mean())


def _gaussian_information(y: np.ndarray) -> float:
    top = min(40, -(-len(y) // 2))
    r = np.array([np.corrcoef(y[:-k], y[k:])[0, 1] for k in range(1, top + 1)])
    ami = -0.5 * np.log(np.maximum(1 - np.nan_to_num(r) ** 2, 1e-300))
    low = np.flatnonzero((ami[1:-1] < ami[:-2]) & (ami[1:-1] < ami[2:]))
    return float(low[0] + 1) if len(low) else float(top)


def _outliers(y: np.ndarray) -> float:
    """Median over rising thresholds of the median position of the points above, -1 (start) to 1 (end)."""
    total = int((y >= 0).sum())
    if total == 0 or y.max() < 0.01:
        return 0.0
    out = []
    for level in np.arange(0, y.max() + 1e-12, 0.01):
        at = np.flatnonzero(y >= level) + 1
        if len(at) < 2 or (len(at) - 1) * 100 / total <= 2:
            break
        out.append(np.median(at) / (len(y) / 2) - 1)
    return float(np.median(out)) if out else 0.0


def _spectrum(y: np.ndarray) -> tuple[float, float]:
    size = 1 << (len(y) - 1).bit_length()
    p = np.abs(np.fft.rfft(y - y.mean(), size)) ** 2 / len(y)
    p[1:-1] *= 2
    w, p = 2 * np.pi * np.arange(len(p)) / size, p / (2 * np.pi)
    area = p[: len(p) // 5].sum() * (w[1] - w[0])
    half = np.searchsorted(np.cumsum(p), p.sum() / 2, side="right")
    return float(area), float(w[min(half, len(w) - 1)])


def _motif(y: np.ndarray) -> float:
    z = _thirds(y)
    p = np.bincount(z[:-1] * 3 + z[1:], minlength=9) / (len(z) - 1)
    p = p[p > 0]
    return float(-(p * np.log(p)).sum())


def _fluctuation(y: np.ndarray, lag: int, dfa: bool) -> float:
    n = len(y)
    taus = np.unique(np.round(np.exp(np.linspace(np.log(5), np.log(n // 2), 50))).astype(int))
    if len(taus) < 12:
        return 0.0
    c = np.cumsum(y[::lag])
    taus = taus[taus <= len(c)]
    logs = []
    for tau in taus:
        part = c[: len(c) // tau * tau].reshape(-1, tau)
        x = np.arange(tau) - (tau - 1) / 2
        part = part - part.mean(1, keepdims=True)
        part = part - (part @ x / (x @ x))[:, None] * x
        v = (part**2).mean() if dfa else (np.ptp(part, axis=1) ** 2).mean()
        logs.append(0.5 * np.log(max(v, 1e-300)))
    t, f = np.log(taus), np.asarray(logs)

    def miss(a, b):
        fit = np.polyfit(t[a:b], f[a:b], 1)
        return np.linalg.norm(f[a:b] - np.polyval(fit, t[a:b]))

    cuts = range(6, len(t) - 5)
    errors = [miss(0, i) + miss(i - 1, len(t)) for i in cuts]
    return float((6 + int(np.argmin(errors))) / len(t)) if errors else 0.0


def characteristics(x: np.ndarray) -> np.ndarray:
    """The 22 values of one z-scored channel, in the order of NAMES."""
    sd = x.std(ddof=1) if len(x) > 1 else 0.0
    if len(x) < 12 or not sd > 0:
        return np.zeros(len(NAMES))
    y = (x - x.mean()) / sd
    ac, step = _acf(y), np.diff(y)
    low = np.flatnonzero(ac < 1 / np.e)
    i = int(low[0]) - 1 if len(low) else len(ac) - 2
    first = i + (1 / np.e - ac[i]) / (ac[i + 1] - ac[i]) if len(low) else float(len(ac))
    dips = np.flatnonzero((ac[1:-1] < ac[:-2]) & (ac[1:-1] < ac[2:]))
    area, centroid = _spectrum(y)
    ahead = y[3:] - (y[:-3] + y[1:-2] + y[2:-1]) / 3
    return np.array([
        _mode(y, 5), _mode(y, 10), first, float(dips[0] + 1) if len(dips) else float(len(ac)), _mutual(y), float((step**3).mean()),
        float((np.abs(step) * 1000 > 40).mean()), float(_gap(y[:-1] <= 0)), _transition(y, ac), _periodicity(y), _embedding(y, ac),
        _gaussian_information(y), _first_zero(_acf(step)) / max(_first_zero(ac), 1), _outliers(y), _outliers(-y), area,
        float(_gap(step >= 0)), _motif(y), _fluctuation(y, 1, False), _fluctuation(y, 2, True), centroid, float(ahead.std(ddof=1)),
    ])


def catch22(
    df: DataFrame, channels: Sequence[str], keys: Sequence[str] = KEYS, limit: int = 25_000, below: int = 500, upto: int = 1000
) -> DataFrame:
    """(keys, channel, feature, value) after the cleaning of the benchmark: no undefined values, no constant channels, bounded length."""
    clean = nan_inf_to_zero(df.select(*keys, "t", *channels), channels)
    sized = repeat_short(centre_cut(clean, limit, keys), below, upto, keys)
    long = drop_constant(melt(sized, [*keys, "t"], channels), keys)
    names = [*keys, "channel"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = characteristics(pdf.sort_values("t")["x"].to_numpy(dtype=float))
        out = pd.DataFrame({"feature": list(NAMES), "value": np.nan_to_num(v, posinf=0.0, neginf=0.0)})
        for k in names:
            out[k] = pdf[k].iloc[0]
        return out[[*names, "feature", "value"]]

    return long.groupBy(*names).applyInPandas(run, f"{key_schema(long, names)}, feature string, value double")


def catch22_summary(df: DataFrame, channels: Sequence[str], keys: Sequence[str] = KEYS, **kw) -> DataFrame:
    """One row per series: min, quartile, mean, quartile and max over the channels of each feature (110 columns).

    A group holds one value per channel, so the exact percentile aggregate is bounded.
    """
    f = catch22(df, channels, keys, **kw)
    spread = {
        "min": F.min("value"), "q25": F.percentile("value", 0.25), "mean": F.avg("value"), "q75": F.percentile("value", 0.75),
        "max": F.max("value"),
    }
    wide = f.groupBy(*keys).pivot("feature", list(NAMES)).agg(*[c.alias(n) for n, c in spread.items()])
    return wide.select(*keys, *[F.col(f"{n}_{s}") for n in NAMES for s in spread])
