"""Profiles of a series: periods, window statistics, entropy, histograms (inventory PRF1-PRF13)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import let, vmean, vsumsq
from ..plans.attach import attach
from ..plans.chunks import key_schema, over_windows
from ..plans.ordered import cumulate, framed, halo
from ..session import cut
from .windows import KEYS


def autocorrelation(
    df: DataFrame, value: str, lags: int = 400, first: int | None = None, keys: Sequence[str] = KEYS, size=None
) -> DataFrame:
    """(keys, lag, acf) for lags 0..lags: products divided by the total sum of squares.

    All rows count; ``first=20_000`` gives the figures of the benchmark, which stops there. A chunk sees the next ``lags`` rows and returns one partial sum per lag, so the rows are not multiplied by the lags.
    """
    s = df.select(*keys, "t", F.col(value).cast("double").alias("x"))
    if first is not None:
        s = s.filter(F.col("t") < first)
    stats = s.groupBy(*keys).agg(F.avg("x").alias("_mu"), F.count(F.lit(1)).alias("_n"))
    s = attach(s, stats, keys).withColumn("x", F.col("x") - F.col("_mu"))
    chunked = halo(s.drop("_mu"), keys, "t", 0, lags, size)
    names = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        x, own = pdf["x"].to_numpy(), int(pdf["_own"].sum())
        top = min(lags, int(pdf["_n"].iloc[0]) - 1)
        sums = np.zeros(top + 1)
        for lag in range(top + 1):
            end = min(own, len(x) - lag)
            if end > 0:
                sums[lag] = x[:end] @ x[lag : lag + end]
        out = pd.DataFrame({"lag": np.arange(top + 1), "v": sums})
        for k in names:
            out[k] = pdf[k].iloc[0]
        return out[[*names, "lag", "v"]] if own else out.iloc[:0][[*names, "lag", "v"]]

    parts = chunked.groupBy(*names, "_chunk").applyInPandas(run, f"{key_schema(df, keys)}, lag int, v double")
    sums = parts.groupBy(*keys, "lag").agg(F.sum("v").alias("v"))
    # at most lags + 1 rows per key from here on
    total = F.max(F.when(F.col("lag") == 0, F.col("v"))).over(Window.partitionBy(*keys))
    return sums.select(*keys, "lag", F.try_divide(F.col("v"), total).alias("acf"))


def period(
    df: DataFrame, value: str, rank: int = 1, keys: Sequence[str] = KEYS, channels: int = 1, lags: int = 400, size=None,
    first: int | None = None,
) -> DataFrame:
    """(keys, period): lag of the highest strict local maximum of the autocorrelation from lag 3 on.

    Out-of-range or missing peaks give 125, several channels 0, rank 0 gives 1.  Rank 2 (3) takes the next best peak at a larger lag.
    """
    everyone = df.select(*keys).distinct()
    if channels > 1:
        return everyone.withColumn("period", F.lit(0))
    if rank == 0:
        return everyone.withColumn("period", F.lit(1))
    a = autocorrelation(df, value, lags, first, keys, size).filter("lag >= 3").withColumn("i", F.col("lag") - 3)
    w = Window.partitionBy(*keys).orderBy("i")
    peaks = a.withColumn("_p", F.lag("acf").over(w)).withColumn("_n", F.lead("acf").over(w))
    peaks = peaks.filter("acf > _p AND acf > _n")
    best = F.max_by("i", F.struct("acf", "i"))
    out = peaks.groupBy(*keys).agg(best.alias("i"))
    for _ in range(rank - 1):
        later = attach(peaks.select(*keys, F.col("i").alias("j"), "acf"), out, keys).filter("j > i")
        nxt = later.groupBy(*keys).agg(F.max_by("j", F.struct("acf", "j")).alias("_nx"))
        out = out.join(nxt, list(keys), "left").select(*keys, F.coalesce("_nx", "i").alias("i"))
    inside = (F.col("i") >= 3) & (F.col("i") <= 300)
    return everyone.join(out, list(keys), "left").select(
        *keys, F.when(inside, F.col("i") + 3).otherwise(F.lit(125)).alias("period")
    )


def dominant_periods(
    df: DataFrame, channels: Sequence[str], window: int, k: int = 2, keys: Sequence[str] = KEYS, stride: int | None = None,
    size=None,
) -> DataFrame:
    """(keys, rank, freq, period, amplitude): strongest frequencies by mean amplitude over windows and channels."""
    half = window // 2 + 1

    def amplitudes(w, t, model):
        return {"a": list(np.abs(np.fft.rfft(w, axis=1)).mean(2))}

    amp = over_windows(df, channels, window, amplitudes, "a array<double>", keys, stride or window, size)
    mean = amp.select(*keys, F.posexplode("a").alias("freq", "a")).groupBy(*keys, "freq").agg(F.avg("a").alias("amplitude"))
    mean = mean.filter((F.col("freq") > 0) & (F.col("freq") < half))
    top = Window.partitionBy(*keys).orderBy(F.round("amplitude", 9).desc(), "freq")
    return (
        mean.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
        .select(*keys, "rank", "freq", F.floor(F.lit(window) / F.col("freq")).cast("int").alias("period"), "amplitude")
    )


def window_stats(df: DataFrame, value: str, window: int, keys: Sequence[str] = KEYS, size=None) -> DataFrame:
    """Statistics over the last ``window`` points: mean, var, skew, kurt (bias-corrected), max, min, lag-1 autocorrelation."""
    n = float(window)
    fr = lambda w: w.rowsBetween(-(window - 1), 0)
    exprs = {
        "_cnt": lambda w: F.count(F.lit(1)).over(fr(w)),
        "mean": lambda w: F.avg(value).over(fr(w)),
        "var": lambda w: F.var_samp(value).over(fr(w)),
        "_g1": lambda w: F.skewness(value).over(fr(w)),
        "_g2": lambda w: F.kurtosis(value).over(fr(w)),
        "max": lambda w: F.max(value).over(fr(w)),
        "min": lambda w: F.min(value).over(fr(w)),
        "_win": lambda w: F.collect_list(F.col(value).cast("double")).over(fr(w)),
    }
    out = framed(df.select(*keys, "t", value), keys, "t", window - 1, 0, exprs, size).filter(F.col("_cnt") == window)
    skew = F.lit(np.sqrt(n * (n - 1)) / (n - 2)) * F.col("_g1")
    kurt = F.lit((n - 1) / ((n - 2) * (n - 3))) * (F.lit(n + 1) * F.col("_g2") + F.lit(6.0))
    return out.select(
        *keys, "t", F.col(value).alias("value"), "mean", "var", skew.alias("skew"), kurt.alias("kurt"), "max", "min",
        lag_autocorrelation(F.col("_win"), 1).alias("acf1"),
    )


def lag_autocorrelation(x: Column, lag: int = 1) -> Column:
    """Sum of (x_i - m)(x_{i+lag} - m) over (n - lag) * variance of one array; NULL for a constant one."""
    n = F.size(x)
    rest = F.greatest(n - lag, F.lit(0))

    def products(mu: Column) -> Column:
        pairs = F.zip_with(F.slice(x, F.lit(1), rest), F.slice(x, F.lit(lag + 1), rest), lambda a, b: (a - mu) * (b - mu))
        return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)

    var = vsumsq(x, vmean(x)) / n
    return let(var, lambda v: F.when(v > 1e-8, let(vmean(x), products) / ((n - lag) * v)))


def _close_pairs(x: np.ndarray, starts: np.ndarray, window: int, tol: np.ndarray, length: int) -> np.ndarray:
    """For each window of a line: pairs of its ``length``-row templates that differ nowhere by more than the window's tolerance.

    A pair's gap does not depend on the window. Of all pairs with one lag, those within the least tolerance are counted in running sums, which a window moves along by
    adding and dropping ends; only gaps between the least and the largest tolerance are compared window by window.
    """
    out = np.zeros(len(starts), np.int64)
    if np.isnan(tol).all():
        return out
    least, most = np.nanmin(tol), np.nanmax(tol)
    for lag in range(1, window - length + 1):
        each = np.abs(x[lag:] - x[:-lag])
        gap = each[:len(each) - length + 1]
        for k in range(1, length):
            gap = np.maximum(gap, each[k:len(each) - length + 1 + k])
        stops = starts + window - length - lag + 1
        sure = np.concatenate([[0], np.cumsum(gap <= least)])
        out += sure[stops] - sure[starts]
        open_ = np.flatnonzero((gap > least) & (gap <= most))
        if len(open_):
            out += ((gap[open_] <= tol[:, None]) & (open_ >= starts[:, None]) & (open_ < stops[:, None])).sum(1)
    out[np.isnan(tol)] = 0
    return out


def _sample_entropy(w: np.ndarray, m: int = 2, block: int = 256) -> np.ndarray:
    """Sample entropy of each row of a (N, w) matrix; rows that overlap like windows of one line are counted together."""
    n, window = w.shape
    tol, out = 0.2 * w.std(axis=1), np.full(n, np.nan)
    if window <= m or not n:
        return out
    # The shift that turns one row into the next, if there is one.
    follows = lambda s, k: np.array_equal(w[1:k, :-s], w[:k - 1, s:], equal_nan=True)
    shift = next((s for s in range(1, min(window, 64)) if n > 1 and follows(s, 2) and follows(s, n)), window)
    for lo in range(0, n, block if shift < window else 1):
        rows = w[lo:lo + block] if shift < window else w[lo:lo + 1]
        line = np.concatenate([rows[0], rows[1:, window - shift:].ravel()])
        starts = np.arange(len(rows)) * shift
        near, nearer = (_close_pairs(line, starts, window, tol[lo:lo + len(rows)], length) for length in (m, m + 1))
        some = (near > 0) & (nearer > 0)
        out[lo:lo + len(rows)][some] = -np.log(nearer[some] / near[some])
    return out


def sample_entropy(df: DataFrame, value: str, window: int, keys: Sequence[str] = KEYS, stride: int = 1, size=None):
    """(keys, t, sampen) per window begin; NULL when no pair matches."""
    out = over_windows(
        df, [value], window, lambda w, t, m: {"sampen": _sample_entropy(w[:, :, 0])}, "sampen double", keys, stride, size
    )
    return out.withColumn("sampen", F.when(~F.isnan("sampen"), F.col("sampen")))


def ar_coefficients(df: DataFrame, value: str, window: int, k: int = 5, keys: Sequence[str] = KEYS, stride=1, size=None):
    """(keys, t, ar): intercept and k coefficients of a least-squares AR model per window; NULL when singular."""
    def fit(w, t, model):
        x = w[:, :, 0]
        lagged = np.stack([x[:, k - j - 1 : x.shape[1] - j - 1] for j in range(k)], axis=2)
        a = np.concatenate([np.ones((*lagged.shape[:2], 1)), lagged], axis=2)
        y = x[:, k:]
        g = np.einsum("nij,nik->njk", a, a)
        r = np.einsum("nij,ni->nj", a, y)
        ok = np.linalg.cond(g) < 1e12
        coef = np.full(r.shape, np.nan)
        if ok.any():
            coef[ok] = np.linalg.solve(g[ok], r[ok][:, :, None])[:, :, 0]
        return {"ar": [c if np.isfinite(c).all() else None for c in coef]}

    return over_windows(df, [value], window, fit, "ar array<double>", keys, stride, size)


def hurst(
    df: DataFrame, value: str, lengths: Sequence[int] = (8, 16, 32, 64, 128), keys: Sequence[str] = KEYS
) -> DataFrame:
    """(keys, hurst, const): slope of log(R/S) on log(length) over dyadic blocks.

    Each block is a bounded group: the range of its cumulative deviation over its population deviation.
    """
    s = df.select(*keys, "t", F.col(value).cast("double").alias("x")).withColumn(
        "m", F.explode(F.array(*[F.lit(m) for m in lengths]))
    ).withColumn("b", F.floor(F.col("t") / F.col("m")))
    at = [*keys, "m", "b"]
    whole = Window.partitionBy(*at)
    s = s.withColumn("_dev", F.col("x") - F.avg("x").over(whole))
    s = s.withColumn("_cum", F.sum("_dev").over(whole.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    block = s.groupBy(*at).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("sd"),
        (F.greatest(F.max("_cum"), F.lit(0.0)) - F.least(F.min("_cum"), F.lit(0.0))).alias("r"),
    ).filter((F.col("n") == F.col("m")) & (F.col("sd") > 0))
    rs = block.groupBy(*keys, "m").agg(F.avg(F.col("r") / F.col("sd")).alias("rs"))
    y, x = F.ln("rs"), F.ln(F.col("m").cast("double"))
    return rs.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("hurst"), F.exp(F.regr_intercept(y, x)).alias("const")
    )


def decompose(df: DataFrame, value: str, freq: int, keys: Sequence[str] = KEYS, size=None) -> DataFrame:
    """Additive parts trend (centred moving average), seasonal (phase means, sum zero) and resid; trend is NULL at the ends."""
    half = freq // 2
    fr = lambda w: w.rowsBetween(-half, half)
    ends = lambda w: (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2
    exprs = {
        "_cnt": lambda w: F.count(F.lit(1)).over(fr(w)),
        "_sum": lambda w: F.sum(value).over(fr(w)),
    }
    if freq % 2 == 0:
        exprs["_ends"] = ends
    out = framed(df.select(*keys, "t", value), keys, "t", half, half, exprs, size)
    total = F.col("_sum") - F.col("_ends") if freq % 2 == 0 else F.col("_sum")
    trend = F.when(F.col("_cnt") == 2 * half + 1, total / freq)
    out = out.withColumn("trend", trend).withColumn("_phase", F.col("t") % freq).select(*keys, "t", value, "trend", "_phase")
    phase = out.groupBy(*keys, "_phase").agg(F.avg(F.col(value) - F.col("trend")).alias("_s"))
    centre = F.avg("_s").over(Window.partitionBy(*keys))  # one row per phase
    phase = phase.withColumn("seasonal", F.col("_s") - centre).drop("_s")
    return attach(out, phase, [*keys, "_phase"]).withColumn(
        "resid", F.col(value) - F.col("trend") - F.col("seasonal")
    ).drop("_phase")


def stepped_features(df: DataFrame, value: str, window: int, step: int, keys: Sequence[str] = KEYS, size=None) -> DataFrame:
    """Window statistics at every ``step``-th point, held until the next one."""
    if step > window // 2:
        raise ValueError("the step must not be larger than half of the window")
    f = window_stats(df, value, window, keys, size).filter(F.col("t") % step == 0).drop("value")
    held = df.select(*keys, "t", value).withColumn("_at", (F.floor(F.col("t") / step) * step).cast("long"))
    return held.join(f.withColumn("_at", F.col("t").cast("long")).drop("t"), [*keys, "_at"]).drop("_at")


def histogram(long: DataFrame, bins: int, keys: Sequence[str] = ("series_id", "channel"), value: str = "x") -> DataFrame:
    """(keys, bin, n, density): equal-width bins, left-closed, the last one closed; empty bins are absent."""
    lim = long.groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    span = F.col("_hi") - F.col("_lo")
    b = F.least(F.floor((F.col(value) - F.col("_lo")) / span * bins), F.lit(bins - 1)).cast("int")
    placed = attach(long, lim, keys).withColumn("bin", F.when(span > 0, b).otherwise(F.lit(bins // 2)))
    counts = placed.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.max("_n").alias("_n"), F.max(span).alias("_span")
    )
    width = F.when(F.col("_span") > 0, F.col("_span")).otherwise(F.lit(1.0)) / bins
    return counts.select(*keys, "bin", "n", (F.col("n") / (F.col("_n") * width)).alias("density"))


def histogram_entropy(hist: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """-sum p log2 p over the bins."""
    total = hist.groupBy(*keys).agg(F.sum(count).alias("_t"))
    p = F.col(count) / F.col("_t")
    return attach(hist, total, keys).groupBy(*keys).agg(
        F.sum(F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))).alias("entropy")
    )


def feature_weight(long: DataFrame, bins: int, keys: Sequence[str] = ("series_id", "channel"), value: str = "x") -> DataFrame:
    """1 - entropy / log2(bins); constant features weigh 0."""
    e = histogram_entropy(histogram(long, bins, keys, value), keys)
    lim = long.groupBy(*keys).agg((F.min(value) == F.max(value)).alias("_const"))
    return e.join(lim, list(keys)).select(
        *keys, F.when(F.col("_const"), F.lit(0.0)).otherwise(1 - F.col("entropy") / np.log2(bins)).alias("weight")
    )


def optimal_bins(
    long: DataFrame, keys: Sequence[str] = ("series_id", "channel"), value: str = "x", upper: int | None = None,
    epsilon: float = 1.0, per_range: int | None = None,
) -> DataFrame:
    """(keys, bins): bin count with the largest penalised likelihood, tried from 1 to sqrt(n) - 1 (or below ``upper``).

    All histograms together have about n / 2 edges.  The edges are ranked among the values in one ordered pass, and the count
    of a bin is the difference of two ranks, so the rows are not repeated for every bin count.
    """
    x = F.col(value).cast("double")
    lim = cut(long.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(F.lit(1)).alias("_n")))
    top = F.lit(upper - 1) if upper else F.floor(F.sqrt("_n")).cast("int") - 1
    tried = lim.withColumn("b", F.explode(F.sequence(F.lit(1), F.greatest(top, F.lit(1))))).repartition(*keys, "b")
    edge = F.col("_lo") + F.col("i") * ((F.col("_hi") - F.col("_lo")) / F.col("b"))
    edges = tried.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("b")))).withColumn("v", edge)
    inner = edges.filter((F.col("i") > 0) & (F.col("i") < F.col("b")))
    both = long.select(*keys, x.alias("v"), F.lit(1).alias("_w")).unionByName(inner.select(*keys, "v").distinct().withColumn("_w", F.lit(0)))
    c = cumulate(both, keys, "v", {"w": F.sum("_w")}, per_range)
    ranked = inner.join(c.select(*keys, "v", (F.col("cum_w") - F.col("w")).alias("below")), [*keys, "v"]).select(*keys, "b", "i", "below", "_n")
    ends = edges.filter((F.col("i") == 0) | (F.col("i") == F.col("b"))).select(
        *keys, "b", "i", F.when(F.col("i") == 0, F.lit(0)).otherwise(F.col("_n")).cast("long").alias("below"), "_n")
    w = Window.partitionBy(*keys, "b").orderBy("i")
    counts = ranked.unionByName(ends).withColumn("n", F.col("below") - F.lag("below").over(w)).filter("i > 0")
    # the penalty counts once per bin, empty bins included
    fit = F.sum(F.when(F.col("n") > 0, F.col("n") * F.ln(F.col("b") * F.col("n") / F.col("_n") + F.lit(epsilon))).otherwise(F.lit(0.0)))
    per_b = counts.groupBy(*keys, "b").agg(fit.alias("f"))
    penalty = F.col("b") * (F.col("b") - 1 + F.pow(F.ln(F.col("b").cast("double")), F.lit(2.5)))
    per_b = per_b.withColumn("score", F.col("f") - penalty)
    return per_b.groupBy(*keys).agg(F.min_by("b", F.struct(-F.col("score"), F.col("b"))).alias("bins"))
