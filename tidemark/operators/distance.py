"""Dissimilarity of two subsequences of equal length (inventory DST1-DST8).

Input is a table of pairs with array columns; plain formulas are Column expressions, the dynamic programs work on a whole Arrow batch of pairs at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import dot
from ..plans.attach import attach, sized
from ..plans.chunks import CHUNK_ROWS, array_moments, collected, key_schema, packed_chunks, solve_per_key, unpack
from ..plans.ordered import framed, halo
from ..session import cut
from .clean import with_length
from .windows import slide

KEYS = ("series_id",)


def window_pairs(df: DataFrame, channel: str, window: int, lag: int, keys: Sequence[str] = KEYS, size=None) -> DataFrame:
    """(keys, t, x, y): every window and the one ``lag`` steps later, cut from one longer window."""
    both = slide(df, [channel], window + lag, keys=keys, out="_b", size=size)
    return both.select(*keys, "t", F.slice("_b", 1, window).alias("x"), F.slice("_b", lag + 1, window).alias("y"))


def lp(x: Column, y: Column, power: float = 2.0) -> Column:
    """Lp norm of the difference over the length."""
    total = F.aggregate(
        F.zip_with(x, y, lambda a, b: F.pow(F.abs(a - b), F.lit(float(power)))), F.lit(0.0), lambda s, v: s + v
    )
    return F.when(F.size(x) > 0, F.pow(total, F.lit(1.0 / power)) / F.size(x)).otherwise(F.lit(0.0))


def lp_neighbourhood(
    pairs: DataFrame, series: DataFrame, channel: str, window: int, neighbourhood: int = 100, power: float = 2.0,
    keys: Sequence[str] = KEYS, size=None,
) -> DataFrame:
    """(keys, t, score): Lp norm over the value range around the window (the window left out) and length^power."""
    reach = neighbourhood + window
    fr = lambda w: F.collect_list(F.col(channel).cast("double")).over(w.rowsBetween(-neighbourhood, reach))
    around = framed(series.select(*keys, "t", channel), keys, "t", neighbourhood, reach, {"_r": fr}, size)
    around = with_length(around.select(*keys, "t", "_r"), keys, "_n")
    half = neighbourhood // 2
    t, n = F.col("t"), F.col("_n")
    inner = (t + half < n) & (t - half > 0)
    late = (t + half >= n) & (t + window < n)
    tail = t + window >= n
    first = F.when(inner, t - half).when(late | tail, n - neighbourhood).otherwise(F.lit(0))
    last = F.when(inner, t + half).when(late, n).when(tail, t).otherwise(t + neighbourhood)
    base = F.greatest(t - neighbourhood, F.lit(0))

    def span(a: Column, b: Column) -> Column:
        length = F.greatest(F.least(b, n) - F.greatest(a, F.lit(0)), F.lit(0)).cast("int")
        start = (F.greatest(a, F.lit(0)) - base + 1).cast("int")
        return F.slice("_r", F.greatest(start, F.lit(1)), length)

    region = F.concat(span(first, t), span(t + window, last))
    around = around.select(*keys, "t", (F.array_max(region) - F.array_min(region)).alias("_d"))
    total = F.aggregate(
        F.zip_with("x", "y", lambda a, b: F.pow(F.abs(a - b), F.lit(float(power)))), F.lit(0.0), lambda s, v: s + v
    )
    out = pairs.join(around, [*keys, "t"])
    score = F.pow(total, F.lit(1.0 / power)) / F.col("_d") / F.pow(F.size("x").cast("double"), F.lit(float(power)))
    return out.select(*keys, "t", F.when(F.col("_d") > 0, score).alias("score"))


def quadratic(pairs: DataFrame, probability: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, t, score): residual * covariance of all residual windows * residual / length, or 1 minus its normal density."""
    r = pairs.select(*keys, "t", F.zip_with("x", "y", lambda a, b: a - b).alias("r"))
    m = array_moments(r, "r", keys)

    def solve(row):
        n, _mean, cov = unpack(row["m"])
        cov = cov * n / max(n - 1, 1)
        if not probability:
            return {"c": cov.tolist(), "k": 0.0}
        sign, logdet = np.linalg.slogdet(cov)
        if sign <= 0:
            return None
        return {"c": np.linalg.inv(cov).tolist(), "k": float(-0.5 * (len(cov) * np.log(2 * np.pi) + logdet))}

    both = attach(r, solve_per_key(m, solve, "c array<array<double>>, k double", keys), keys)
    form = dot(F.transform("c", lambda row: dot(row, F.col("r"))), F.col("r"))
    score = F.greatest(1 - F.exp(F.col("k") - form / 2), F.lit(0.0)) if probability else form / F.size("r")
    return both.select(*keys, "t", score.alias("score"))


def volatility_weighted(
    series: DataFrame, value: str, estimate: str, window: int, decay: float = 0.94, keys: Sequence[str] = KEYS, size=None
) -> DataFrame:
    """(keys, t, score) per window begin: mean absolute error over an exponentially weighted volatility.

    Weights below 1e-12 are left out, so a chunk needs a bounded past.
    """
    past = int(np.ceil(np.log(1e-12) / np.log(decay)))
    chunked = halo(series.select(*keys, "t", value, estimate), keys, "t", past, window - 1, size)
    names = list(keys)
    cols = [*names, "t", "score"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        err = (pdf[value] - pdf[estimate]).to_numpy(dtype=float)
        weights = (1 - decay) * decay ** np.arange(past + 1)
        total = np.convolve(np.ones(len(err)), weights)[: len(err)]
        sigma = np.sqrt(np.convolve(err**2, weights)[: len(err)] / total)
        ratio = np.divide(np.abs(err), sigma, out=np.zeros(len(err)), where=sigma > 0)
        c = np.concatenate([[0.0], np.cumsum(ratio)])
        out = pdf[[*names, "t"]].copy()
        score = np.full(len(pdf), np.nan)
        if len(pdf) >= window:
            score[: len(pdf) - window + 1] = (c[window:] - c[:-window]) / window
        out["score"] = score
        return out[pdf["_own"].to_numpy() & np.isfinite(score)][cols]

    kind = series.schema["t"].dataType.simpleString()
    return chunked.groupBy(*names, "_chunk").applyInPandas(run, f"{key_schema(series, keys)}, t {kind}, score double")


# Bounds of the fitted volatility: -log(1 - persistence), and alpha's share of the persistence.
_LEAST_Q, _MOST_Q = 0.01, 7.6
_MEMORY = int(np.ceil(np.log(1e-12) / np.log1p(-np.exp(-_MOST_Q))))


def _coefficients(q: np.ndarray, share: np.ndarray, variance: float):
    """omega, alpha, beta; omega is such that the long-run variance is the one of the errors."""
    p = 1 - np.exp(-q)
    return variance * (1 - p), p * share, p * (1 - share)


def _variances(e2: np.ndarray, first: np.ndarray, omega, alpha, beta) -> np.ndarray:
    """Conditional variances before each of the squared errors and after the last, one column per candidate."""
    out = np.empty((len(e2) + 1, len(first)))
    out[0] = first
    for i, x in enumerate(e2):
        out[i + 1] = omega + alpha * x + beta * out[i]
    return out


def _candidates(row) -> tuple:
    return _coefficients(np.asarray(row["q"], dtype=float), np.asarray(row["share"], dtype=float), row["variance"])


def _entry_variances(chunks: DataFrame, models: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """(keys, _chunk, first): conditional variance of every candidate at the begin of each chunk.

    A chunk maps the variance at its begin to that of the next by ``scale * v + shift``; the maps of the chunks before are composed. Those so
    far back that their weight is below 1e-12 are left out, so a fold has a bounded length.
    """
    names = list(keys)

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                omega, alpha, beta = _candidates(row)
                e2 = (np.asarray(row["c0"], dtype=float) - row["mean"]) ** 2
                shift = np.zeros(len(beta))
                for x in e2:
                    shift = omega + alpha * x + beta * shift
                out.append({**{k: row[k] for k in (*names, "_chunk", "variance")}, "scale": beta ** len(e2), "shift": shift})
            yield pd.DataFrame(out, columns=[*names, "_chunk", "variance", "scale", "shift"])

    maps = chunks.join(models, names).mapInPandas(run, f"{key_schema(chunks, keys)}, _chunk long, variance double, scale array<double>, shift array<double>")
    back = Window.partitionBy(*names).orderBy("_chunk").rowsBetween(-max(1, -(-_MEMORY // size)), -1)
    before = maps.select(*names, "_chunk", F.transform("shift", lambda _: F.col("variance")).alias("v"), F.collect_list(F.struct("scale", "shift")).over(back).alias("_maps"))
    step = lambda acc, m: F.zip_with(F.zip_with(acc, m["scale"], lambda v, a: v * a), m["shift"], lambda v, b: v + b)
    return before.select(*names, "_chunk", F.aggregate("_maps", F.col("v"), step).alias("first"))


def _with_entry(chunks, models, keys, size):
    return chunks.join(sized(_entry_variances(chunks, models, keys, size)), [*keys, "_chunk"]).join(models, list(keys))


def _errors(series: DataFrame, value: str, estimate: str, keys: Sequence[str]) -> DataFrame:
    e = (F.col(value) - F.col(estimate)).cast("double")
    return series.select(*keys, "t", e.alias("e")).filter(F.col("e").isNotNull() & ~F.isnan("e"))


def volatility_fit(series: DataFrame, value: str, estimate: str, keys: Sequence[str] = KEYS, size: int | None = None, grid: int = 9, tolerance: float = 1e-4) -> DataFrame:
    """(keys, mean, variance, omega, alpha, beta, likelihood): a GARCH(1, 1) volatility of the errors of every series, by maximum likelihood.

    variance(t + 1) = omega + alpha * (e(t) - mean)^2 + beta * variance(t), from the variance of all errors, which is also the long-run variance
    (omega follows from alpha and beta). The Gaussian likelihood of a grid of candidates is summed over chunks; the grid then shrinks around
    the best one until it is narrower than ``tolerance``. Rows are packed once and not shuffled again; the number of passes does not depend
    on the data. Errors that are missing are left out; a series without two different errors has no row.
    """
    names, size = list(keys), size or CHUNK_ROWS
    errors = _errors(series, value, estimate, keys)
    chunks = packed_chunks(errors, ["e"], 1, keys, size)
    known = cut(errors.groupBy(*names).agg(F.avg("e").alias("mean"), F.var_pop("e").alias("variance"), F.count("*").alias("n")).filter("n > 1 AND variance > 0"))
    return _fit(chunks, known, keys, size, grid, tolerance)


def _fit(chunks: DataFrame, known: DataFrame, keys: Sequence[str], size: int, grid: int, tolerance: float) -> DataFrame:
    names = list(keys)

    def around(row, wide: float) -> dict:
        q = np.clip(row["at_q"] + np.linspace(-wide, wide, grid) * (_MOST_Q - _LEAST_Q) / 2, _LEAST_Q, _MOST_Q)
        share = np.clip(row["at_share"] + np.linspace(-wide, wide, grid) / 2, 0.0, 1.0)
        return {"mean": row["mean"], "variance": row["variance"], "q": np.repeat(q, grid), "share": np.tile(share, grid)}

    def likelihood(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                e2 = (np.asarray(row["c0"], dtype=float) - row["mean"]) ** 2
                first, total = np.asarray(row["first"], dtype=float), 0.0
                coefficients = _candidates(row)
                for lo in range(0, len(e2), 4096):
                    part = e2[lo:lo + 4096]
                    v = _variances(part, first, *coefficients)
                    first, v = v[-1], v[:-1]
                    total = total - 0.5 * (np.log(2 * np.pi * v) + part[:, None] / v).sum(0)
                out.append({**{k: row[k] for k in names}, "v": total})
            yield pd.DataFrame(out, columns=[*names, "v"])

    at = known.select(*names, "mean", "variance", F.lit((_LEAST_Q + _MOST_Q) / 2).alias("at_q"), F.lit(0.5).alias("at_share"))
    wide = 1.0
    while True:
        models = sized(solve_per_key(at, lambda row, wide=wide: around(row, wide), "mean double, variance double, q array<double>, share array<double>", keys))
        parts = _with_entry(chunks, models, keys, size).mapInPandas(likelihood, f"{key_schema(chunks, keys)}, v array<double>")
        sums = collected(parts.select(*names, F.posexplode("v").alias("i", "v")), keys)

        def best(row):
            i = int(np.argmax(np.asarray(row["m"], dtype=float)))
            return {"mean": row["mean"], "variance": row["variance"], "at_q": float(row["q"][i]), "at_share": float(row["share"][i]), "likelihood": float(row["m"][i])}

        at = cut(solve_per_key(sums.join(models, names), best, "mean double, variance double, at_q double, at_share double, likelihood double", keys))
        if wide <= tolerance:
            break
        wide *= 0.4
    p = 1 - F.exp(-F.col("at_q"))
    return at.select(*names, "mean", "variance", (F.col("variance") * (1 - p)).alias("omega"), (p * F.col("at_share")).alias("alpha"), (p * (1 - F.col("at_share"))).alias("beta"), "likelihood")


def volatility_fitted(series: DataFrame, value: str, estimate: str, window: int, model: DataFrame | None = None, keys: Sequence[str] = KEYS, size: int | None = None) -> DataFrame:
    """(keys, t, score) per window begin: mean absolute error over the volatility that ``volatility_fit`` finds (or ``model``, its result)."""
    names, size = list(keys), size or CHUNK_ROWS
    model = model if model is not None else volatility_fit(series, value, estimate, keys, size)
    p = F.col("alpha") + F.col("beta")
    models = sized(model.select(*names, "mean", "variance", F.array(-F.log(1 - p)).alias("q"), F.array(F.col("alpha") / p).alias("share")))
    chunks = packed_chunks(_errors(series, value, estimate, keys).withColumn("at", F.col("t")), ["e", "at"], 1, keys, size)
    kind = series.schema["t"].dataType.simpleString()

    def ratios(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                e = np.asarray(row["c0"], dtype=float)
                v = _variances((e - row["mean"]) ** 2, np.asarray(row["first"], dtype=float), *_candidates(row))[:-1, 0]
                yield pd.DataFrame({**{k: [row[k]] * len(e) for k in names}, "t": np.asarray(row["c1"], dtype=np.int64), "r": np.abs(e) / np.sqrt(v)})

    rows = _with_entry(chunks, models, keys, size).mapInPandas(ratios, f"{key_schema(series, keys)}, t {kind}, r double")
    over = lambda fn: lambda w: fn("r").over(w.rowsBetween(0, window - 1))
    out = framed(rows, keys, "t", 0, window - 1, {"score": over(F.avg), "_n": over(F.count)}, size)
    return out.filter(F.col("_n") == window).select(*names, "t", "score")


def fourier(x: Column, y: Column) -> Column:
    """L2 norm of the difference of the transforms over the length; by Parseval the L2 norm over the root of the length."""
    total = F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(total / F.size(x))


def _segments(x: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots of each row of a matrix, and the values of its piecewise-linear form.

    From a knot a line goes through the next point; the next knot is the first later point that it misses by ``bound`` or more.
    """
    rows, n = x.shape
    at = np.arange(n)
    slope = np.diff(x, axis=1, append=x[:, -1:])
    line = x[:, :, None] + (at[None, :] - at[:, None])[None] * slope[:, :, None]  # [row, knot, point]
    miss = (np.abs(x[:, None, :] - line) >= bound) & (at[None, :] >= at[:, None] + 2)[None]
    following = np.where(miss.any(2), miss.argmax(2), n)
    knot, here = np.zeros((rows, n), bool), np.zeros(rows, np.int64)
    live = np.arange(rows) if n else np.zeros(0, np.int64)
    while len(live):
        knot[live, here[live]] = True
        here[live] = following[live, here[live]]
        live = live[here[live] < n]
    # A line that runs to the end leaves the last point to itself only if a knot is there.
    owner = np.maximum.accumulate(np.where(knot, at[None], 0), axis=1)
    return knot, np.take_along_axis(line, owner[:, None, :], 1)[:, 0, :] if n else x


def _line_gap(x: np.ndarray, y: np.ndarray, bound: float) -> np.ndarray:
    """Mean absolute difference of the piecewise-linear forms at the knots of either, row by row."""
    (kx, fx), (ky, fy) = _segments(x, bound), _segments(y, bound)
    either = kx | ky
    return (np.abs(fx - fy) * either).sum(1) / np.maximum(either.sum(1), 1)


def _stack(x: pd.Series, y: pd.Series):
    return np.stack(x.to_numpy()).astype(float), np.stack(y.to_numpy()).astype(float)


def linear_segments(bound: float = 1.0):
    """Pandas UDF (x, y): mean absolute difference at the knots of both piecewise-linear fits."""
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        a, b = _stack(x, y)
        step = max(1, (1 << 22) // max(a.shape[1] ** 2, 1))
        return pd.Series(np.concatenate([_line_gap(a[i:i + step], b[i:i + step], bound) for i in range(0, len(a), step)]))

    return run


def _wavefront(rows: int, n: int, border: Callable, step: Callable, limit: np.ndarray | None = None) -> np.ndarray:
    """Last cell of a dynamic program over an (n, n) grid, for many grids at once, in the memory of three anti-diagonals.

    ``border(k)`` is the value of the cells (0, k) and (k, 0). ``step(i, j, up, left, corner)`` gives the cells with row slice ``i`` and column slice ``j`` (which runs backwards) from
    their neighbours. A grid whose last two diagonals both exceed its limit throughout ends early with infinity: costs only grow along a path.
    """
    out, live = np.full(rows, np.inf), np.arange(rows)
    before, last = np.full((rows, n), np.inf), np.full((rows, n), np.inf)
    last[:, 0] = 0.0
    for k in range(1, 2 * n - 1):
        now = np.full((len(live), n), np.inf)
        if k < n:
            now[:, 0] = now[:, k] = border(k)
        lo, hi = max(1, k - n + 1), min(k - 1, n - 1)
        if lo <= hi:
            back = slice(k - lo, k - hi - 1, -1)
            now[:, lo:hi + 1] = step(live, slice(lo, hi + 1), back, last[:, lo - 1:hi], last[:, lo:hi + 1], before[:, lo - 1:hi])
        before, last = last, now
        if limit is not None:
            open_ = np.minimum(before.min(1), last.min(1)) <= limit[live]
            if not open_.all():
                live, before, last = live[open_], before[open_], last[open_]
            if not len(live):
                break
    out[live] = last[:, n - 1]
    return out


CELLS = 1 << 20


def _by_rows(a: np.ndarray, run: Callable) -> np.ndarray:
    """``run(slice)`` over pieces of the batch, so that a diagonal of all its grids stays small."""
    size = max(1, CELLS // max(a.shape[1], 1))
    return np.concatenate([run(slice(i, i + size)) for i in range(0, len(a), size)])


def _warped(a: np.ndarray, b: np.ndarray, power: int, limit: np.ndarray | None = None) -> np.ndarray:
    # Row and column 0 stand before the sequences.
    step = lambda g, i, j, up, left, corner: np.abs(a[g, i.start - 1:i.stop - 1] - b[g][:, _shifted(j)]) ** power + np.minimum(np.minimum(up, left), corner)
    return _wavefront(len(a), a.shape[1] + 1, lambda k: np.inf, step, limit)


def _shifted(j: slice) -> slice:
    """A backward slice one place to the left."""
    return slice(j.start - 1, j.stop - 1 if j.stop else None, -1)


def warping(power: int = 1):
    """Pandas UDF (x, y): dynamic time warping cost over the length."""
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        a, b = _stack(x, y)
        return pd.Series(_by_rows(a, lambda s: _warped(a[s], b[s], power)) / a.shape[1])

    return run


def warping_bound(a: np.ndarray, b: np.ndarray, power: int = 1) -> np.ndarray:
    """At most the warping cost, in linear time: every value outside the range of the other sequence is matched to something inside it."""
    def outside(x, y):
        lo, hi = y.min(1, keepdims=True), y.max(1, keepdims=True)
        return (np.maximum(np.maximum(lo - x, x - hi), 0) ** power).sum(1)

    return np.maximum(outside(a, b), outside(b, a))


def warping_within(power: int = 1):
    """Pandas UDF (x, y, limit): the warping cost over the length where it is at most ``limit``, else NULL.

    Pairs whose lower bound exceeds the limit are not compared, others are given up as soon as every path exceeds it.
    """
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series, limit: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        if len(x):
            a, b = _stack(x, y)
            most = limit.to_numpy(dtype=float) * a.shape[1] * (1 + 1e-12)
            near = np.flatnonzero(warping_bound(a, b, power) <= most)
            if len(near):
                a, b, bound = a[near], b[near], most[near]
                cost = _by_rows(a, lambda s: _warped(a[s], b[s], power, bound[s]))
                out[near] = np.where(cost <= bound, cost / a.shape[1], np.nan)
        return pd.Series(out).astype("Float64").mask(np.isnan(out))

    return run


def edit(epsilon: float = 0.1):
    """Pandas UDF (x, y): edit distance on real sequences over the length; values closer than epsilon match."""
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        a, b = _stack(x, y)

        def part(s):
            a_, b_ = a[s], b[s]
            step = lambda g, i, j, up, left, corner: np.where(np.abs(a_[:, i] - b_[:, j]) < epsilon, corner, 1 + np.minimum(np.minimum(up, left), corner))
            return _wavefront(len(a_), a.shape[1], lambda k: k, step)

        return pd.Series(_by_rows(a, part) / a.shape[1])

    return run


def time_warp_edit(gamma: float = 0.1, nu: float = 0.1):
    """Pandas UDF (x, y): time warp edit distance (Marteau, 2009) on unit time stamps."""
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        a, b = (np.pad(v, ((0, 0), (1, 0))) for v in _stack(x, y))

        def part(s):
            a_, b_ = a[s], b[s]
            drop_a, drop_b = (np.abs(np.diff(v, axis=1, prepend=0.0)) + nu + gamma for v in (a_, b_))

            def step(g, i, j, up, left, corner):
                lag = 2 * nu * np.abs(np.arange(i.start, i.stop) - np.arange(j.start, j.stop, -1))
                keep = corner + np.abs(a_[:, i] - b_[:, j]) + np.abs(a_[:, i.start - 1:i.stop - 1] - b_[:, _shifted(j)]) + lag
                return np.minimum(np.minimum(up + drop_a[:, i], left + drop_b[:, j]), keep)

            return _wavefront(len(a_), a.shape[1], lambda k: np.inf, step)

        return pd.Series(_by_rows(a, part))

    return run
