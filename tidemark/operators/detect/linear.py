"""Subspace, covariance and margin scores (inventory DET9-DET12).

Fits need only sums over the windows (count, mean, Gram matrix), which Spark adds up; the small eigen problem of each series is
solved on an executor, all series in parallel.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...plans.attach import attach
from ...plans.chunks import (
    CHUNK_ROWS, _moment_rows, array_moments, collected, key_schema, over_rows, over_windows, packed_chunks, solve_per_key, sum_over_windows, unpack,
    values_over_windows, window_moments, window_view,
)
from ...plans.ordered import cumulate, order_value, quantile_of
from ...session import cut
from ..windows import centre_pad
from .cluster import hashed_share, sampled_windows, window_rows

KEYS = ("series_id",)


def signed(v: np.ndarray) -> np.ndarray:
    """Unit columns whose entry of largest magnitude is positive."""
    big = np.abs(v).argmax(0)
    return v * np.where(v[big, np.arange(v.shape[1])] < 0, -1.0, 1.0)


def eigen(cov: np.ndarray):
    """Eigenvalues (descending) and signed eigenvectors."""
    w, v = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(w)[::-1]
    return np.maximum(w[order], 0.0), signed(v[:, order])


def pick_rank(values: np.ndarray, components: int | float | None, n: float) -> int:
    """None: all; a share: enough components to explain it; else the number itself."""
    most = int(min(len(values), max(n, 1)))
    if components is None:
        return most
    if isinstance(components, float) and components < 1:
        share = np.cumsum(values) / max(values.sum(), 1e-300)
        return min(int(np.searchsorted(share, components) + 1), most)
    return max(1, min(int(components), most))


def _channel_major(w, model=None):
    return window_rows(w, False)


PCA_MODEL = "n double, mean array<double>, scale array<double>, keep array<int>, k int, vectors array<double>, ratio array<double>, singular array<double>"


def pca_fit(
    df: DataFrame, channels: Sequence[str], window: int = 100, components: int | float | None = None,
    keys: Sequence[str] = KEYS, size=None, standard: bool = True,
) -> DataFrame:
    """Principal axes of standardised windows; constant (all-zero after scaling) positions are dropped."""
    m = window_moments(df, channels, window, _channel_major, keys, size=size)

    def solve(row):
        n, mean, cov = unpack(row["m"])
        var = np.diag(cov)
        sd = np.sqrt(np.maximum(var, 0)) if standard else np.ones(len(mean))
        keep = np.flatnonzero(var > 1e-12 * max(var.max(), 1e-300))
        if not len(keep):
            return None
        scale = np.where(sd > 0, sd, 1.0)
        c = cov[np.ix_(keep, keep)] / np.outer(scale[keep], scale[keep])
        values, vectors = eigen(c)
        k = pick_rank(values, components, n)
        return {
            "n": n, "mean": mean.tolist(), "scale": scale.tolist(), "keep": keep.tolist(), "k": k,
            "vectors": vectors[:, :k].ravel().tolist(), "ratio": (values[:k] / values.sum()).tolist(),
            "singular": np.sqrt(values[:k] * n).tolist(),
        }

    return cut(solve_per_key(m, solve, PCA_MODEL, keys))


def _standard(x, m):
    keep = np.asarray(m["keep"], int)
    return ((x - np.asarray(m["mean"])) / np.asarray(m["scale"]))[:, keep]


def pca_score(
    df: DataFrame, channels: Sequence[str], window: int = 100, components: int | float | None = None,
    train: DataFrame | None = None, keys: Sequence[str] = KEYS, size=None, model: DataFrame | None = None,
) -> DataFrame:
    """Sum over the components of the distance between the scaled window and the component, over its explained share."""
    if model is None:
        model = pca_fit(df if train is None else train, channels, window, components, keys, size)

    def score(w, t, m):
        x = _standard(window_rows(w, False), m)
        v = np.asarray(m["vectors"]).reshape(x.shape[1], -1)
        d2 = (x * x).sum(1)[:, None] - 2 * x @ v + 1.0
        return {"score": (np.sqrt(np.maximum(d2, 0)) / np.maximum(np.asarray(m["ratio"]), 1e-12)).sum(1)}

    scored = over_windows(df, channels, window, score, "score double", keys, size=size, models=model)
    return centre_pad(df, scored, window, keys)


# Principal component pursuit.  The row state (low-rank part, sparse part, multiplier) stays on the rows.

_STATE = "x array<double>, s array<double>, y array<double>, l array<double>"


def _shrink(g: np.ndarray, mu: float) -> np.ndarray:
    """Projection that lowers the singular values of a matrix with Gram matrix ``g`` by 1 / mu."""
    values, v = eigen(g)
    sv = np.sqrt(values)
    return (v * np.where(sv > 1 / mu, (sv - 1 / mu) / np.maximum(sv, 1e-300), 0.0)) @ v.T


def _split(x, s, y, p, mu, lam):
    """Low-rank part, sparse part and what both leave, after one step."""
    low = (x - s + y / mu) @ p
    z = x - low + y / mu
    sparse = np.sign(z) * np.maximum(np.abs(z) - lam / mu, 0)
    return low, sparse, x - low - sparse


def _pursuit(x: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """All steps for one matrix: (low-rank part, sparse part)."""
    top = np.abs(x).sum(0).max(initial=0.0)
    mu = x.size / (4 * top) if top > 0 else 1.0
    lam, norm = 1 / math.sqrt(max(*x.shape, 1)), math.sqrt((x**2).sum())
    s, y, low = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    for _ in range(max_iter):
        z = x - s + y / mu
        low, s, gap = _split(x, s, y, _shrink(z.T @ z, mu), mu, lam)
        y = y + mu * gap
        if math.sqrt((gap**2).sum()) <= tol * max(norm, 1e-300):
            break
    return low, s


def robust_pca(
    df: DataFrame, channels: Sequence[str], max_iter: int = 1000, tol: float = 1e-7, keys: Sequence[str] = KEYS,
    mode: str = "sparse", size=None, prune: bool = False,
) -> DataFrame:
    """(keys, t, score): absolute sparse part per row; ``mode="reference"`` compares the low-rank part with its own projection.

    With ``prune`` channels that are zero in all rows of a series are left out of that series; one without any other has no model.
    A series of at most ``size`` rows (a chunk) is solved in one task. Longer ones take these steps together: the Gram matrix of the shrunk data
    (one aggregate), a small eigen problem per series, and a row-local update, checkpointed. Both take the same steps, each series until it meets
    the tolerance or ``max_iter``; the long ones go on until all of them do.
    """
    names = list(keys)
    every = df.select(*keys, "t", F.array(*[F.col(c).cast("double") for c in channels]).alias("x"))
    if prune:
        alive = every.select(*keys, F.posexplode("x").alias("_i", "_v")).groupBy(*keys, "_i").agg(F.max(F.abs("_v")).alias("_m")).filter("_m > 0")
        alive = alive.groupBy(*keys).agg(F.sort_array(F.collect_list("_i")).alias("_at"))
        zero = attach(every, alive, keys, "left")
        dead = zero.filter("_at IS NULL").select(*keys, "t", F.lit(None).cast("double").alias("score"))
        every = zero.filter("_at IS NOT NULL").select(*keys, "t", F.transform("_at", lambda i: F.element_at("x", i + 1)).alias("x"))
    lengths = cut(every.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    short = attach(every, lengths.filter(F.col("_n") <= (size or CHUNK_ROWS)), keys).drop("_n")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        low, sparse = _pursuit(np.stack(pdf["x"].to_numpy()), max_iter, tol)
        return pdf[[*names, "t"]].assign(s=list(sparse), l=list(low))

    kind = df.schema["t"].dataType.simpleString()
    solved = short.groupBy(*names).applyInPandas(whole, f"{key_schema(df, keys)}, t {kind}, s array<double>, l array<double>")
    long_ = lengths.filter(F.col("_n") > (size or CHUNK_ROWS))
    state = solved if long_.isEmpty() else solved.unionByName(_pursuit_together(attach(every, long_, keys).drop("_n"), max_iter, tol, keys, size))
    scored = _pursuit_score(cut(state) if mode != "sparse" else state, mode, keys, size)
    return scored.unionByName(dead) if prune else scored


def _pursuit_together(raw: DataFrame, max_iter: int, tol: float, keys: Sequence[str], size) -> DataFrame:
    """(keys, t, s, l) of all series at once, one distributed step after the other."""
    names = list(keys)
    zero = F.transform("x", lambda v: v * 0.0)
    state = cut(raw.select(*keys, "t", "x", zero.alias("s"), zero.alias("y"), zero.alias("l")))
    long = state.select(*keys, F.posexplode("x").alias("i", "v"))
    cols = long.groupBy(*keys, "i").agg(F.sum(F.abs("v")).alias("a"), F.sum(F.col("v") ** 2).alias("q"), F.count("v").alias("n"))
    base = cut(cols.groupBy(*keys).agg(
        (F.sum("n") / (F.lit(4.0) * F.max("a"))).alias("mu"), F.sqrt(F.sum("q")).alias("norm"), F.max("n").alias("n"),
        F.count(F.lit(1)).alias("d"),
    ).select(*keys, F.when(F.col("mu").isNull(), 1.0).otherwise(F.col("mu")).alias("mu"), "norm",
             (F.lit(1.0) / F.sqrt(F.greatest("n", "d").cast("double"))).alias("lam")))

    def stacked(pdf):
        return (np.stack(pdf[c].to_numpy()) for c in ("x", "s", "y", "l"))

    def gram(pdf, m):
        x, s, y, _l = stacked(pdf)
        z = x - s + y / m["mu"]
        vec = np.empty(len(pdf), dtype=object)
        vec[0] = (z.T @ z).ravel()
        return {"g": vec}

    def solve(row):
        g = np.asarray(row["m"])
        d = int(math.sqrt(len(g)))
        return {"mu": row["mu"], "lam": row["lam"], "norm": row["norm"], "p": _shrink(g.reshape(d, d), row["mu"]).ravel().tolist()}

    def update(pdf, m):
        x, s, y, _l = stacked(pdf)
        d = x.shape[1]
        low, sparse, gap = _split(x, s, y, np.asarray(m["p"]).reshape(d, d), m["mu"], m["lam"])
        return {"x": list(x), "s": list(sparse), "y": list(y + m["mu"] * gap), "l": list(low), "e": (gap**2).sum(1)}

    for _ in range(max_iter):
        g = over_rows(state, ["x", "s", "y", "l"], gram, "g array<double>", keys, size, base).filter("g IS NOT NULL")
        sums = collected(g.select(*keys, F.posexplode("g").alias("i", "v")), keys).join(base, names)
        model = solve_per_key(sums, solve, "mu double, lam double, norm double, p array<double>", keys)
        state = cut(over_rows(state, ["x", "s", "y", "l"], update, f"{_STATE}, e double", keys, size, cut(model)))
        err = state.groupBy(*keys).agg(F.sqrt(F.sum("e")).alias("e")).join(base, names)
        if (err.agg(F.max(F.col("e") / F.greatest("norm", F.lit(1e-300))).alias("r")).first()["r"] or 0.0) <= tol:
            break
    return state.select(*keys, "t", "s", "l")


def _pursuit_score(state: DataFrame, mode: str, keys: Sequence[str], size) -> DataFrame:
    if mode == "sparse":
        return state.select(*keys, "t", F.aggregate("s", F.lit(0.0), lambda a, v: a + F.abs(v)).alias("score"))
    m = array_moments(state, "l", keys)

    def axes(row):
        n, mean, cov = unpack(row["m"])
        return {"mean": mean.tolist(), "v": eigen(cov)[1].ravel().tolist()}

    model = solve_per_key(m, axes, "mean array<double>, v array<double>", keys)

    def score(pdf, mm):
        low = np.stack(pdf["l"].to_numpy())
        d = low.shape[1]
        return {"score": np.abs(low - (low - np.asarray(mm["mean"])) @ np.asarray(mm["v"]).reshape(d, d)).sum(1)}

    return over_rows(state, ["l"], score, "score double", keys, size, cut(model))


# Minimum covariance determinant.


def chi2_quantile(q: float, p: int) -> float:
    """Wilson-Hilferty approximation."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(q)
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


FALL = 1e-8  # of the log determinant; a step that falls by no more ends the search


def _centred_moments(x: np.ndarray, mean) -> np.ndarray:
    return _moment_rows(x - np.asarray(mean))


def _moved_moments(m: np.ndarray, mean) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from moments about ``mean``."""
    _n, shift, cov = unpack(m, len(mean))
    return np.asarray(mean) + shift, cov


def _log_det(cov: np.ndarray, scale) -> float:
    """Of the covariance in units of ``scale``; directions without spread count alike."""
    return float(np.log(np.maximum(np.linalg.eigvalsh(cov / np.outer(scale, scale)), 1e-9)).sum())


def _support(n, p: int, support: float | None) -> float:
    return float(support) if support else min(1.0, math.ceil(0.5 * (n + p + 1)) / n)


def _nearer(x: np.ndarray, m) -> np.ndarray:
    return x[_mahalanobis(x, m) <= m["q"] * (1 + 1e-12)]


def _concentrated(x: np.ndarray, m: dict, share: float, steps: int) -> dict:
    """Concentration steps from the model ``m`` until the determinant stops falling."""
    for _ in range(steps):
        q = np.quantile(_mahalanobis(x, m), share)
        m = _concentration(m, _centred_moments(_nearer(x, {**m, "q": q}), m["mean"]))
        if m["done"]:
            break
    return m


def _concentration(m, moments) -> dict:
    """The model after one step; the old one, done, when the determinant does not fall."""
    mean, cov = _moved_moments(moments, m["mean"])
    det = _log_det(cov, m["scale"])
    fall = m["det"] - det
    if fall <= FALL:
        return {**{k: m[k] for k in ("mean", "inv", "p", "scale", "det")}, "fall": fall, "done": True}
    inv = np.linalg.pinv(cov).ravel().tolist()
    return {"mean": mean.tolist(), "inv": inv, "p": m["p"], "scale": m["scale"], "det": det, "fall": fall, "done": False}


def _best_start(x: np.ndarray, support: float | None, seed: int, steps: int, starts: int = 30) -> dict:
    """Of the concentrated random starts on ``x`` the one with the smallest determinant, as a model no step was taken from."""
    rng = np.random.default_rng(seed)
    n, p = x.shape
    sd = x.std(0)
    scale = np.where(sd > 0, sd, 1.0).tolist()
    best = None
    for _ in range(starts):
        rows = x[rng.choice(n, size=min(p + 1, n), replace=False)]
        mean, cov = rows.mean(0), np.atleast_2d(np.cov(rows.T, ddof=0))
        m = {"mean": mean.tolist(), "inv": np.linalg.pinv(cov).ravel().tolist(), "p": p, "scale": scale, "det": math.inf}
        m = _concentrated(x, m, _support(n, p, support), steps)
        if best is None or m["det"] < best["det"]:
            best = m
    return {**best, "det": math.inf, "fall": math.inf, "done": False}


def _outer_bound(median: float, p: int) -> float:
    """The 97.5 % quantile; the median distance of normal data is the chi-square median."""
    return median / chi2_quantile(0.5, p) * chi2_quantile(0.975, p)


MCD_MODEL = "mean array<double>, inv array<double>, p int, scale array<double>, det double, fall double, done boolean"


def _mahalanobis(x, m):
    p = int(m["p"])
    gap = x - np.asarray(m["mean"])
    return ((gap @ np.asarray(m["inv"]).reshape(p, p)) * gap).sum(1)


def _reweighted(m, moments) -> dict:
    mean, cov = _moved_moments(moments, m["mean"])
    return {**{k: m[k] for k in ("p", "scale", "det", "fall", "done")}, "mean": mean.tolist(), "inv": np.linalg.pinv(cov).ravel().tolist()}


def _warn_unfinished(model: DataFrame, what: str, steps: int) -> DataFrame:
    n = model.filter("NOT done").count()
    if n:
        warnings.warn(f"{what}: {n} series not converged after {steps} steps", RuntimeWarning, stacklevel=3)
    return model


def mcd_fit(
    df: DataFrame, channels: Sequence[str], window: int = 1, support: float | None = None, steps: int = 500, seed: int = 2024,
    keys: Sequence[str] = KEYS, size=None, prep=window_rows,
) -> DataFrame:
    """Robust mean and inverse covariance per series.

    Starts are searched on a hash sample (about ``STARTS`` windows); concentration steps over all windows follow from the best one until the
    covariance determinant stops falling: distances, the exact quantile that holds the support, and the moments of the rows below it. At
    last the rows within the 97.5 % chi-square quantile are taken. After ``steps`` steps a series is left with ``done`` false, its last
    ``fall`` of the log determinant, and a warning. A series of at most a chunk is solved in one task; longer ones take their steps together.
    """
    names, chans, limit = list(keys), list(channels), size or CHUNK_ROWS
    columns = [*names, *[c.split()[0] for c in MCD_MODEL.split(", ")]]
    lengths = cut(df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        if len(pdf) < window:
            return pd.DataFrame(columns=columns)
        x = prep(window_view(pdf[chans].to_numpy(dtype=float), window))
        chosen = hashed_share(pdf["t"].to_numpy()[: len(x)], seed) < STARTS / len(pdf)
        if not chosen.any():
            return pd.DataFrame(columns=columns)
        m = _concentrated(x, _best_start(x[chosen], support, seed, steps), _support(*x.shape, support), steps)
        q = _outer_bound(float(np.median(_mahalanobis(x, m))), x.shape[1])
        m = _reweighted(m, _centred_moments(_nearer(x, {**m, "q": q}), m["mean"]))
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in names}, **m}], columns=columns)

    short = attach(df.select(*names, "t", *chans), lengths.filter(F.col("_n") <= limit), names).drop("_n")
    solved = short.groupBy(*names).applyInPandas(whole, f"{key_schema(df, keys)}, {MCD_MODEL}")
    long_ = lengths.filter(F.col("_n") > limit)
    if not long_.isEmpty():
        rest = attach(df.select(*names, "t", *chans), long_, names).drop("_n")
        solved = solved.unionByName(_mcd_together(rest, chans, window, support, steps, seed, keys, size, prep))
    return _warn_unfinished(cut(solved), "MCD", steps)


STARTS = 1000


def _mcd_together(df: DataFrame, channels, window, support, steps, seed, keys, size, prep) -> DataFrame:
    """Models of series that are longer than a chunk."""
    names = list(keys)
    sample = sampled_windows(df, channels, window, STARTS, seed, keys, size, prep)

    m_columns = [c.split()[0] for c in MCD_MODEL.split(", ")]

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _best_start(np.stack(pdf.sort_values("t")["x"].to_numpy()), support, seed, steps)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in names}, **m}])[[*names, *m_columns]]

    model = cut(sample.groupBy(*names).applyInPandas(start, f"{key_schema(df, keys)}, {MCD_MODEL}"))
    chunks, dims = packed_chunks(df, channels, window, keys, size), len(channels)
    share = F.lit(float(support)) if support else F.least(
        F.lit(1.0), F.ceil(F.lit(0.5) * (F.col("tot_n") + F.lit(dims * window + 1))) / F.col("tot_n")
    )

    def step(model, fraction, bound, update):
        d = values_over_windows(chunks, dims, window, lambda w, m: _mahalanobis(prep(w), m), model, keys)
        q = cumulate(d, keys, "v").groupBy(*names).agg(quantile_of("v", fraction).alias("_q"))
        stat = cut(solve_per_key(q.join(model, names), lambda row: {**{c: row[c] for c in m_columns}, "q": bound(row)}, f"{MCD_MODEL}, q double", keys))
        sums = sum_over_windows(chunks, dims, window, lambda w, m: _centred_moments(_nearer(prep(w), m), m["mean"]), stat, keys)
        return cut(solve_per_key(sums.join(model, names), lambda row: update(row, np.asarray(row["m"])), MCD_MODEL, keys))

    def concentrate(row, m):
        return {c: row[c] for c in m_columns} if row["done"] else _concentration(row, m)

    for _ in range(steps):
        model = step(model, share, lambda row: row["_q"], concentrate)
        if model.filter("NOT done").isEmpty():
            break
    return step(model, F.lit(0.5), lambda row: _outer_bound(row["_q"], int(row["p"])), _reweighted)


def mcd_score(
    df: DataFrame, channels: Sequence[str], window: int = 1, support: float | None = None, train: DataFrame | None = None,
    keys: Sequence[str] = KEYS, size=None, seed: int = 2024, normalise: bool = True,
) -> DataFrame:
    """(keys, t, score): squared robust Mahalanobis distance."""
    prep = window_rows if normalise and len(channels) * window > 1 else _channel_major
    model = mcd_fit(df if train is None else train, channels, window, support, seed=seed, keys=keys, size=size, prep=prep)
    scored = over_windows(
        df, channels, window, lambda w, t, m: {"score": _mahalanobis(prep(w), m)}, "score double", keys, size=size, models=model
    )
    return centre_pad(df, scored, window, keys) if window > 1 else scored


# One-class margin on random Fourier features (or the plain vectors for the linear kernel).


def _features(x: np.ndarray, kernel: str, gamma: float | str, width: int, seed: int) -> np.ndarray:
    """Vectors whose products approximate the kernel: itself for linear, random waves for rbf, products of random signs for poly (degree 3)."""
    if kernel == "linear":
        return x
    p = x.shape[1]
    g = 1.0 / p if gamma == "auto" else float(gamma)
    rng = np.random.default_rng(seed)
    if kernel == "rbf":
        w, b = rng.normal(scale=math.sqrt(2 * g), size=(p, width)), rng.uniform(0, 2 * math.pi, size=width)
        return math.sqrt(2.0 / width) * np.cos(x @ w + b)
    if kernel == "poly":
        out = np.full((len(x), width), math.sqrt(g**3 / width))
        for _ in range(3):
            out = out * (x @ rng.choice([-1.0, 1.0], size=(p, width)))
        return out
    raise ValueError(f"kernel {kernel!r} has no product form; use linear, rbf or poly")


GAP = 1e-6  # of the objective, between its value and its lower bound


def _nearest_weights(points: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights of the point nearest to the origin in the hull of ``points``, from weights whose last point is new (Wolfe's inner steps)."""
    weights = weights.copy()
    g = points @ points.T
    g = g / max(np.diag(g).max(), 1e-300)
    active = weights > 0
    active[-1] = True
    while True:
        at = np.flatnonzero(active)
        k = len(at)
        side = np.block([[g[np.ix_(at, at)], np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
        best = np.linalg.lstsq(side, np.append(np.zeros(k), 1.0), rcond=None)[0][:k]
        if k == 1 or (best >= 0).all():
            weights[:] = 0
            weights[at] = best / best.sum()
            return weights
        now = weights[at]
        down = best < 0
        share = np.full(k, np.inf)
        share[down] = now[down] / (now[down] - best[down])
        out = share.argmin()
        weights[at] = np.maximum(now + share[out] * (best - now), 0)
        weights[at[out]] = 0
        active[at[out]] = False


def _margin_start(mean: np.ndarray, square: float) -> dict:
    w = mean.tolist()
    return {"w": w, "rho": 0.0, "points": w, "weights": [1.0], "square": square, "gap": math.inf, "done": False}


def _tail(phi: np.ndarray, w, rho: float) -> np.ndarray:
    """Rows below rho and their sum, rows at rho and their sum."""
    s = phi @ np.asarray(w)
    near = 1e-12 * max(abs(rho), 1.0)
    low, at = s < rho - near, np.abs(s - rho) <= near
    return np.concatenate([[low.sum(), at.sum()], phi[low].sum(0), phi[at].sum(0)])


def _margin_step(m, rho: float, tail: np.ndarray, size: float) -> dict:
    """One step: the mean of the ``size`` rows with the smallest margins joins the hull, whose point nearest to the origin is the new normal.

    Half the square of the normal is the dual of the objective; ``gap`` is what the objective lies above it, as a share.
    """
    w, d = np.asarray(m["w"]), (len(tail) - 2) // 2
    v = (tail[2 : 2 + d] + (size - tail[0]) / max(tail[1], 1.0) * tail[2 + d :]) / size
    square = float(w @ w)
    gap = (square - float(w @ v)) / max(square, 1e-9 * m["square"], 1e-300)
    if gap <= GAP:
        return {**{k: m[k] for k in ("w", "points", "weights", "square")}, "rho": rho, "gap": gap, "done": True}
    points = np.vstack([np.asarray(m["points"]).reshape(-1, d), v])
    weights = _nearest_weights(points, np.append(np.asarray(m["weights"]), 0.0))
    points, weights = points[weights > 0], weights[weights > 0]
    return {
        "w": (weights @ points).tolist(), "rho": rho, "points": points.ravel().tolist(), "weights": weights.tolist(), "square": m["square"],
        "gap": gap, "done": False,
    }


MARGIN_MODEL = "w array<double>, rho double, points array<double>, weights array<double>, square double, gap double, done boolean"


def _margin_rank(n, nu: float) -> tuple[float, int]:
    """Rows that share the weight, and the 0-based rank of the margin rho among all."""
    size = max(nu * n, 1.0)
    return size, min(math.ceil(size - 1e-9), int(n)) - 1


def ocsvm_fit(
    df: DataFrame, channels: Sequence[str], prep, window: int = 1, nu: float = 0.5, steps: int = 1000, keys: Sequence[str] = KEYS, size=None,
) -> DataFrame:
    """Normal ``w`` and offset ``rho`` of the margin over all windows ``prep(windows)``, one row per series.

    Steps run until the objective is within a share ``GAP`` of its lower bound. After ``steps`` of them a series is left with ``done`` false,
    its ``gap``, and a warning. A series of at most a chunk is solved in one task; longer ones take their steps together.
    """
    names, chans, limit = list(keys), list(channels), size or CHUNK_ROWS
    m_columns = [c.split()[0] for c in MARGIN_MODEL.split(", ")]
    columns = [*names, *m_columns]
    lengths = cut(df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        if len(pdf) < window:
            return pd.DataFrame(columns=columns)
        phi = prep(window_view(pdf[chans].to_numpy(dtype=float), window))
        m = _margin_start(phi.mean(0), float((phi**2).sum() / len(phi)))
        share, rank = _margin_rank(len(phi), nu)
        for _ in range(steps):
            rho = float(np.partition(phi @ np.asarray(m["w"]), rank)[rank])
            m = _margin_step(m, rho, _tail(phi, m["w"], rho), share)
            if m["done"]:
                break
        else:
            m["rho"] = float(np.partition(phi @ np.asarray(m["w"]), rank)[rank])
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in names}, **m}], columns=columns)

    short = attach(df.select(*names, "t", *chans), lengths.filter(F.col("_n") <= limit), names).drop("_n")
    solved = short.groupBy(*names).applyInPandas(whole, f"{key_schema(df, keys)}, {MARGIN_MODEL}")
    long_ = lengths.filter(F.col("_n") > limit)
    if not long_.isEmpty():
        rest = attach(df.select(*names, "t", *chans), long_, names).drop("_n")
        solved = solved.unionByName(_margin_together(rest, chans, prep, window, nu, steps, keys, size))
    return _warn_unfinished(cut(solved), "OCSVM", steps)


def _margin_together(df: DataFrame, channels, prep, window, nu, steps, keys, size) -> DataFrame:
    """Models of series that are longer than a chunk."""
    names, dims = list(keys), len(channels)
    m_columns = [c.split()[0] for c in MARGIN_MODEL.split(", ")]
    chunks = packed_chunks(df, channels, window, keys, size)

    def total(w, _m):
        phi = prep(w)
        return np.concatenate([[len(phi), (phi**2).sum()], phi.sum(0)])

    def first(row):
        m = np.asarray(row["m"])
        return {"n": m[0], **_margin_start(m[2:] / m[0], float(m[1] / m[0]))}

    schema = f"n double, {MARGIN_MODEL}"
    every = chunks.select(*names).distinct()
    model = cut(solve_per_key(sum_over_windows(chunks, dims, window, total, every, keys), first, schema, keys))

    def placed(model):
        s = cumulate(values_over_windows(chunks, dims, window, lambda w, m: prep(w) @ np.asarray(m["w"]), model.select(*names, "w"), keys), keys, "v")
        rank = F.least(F.ceil(F.greatest(F.lit(nu) * F.col("tot_n"), F.lit(1.0)) - 1e-9), F.col("tot_n")) - 1
        return cut(s.groupBy(*names).agg(order_value("v", rank).alias("rho")).join(model.drop("rho"), names))

    def move(row):
        if row["done"]:
            return {c: row[c] for c in ("n", *m_columns)}
        return {"n": row["n"], **_margin_step(row, row["rho"], np.asarray(row["m"]), _margin_rank(row["n"], nu)[0])}

    for _ in range(steps):
        at = placed(model)
        tails = sum_over_windows(chunks, dims, window, lambda w, m: _tail(prep(w), m["w"], m["rho"]), at.select(*names, "w", "rho"), keys)
        model = cut(solve_per_key(tails.join(at, names), move, schema, keys))
        if model.filter("NOT done").isEmpty():
            break
    else:
        model = placed(model)
    return model.select(*names, *m_columns)


def ocsvm_score(
    df: DataFrame, channels: Sequence[str], window: int = 1, kernel: str = "rbf", nu: float = 0.5, gamma="auto",
    features: int = 128, steps: int = 1000, train: DataFrame | None = None, keys: Sequence[str] = KEYS, size=None, seed: int = 0,
    compat: bool = False,
) -> DataFrame:
    """(keys, t, score): offset minus projection (``ocsvm_fit``).

    Windows are scaled to their own range when fitted and when scored; ``compat=True`` scales them in the fit only, as the benchmark does.
    """
    if kernel not in ("linear", "rbf", "poly"):
        raise ValueError(f"kernel {kernel!r} has no product form; use linear, rbf or poly")
    base = df if train is None else train

    def prep(w, scaled=True):
        x = window_rows(w)
        if scaled:
            lo, hi = x.min(1, keepdims=True), x.max(1, keepdims=True)
            x = np.divide(x - lo, hi - lo, out=np.zeros_like(x), where=hi > lo)
        return _features(x, kernel, gamma, features, seed)

    model = ocsvm_fit(base, channels, prep, window, nu, steps, keys, size)
    scored = over_windows(
        df, channels, window, lambda w, t, m: {"score": m["rho"] - prep(w, not compat) @ np.asarray(m["w"])}, "score double", keys,
        size=size, models=model,
    )
    return centre_pad(df, scored, window, keys) if window > 1 else scored
