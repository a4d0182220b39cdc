"""k-means based scores (inventory DET1, DET2).

Every series gets its own centres.  The first centres come from a bounded hash sample of its windows; Lloyd steps then run over all
windows: a chunk returns sums per cluster, Spark adds them, and the centres of the next step are one small row per series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.vectors import distance, sqdist
from ...plans.attach import attach
from ...plans.chunks import CHUNK_ROWS, key_schema, over_windows, packed_chunks, solve_per_key, sum_over_windows, window_view
from ...session import cut
from ..windows import overlap_mean

KEYS = ("series_id",)
SAMPLE = 2000


def window_rows(w: np.ndarray, normalise: bool = True) -> np.ndarray:
    """Channel-major window vectors, each z-scored on its own (sample deviation, undefined values 0)."""
    x = w.transpose(0, 2, 1).reshape(len(w), -1)
    if not normalise:
        return np.ascontiguousarray(x)
    if x.shape[1] < 2:
        return np.zeros_like(x)
    mu, sd = x.mean(1, keepdims=True), x.std(1, ddof=1, keepdims=True)
    return np.divide(x - mu, sd, out=np.zeros_like(x), where=sd > 0)


def hashed_share(t: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) per row index; depends on the seed and the index only."""
    h = (t.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h.astype(np.float64) / 2.0**64


def sampled_windows(
    df: DataFrame, channels, window: int, rows: int = SAMPLE, seed: int = 0, keys=KEYS, size=None, prep=window_rows
) -> DataFrame:
    """About ``rows`` window vectors per series, chosen by the hash of their begin: (keys, t, x)."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    def pick(w, t, model):
        keep = hashed_share(t, seed) < rows / max(model["n"], 1)
        x = prep(w[keep])
        vec = np.empty(len(t), dtype=object)
        vec[np.flatnonzero(keep)] = list(x)
        return {"x": vec}

    out = over_windows(df, channels, window, pick, "x array<double>", keys, size=size, models=n)
    return out.filter(F.col("x").isNotNull())


def _nearest(x: np.ndarray, c: np.ndarray):
    d2 = np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)
    own = d2.argmin(1)
    return own, np.sqrt(((x - c[own]) ** 2).sum(1))


def _seed_centres(x: np.ndarray, k: int, seed: int, steps: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = [x[rng.integers(len(x))]]
    d2 = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        p = d2 / d2.sum() if d2.sum() > 0 else None
        centres.append(x[rng.choice(len(x), p=p)])
        d2 = np.minimum(d2, ((x - centres[-1]) ** 2).sum(1))
    c = np.stack(centres)
    for _ in range(steps):
        own, _d = _nearest(x, c)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(0)
    return c


def kmeans_fit(
    df: DataFrame, channels: Sequence[str], k: int = 20, window: int = 20, steps: int = 300, seed: int = 0,
    normalise: bool = True, keys: Sequence[str] = KEYS, size=None, tol: float = 1e-4,
) -> DataFrame:
    """(keys, k, centres, sizes, shift): centres as one flat array per series, and the rows of each cluster.

    Lloyd steps run until no centre moves by more than ``tol``, at most ``steps`` times; ``shift`` is the last move. Only the start uses a sample
    (about ``SAMPLE`` windows per series). A series of at most a chunk is solved in one task; longer ones take their steps together.
    """
    names = list(keys)
    prep = lambda w: window_rows(w, normalise)
    lengths = cut(df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")))
    limit = size or CHUNK_ROWS
    chans = list(channels)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        out = pdf.iloc[:1][names].copy()
        if len(pdf) < window:
            return out.iloc[:0].reindex(columns=[*names, "k", "centres", "shift", "sizes"])
        view = window_view(pdf[chans].to_numpy(dtype=float), window)
        x = prep(view)
        c = _seed_centres(x[hashed_share(pdf["t"].to_numpy()[: len(view)], seed) < SAMPLE / len(pdf)], k, seed)
        shift, n = float("inf"), np.zeros(len(c))
        for _ in range(steps):
            c, n, shift = _moved(_cluster_sums(x, c), c)
            if shift <= tol:
                break
        out["k"], out["centres"], out["shift"], out["sizes"] = len(c), [c.ravel().tolist()], shift, [n.tolist()]
        return out

    short = attach(df.select(*names, "t", *chans), lengths.filter(F.col("_n") <= limit), names).drop("_n")
    solved = short.groupBy(*names).applyInPandas(whole, f"{key_schema(df, keys)}, {MODEL_COLUMNS}")
    long_ = lengths.filter(F.col("_n") > limit)
    if not long_.isEmpty():
        rest = attach(df.select(*names, "t", *chans), long_, names).drop("_n")
        solved = solved.unionByName(_lloyd_together(rest, chans, k, window, steps, seed, prep, keys, size, tol))
    return cut(solved)


MODEL_COLUMNS = "k int, centres array<double>, shift double, sizes array<double>"


def _cluster_sums(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Rows of each cluster, then the sum of its rows, flattened."""
    own, _d = _nearest(x, c)
    hot = np.zeros((len(x), len(c)))
    hot[np.arange(len(x)), own] = 1
    return np.concatenate([hot.sum(0), (hot.T @ x).ravel()])


def _moved(sums: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """New centres, cluster sizes and the largest move of a coordinate; an empty cluster stays where it is."""
    n, s = sums[: len(old)], sums[len(old) :].reshape(len(old), -1)
    new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], old)
    return new, n, float(np.abs(new - old).max())


def _lloyd_together(df: DataFrame, channels, k, window, steps, seed, prep, keys, size, tol) -> DataFrame:
    """Models of series that are longer than a chunk: every step is one sum over all their windows."""
    names = list(keys)
    sample = sampled_windows(df, channels, window, seed=seed, keys=keys, size=size, prep=prep)

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("t")["x"].to_numpy())
        c = _seed_centres(x, k, seed)
        out = pdf.iloc[:1][names].copy()
        out["k"], out["centres"], out["shift"] = len(c), [c.ravel().tolist()], float("inf")
        out["sizes"] = [np.zeros(len(c)).tolist()]
        return out

    model = cut(sample.groupBy(*names).applyInPandas(start, f"{key_schema(df, keys)}, {MODEL_COLUMNS}"))
    chunks = packed_chunks(df, channels, window, keys, size)

    def sums(w, m):
        return _cluster_sums(prep(w), np.asarray(m["centres"]).reshape(int(m["k"]), -1))

    def update(row):
        new, n, shift = _moved(np.asarray(row["m"]), np.asarray(row["centres"]).reshape(int(row["k"]), -1))
        return {"k": int(row["k"]), "centres": new.ravel().tolist(), "shift": shift, "sizes": n.tolist()}

    for _ in range(steps):
        joined = sum_over_windows(chunks, len(channels), window, sums, model, keys).join(model, names)
        model = cut(solve_per_key(joined, update, MODEL_COLUMNS, keys))
        if (model.agg(F.max("shift").alias("s")).first()["s"] or 0.0) <= tol:
            break
    return model


def kmeans_score(
    df: DataFrame, channels: Sequence[str], k: int = 20, window: int = 20, normalise: bool = True,
    keys: Sequence[str] = KEYS, size=None, model: DataFrame | None = None, train: DataFrame | None = None, **fit,
) -> DataFrame:
    """Distance of every window to its centre, averaged over the windows that cover a point."""
    if model is None:
        model = kmeans_fit(df if train is None else train, channels, k, window, normalise=normalise, keys=keys, size=size, **fit)

    def score(w, t, m):
        c = np.asarray(m["centres"]).reshape(int(m["k"]), -1)
        return {"score": _nearest(window_rows(w, normalise), c)[1]}

    scored = over_windows(df, channels, window, score, "score double", keys, size=size, models=model)
    return overlap_mean(df, scored, window, keys=keys, size=size)


def separate(sizes: Sequence[float], alpha: float = 0.9, beta: float = 5.0) -> np.ndarray:
    """Large clusters: the smallest prefix (by size) that both holds the share alpha and drops by the ratio beta.

    Failing both together, the share alone decides, then the ratio alone.
    """
    sizes = np.asarray(sizes, float)
    order = np.argsort(-sizes, kind="stable")
    ranked, n = sizes[order], sizes.sum()
    by_share = np.cumsum(ranked)[:-1] >= n * alpha
    by_ratio = ranked[:-1] / np.maximum(ranked[1:], 1e-300) >= beta
    for hit in (by_share & by_ratio, by_share, by_ratio):
        if hit.any():
            return order[: int(np.flatnonzero(hit)[0]) + 1]
    raise ValueError("no separation into large and small clusters; change alpha or beta")


def cblof_score(
    df: DataFrame, channels: Sequence[str], k: int = 8, alpha: float = 0.9, beta: float = 5.0, window: int = 1,
    keys: Sequence[str] = KEYS, size=None, model: DataFrame | None = None, train: DataFrame | None = None,
    weighted: bool = False, **fit,
) -> DataFrame:
    """(keys, t, score): distance to the own centre in a large cluster, else to the nearest large centre.

    A series whose clusters cannot be told into large and small ones has NULL scores, the others are not affected.
    """
    if model is None:
        model = kmeans_fit(df if train is None else train, channels, k, window, keys=keys, size=size, **fit)

    def score(w, t, m):
        x = window_rows(w)
        c, sizes = np.asarray(m["centres"]).reshape(int(m["k"]), -1), np.asarray(m["sizes"])
        try:
            large = separate(sizes, alpha, beta) if len(c) > 1 else np.arange(len(c))
        except ValueError:
            return {"score": np.full(len(x), np.nan)}
        own, d = _nearest(x, c)
        _near, d_large = _nearest(x, c[large])
        d = np.where(np.isin(own, large), d, d_large)
        return {"score": d * sizes[own] if weighted else d}

    scored = over_windows(df, channels, window, score, "score double", keys, size=size, models=model)
    if window > 1:
        from ..windows import centre_pad

        return centre_pad(df, scored, window, keys)
    return scored


# The same steps on a vector column with given centres, as Column expressions.


def assign(vectors: DataFrame, centres: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Nearest centre of every vector: centres (keys, cluster, c) -> (…, cluster, distance)."""
    packed = centres.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cluster", "c"))).alias("_cs"))
    out = attach(vectors, packed, keys)
    best = F.array_min(
        F.transform("_cs", lambda s: F.struct(sqdist(F.col("x"), s["c"]).alias("d"), s["cluster"].alias("cluster")))
    )
    return out.withColumn("_b", best).withColumn("cluster", F.col("_b.cluster")).withColumn(
        "distance", F.sqrt("_b.d")
    ).drop("_cs", "_b")


def large_clusters(assigned: DataFrame, alpha: float = 0.9, beta: float = 5.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, cluster, size, large) by the rule of ``separate``; few rows per key."""
    from pyspark.sql import Window

    sizes = assigned.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy(*keys).orderBy(F.col("size").desc(), "cluster")
    whole = Window.partitionBy(*keys)
    s = sizes.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.sum("size").over(whole))
    s = s.withColumn("_share", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) >= F.col("_n") * alpha)
    s = s.withColumn("_ratio", F.col("size") / F.lead("size").over(w) >= beta)
    not_last = F.col("_r") < F.max("_r").over(whole)
    first = lambda c: F.min(F.when(not_last & c, F.col("_r"))).over(whole)
    cut_at = F.coalesce(first(F.col("_share") & F.col("_ratio")), first(F.col("_share")), first(F.col("_ratio")))
    return s.select(*keys, "cluster", "size", (F.col("_r") <= cut_at).alias("large"))


def cblof_from_centres(vectors: DataFrame, centres: DataFrame, alpha=0.9, beta=5.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, t, cluster, score) of the cluster-based factor with given centres."""
    a = assign(vectors, centres, keys)
    large = large_clusters(a, alpha, beta, keys)
    kept = centres.join(large.filter("large").select(*keys, "cluster"), [*keys, "cluster"])
    packed = kept.groupBy(*keys).agg(F.collect_list("c").alias("_lc"))
    out = attach(attach(a, large.select(*keys, "cluster", "large"), [*keys, "cluster"]), packed, keys)
    near = F.array_min(F.transform("_lc", lambda c: distance(F.col("x"), c)))
    return out.select(*keys, "t", "cluster", F.when(F.col("large"), F.col("distance")).otherwise(near).alias("score"))
