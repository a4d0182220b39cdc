"""Plug-ins by name (inventory UDF1-UDF5, DET21): detectors, metrics, recommenders and the hyper-parameter grid.

Thresholding strategies register in ``operators.threshold``.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.chunks import CHUNK_ROWS, collected, key_schema, solve_per_key, with_models
from ..plans.ordered import halo
from ..session import cut
from . import metrics as mt
from .detect import cluster, density, forecast, forest, linear, neighbours, reconstruct
from .detect.vectors import as_vectors
from .profile import period
from .settings import GRID
from .windows import centre_pad

KEYS = ("series_id",)


def _vector_detector(score: Callable) -> Callable:
    """Detector on row or window vectors; window scores are centred on the points."""
    def run(df, channels, train=None, window: int = 1, keys=KEYS, size=None, **kw):
        v = as_vectors(df, channels, window, keys=keys, size=size)
        t = None if train is None else as_vectors(train, channels, window, keys=keys, size=size)
        out = score(v, t, keys, **kw)
        return centre_pad(df, out, window, keys) if window > 1 else out

    return run


def _hbos(v, train, keys, n_bins=10, tol=0.5, alpha=0.1):
    model = density.hbos_fit(v if train is None else train, n_bins, alpha, keys)
    return density.hbos_score(v, model, tol, keys)


def _copod(v, train, keys):
    return density.copod(v, keys, train)


def _knn(v, train, keys, n_neighbors=10, method="largest"):
    return neighbours.knn_score(v, n_neighbors, method, keys, train=train)


def _lof(v, train, keys, n_neighbors=30, metric="minkowski"):
    power = {"minkowski": 2, "euclidean": 2, "manhattan": 1}[metric]
    return neighbours.lof_score(v, n_neighbors, keys, p=power)


SHORT, SHORT_WINDOW = 600, 50  # fixed values: train splits below this length use this window


def _by_length(fn: Callable, default: int) -> Callable:
    """Semi-supervised detector with the default window, or the short one for series whose train split is short."""
    def run(df, channels, train=None, window: int | None = None, keys=KEYS, size=None, **kw):
        if window or train is None:
            return fn(df, channels, window or default, train, keys, size, **kw)
        n = cut(train.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
        kinds = {r["short"] for r in n.select((F.col("_n") < SHORT).alias("short")).distinct().collect()}
        parts = []
        for short in sorted(kinds):
            some = n.filter((F.col("_n") < SHORT) == F.lit(short)).select(*keys)
            own, fit = (x.join(some, list(keys), "left_semi") for x in (df, train))
            parts.append(fn(own, channels, SHORT_WINDOW if short else default, fit, keys, size, **kw))
        out = parts[0] if parts else fn(df, channels, default, train, keys, size, **kw)
        return out.unionByName(parts[1]) if len(parts) > 1 else out

    return run


def _adapted(fn: Callable, default: int) -> Callable:
    return _by_length(lambda df, channels, window, train, keys, size, **kw: fn(df, channels, window=window, train=train, keys=keys, size=size, **kw), default)


def _forecast(features: str) -> Callable:
    return _by_length(lambda df, channels, window, train, keys, size, **kw: forecast.forecast_score(df, channels, window, features, train, keys=keys, size=size, **kw), 100)


def _kmeans(df, channels, train=None, n_clusters=20, window_size=20, keys=KEYS, size=None, **kw):
    return cluster.kmeans_score(df, channels, n_clusters, window_size, keys=keys, size=size, train=train, **kw)


def _cblof(df, channels, train=None, n_clusters=8, alpha=0.9, beta=5.0, keys=KEYS, size=None, **kw):
    return cluster.cblof_score(df, channels, n_clusters, alpha, beta, keys=keys, size=size, train=train, **kw)


def _rpca(df, channels, train=None, max_iter=1000, keys=KEYS, size=None, mode="reference", prune=True, **kw):
    return linear.robust_pca(df, channels, max_iter, keys=keys, size=size, mode=mode, prune=prune, **kw)


UNSUPERVISED: dict[str, Callable] = {
    "KMeansAD_U": _kmeans, "COPOD": _vector_detector(_copod), "CBLOF": _cblof, "HBOS": _vector_detector(_hbos),
    "IForest": forest.iforest, "EIF": forest.extended_iforest, "LOF": _vector_detector(_lof), "KNN": _vector_detector(_knn),
    "PCA": linear.pca_score, "RobustPCA": _rpca,
}
SEMISUPERVISED: dict[str, Callable] = {
    "KMeansAD": _kmeans, "MCD": linear.mcd_score, "OCSVM": linear.ocsvm_score,
    "CNN": _forecast("dilated"), "LSTMAD": _forecast("full"),
    "AutoEncoder": _adapted(reconstruct.autoencoder, 100), "USAD": _adapted(reconstruct.two_stage, 5),
    "OmniAnomaly": _adapted(reconstruct.window_subspace, 100), "TranAD": _adapted(reconstruct.last_step, 10),
    "Donut": _adapted(reconstruct.probabilistic, 100), "TimesNet": _adapted(reconstruct.phase_mean, 96),
    "AnomalyTransformer": _adapted(reconstruct.association, 100), "ALLM4TS": _adapted(reconstruct.row_subspace, 100),
    "OFA": _adapted(reconstruct.segment_subspace, 100), "FITS": _adapted(reconstruct.spectral, 100),
}
# Detectors that also come in a form whose window is the period of a single-channel series.
PERIODIC = ("HBOS", "IForest", "LOF", "KNN", "PCA", "OCSVM", "MCD")
CUSTOM: dict[str, tuple[Callable, int]] = {}
FITTED: dict[str, tuple[Callable, Callable, Callable, int]] = {}
PROBE = 32  # further rows on both sides, to see whether a local function looks beyond its context


def register_detector(name: str, fn: Callable, context: int = 0) -> None:
    """Add a local function ``fn(matrix) -> scores``: the score of a row may depend on the ``context`` rows on both sides and on no others.

    Series are cut into chunks, so a function that needs a whole series would give other scores for other cuts. Each chunk is therefore scored
    a second time with more rows around it; where that changes a score, the rows of the chunk get an error instead. Detectors that need
    statistics of the whole series are added with ``register_fitted``.
    """
    CUSTOM[name] = (fn, context)


def register_fitted(name: str, partial: Callable, solve: Callable, score: Callable, context: int = 0) -> None:
    """Add a detector with a model: ``partial(matrix) -> sums`` over any rows (added up over the series), ``solve(sums) -> model`` (arrays),
    ``score(matrix, model) -> scores`` of rows that see ``context`` rows on both sides. Results do not depend on the chunks."""
    FITTED[name] = (partial, solve, score, context)


def names() -> list[str]:
    return [*UNSUPERVISED, *SEMISUPERVISED, *[f"Sub_{n}" for n in PERIODIC], *CUSTOM, *FITTED]


def run_custom(df: DataFrame, channels: Sequence[str], name: str, keys: Sequence[str] = KEYS, size=None) -> DataFrame:
    """(keys, t, score, error): an exception becomes the error text of the rows of its chunk, the job goes on."""
    fn, context = CUSTOM[name]
    chans, cols = list(channels), [*keys, "t", "score", "error"]
    chunked = halo(df.select(*keys, "t", *channels), keys, "t", context + PROBE, context + PROBE, size or CHUNK_ROWS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable").reset_index(drop=True)
        own = np.flatnonzero(pdf["_own"].to_numpy())
        if not len(own):
            return pd.DataFrame(columns=cols)
        x = pdf[chans].to_numpy(dtype=float)
        lo, hi = max(own[0] - context, 0), min(own[-1] + context + 1, len(x))
        out = pdf.loc[own, [*keys, "t"]].copy()
        out["score"], out["error"] = np.nan, None
        try:
            near = np.asarray(fn(x[lo:hi]), dtype=float)[own - lo]
            probes = [np.asarray(fn(x[a:b]), dtype=float)[own - a] for a, b in ((0, len(x)), (0, hi), (lo, len(x)))]
            if all(np.allclose(near, p, rtol=1e-9, atol=1e-12, equal_nan=True) for p in probes):
                out["score"] = near
            else:
                out["error"] = "the scores depend on rows beyond the context; use register_fitted"
        except Exception as exc:  # noqa: BLE001 - a plug-in may raise anything
            out["error"] = f"{type(exc).__name__}: {exc}"
        return out[cols]

    schema = f"{key_schema(df, keys)}, t {df.schema['t'].dataType.simpleString()}, score double, error string"
    return chunked.groupBy(*keys, "_chunk").applyInPandas(run, schema)


def run_fitted(df: DataFrame, channels: Sequence[str], name: str, train: DataFrame | None = None, keys: Sequence[str] = KEYS, size=None) -> DataFrame:
    """(keys, t, score) of a detector with a model; series without training rows have NULL scores."""
    partial, solve, score, context = FITTED[name]
    chans, names_ = list(channels), list(keys)
    base = df if train is None else train

    def sums(batches):
        for pdf in batches:
            for key, part in pdf.groupby(names_, sort=False, dropna=False):
                flat = np.asarray(partial(part[chans].to_numpy(dtype=float)), dtype=float).ravel()
                out = pd.DataFrame({"i": np.arange(len(flat)), "v": flat})
                for k, v in zip(names_, key, strict=True):
                    out[k] = v
                yield out[[*names_, "i", "v"]]

    parts = base.select(*keys, *chans).mapInPandas(sums, f"{key_schema(df, keys)}, i int, v double")
    model = solve_per_key(collected(parts, keys), lambda row: {"model": np.asarray(solve(np.asarray(row["m"])), dtype=float).ravel().tolist()}, "model array<double>", keys)
    chunked = halo(df.select(*keys, "t", *chans), keys, "t", context, context, size or CHUNK_ROWS)

    def run(pdf: pd.DataFrame, m) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        own = pdf["_own"].to_numpy()
        out = pdf.loc[own, [*names_, "t"]].copy()
        out["score"] = np.nan if m is None else np.asarray(score(pdf[chans].to_numpy(dtype=float), np.asarray(m["model"])), dtype=float)[own]
        return out

    schema = f"{key_schema(df, keys)}, t {df.schema['t'].dataType.simpleString()}, score double"
    return with_models(chunked, names_, cut(model), run, [*names_, "t", "score"], schema)


def detect(
    name: str, df: DataFrame, channels: Sequence[str], train: DataFrame | None = None, keys: Sequence[str] = KEYS, **kw
) -> DataFrame:
    """Score all series with the detector of that name: (keys, t, score).  Higher means more anomalous.

    ``Sub_<name>`` takes the period of the only channel as window; series are scored per period.
    """
    if name in CUSTOM:
        return run_custom(df, channels, name, keys, **kw)
    if name in FITTED:
        return run_fitted(df, channels, name, train, keys, **kw)
    if name in UNSUPERVISED:
        return UNSUPERVISED[name](df, channels, train=train, keys=keys, **kw)
    if name in SEMISUPERVISED:
        return SEMISUPERVISED[name](df, channels, train=train, keys=keys, **kw)
    if name.startswith("Sub_") and name[4:] in PERIODIC:
        return periodic(name[4:], df, channels, keys=keys, **kw)
    raise ValueError(f"unknown detector {name}; known: {', '.join(names())}")


def periodic(
    name: str, df: DataFrame, channels: Sequence[str], rank: int = 1, keys: Sequence[str] = KEYS, **kw
) -> DataFrame:
    """Window = period of each series.  Series are handled together per distinct period (at most 300 of them)."""
    p = period(df, channels[0], rank, keys, len(channels))
    windows = sorted(r["period"] for r in p.select("period").distinct().collect())  # a few small numbers
    parts = []
    for w in windows:
        some = df.join(p.filter(F.col("period") == w).select(*keys), list(keys), "left_semi")
        parts.append(detect(name, some, channels, keys=keys, window=max(int(w), 1), **kw))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Hyper-parameter grid: one row per detector and setting.


def settings(grid: dict[str, dict[str, list]]) -> list[tuple[str, dict]]:
    """All combinations of every detector."""
    out = []
    for name, params in grid.items():
        for values in itertools.product(*params.values()):
            out.append((name, dict(zip(params, values, strict=True))))
    return out


def grid_table(spark: SparkSession, grid: dict[str, dict[str, list]] | None = None) -> DataFrame:
    """(model, setting, params): the grid as rows; its size is that of the given dictionary."""
    rows = [(n, i, {k: str(v) for k, v in p.items()}) for i, (n, p) in enumerate(settings(grid or GRID))]
    return spark.createDataFrame(rows, "model string, setting int, params map<string,string>")


def search(
    df: DataFrame, channels: Sequence[str], grid: dict[str, dict[str, list]], metric: Callable | None = None,
    keys: Sequence[str] = KEYS, label: str = "label",
) -> DataFrame:
    """(keys, model, setting, value): every setting on all series; one job per setting, series are rows of it."""
    metric = metric or (lambda s: mt.pointwise(s, keys).select(*keys, F.col("auc_roc").alias("value")))
    out = None
    for i, (name, params) in enumerate(settings(grid)):
        scored = detect(name, df, channels, keys=keys, **params).join(df.select(*keys, "t", label), [*keys, "t"])
        part = metric(scored).withColumn("model", F.lit(name)).withColumn("setting", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


METRICS: dict[str, Callable] = {
    "pointwise": mt.pointwise, "pa_f1": mt.point_adjusted_f1, "event_f1": mt.event_f1, "range_f1": mt.range_f1,
    "affiliation_f": mt.affiliation_f, "vus": mt.vus, "auc_ptrt": mt.auc_ptrt, "recall_precision": mt.recall_precision,
}


def register_metric(name: str, fn: Callable) -> None:
    """Add ``fn(labelled scores) -> one row per key``."""
    METRICS[name] = fn


def evaluate(name: str, df: DataFrame, **kw) -> DataFrame:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name}")
    return METRICS[name](df, **kw)
