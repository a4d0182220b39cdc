"""Isolation forests with axis-parallel or oblique splits (inventory DET5, DET6).

Each tree grows on about 256 windows chosen by a hash of (tree, window begin), so the trees do not depend on the partitioning.  All trees of
all series grow in parallel, one small group per tree; the finished forest of a series is one row that follows its chunks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...plans.chunks import key_schema, over_windows
from ...session import cut
from ..windows import centre_pad
from .cluster import hashed_share, window_rows

KEYS = ("series_id",)
EULER = 0.5772156649  # fixed value


def path_norm(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = np.where(big, n, 3)
    return np.where(big, 2 * (np.log(m - 1) + EULER) - 2 * (m - 1) / m, out)


def grow(x: np.ndarray, seed: int, features: int, oblique: bool, extension: int | None = None):
    """Heap-free tree as flat arrays: feature (or normal), threshold, left, right, size, depth."""
    rng = np.random.default_rng(seed)
    p = x.shape[1]
    limit = math.ceil(math.log2(max(len(x), 2)))
    usable = np.sort(rng.choice(p, size=min(features, p), replace=False))
    nodes: list[list[float]] = []
    normals: list[np.ndarray] = []

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(rows), depth])
        normals.append(np.zeros(p))
        if depth >= limit or len(rows) <= 1:
            return at
        part = x[rows]
        lo, hi = part.min(0), part.max(0)
        if oblique:
            if not (hi > lo).any():
                return at
            normal = rng.normal(size=p)
            zero = p - 1 - (p - 1 if extension is None else extension)
            if zero > 0:
                normal[rng.choice(p, size=zero, replace=False)] = 0.0
            point = rng.uniform(lo, hi)
            value = part @ normal
            threshold = float(point @ normal)
            nodes[at][0] = 0
            normals[at] = normal
        else:
            open_ = usable[hi[usable] > lo[usable]]
            if not len(open_):
                return at
            f = int(rng.choice(open_))
            threshold = float(rng.uniform(lo[f], hi[f]))
            value = part[:, f]
            nodes[at][0] = f
        nodes[at][1] = threshold
        below = value <= threshold
        nodes[at][2] = add(rows[below], depth + 1)
        nodes[at][3] = add(rows[~below], depth + 1)
        return at

    add(np.arange(len(x)), 0)
    return np.asarray(nodes), np.stack(normals)


def depths(x: np.ndarray, nodes: np.ndarray, normals: np.ndarray | None) -> np.ndarray:
    """Path length of every row: depth of its leaf plus the mean depth of the unsplit points there."""
    at = np.zeros(len(x), dtype=int)
    while True:
        inner = nodes[at, 0] >= 0
        if not inner.any():
            break
        rows = np.flatnonzero(inner)
        node = at[rows]
        if normals is None:
            value = x[rows, nodes[node, 0].astype(int)]
        else:
            value = np.einsum("ij,ij->i", x[rows], normals[node])
        below = value <= nodes[node, 1]
        at[rows] = np.where(below, nodes[node, 2], nodes[node, 3]).astype(int)
    return nodes[at, 5] + path_norm(nodes[at, 4])


def forest_fit(
    df: DataFrame, channels: Sequence[str], window: int = 1, trees: int = 100, sample: int = 256,
    max_features: int | float = 1.0, oblique: bool = False, extension: int | None = None, seed: int = 0,
    keys: Sequence[str] = KEYS, size=None, prep=window_rows,
) -> DataFrame:
    """(keys, tree list): every tree with its nodes, and for oblique trees the normals."""
    names = list(keys)
    n = df.groupBy(*keys).agg((F.count(F.lit(1)) - (window - 1)).alias("n"))

    def draw(w, t, model):
        total = max(int(model["n"]), 1)
        # a little more than needed; the tree takes the smallest hashes
        share = min(1.0, (sample + 6 * math.sqrt(sample)) / total)
        lists = np.empty(len(t), dtype=object)
        hits = np.stack([hashed_share(t, seed * 1009 + j + 1) for j in range(trees)], axis=1)
        chosen = hits < share if share < 1 else np.ones_like(hits, dtype=bool)
        any_ = chosen.any(1)
        vec = np.empty(len(t), dtype=object)
        rows = np.flatnonzero(any_)
        vec[rows] = list(prep(w[rows]))
        for i in rows:
            lists[i] = np.flatnonzero(chosen[i]).astype(np.int32)
        return {"trees": lists, "x": vec}

    drawn = over_windows(df, channels, window, draw, "trees array<int>, x array<double>", keys, size=size, models=n)
    drawn = drawn.filter("x IS NOT NULL").select(*keys, "t", "x", F.explode("trees").alias("tree"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        j = int(pdf["tree"].iloc[0])
        t = pdf["t"].to_numpy()
        order = np.lexsort((t, hashed_share(t, seed * 1009 + j + 1)))[:sample]
        x = np.stack(pdf["x"].to_numpy()[order])
        p = x.shape[1]
        feats = max(1, int(max_features * p)) if isinstance(max_features, float) else max_features
        nodes, normals = grow(x, seed * 1009 + j, feats, oblique, extension)
        out = pdf.iloc[:1][[*names, "tree"]].copy()
        out["psi"], out["width"] = len(x), p
        out["nodes"] = [nodes.ravel().tolist()]
        out["normals"] = [normals.ravel().tolist() if oblique else []]
        return out

    schema = f"{key_schema(df, keys)}, tree int, psi int, width int, nodes array<double>, normals array<double>"
    return cut(drawn.groupBy(*names, "tree").applyInPandas(build, schema))


def _packed(forest: DataFrame, keys) -> DataFrame:
    return forest.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("tree", "psi", "width", "nodes", "normals"))).alias("forest"),
    ).select(*keys, F.col("forest.psi").alias("psi"), F.col("forest.width").alias("width"),
             F.transform("forest.nodes", lambda v: F.size(v)).alias("cut"),
             F.flatten("forest.nodes").alias("nodes"), F.flatten("forest.normals").alias("normals"))


def forest_score(
    df: DataFrame, channels: Sequence[str], forest: DataFrame, window: int = 1, keys: Sequence[str] = KEYS, size=None,
    prep=window_rows,
) -> DataFrame:
    """(keys, t, score): 2^(-mean path length / mean depth of the sample size)."""
    def score(w, t, m):
        x = prep(w)
        p = int(m["width"][0])
        nodes, normals = np.asarray(m["nodes"]), np.asarray(m["normals"])
        total, at, nat = np.zeros(len(x)), 0, 0
        for psi, width in zip(m["psi"], m["cut"], strict=True):
            tree = nodes[at : at + width].reshape(-1, 6)
            at += width
            norm = None
            if len(normals):
                norm = normals[nat : nat + len(tree) * p].reshape(-1, p)
                nat += len(tree) * p
            total += depths(x, tree, norm) / max(float(path_norm(psi)), 1e-12)
        return {"score": np.exp2(-total / len(m["psi"]))}

    scored = over_windows(df, channels, window, score, "score double", keys, size=size, models=_packed(forest, keys))
    return centre_pad(df, scored, window, keys) if window > 1 else scored


def iforest(
    df: DataFrame, channels: Sequence[str], window: int = 100, trees: int = 100, max_features: int | float = 1,
    train: DataFrame | None = None, keys: Sequence[str] = KEYS, size=None, seed: int = 0,
) -> DataFrame:
    normal = len(channels) > 1
    prep = window_rows if normal else (lambda w: window_rows(w, False))
    base = df if train is None else train
    forest = forest_fit(base, channels, window, trees, max_features=max_features, keys=keys, size=size, seed=seed, prep=prep)
    return forest_score(df, channels, forest, window, keys, size, prep)


def extended_iforest(
    df: DataFrame, channels: Sequence[str], trees: int = 100, extension: int | None = None, train: DataFrame | None = None,
    keys: Sequence[str] = KEYS, size=None, seed: int = 0,
) -> DataFrame:
    base = df if train is None else train
    forest = forest_fit(base, channels, 1, trees, oblique=True, extension=extension, keys=keys, size=size, seed=seed)
    return forest_score(df, channels, forest, 1, keys, size)


def forest_shape(forest: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, tree, leaves, depth): shape of every tree."""
    node = F.transform(
        F.sequence(F.lit(0), (F.size("nodes") / 6 - 1).cast("int")),
        lambda i: F.struct(F.element_at("nodes", i * 6 + 1).alias("f"), F.element_at("nodes", i * 6 + 6).alias("d")),
    )
    f = forest.select(*keys, "tree", node.alias("n"))
    return f.select(
        *keys, "tree", F.size(F.filter("n", lambda s: s["f"] < 0)).alias("leaves"),
        F.array_max(F.transform("n", lambda s: s["d"])).cast("int").alias("depth"),
    )
