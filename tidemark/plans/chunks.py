"""Numpy work on chunks of a series, and Gram matrices summed by Spark.

Spark cuts every series into chunks with a halo and shuffles them; a task sees one chunk (a bounded number of rows), takes the sliding
windows as a view and returns one row per window.  Windows are never written out.  Model parameters are one row per series and
travel to the chunks of their series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .attach import sized
from .ordered import halo

KEYS = ("series_id",)
CHUNK_ROWS = 1 << 15
BATCH_CELLS = 1 << 22


def key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)


def window_view(x: np.ndarray, window: int) -> np.ndarray:
    """(n - w + 1, w, d) view of an (n, d) matrix."""
    return np.lib.stride_tricks.sliding_window_view(x, window, axis=0).transpose(0, 2, 1)


def _batches(n: int, cells: int):
    step = max(1, BATCH_CELLS // max(cells, 1))
    for a in range(0, n, step):
        yield a, min(n, a + step)


def _own_windows(pdf: pd.DataFrame, channels, window: int, stride: int):
    """Begins owned by the chunk and the view of all its windows."""
    pdf = pdf.sort_values("t", kind="stable")
    x = pdf[list(channels)].to_numpy(dtype=float)
    if len(x) < window:
        return None, None
    view = window_view(x, window)
    t = pdf["t"].to_numpy()[: len(view)]
    pick = pdf["_own"].to_numpy()[: len(view)] & (t % stride == 0)
    return t, (view, np.flatnonzero(pick))


def over_windows(
    df: DataFrame, channels: Sequence[str], window: int, fn: Callable, schema: str, keys: Sequence[str] = KEYS,
    stride: int = 1, size: int | None = None, models: DataFrame | None = None,
) -> DataFrame:
    """One row per window begin: ``fn(windows[N, w, d], t[N], model) -> {column: values}``.

    ``schema`` lists the columns that fn returns; the keys and t are added.
    """
    chunked = halo(df.select(*keys, "t", *channels), keys, "t", 0, window - 1, size or CHUNK_ROWS)
    names, chans = list(keys), list(channels)
    out_schema = f"{key_schema(df, keys)}, t {df.schema['t'].dataType.simpleString()}, {schema}"
    columns = [*names, "t", *[c.strip().split()[0] for c in _split_schema(schema)]]
    modelled = models is not None

    def run(pdf: pd.DataFrame, model) -> pd.DataFrame:
        t, rest = _own_windows(pdf, chans, window, stride)
        if t is None:
            return pd.DataFrame(columns=columns)
        view, at = rest
        parts = []
        if model is None and modelled:  # NULL results
            parts.append(pd.DataFrame({"t": t[at], **dict.fromkeys(columns[len(names) + 1 :])}))
            at = at[:0]
        for a, b in _batches(len(at), window * len(chans)):
            res = fn(view[at[a:b]], t[at[a:b]], model)
            parts.append(pd.DataFrame({"t": t[at[a:b]], **res}))
        out = pd.concat(parts) if parts else pd.DataFrame(columns=columns)
        for k in names:
            out[k] = pdf[k].iloc[0]
        return out[columns]

    if models is None:
        return chunked.groupBy(*names, "_chunk").applyInPandas(lambda pdf: run(pdf, None), out_schema)
    return with_models(chunked, names, models, run, columns, out_schema)


def with_models(chunked, names, models, run, columns, out_schema):
    """``run(chunk, model)`` with the model of the chunk's series, or None where the series has no model."""
    spread = chunked.select(*names, "_chunk").distinct().join(sized(models), names)
    fresh = spread.select(*[F.col(c).alias(c) for c in spread.columns])

    def both(pdf: pd.DataFrame, mdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=columns)
        return run(pdf, None if mdf.empty else mdf.iloc[0].to_dict())[columns]

    return (
        chunked.groupBy(*names, "_chunk")
        .cogroup(fresh.groupBy(*names, "_chunk"))
        .applyInPandas(both, out_schema)
    )


def packed_chunks(df: DataFrame, channels: Sequence[str], window: int, keys: Sequence[str] = KEYS, size: int | None = None) -> DataFrame:
    """One row per chunk: (keys, _chunk, own, one array per channel), own rows first, then the rows that windows reach into.

    Written once for operators that pass over all windows again and again; a pass then needs no shuffle of rows.
    """
    chunked = halo(df.select(*keys, "t", *channels), keys, "t", 0, window - 1, size or CHUNK_ROWS)
    rows = F.sort_array(F.collect_list(F.struct("t", "_own", *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(channels)])))
    out = chunked.groupBy(*keys, "_chunk").agg(rows.alias("_rows"), F.sum(F.col("_own").cast("int")).cast("int").alias("own"))
    return cut(out.select(*keys, "_chunk", "own", *[F.col(f"_rows._c{i}").alias(f"c{i}") for i in range(len(channels))]))


def sum_over_windows(chunks: DataFrame, dims: int, window: int, fn: Callable, models: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, m): the sum over all windows of packed chunks of ``fn(windows, model) -> flat array``; one row per chunk is summed."""
    names = list(keys)

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                x = np.stack([np.asarray(row[f"c{i}"], dtype=float) for i in range(dims)], axis=1)
                if len(x) < window or not row["own"]:
                    continue
                view = window_view(x, window)[: row["own"]]
                total = 0.0
                for a, b in _batches(len(view), window * dims):
                    total = total + fn(view[a:b], row)
                out.append({**{k: row[k] for k in names}, "v": total})
            yield pd.DataFrame(out, columns=[*names, "v"])

    parts = chunks.join(sized(models), names).mapInPandas(run, f"{key_schema(chunks, keys)}, v array<double>")
    return collected(parts.select(*names, F.posexplode("v").alias("i", "v")), keys)


def values_over_windows(chunks: DataFrame, dims: int, window: int, fn: Callable, models: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, v): ``fn(windows, model) -> values``, one row per window of packed chunks."""
    names = list(keys)

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                x = np.stack([np.asarray(row[f"c{i}"], dtype=float) for i in range(dims)], axis=1)
                if len(x) < window or not row["own"]:
                    continue
                view = window_view(x, window)[: row["own"]]
                for a, b in _batches(len(view), window * dims):
                    yield pd.DataFrame({**{k: row[k] for k in names}, "v": fn(view[a:b], row)})

    return chunks.join(sized(models), names).mapInPandas(run, f"{key_schema(chunks, keys)}, v double")


def over_rows(
    df: DataFrame, columns_in: Sequence[str], fn: Callable, schema: str, keys: Sequence[str] = KEYS,
    size: int | None = None, models: DataFrame | None = None, order: str = "t",
) -> DataFrame:
    """One row per row: ``fn(frame, model) -> {column: values}``; the frame holds ``columns_in`` of one chunk."""
    chunked = halo(df.select(*keys, order, *columns_in), keys, order, 0, 0, size or CHUNK_ROWS)
    names = list(keys)
    out_schema = f"{key_schema(df, keys)}, {order} {df.schema[order].dataType.simpleString()}, {schema}"
    columns = [*names, order, *[c.strip().split()[0] for c in _split_schema(schema)]]

    modelled = models is not None

    def run(pdf: pd.DataFrame, model) -> pd.DataFrame:
        values = dict.fromkeys(columns[len(names) + 1 :]) if model is None and modelled else fn(pdf, model)
        out = pd.DataFrame({order: pdf[order].to_numpy(), **values})
        for k in names:
            out[k] = pdf[k].iloc[0]
        return out[columns]

    if models is None:
        return chunked.groupBy(*names, "_chunk").applyInPandas(lambda pdf: run(pdf, None), out_schema)
    return with_models(chunked, names, models, run, columns, out_schema)


def _split_schema(schema: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(schema[last:i])
            last = i + 1
    return [*parts, schema[last:]]


def _moment_rows(m: np.ndarray) -> np.ndarray:
    """Count, sums and the upper triangle of the Gram matrix of a row matrix, flattened."""
    g = m.T @ m
    return np.concatenate([[len(m)], m.sum(0), g[np.triu_indices(g.shape[0])]])


def collected(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum flattened partial results (keys, i, v) and pack them as one array ``m`` per key."""
    total = parts.groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    return total.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("m")
    )


def window_moments(
    df: DataFrame, channels: Sequence[str], window: int, prep: Callable | None = None, keys: Sequence[str] = KEYS,
    stride: int = 1, size: int | None = None, models: DataFrame | None = None, weight: Callable | None = None,
) -> DataFrame:
    """(keys, m): count, sums and Gram matrix of ``prep(windows, model)`` rows (default: flattened, time-major).

    The partial results of a chunk are exploded and summed with map-side combine, so no task holds a whole series.
    """
    names, chans = list(keys), list(channels)
    chunked = halo(df.select(*names, "t", *chans), names, "t", 0, window - 1, size or CHUNK_ROWS)
    cols = [*names, "i", "v"]
    schema = f"{key_schema(df, keys)}, i int, v double"
    modelled = models is not None

    def run(pdf: pd.DataFrame, model) -> pd.DataFrame:
        t, rest = _own_windows(pdf, chans, window, stride)
        if t is None or not len(rest[1]) or model is None and modelled:
            return pd.DataFrame(columns=cols)
        view, at = rest
        acc = None
        for a, b in _batches(len(at), window * len(chans)):
            w = view[at[a:b]]
            rows = prep(w, model) if prep else w.reshape(len(w), -1)
            if weight is not None:
                rows = rows[weight(rows, model)]
            part = _moment_rows(rows)
            acc = part if acc is None else acc + part
        out = pd.DataFrame({"i": np.arange(len(acc)), "v": acc})
        for k in names:
            out[k] = pdf[k].iloc[0]
        return out[cols]

    if models is None:
        parts = chunked.groupBy(*names, "_chunk").applyInPandas(lambda pdf: run(pdf, None), schema)
    else:
        parts = with_models(chunked, names, models, run, cols, schema)
    return collected(parts, keys)


def row_moments(df: DataFrame, channels: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, m) over plain rows; partial results per Arrow batch, so the rows themselves are not shuffled."""
    names, chans = list(keys), list(channels)

    def run(batches):
        for pdf in batches:
            for key, part in pdf.groupby(names, sort=False):
                flat = _moment_rows(part[chans].to_numpy(dtype=float))
                out = pd.DataFrame({"i": np.arange(len(flat)), "v": flat})
                for k, v in zip(names, key if isinstance(key, tuple) else (key,), strict=True):
                    out[k] = v
                yield out[[*names, "i", "v"]]

    parts = df.select(*names, *chans).mapInPandas(run, f"{key_schema(df, keys)}, i int, v double")
    return collected(parts, keys)


def array_moments(df: DataFrame, column: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, m) of a vector column; partial results per Arrow batch."""
    names = list(keys)

    def run(batches):
        for pdf in batches:
            for key, part in pdf.groupby(names, sort=False):
                flat = _moment_rows(np.stack(part[column].to_numpy()).astype(float))
                out = pd.DataFrame({"i": np.arange(len(flat)), "v": flat})
                for k, v in zip(names, key if isinstance(key, tuple) else (key,), strict=True):
                    out[k] = v
                yield out[[*names, "i", "v"]]

    parts = df.select(*names, column).mapInPandas(run, f"{key_schema(df, keys)}, i int, v double")
    return collected(parts, keys)


def unpack(m, p: int | None = None):
    """(count, mean, covariance with ddof 0) of a packed moment array."""
    m = np.asarray(m, dtype=float)
    if p is None:
        p = int((-3 + np.sqrt(9 + 8 * (len(m) - 1))) / 2 + 0.5)
    n, s = m[0], m[1 : 1 + p]
    g = np.zeros((p, p))
    g[np.triu_indices(p)] = m[1 + p :]
    g = g + g.T - np.diag(np.diag(g))
    mean = s / n
    return n, mean, g / n - np.outer(mean, mean)


def solve_per_key(moments: DataFrame, fn: Callable, schema: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Model per key: ``fn(row dict) -> {column: value}`` on the executors, one small row per key."""
    names = list(keys)
    columns = [*names, *[c.strip().split()[0] for c in _split_schema(schema)]]

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                res = fn(row)
                if res is not None:
                    rows.append({**{k: row[k] for k in names}, **res})
            yield pd.DataFrame(rows, columns=columns)

    return moments.mapInPandas(run, f"{key_schema(moments, keys)}, {schema}")
