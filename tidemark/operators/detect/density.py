"""Copula- and histogram-based scores (inventory DET3, DET4)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...plans.attach import attach
from ...plans.ordered import cumulate
from ..profile import optimal_bins
from .vectors import as_long

KEYS = ("series_id",)


def copod(vectors: DataFrame, keys: Sequence[str] = KEYS, train: DataFrame | None = None, per_range=None) -> DataFrame:
    """(keys, t, score): sum over the elements of max(skew-chosen tail, mean of both tails) of -ln ECDF.

    With ``train`` the tails are those of train and test rows together, and only the test rows are returned.
    """
    at = [*keys, "channel"]
    long = as_long(vectors, keys)
    base = long if train is None else long.unionByName(as_long(train, keys))
    c = cumulate(base, at, "x", per_range=per_range)
    left = -F.ln(F.col("cum_n") / F.col("tot_n"))
    right = -F.ln((F.col("tot_n") - F.col("cum_n") + F.col("n")) / F.col("tot_n"))
    skew = base.groupBy(*at).agg(F.coalesce(F.skewness("x"), F.lit(0.0)).alias("_skew"))
    tails = attach(c.select(*at, "x", left.alias("_l"), right.alias("_r")), skew, at)
    both = F.col("_l") + F.col("_r")
    chosen = F.when(F.col("_skew") > 0, F.col("_r")).when(F.col("_skew") < 0, F.col("_l")).otherwise(both)
    tails = tails.select(*at, "x", F.greatest(chosen, both / 2).alias("_o"))
    return long.join(tails, [*at, "x"]).groupBy(*keys, "t").agg(F.sum("_o").alias("score"))


def _edge(i: Column, lo: Column, hi: Column, bins: Column) -> Column:
    return F.when(i >= bins, hi).otherwise(lo + i * ((hi - lo) / bins))


def _bin(x: Column, lo: Column, hi: Column, bins: Column, right: bool) -> Column:
    """Bin of a value by comparison with the edges: left-closed (last bin closed), or right-closed (first edge in bin 0)."""
    guess = F.floor((x - lo) / ((hi - lo) / bins)).cast("int")
    out = guess - 1
    for off in (0, 1):
        e = _edge(guess + off, lo, hi, bins)
        out = out + F.when((e < x) if right else (e <= x), 1).otherwise(0)
    return F.greatest(F.least(out, bins - 1), F.lit(0)).cast("int")


def hbos_fit(
    vectors: DataFrame, bins: int | str = 10, alpha: float = 0.1, keys: Sequence[str] = KEYS, per_element_bins=None
) -> DataFrame:
    """Histogram model: (keys, channel, lo, hi, bins, logd) with one log density per bin."""
    at = [*keys, "channel"]
    long = as_long(vectors, keys)
    lim = long.groupBy(*at).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("_n"))
    if bins == "auto":
        lim = lim.join(optimal_bins(long, at), at)
    else:
        lim = lim.withColumn("bins", F.lit(int(bins)))
    flat = F.col("hi") == F.col("lo")
    # a constant element gets the unit-wide range around its value
    lim = lim.withColumn("_c", F.col("lo")).withColumn("lo", F.when(flat, F.col("_c") - 0.5).otherwise(F.col("lo")))
    lim = lim.withColumn("hi", F.when(flat, F.col("_c") + 0.5).otherwise(F.col("hi"))).drop("_c")
    placed = attach(long, lim, at)
    counts = placed.groupBy(*at, "lo", "hi", "bins", "_n", _bin(F.col("x"), F.col("lo"), F.col("hi"), F.col("bins"), False).alias("b")).agg(
        F.count(F.lit(1)).alias("c")
    )
    table = counts.groupBy(*at, "lo", "hi", "bins", "_n").agg(F.map_from_entries(F.collect_list(F.struct("b", "c"))).alias("m"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    logd = F.transform(
        F.sequence(F.lit(0), F.col("bins") - 1),
        lambda i: F.log2(F.coalesce(F.try_element_at("m", i), F.lit(0)) / (F.col("_n") * width) + F.lit(alpha)),
    )
    return table.select(*at, "lo", "hi", "bins", logd.alias("logd"))


def hbos_score(vectors: DataFrame, model: DataFrame, tol: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, t, score) with a frozen model: minus the sum of log densities.

    Lookup bins are right-closed.  A value outside the range takes the edge bin while it is within tol bin widths, and the
    smallest density beyond that.
    """
    at = [*keys, "channel"]
    x, lo, hi, bins = F.col("x"), F.col("lo"), F.col("hi"), F.col("bins")
    slack = (hi - lo) / bins * F.lit(tol)
    inside = F.element_at("logd", _bin(x, lo, hi, bins, True) + 1)
    value = (
        F.when(x < lo, F.when(lo - x <= slack, F.element_at("logd", 1)).otherwise(F.array_min("logd")))
        .when(x > hi, F.when(x - hi <= slack, F.element_at("logd", -1)).otherwise(F.array_min("logd")))
        .otherwise(inside)
    )
    scored = attach(as_long(vectors, keys), model, at).select(*keys, "t", value.alias("_v"))
    return scored.groupBy(*keys, "t").agg((-F.sum("_v")).alias("score"))


def hbos_points(x: np.ndarray, lo: float, hi: float, logd: np.ndarray, tol: float = 0.5) -> np.ndarray:
    """Log densities of the values of one element by a frozen histogram; the rule of :func:`hbos_score` for rows in memory."""
    bins = len(logd)
    width = (hi - lo) / bins
    edges = np.append(lo + np.arange(bins) * width, hi)
    inside = logd[np.clip(np.searchsorted(edges, x, "left") - 1, 0, bins - 1)]
    low = np.where(lo - x <= width * tol, logd[0], logd.min())
    high = np.where(x - hi <= width * tol, logd[-1], logd.min())
    return np.where(x < lo, low, np.where(x > hi, high, inside))


def hbos(vectors: DataFrame, bins: int | str = 10, tol: float = 0.5, alpha: float = 0.1, keys: Sequence[str] = KEYS):
    return hbos_score(vectors, hbos_fit(vectors, bins, alpha, keys), tol, keys)
