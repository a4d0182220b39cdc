"""Scores as levels of a threshold list.

With thresholds numbered 0..m-1 in ascending order, ``kx`` is the number of thresholds a score exceeds; the point is
predicted at level k exactly when k < kx.  All thresholds are then evaluated together by histograms over kx.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...plans.attach import attach
from ...plans.ordered import carry, running_sum, shifted
from ...session import cut
from ..threshold import grid_exceeded

KEYS = ("series_id",)
GRID = 100


def on_grid(df: DataFrame, keys: Sequence[str] = KEYS, score="score", label="label", count: int = GRID) -> DataFrame:
    """Evenly spaced thresholds between the smallest and the largest score, score > threshold."""
    s = F.col(score).cast("double")
    lim = df.groupBy(*keys).agg(F.min(s).alias("_lo"), F.max(s).alias("_hi"))
    kx = grid_exceeded(s, F.col("_lo"), F.col("_hi"), count)
    return attach(df, lim, keys).select(*keys, "t", kx.alias("kx"), F.col(label).cast("int").alias("label"))


def on_thresholds(
    df: DataFrame, thresholds: DataFrame, keys: Sequence[str] = KEYS, score="score", label="label", strict=False
) -> DataFrame:
    """A short list of thresholds per key (keys, threshold), score >= threshold (or > with ``strict``)."""
    listed = thresholds.groupBy(*keys).agg(F.sort_array(F.collect_list("threshold")).alias("_th"))
    below = (lambda v: v < F.col(score)) if strict else (lambda v: v <= F.col(score))
    kx = F.size(F.filter("_th", below))
    return attach(df, listed, keys).select(*keys, "t", kx.alias("kx"), F.col(label).cast("int").alias("label"))


def on_prediction(df: DataFrame, keys: Sequence[str] = KEYS, pred="pred", label="label") -> DataFrame:
    """One level: the given 0/1 prediction."""
    return df.select(*keys, "t", F.col(pred).cast("int").alias("kx"), F.col(label).cast("int").alias("label"))


def traced(points: DataFrame, keys: Sequence[str] = KEYS, size: int | None = None) -> DataFrame:
    """Neighbouring levels (pk, nk) and running counts: label points cl, label runs cs, label positions ct."""
    s = shifted(points, keys, "t", {"pk": ("kx", 1), "nk": ("kx", -1), "_pl": ("label", 1)}, size)
    s = s.select(
        *keys, "t", "kx", "label", F.coalesce("pk", F.lit(0)).alias("pk"), F.coalesce("nk", F.lit(0)).alias("nk"),
        F.when((F.col("label") == 1) & (F.coalesce("_pl", F.lit(0)) == 0), 1).otherwise(0).alias("st"),
        (F.col("label") * F.col("t")).cast("long").alias("_tl"),
    )
    return cut(running_sum(s, keys, "t", {"cl": "label", "cs": "st", "ct": "_tl"}, size).drop("_tl"))


def level_runs(trace: DataFrame, keys: Sequence[str] = KEYS, size: int | None = None) -> DataFrame:
    """Predicted runs of all levels: (keys, k, s, e, lab, ev, ts).

    lab and ts count and sum the label positions inside, ev counts the label runs that are met.  Only the points where a level
    begins or ends are listed, and each begin takes the next end of its level.
    """
    edge = trace.filter((F.col("kx") > F.col("pk")) | (F.col("kx") > F.col("nk"))).withColumn(
        "k", F.explode(F.sequence(F.least("pk", "nk"), F.col("kx") - 1))
    )
    end = F.struct(F.col("t").alias("e"), "cl", "cs", "ct")
    edge = edge.withColumn("_end", F.when(F.col("k") >= F.col("nk"), end))
    paired = carry(edge, [*keys, "k"], "t", {"_at": ("_end", "next", True)}, size).filter(F.col("k") >= F.col("pk"))
    return paired.select(
        *keys, "k", F.col("t").alias("s"), F.col("_at.e").alias("e"),
        (F.col("_at.cl") - F.col("cl") + F.col("label")).alias("lab"),
        (F.col("_at.cs") - F.col("cs") + F.col("label")).alias("ev"),
        (F.col("_at.ct") - F.col("ct") + F.col("label") * F.col("t")).alias("ts"),
    )
