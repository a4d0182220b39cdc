"""Affiliation precision, recall and F (MET9), after Huet et al., KDD 2022, with closed-form integrals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...plans.attach import attach
from ...plans.ordered import carry
from ...session import cut
from ..events import distance_integral, precision_integral, recall_integral, zones
from ..joins import clip_to_zones
from .levels import KEYS, level_runs
from .points import _trace, _with_all_keys


def _zones_of(trace: DataFrame, keys, size) -> DataFrame:
    """Affiliation zones of the label runs; the time range is the whole series."""
    runs = trace.filter("label = 1").groupBy(*keys, "cs").agg(F.min("t").alias("s"), (F.max("t") + 1).alias("e"))
    n = trace.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    runs = attach(runs.drop("cs"), n, keys)
    return cut(zones(runs, F.lit(0), F.col("_n"), keys, size).drop("_n"))


def by_event(
    runs: DataFrame, zone_table: DataFrame, keys: Sequence[str] = KEYS, level: Sequence[str] = ("k",), size=None,
) -> DataFrame:
    """Per level and event that has a prediction in its zone: precision, recall and their distance forms.

    ``runs`` are inclusive predicted runs (keys, level, s, e).
    """
    z = zone_table.select(*keys, "zone", "z0", "z1", F.col("s").alias("gs"), F.col("e").alias("ge"))
    events = runs.select(*keys, *level, "s", (F.col("e") + 1).alias("e"))
    at = [*keys, *level, "zone"]
    pieces = clip_to_zones(events, z, keys)
    pieces = carry(pieces, at, "lo", {"_ph": ("hi", "prev", False), "_nl": ("lo", "next", False)}, size)
    lo, hi, gs, ge, z0, z1 = (F.col(c).cast("double") for c in ("lo", "hi", "gs", "ge", "z0", "z1"))
    v0 = F.coalesce((F.col("_ph") + lo) / 2, F.lit(float("-inf")))
    v1 = F.coalesce((hi + F.col("_nl")) / 2, F.lit(float("inf")))
    near0, near1 = F.greatest(gs, v0), F.least(ge, v1)
    far = F.when(near1 > near0, distance_integral(near0, near1, lo, hi)).otherwise(F.lit(0.0))
    return pieces.groupBy(*at).agg(
        (F.sum(precision_integral(lo, hi, gs, ge, z0, z1)) / F.sum(hi - lo)).alias("precision"),
        (F.sum(recall_integral(lo, hi, v0, v1, gs, ge, z0, z1)) / F.max(ge - gs)).alias("recall"),
        (F.sum(distance_integral(lo, hi, gs, ge)) / F.sum(hi - lo)).alias("precision_distance"),
        (F.sum(far) / F.max(ge - gs)).alias("recall_distance"),
    )


def affiliation(
    df: DataFrame | None, keys: Sequence[str] = KEYS, score="score", label="label", pred=None, size=None, trace=None,
    runs=None, bucket: int = 1024, eps: float = 1e-15,
) -> DataFrame:
    """(keys, k, precision, recall, f) for every level with at least one prediction.

    Precision is the mean over the events with a prediction in their zone; recall is the mean over all events, 0 for
    an empty zone.
    """
    trace = _trace(df, keys, score, label, pred, size) if trace is None else trace
    runs = level_runs(trace, keys, size) if runs is None else runs
    z = _zones_of(trace, keys, size)
    events = z.groupBy(*keys).agg(F.count(F.lit(1)).alias("_events"))
    e = by_event(runs, z, keys, ("k",), size)
    out = attach(
        e.groupBy(*keys, "k").agg(F.avg("precision").alias("precision"), F.sum("recall").alias("recall")), events, keys
    ).withColumn("recall", F.col("recall") / F.col("_events")).drop("_events")
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f", F.lit(2.0) * p * r / (p + r + F.lit(eps)))


def affiliation_f(df: DataFrame | None, keys: Sequence[str] = KEYS, trace=None, **kw) -> DataFrame:
    """Best affiliation F over the threshold grid (or that of a given prediction)."""
    if trace is None:
        trace = _trace(df, keys, kw.pop("score", "score"), kw.pop("label", "label"), kw.get("pred"), kw.get("size"))
    best = affiliation(None, keys, trace=trace, **kw).groupBy(*keys).agg(F.max("f").alias("affiliation_f"))
    return _with_all_keys(trace, best, keys, "affiliation_f")
