"""Runs, ramps, zones and affiliation integrals (inventory EVT1-EVT15).

Runs come from ``analytic.runs``; neighbouring runs are found with ``carry`` on the run table, which is
cut into chunks like every other ordered table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.attach import attach
from ..plans.ordered import carry
from .analytic import run_ids, runs

KEYS = ("series_id",)


def ranges(df: DataFrame, keys: Sequence[str] = KEYS, flag: str = "label", extra=None, size=None) -> DataFrame:
    """Inclusive runs (s, e)."""
    return runs(df, keys, flag, extra=extra, size=size)


def half_open(df: DataFrame, keys: Sequence[str] = KEYS, flag: str = "label", size=None) -> DataFrame:
    return runs(df, keys, flag, size=size).select(*keys, "s", (F.col("e") + 1).alias("e"))


def lengths(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def event_runs(df: DataFrame, keys: Sequence[str] = KEYS, flag: str = "label", compat: bool = False, size=None):
    """Runs for event scores.  ``compat`` cuts the last point of a run still open at the end of the series."""
    r = runs(df, keys, flag, size=size)
    if not compat:
        return r.select(*keys, "s", "e")
    r = attach(r, lengths(df, keys), keys)
    return r.select(*keys, "s", F.when(F.col("e") == F.col("n") - 1, F.col("e") - 1).otherwise(F.col("e")).alias("e"))


def run_count(df: DataFrame, keys: Sequence[str] = KEYS, flag: str = "label", size=None) -> DataFrame:
    """Runs per key (0 included)."""
    marked = run_ids(df, keys, flag, size=size)
    return marked.groupBy(*keys).agg(F.count_if(F.col("run_id") == F.col("t")).alias("runs"))


def point_adjust(
    df: DataFrame, keys: Sequence[str] = KEYS, pred: str = "pred", label: str = "label", compat: bool = False, size=None
) -> DataFrame:
    """A run that is hit once is predicted whole.  ``compat`` does not fill position 0 backwards."""
    marked = run_ids(df, keys, label, size=size)
    hit = marked.filter("run_id IS NOT NULL").groupBy(*keys, "run_id").agg(
        F.max(pred).alias("_hit"), F.min(F.when(F.col(pred) == 1, F.col("t"))).alias("_first")
    )
    out = marked.join(hit, [*keys, "run_id"], "left")
    whole = F.coalesce(F.col("_hit"), F.lit(0)) == 1
    if compat:
        whole = whole & ((F.col("t") > 0) | (F.col("_first") == 0))
    adjusted = F.when(whole, F.lit(1)).otherwise(F.col(pred))
    return out.withColumn("adjusted", adjusted).drop("run_id", "_hit", "_first")


def adjust_latency(df: DataFrame, keys: Sequence[str] = KEYS, pred: str = "pred", label: str = "label", size=None):
    """Points filled before the first hit of a run, per run hit."""
    marked = run_ids(df, keys, label, size=size).filter("run_id IS NOT NULL")
    hit = marked.groupBy(*keys, "run_id").agg(F.min(F.when(F.col(pred) == 1, F.col("t"))).alias("f"))
    return hit.groupBy(*keys).agg(
        (F.coalesce(F.sum(F.col("f") - F.col("run_id")), F.lit(0)) / (F.count("f") + F.lit(1e-4))).alias("latency")
    )


def halo_points(runs_: DataFrame, reach: Column, n: Column | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Positions up to ``reach`` outside a run: (keys, s, e, t, d) with d the distance to the run."""
    steps = F.when(reach >= 1, F.sequence(F.lit(1), reach.cast("int")))
    side = runs_.withColumn("d", F.explode(steps))
    both = side.select("*", F.explode(F.array(F.col("s") - F.col("d"), F.col("e") + F.col("d"))).alias("t"))
    both = both.filter(F.col("t") >= 0)
    return both if n is None else both.filter(F.col("t") < n)


def ramp(
    df: DataFrame, window: int, keys: Sequence[str] = KEYS, label: str = "label", style: str = "after",
    share: float | None = None, size=None,
) -> DataFrame:
    """Soft labels: 1 inside a run, sqrt(1 - d / window) within window // 2 of it, capped at 1.

    ``style="edge"`` gives the run end a second 1 and stops one point earlier behind the run; ``share`` makes the
    reach a share of the run length (and the window twice that).
    """
    r = runs(df, keys, label, size=size)
    reach = F.floor(F.col("len") * F.lit(float(share))) if share is not None else F.lit(window // 2)
    span = F.lit(2) * reach if share is not None else F.lit(window)
    r = r.withColumn("_reach", reach.cast("int")).withColumn("_span", span)
    pts = halo_points(r, F.col("_reach"), None, keys)
    if share is not None or style == "edge":
        # the ramp behind a run starts at its end, so it reaches one point less far
        pts = pts.filter((F.col("t") < F.col("s")) | (F.col("d") < F.col("_reach")))
    add = pts.groupBy(*keys, "t").agg(F.sum(F.sqrt(F.lit(1.0) - F.col("d") / F.col("_span"))).alias("_add"))
    out = df.join(add, [*keys, "t"], "left")
    soft = F.least(F.lit(1.0), F.col(label).cast("double") + F.coalesce("_add", F.lit(0.0)))
    return out.withColumn("soft", soft).drop("_add")


def merged_halos(runs_: DataFrame, window: int, n: DataFrame, keys: Sequence[str] = KEYS, size=None) -> DataFrame:
    """Runs widened by window // 2; neighbours whose halos touch become one segment."""
    h = window // 2
    r = carry(runs_.select(*keys, "s", "e"), keys, "s", {"_pe": ("e", "prev", False)}, size)
    first = F.when(F.col("_pe").isNull() | (F.col("_pe") + h < F.col("s") - h), F.col("s"))
    r = carry(r.withColumn("_first", first), keys, "s", {"_seg": ("_first", "prev", True)}, size)
    seg = r.groupBy(*keys, "_seg").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return attach(seg, n, keys).select(
        *keys,
        F.greatest(F.col("s") - h, F.lit(0)).alias("s"),
        F.least(F.col("e") + h, F.col("n") - 1).alias("e"),
    )


def time_range(events: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return events.groupBy(*keys).agg(F.min("s").alias("t0"), F.max("e").alias("t1"))


def has_point_events(events: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return events.groupBy(*keys).agg(F.max(F.col("s") == F.col("e")).alias("has_points"))


def invalid_events(events: DataFrame, keys: Sequence[str] = KEYS, size=None) -> DataFrame:
    """Events that end before they start, or overlap the next one."""
    nxt = carry(events, keys, "s", {"_ns": ("s", "next", False)}, size)
    return nxt.filter((F.col("e") < F.col("s")) | (F.col("_ns") < F.col("e"))).drop("_ns")


def zones(events: DataFrame, t0, t1, keys: Sequence[str] = KEYS, size=None) -> DataFrame:
    """Affiliation zone (z0, z1) of every half-open event: midpoints to its neighbours, the range ends outside.

    ``zone`` is the start of the event.
    """
    r = carry(events, keys, "s", {"_pe": ("e", "prev", False), "_ns": ("s", "next", False)}, size)
    z0 = F.coalesce((F.col("_pe") + F.col("s")) / F.lit(2.0), t0.cast("double"))
    z1 = F.coalesce((F.col("e") + F.col("_ns")) / F.lit(2.0), t1.cast("double"))
    return r.withColumn("zone", F.col("s")).withColumn("z0", z0).withColumn("z1", z1).drop("_pe", "_ns")


def cut_by(lo: Column, hi: Column, s: Column, e: Column) -> dict[str, Column]:
    """Parts of the interval (lo, hi) before, inside and after the event (s, e); lengths may be 0."""
    return {
        "b0": F.least(lo, s), "b1": F.least(hi, s),
        "i0": F.greatest(F.least(lo, e), s), "i1": F.greatest(F.least(hi, e), s),
        "a0": F.greatest(lo, e), "a1": F.greatest(hi, e),
    }


def distance_integral(lo: Column, hi: Column, s: Column, e: Column) -> Column:
    """Integral over (lo, hi) of the distance to the event (s, e)."""
    c = cut_by(lo, hi, s, e)
    before = (c["b1"] - c["b0"]) * (s - (c["b0"] + c["b1"]) / 2)
    after = (c["a1"] - c["a0"]) * ((c["a0"] + c["a1"]) / 2 - e)
    return before + after


def _capped(u: Column, v: Column, cap: Column) -> Column:
    """Integral of min(x, cap) over x in (u, v), 0 <= u <= v."""
    m = F.least(F.greatest(cap, u), v)
    return (m * m - u * u) / 2 + (v - m) * cap


def precision_integral(lo: Column, hi: Column, s: Column, e: Column, z0: Column, z1: Column) -> Column:
    """Integral over the predicted piece of the chance that a random point of the zone lies farther from the event."""
    c = cut_by(lo, hi, s, e)
    total = z1 - z0

    def side(u, v):
        width = F.greatest(v - u, F.lit(0.0))
        far = F.greatest(v, u)
        taken = (e - s) * width + _capped(u, far, s - z0) + _capped(u, far, z1 - e)
        return width - taken / total

    inside = c["i1"] - c["i0"]
    return inside + side(s - c["b1"], s - c["b0"]) + side(c["a0"] - e, c["a1"] - e)


def recall_integral(
    p0: Column, p1: Column, v0: Column, v1: Column, s: Column, e: Column, z0: Column, z1: Column
) -> Column:
    """Integral over the event points nearest to the prediction (p0, p1) of the chance that a random point of
    the zone lies farther from them than the prediction; (v0, v1) is where this prediction is the nearest one."""
    lo, hi = F.greatest(s, v0), F.least(e, v1)
    c = cut_by(lo, hi, p0, p1)
    total = z1 - z0

    # before the prediction: distance is p0 - y, the near-side share is min(p0 - y, y - z0)
    a, b = c["b0"], F.greatest(c["b1"], c["b0"])
    k = F.least(F.greatest((p0 + z0) / 2, a), b)
    rise = ((k - z0) * (k - z0) - (a - z0) * (a - z0)) / 2
    fall = ((p0 - k) * (p0 - k) - (p0 - b) * (p0 - b)) / 2
    whole = ((p0 - a) * (p0 - a) - (p0 - b) * (p0 - b)) / 2
    before = (b - a) - (rise + fall + whole) / total
    # after the prediction: distance is y - p1, the near-side share is min(y - p1, z1 - y)
    a, b = c["a0"], F.greatest(c["a1"], c["a0"])
    k = F.least(F.greatest((p1 + z1) / 2, a), b)
    rise = ((k - p1) * (k - p1) - (a - p1) * (a - p1)) / 2
    fall = ((z1 - k) * (z1 - k) - (z1 - b) * (z1 - b)) / 2
    whole = ((b - p1) * (b - p1) - (a - p1) * (a - p1)) / 2
    after = (b - a) - (rise + fall + whole) / total
    value = (c["i1"] - c["i0"]) + before + after
    return F.when(hi > lo, value).otherwise(F.lit(0.0))


def confusion_code(label: str = "label", pred: str = "pred") -> Column:
    """0 true negative, 1 false negative, 2 false positive, 3 true positive."""
    return F.col(label) + F.lit(2) * F.col(pred)
