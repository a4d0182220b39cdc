"""Volume under the surface (MET10-MET12), after Paparrizos et al., VLDB 2022.

Thresholds are evenly spaced order statistics, numbered from the highest; ``k0`` is the first one at or below a score,
so that a point is predicted at every k >= k0.  Only label points and points within half a window of a run carry weight; they
are reduced to counts per (distances, k0) before the window sizes are unfolded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...plans.attach import attach
from ...plans.ordered import carry, cumulate
from ...session import cut
from ..events import halo_points, ranges

KEYS = ("series_id",)


def _spaced(df: DataFrame, keys, score, count: int, per_range) -> DataFrame:
    """(keys, k, threshold, n_pred, n): order statistics with the points at or above them."""
    c = cumulate(df, keys, score, per_range=per_range)
    first = F.col("tot_n") - F.col("cum_n")
    last = first + F.col("n") - 1
    step = (F.col("tot_n") - 1) / F.lit(count - 1)
    lo = F.greatest(F.floor(first / step) - 1, F.lit(0)).cast("int")
    hi = F.least(F.ceil((last + 1) / step) + 1, F.lit(count - 1)).cast("int")
    ks = F.when(F.col("tot_n") > 1, F.sequence(lo, hi)).otherwise(F.sequence(F.lit(0), F.lit(count - 1)))
    pos = F.floor(F.col("k") * step)
    return c.withColumn("k", F.explode(ks)).filter((pos >= first) & (pos <= last)).select(
        *keys, "k", F.col(score).alias("threshold"), (last + 1).alias("n_pred"), F.col("tot_n").alias("n")
    )


def _cumulated(grid: DataFrame, hist: DataFrame, at: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Running sums of a sparse histogram over k on a dense grid."""
    w = Window.partitionBy(*at).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    joined = grid.join(hist, [*at, "k"], "left")
    return joined.withColumns({n: F.sum(F.coalesce(n, F.lit(0))).over(w) for n in names})


def _surface(
    points: DataFrame, grid: DataFrame, windows: Sequence[int], keys: Sequence[str], size=None
) -> DataFrame:
    """(keys, w, k, tp, n_labels, pos, segments, existing) for every window size and threshold.

    ``points``: (keys, t, label, k0); ``grid``: (keys, k, ...).
    """
    widest = max(windows)
    half = widest // 2
    runs = ranges(points, keys, extra={"core": F.min("k0")}, size=size)
    # weights: ramp points by the distances to the runs around them
    near = halo_points(runs.select(*keys, "s", "e"), F.lit(half), None, keys) if half else None
    if near is not None:
        near = cut(near.join(points.select(*keys, "t", "label", "k0"), [*keys, "t"]))
        ramp = near.filter("label = 0").groupBy(*keys, "t", "k0").agg(F.sort_array(F.collect_list("d")).alias("ds"))
        ramp = ramp.groupBy(*keys, "k0", "ds").agg(F.count(F.lit(1)).alias("cnt"))
        fits = [w for w in windows if w >= 2]
        ramp = ramp.withColumn("w", F.explode(F.array(*[F.lit(w) for w in fits]))).filter(
            F.floor(F.col("w") / 2) >= F.col("ds")[0]
        )
        weight = F.aggregate(
            F.filter("ds", lambda d: d <= F.floor(F.col("w") / 2)), F.lit(0.0),
            lambda acc, d: acc + F.sqrt(F.lit(1.0) - d / F.col("w")),
        )
        ramp = ramp.groupBy(*keys, "w", F.col("k0").alias("k")).agg(
            F.sum(F.col("cnt") * F.least(F.lit(1.0), weight)).alias("soft")
        )
    core = points.filter("label = 1").groupBy(*keys, F.col("k0").alias("k")).agg(F.count(F.lit(1)).alias("hard"))
    all_w = F.explode(F.array(*[F.lit(w) for w in windows]))
    wide = grid.select(*keys, "k").withColumn("w", all_w)
    out = _cumulated(wide, core.withColumn("w", all_w), [*keys, "w"], ["hard"])
    out = _cumulated(out, ramp, [*keys, "w"], ["soft"]) if near is not None else out.withColumn("soft", F.lit(0.0))
    # existence: runs whose halos touch form one segment; its first k is the smallest k0 inside
    halves = sorted({w // 2 for w in windows})
    reach = runs.select(*keys, "s", "e", "core", F.explode(F.array(*[F.lit(h) for h in halves])).alias("h"))
    if near is not None:
        inner = near.groupBy(*keys, "s", "d").agg(F.min("k0").alias("kd"))
        upto = Window.partitionBy(*keys, "s").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
        inner = inner.withColumn("kd", F.min("kd").over(upto)).withColumnRenamed("d", "h")
        # near a border of the series a distance may have no point: take the nearest smaller distance
        reach = reach.join(inner, [*keys, "s", "h"], "left")
        filled = Window.partitionBy(*keys, "s").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
        reach = reach.withColumn("kd", F.min("kd").over(filled))
        reach = reach.withColumn("first", F.least("core", F.coalesce("kd", "core")))
    else:
        reach = reach.withColumn("first", F.col("core"))
    reach = carry(reach, [*keys, "h"], "s", {"_pe": ("e", "prev", False)}, size)
    opens = F.when(F.col("_pe").isNull() | (F.col("_pe") + F.col("h") < F.col("s") - F.col("h")), F.col("s"))
    reach = carry(reach.withColumn("_o", opens), [*keys, "h"], "s", {"_seg": ("_o", "prev", True)}, size)
    seg = reach.groupBy(*keys, "h", "_seg").agg(F.min("first").alias("k"))
    seg = seg.groupBy(*keys, "h", "k").agg(F.count(F.lit(1)).alias("existing"))
    total = seg.groupBy(*keys, "h").agg(F.sum("existing").alias("segments"))
    seg_grid = grid.select(*keys, "k").withColumn("h", F.explode(F.array(*[F.lit(h) for h in halves])))
    seg = _cumulated(seg_grid, seg, [*keys, "h"], ["existing"]).join(total, [*keys, "h"])
    pos = points.groupBy(*keys).agg(F.sum("label").alias("pos"))
    out = attach(out, pos, keys).withColumn("h", F.floor(F.col("w") / 2).cast("int"))
    out = out.join(seg, [*keys, "h", "k"])
    return out.select(
        *keys, "w", "k", (F.col("hard") + F.col("soft")).alias("tp"), (F.col("pos") + F.col("soft")).alias("n_labels"),
        "pos", "segments", "existing",
    )


def _first_below(df: DataFrame, spaced: DataFrame, keys, score, label) -> DataFrame:
    listed = spaced.groupBy(*keys).agg(F.sort_array(F.collect_list("threshold"), asc=False).alias("_th"))
    k0 = F.size(F.filter("_th", lambda v: v > F.col(score)))
    return cut(attach(df, listed, keys).select(*keys, "t", F.col(label).cast("int").alias("label"), k0.alias("k0")))


def _areas(df, windows, keys, score, label, count, per_range, size) -> DataFrame:
    spaced = cut(_spaced(df, keys, score, count, per_range))
    points = _first_below(df, spaced, keys, score, label)
    s = _surface(points, spaced, windows, keys, size).join(spaced, [*keys, "k"])
    p_new = (F.col("pos") + F.col("n_labels")) / 2
    recall = F.least(F.col("tp") / p_new, F.lit(1.0))
    s = s.select(
        *keys, "w", "k", (recall * F.col("existing") / F.col("segments")).alias("tpr"),
        F.coalesce(F.try_divide(F.col("n_pred") - F.col("tp"), F.col("n") - p_new), F.lit(1.0)).alias("fpr"),
        (F.col("tp") / F.col("n_pred")).alias("prec"),
    )
    w = Window.partitionBy(*keys, "w").orderBy("k")
    s = s.withColumn("pt", F.coalesce(F.lag("tpr").over(w), F.lit(0.0))).withColumn(
        "pf", F.coalesce(F.lag("fpr").over(w), F.lit(0.0))
    )
    last = F.col("k") == F.lit(count - 1)
    roc = F.sum((F.col("fpr") - F.col("pf")) * (F.col("tpr") + F.col("pt")) / 2) + F.sum(
        F.when(last, (F.lit(1.0) - F.col("fpr")) * (F.col("tpr") + 1) / 2).otherwise(F.lit(0.0))
    )
    return s.groupBy(*keys, "w").agg(roc.alias("auc"), F.sum((F.col("tpr") - F.col("pt")) * F.col("prec")).alias("ap"))


def _keyed(df, keys, label, scored):
    return df.groupBy(*keys).agg(F.max(label).alias("_any")).join(scored, list(keys), "left").drop("_any")


def vus(
    df: DataFrame, window: int = 100, keys: Sequence[str] = KEYS, score="score", label="label", thresholds: int = 250,
    per_range=None, size=None,
) -> DataFrame:
    """vus_roc and vus_pr: mean areas over the window sizes 0..window; NULL without positive labels."""
    a = _areas(df, list(range(window + 1)), keys, score, label, thresholds, per_range, size)
    means = a.groupBy(*keys).agg(F.avg("auc").alias("vus_roc"), F.avg("ap").alias("vus_pr"))
    return _keyed(df, keys, label, means)


def range_auc(
    df: DataFrame, window: int = 100, keys: Sequence[str] = KEYS, score="score", label="label", thresholds: int = 250,
    per_range=None, size=None,
) -> DataFrame:
    """Range AUC and AP at one window size."""
    a = _areas(df, [window], keys, score, label, thresholds, per_range, size).drop("w")
    return _keyed(df, keys, label, a.withColumnsRenamed({"auc": "range_auc", "ap": "range_ap"}))


def vus_pred(
    df: DataFrame, window: int = 100, keys: Sequence[str] = KEYS, pred="pred", label="label", size=None
) -> DataFrame:
    """Mean recall, precision and F over the window sizes of a given prediction."""
    points = cut(df.select(
        *keys, "t", F.col(label).cast("int").alias("label"), F.when(F.col(pred) == 1, 0).otherwise(1).alias("k0")
    ))
    n = df.groupBy(*keys).agg(F.sum(pred).alias("n_pred"), F.lit(0).alias("k"))
    s = _surface(points, n, list(range(window + 1)), keys, size).join(n, [*keys, "k"])
    recall = F.least(F.col("tp") / ((F.col("pos") + F.col("n_labels")) / 2), F.lit(1.0))
    s = s.select(*keys, recall.alias("r"), F.coalesce(F.try_divide("tp", "n_pred"), F.lit(0.0)).alias("p"))
    f = F.when(F.col("p") + F.col("r") > 0, F.lit(2.0) * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
    means = s.groupBy(*keys).agg(
        F.avg("r").alias("vus_recall"), F.avg("p").alias("vus_precision"), F.avg(F.coalesce(f, F.lit(0.0))).alias("vus_f")
    )
    return _keyed(df, keys, label, means)
