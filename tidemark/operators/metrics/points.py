"""Point-wise metrics (MET1-MET6, MET8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..analytic import roc_table
from ..threshold import label_by, ratio_quantile
from .levels import KEYS, on_grid, on_prediction, traced


def pointwise(
    df: DataFrame, keys: Sequence[str] = KEYS, score="score", label="label", per_range=None
) -> DataFrame:
    """auc_roc, auc_pr (average precision), pr_auc (trapezoid) and best_f1 of every key; NULL without both classes.

    The row of a distinct score knows the counts before it, so that one aggregate over the rows gives all four.
    """
    r = roc_table(df, keys, score, label, per_range)
    tp, fp, p, n = (F.col(c).cast("double") for c in ("tp", "fp", "p", "n"))
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    prec, rec = tp / (tp + fp), tp / pos
    before = tp + fp - n
    prec_before = F.when(before > 0, (tp - p) / before).otherwise(F.lit(1.0))
    r = r.filter(both)
    return r.groupBy(*keys).agg(
        F.sum((n - p) * (tp - p / 2) / (pos * neg)).alias("auc_roc"),
        F.sum(p / pos * prec).alias("auc_pr"),
        F.sum(p / pos * (prec + prec_before) / 2).alias("pr_auc"),
        F.max(F.lit(2.0) * prec * rec / (prec + rec + F.lit(1e-5))).alias("best_f1"),
    )


def _counts(df, keys, pred, label):
    tp = F.sum(F.col(pred) * F.col(label))
    precision = F.coalesce(F.try_divide(tp, F.sum(pred)), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, F.sum(label)), F.lit(0.0))
    return df.groupBy(*keys).agg(recall.alias("recall"), precision.alias("precision"))


def best_f1(df: DataFrame, keys: Sequence[str] = KEYS, score="score", label="label", pred: str | None = None):
    """Best F1 over all thresholds, or the F1 of a given prediction."""
    if pred is None:
        return pointwise(df, keys, score, label).select(*keys, F.col("best_f1").alias("f1"))
    c = _counts(df, keys, pred, label)
    total = F.col("precision") + F.col("recall")
    f = F.when(total > 0, F.lit(2.0) * F.col("precision") * F.col("recall") / total).otherwise(F.lit(0.0))
    return c.select(*keys, f.alias("f1"))


def recall_precision(df: DataFrame, anomaly_ratio=0.05, keys: Sequence[str] = KEYS, score="score", label="label"):
    """Recall and precision at the quantile 1 - 1.5 * ratio."""
    thr = ratio_quantile(df, anomaly_ratio, keys, score)
    return _counts(label_by(df, thr, keys, score), keys, "pred", label)


def level_counts(trace: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per level that occurs: predicted points fp and tp, points of hit runs tp_pa, hit runs, and totals.

    A run counts as hit up to its highest level.  One row per key and level (at most the number of thresholds).
    """
    pts = trace.groupBy(*keys, F.col("kx").alias("lev")).agg(
        F.sum(1 - F.col("label")).alias("fp"), F.sum("label").alias("tp")
    )
    runs = trace.filter("label = 1").groupBy(*keys, "cs").agg(F.max("kx").alias("lev"), F.count(F.lit(1)).alias("len"))
    runs = runs.groupBy(*keys, "lev").agg(F.sum("len").alias("tp_pa"), F.count(F.lit(1)).alias("hits"))
    both = pts.join(runs, [*keys, "lev"], "full").fillna(0)
    w = Window.partitionBy(*keys).orderBy(F.col("lev").desc())
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return both.select(
        *keys, "lev", *[F.sum(c).over(upto).alias(c) for c in ("fp", "tp", "tp_pa", "hits")],
        F.sum("tp").over(whole).alias("pos"), F.sum("hits").over(whole).alias("events"),
    ).filter("lev > 0 AND pos > 0")


def _trace(df, keys, score, label, pred, size):
    points = on_grid(df, keys, score, label) if pred is None else on_prediction(df, keys, pred, label)
    return traced(points, keys, size)


def _with_all_keys(trace, scored, keys, name):
    """Keys without a predicted point score 0, keys without a positive label NULL."""
    pos = trace.groupBy(*keys).agg(F.max("label").alias("_any"))
    out = pos.join(scored, list(keys), "left")
    return out.select(*keys, F.when(F.col("_any") == 1, F.coalesce(name, F.lit(0.0))).alias(name))


def point_adjusted_f1(
    df: DataFrame | None, keys: Sequence[str] = KEYS, score="score", label="label", pred=None, size=None, trace=None
) -> DataFrame:
    """F1 after point adjustment, best over the threshold grid (or of a given prediction)."""
    trace = _trace(df, keys, score, label, pred, size) if trace is None else trace
    c = level_counts(trace, keys)
    f = F.lit(2.0) * F.col("tp_pa") / (F.col("tp_pa") + F.col("fp") + F.col("pos"))
    return _with_all_keys(trace, c.groupBy(*keys).agg(F.max(f).alias("pa_f1")), keys, "pa_f1")


def event_f1(
    df: DataFrame | None, keys: Sequence[str] = KEYS, score="score", label="label", pred=None, size=None, trace=None,
    eps: float = 1e-15,
) -> DataFrame:
    """Event recall with point precision, best over the threshold grid (or of a given prediction)."""
    trace = _trace(df, keys, score, label, pred, size) if trace is None else trace
    c = level_counts(trace, keys)
    rec = F.col("hits") / F.col("events")
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    f = F.lit(2.0) * rec * prec / (rec + prec + F.lit(eps))
    return _with_all_keys(trace, c.groupBy(*keys).agg(F.max(f).alias("event_f1")), keys, "event_f1")


def cut_trace(df: DataFrame, keys: Sequence[str] = KEYS, score="score", label="label", pred=None, size=None):
    """The trace table several metrics can share."""
    return _trace(df, keys, score, label, pred, size)


def false_alarm_share(df: DataFrame, keys: Sequence[str] = KEYS, pred="pred", label="label") -> DataFrame:
    """False positives over false positives plus positives."""
    fp = F.sum(F.col(pred) * (1 - F.col(label)))
    return df.groupBy(*keys).agg(F.try_divide(fp, fp + F.sum(label)).alias("fpr"))
