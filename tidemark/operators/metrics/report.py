"""All metrics of a score table in one result (MET15, MET18 and the 12-column report)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import cut
from ..threshold import label_by, sigma, top_k_points
from .affiliation import affiliation_f
from .levels import KEYS, level_runs
from .points import _counts, _trace, best_f1, event_f1, point_adjusted_f1, pointwise, recall_precision
from .ranges import auc_ptrt, range_f1, range_scores
from .vus import vus, vus_pred

# Column names of the result record; fixed values.
RECORD = {
    "auc_pr": "AUC-PR", "auc_roc": "AUC-ROC", "vus_pr": "VUS-PR", "vus_roc": "VUS-ROC", "f1": "Standard-F1",
    "pa_f1": "PA-F1", "event_f1": "Event-based-F1", "range_f1": "R-based-F1", "affiliation_f": "Affiliation-F",
    "recall": "Recall", "precision": "Precision", "auc_ptrt": "AUC-PTRT",
}


def _together(parts: list[DataFrame], keys) -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(keys), "left"), parts)


def full_report(
    df: DataFrame, window: int = 100, pred: str | None = None, thresholds: int = 250, anomaly_ratio: float = 0.05,
    keys: Sequence[str] = KEYS, score="score", label="label", record_names: bool = False,
) -> DataFrame:
    """The 12 quality columns, one row per key.  Series without a positive label get NULL."""
    df = cut(df.select(*keys, "t", score, label, *([pred] if pred else [])))
    trace = _trace(df, keys, score, label, pred, None)
    runs = cut(level_runs(trace, keys))
    points = pointwise(df, keys, score, label)
    everyone = df.select(*keys).distinct()
    f1 = best_f1(df, keys, score, label, pred) if pred else points.select(*keys, F.col("best_f1").alias("f1"))
    out = _together(
        [
            everyone, points.select(*keys, "auc_pr", "auc_roc"), vus(df, window, keys, score, label, thresholds), f1,
            point_adjusted_f1(None, keys, trace=trace), event_f1(None, keys, trace=trace),
            range_f1(None, keys, pred=pred, trace=trace, runs=runs),
            affiliation_f(None, keys, pred=pred, trace=trace, runs=runs),
            recall_precision(df, anomaly_ratio, keys, score, label), auc_ptrt(df, keys, score, label),
        ],
        keys,
    )
    out = out.select(*keys, *RECORD)
    return out.withColumnsRenamed(RECORD) if record_names else out


def prediction_report(
    df: DataFrame, window: int = 100, pred: str = "pred", keys: Sequence[str] = KEYS, label="label"
) -> DataFrame:
    """Eight columns for a given prediction: precision, recall, F1, PA-F1, event F1, range F1, affiliation F, VUS F."""
    df = cut(df.select(*keys, "t", pred, label))
    trace = _trace(df, keys, None, label, pred, None)
    runs = cut(level_runs(trace, keys))
    return _together(
        [
            _counts(df, keys, pred, label), best_f1(df, keys, label=label, pred=pred),
            point_adjusted_f1(None, keys, trace=trace), event_f1(None, keys, trace=trace),
            range_f1(None, keys, pred=pred, trace=trace, runs=runs),
            affiliation_f(None, keys, pred=pred, trace=trace, runs=runs),
            vus_pred(df, window, keys, pred, label).select(*keys, "vus_f"),
        ],
        keys,
    )


def scalar_report(
    df: DataFrame, pred: str | None = None, alpha: float = 0.2, keys: Sequence[str] = KEYS, score="score", label="label"
) -> DataFrame:
    """Eleven values: AUC, precision, recall, F, PA-F1, range recall with its parts, range precision, range F, precision@k.

    The default prediction is score > mean + 3 sd.  precision@k uses the scores.
    """
    df = cut(df.select(*keys, "t", score, label, *([pred] if pred else [])))
    p = df if pred else label_by(df, sigma(df, 3.0, keys, score), keys, score, strict=True)
    p = p if pred is None else p.withColumnRenamed(pred, "pred")
    p = cut(p)
    r = range_scores(p, keys, "pred", label, r_alpha=alpha)
    top = label_by(df, top_k_points(df, None, keys, score, label), keys, score, strict=True, out="_k")
    at_k = top.groupBy(*keys).agg(F.try_divide(F.sum(F.col("_k") * F.col(label)), F.sum(label)).alias("precision_at_k"))
    total = F.col("rprecision") + F.col("rrecall")
    rf = F.when(total > 0, F.lit(2.0) * F.col("rprecision") * F.col("rrecall") / total).otherwise(F.lit(0.0))
    return _together(
        [
            pointwise(df, keys, score, label).select(*keys, F.col("auc_roc").alias("auc")),
            _counts(p, keys, "pred", label), best_f1(p, keys, score, label, "pred"),
            point_adjusted_f1(p, keys, score, label, "pred"),
            r.select(*keys, F.col("recall").alias("rrecall"), "existence", "overlap", F.col("precision").alias("rprecision")),
            at_k,
        ],
        keys,
    ).withColumn("rf", rf)


def bulk(scores: DataFrame, truth: DataFrame, keys: Sequence[str] = ("dataset", "model"), **kw) -> DataFrame:
    """Metrics of every model on every dataset in one job: scores (dataset, model, t, score), truth (dataset, t, label)."""
    return full_report(scores.join(truth, ["dataset", "t"]), keys=list(keys), **kw)

