"""From scores to labels (inventory THR1-THR12).

Every strategy is a function (scores) -> one threshold per series; ``label_by`` applies it.
Quantiles are exact and come from ``cumulate``, so a single huge series is no special case.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.attach import attach
from ..plans.ordered import cumulate, quantile_of, quantiles, shifted
from .clean import check_range

KEYS = ("series_id",)


def label_by(
    df: DataFrame, thresholds: DataFrame, keys: Sequence[str] = KEYS, score: str = "score", strict: bool = False,
    out: str = "pred",
) -> DataFrame:
    """Prediction 1 where score >= threshold (or > with ``strict``)."""
    both = attach(df, thresholds.select(*keys, "threshold"), keys)
    above = F.col(score) > F.col("threshold") if strict else F.col(score) >= F.col("threshold")
    return both.withColumn(out, above.cast("int")).drop("threshold")


def no_threshold(df: DataFrame, score: str = "score", out: str = "pred") -> DataFrame:
    """Pass labels through; continuous scores are an error."""
    kind = dict(df.dtypes)[score]
    if kind not in ("int", "bigint", "smallint", "tinyint", "boolean"):
        raise ValueError("continuous scores need a thresholding strategy")
    return df.withColumn(out, F.col(score).cast("int"))


def fixed(df: DataFrame, theta: float = 0.8, keys: Sequence[str] = KEYS) -> DataFrame:
    check_range(theta, 0.0, 1.0, "theta")
    return df.select(*keys).distinct().withColumn("threshold", F.lit(float(theta)))


def percentile(df: DataFrame, q: float = 90, keys: Sequence[str] = KEYS, score: str = "score", per_range=None):
    """Percentile with linear interpolation over the valid scores."""
    check_range(q, 0, 100, "q")
    valid = df.filter(~F.isnan(F.col(score).cast("double")) & F.col(score).isNotNull())
    return quantiles(valid, keys, score, {"threshold": q / 100.0}, per_range)


def top_k_points(
    df: DataFrame, k: int | None = None, keys: Sequence[str] = KEYS, score: str = "score", label: str = "label",
    per_range=None,
) -> DataFrame:
    """Percentile (1 - k/n) * 100; k defaults to the number of labels of the series."""
    pos = F.sum(F.col(label).cast("long")) if k is None else F.sum(F.lit(0))
    c = cumulate(df, keys, score, {"p": pos}, per_range)
    wanted = F.col("tot_p") if k is None else F.lit(k)
    return c.groupBy(*keys).agg(quantile_of(score, 1 - wanted / F.col("tot_n")).alias("threshold"))


def top_k_ranges(
    df: DataFrame, k: int | None = None, keys: Sequence[str] = KEYS, score: str = "score", label: str = "label",
    order: str = "t", per_range=None, size=None,
) -> DataFrame:
    """Highest of the distinct scores (the smallest is not tried) whose predictions have at least k runs.

    A run at level theta starts where score >= theta > previous score, so each point adds one run to a half-open range of
    thresholds: +1 at its own score, -1 just above the previous one.  A cumulative sum over the distinct scores gives
    the run counts of all thresholds at once.  k defaults to the number of label runs.
    """
    s = shifted(df.select(*keys, order, score, label), keys, order, {"_ps": (score, 1), "_pl": (label, 1)}, size)
    begins = F.when((F.col(label) == 1) & (F.coalesce("_pl", F.lit(0)) != 1), 1).otherwise(0)
    up = s.select(
        *keys, F.col(score).alias("v"), F.lit(1).alias("_own"), begins.alias("_k"),
        F.when(F.col("_ps").isNull() | (F.col("_ps") < F.col(score)), 1).otherwise(0).alias("_up"),
        F.lit(0).alias("_down"),
    )
    # thresholds at or below the previous score do not start a run here
    down = s.filter(F.col("_ps") < F.col(score)).select(
        *keys, F.col("_ps").alias("v"), F.lit(0).alias("_own"), F.lit(0).alias("_k"), F.lit(0).alias("_up"),
        F.lit(1).alias("_down"),
    )
    c = cumulate(
        up.unionByName(down), keys, "v",
        {m: F.sum(f"_{m}") for m in ("own", "k", "up", "down")}, per_range,
    )
    # runs at theta = starts with score >= theta minus those whose previous score is >= theta as well
    count = (F.col("tot_up") - F.col("cum_up") + F.col("up")) - (
        F.col("tot_down") - F.col("cum_down") + F.col("down")
    )
    wanted = F.col("tot_k") if k is None else F.lit(k)
    tried = c.withColumn("_runs", count).withColumn("_first", F.col("cum_own") == F.col("own"))
    enough = F.max(F.when(~F.col("_first") & (F.col("_runs") >= wanted), F.col("v")))
    return tried.groupBy(*keys).agg(
        F.coalesce(enough, F.min(F.when(~F.col("_first"), F.col("v"))), F.min("v")).alias("threshold")
    )


def sigma(df: DataFrame, factor: float = 3.0, keys: Sequence[str] = KEYS, score: str = "score") -> DataFrame:
    """mean + factor * population deviation."""
    return df.groupBy(*keys).agg((F.avg(score) + F.lit(factor) * F.stddev_pop(score)).alias("threshold"))


def outlier_fraction(df: DataFrame, share: float = 0.1, keys: Sequence[str] = KEYS, score: str = "score"):
    """Threshold for ``score > threshold`` that labels about ``share`` of the points."""
    check_range(share, 0.0, 1.0, "share")
    return quantiles(df, keys, score, {"threshold": 1 - share})


def precision_at_n(
    df: DataFrame, n: int | None = None, keys: Sequence[str] = KEYS, score: str = "score", label: str = "label"
) -> DataFrame:
    """Precision when as many points are labelled as there are positives (or n)."""
    thr = top_k_points(df, n, keys, score, label)
    return label_by(df, thr, keys, score, strict=True).groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum(F.col("pred") * F.col(label)), F.sum("pred")), F.lit(0.0)).alias("precision_at_n")
    )


def ratio_quantile(df: DataFrame, anomaly_ratio: float = 0.05, keys: Sequence[str] = KEYS, score: str = "score"):
    """Quantile 1 - 1.5 * anomaly ratio."""
    return quantiles(df, keys, score, {"threshold": 1 - 1.5 * anomaly_ratio})


def model_sigma(stats: DataFrame, mu: str = "mu", sd: str = "sd", keys: Sequence[str] = KEYS) -> DataFrame:
    """mu + 3 sd from stored statistics."""
    return stats.select(*keys, (F.col(mu) + F.lit(3.0) * F.col(sd)).alias("threshold"))


def ratio_report(
    df: DataFrame, anomaly_ratio: float = 1.0, keys: Sequence[str] = KEYS, score: str = "score", label: str = "label"
) -> DataFrame:
    """Percentile 100 - ratio as strict threshold, with accuracy, precision, recall and F1."""
    thr = percentile(df, 100 - anomaly_ratio, keys, score)
    p = label_by(df, thr, keys, score, strict=True)
    tp = F.sum(F.col("pred") * F.col(label))
    precision = F.coalesce(F.try_divide(tp, F.sum("pred")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, F.sum(label)), F.lit(0.0))
    out = p.groupBy(*keys).agg(
        F.avg((F.col("pred") == F.col(label)).cast("double")).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"),
    )
    total = F.col("precision") + F.col("recall")
    f = F.when(total > 0, F.lit(2.0) * F.col("precision") * F.col("recall") / total).otherwise(F.lit(0.0))
    return attach(out.withColumn("f1", f), thr, keys)


def grid(df: DataFrame, count: int = 100, keys: Sequence[str] = KEYS, score: str = "score") -> DataFrame:
    """``count`` evenly spaced thresholds from the smallest to the largest score: (keys, k, threshold)."""
    lim = df.groupBy(*keys).agg(F.min(score).cast("double").alias("_lo"), F.max(score).cast("double").alias("_hi"))
    return lim.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).select(
        *keys, "k", grid_value(F.col("_lo"), F.col("_hi"), F.col("k"), count).alias("threshold")
    )


def grid_value(lo, hi, k, count: int):
    """k-th of ``count`` evenly spaced values; the last is exactly the upper end."""
    step = (hi - lo) / F.lit(float(count - 1))
    return F.when(k >= count - 1, hi).otherwise(lo + k * step)


def grid_exceeded(value, lo, hi, count: int):
    """How many grid thresholds lie strictly below the value (0..count).

    The position is guessed by division and then put right against the grid values themselves.
    """
    width = (hi - lo) / F.lit(float(count - 1))
    guess = F.floor((value - lo) / width).cast("int")
    below = F.greatest(guess - 1, F.lit(0))
    # the thresholds before ``below`` are passed for sure; three more may be
    for off in (0, 1, 2):
        g = F.greatest(guess - 1, F.lit(0)) + off
        below = below + F.when((g <= count - 1) & (grid_value(lo, hi, g, count) < value), 1).otherwise(0)
    return F.when(value > lo, below).otherwise(F.lit(0)).cast("int")


STRATEGIES: dict[str, Callable] = {
    "fixed": fixed,
    "percentile": percentile,
    "top_k_points": top_k_points,
    "top_k_ranges": top_k_ranges,
    "sigma": sigma,
    "outlier_fraction": outlier_fraction,
    "ratio_quantile": ratio_quantile,
}


def register_strategy(name: str, fn: Callable) -> None:
    """Add a strategy ``fn(df, *, keys, score, ...) -> (keys, threshold)``."""
    STRATEGIES[name] = fn


def find_threshold(name: str, df: DataFrame, **kw) -> DataFrame:
    if name not in STRATEGIES:
        raise ValueError(f"unknown thresholding strategy {name}")
    return STRATEGIES[name](df, **kw)
