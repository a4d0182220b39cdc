"""What every detector shares: labels, probabilities, confidence (inventory DET16-DET20, DET22)."""

from __future__ import annotations

from collections.abc import Sequence
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.scalars import erf
from ...plans.attach import attach
from ...plans.ordered import quantiles
from ..analytic import train_rank
from ..clean import check_range
from ..metrics.points import pointwise
from ..threshold import precision_at_n

KEYS = ("series_id",)


def fitted(scores: DataFrame, contamination: float = 0.1, keys: Sequence[str] = KEYS) -> DataFrame:
    """What a fitted detector keeps of its train scores: threshold, mu, sd, lo, hi, n."""
    check_range(contamination, 0.0, 0.5, "contamination", include_low=False)
    thr = quantiles(scores, keys, "score", {"threshold": 1.0 - contamination})
    stats = scores.groupBy(*keys).agg(
        F.avg("score").alias("mu"), F.stddev_pop("score").alias("sd"), F.min("score").alias("lo"),
        F.max("score").alias("hi"), F.count(F.lit(1)).alias("n"),
    )
    return thr.join(stats, list(keys)).withColumn("contamination", F.lit(float(contamination)))


def predict(scores: DataFrame, fit: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Label 1 where the score is above the train threshold."""
    out = attach(scores, fit.select(*keys, "threshold"), keys)
    return out.withColumn("pred", (F.col("score") > F.col("threshold")).cast("int")).drop("threshold")


def predict_proba(scores: DataFrame, fit: DataFrame, method: str = "linear", keys: Sequence[str] = KEYS) -> DataFrame:
    """Outlier probability: train min-max (linear) or Gaussian error function (unify), clipped to [0, 1]."""
    out = attach(scores, fit.select(*keys, "mu", "sd", "lo", "hi"), keys)
    if method == "linear":
        p = F.try_divide(F.col("score") - F.col("lo"), F.col("hi") - F.col("lo"))
    elif method == "unify":
        p = erf(F.try_divide(F.col("score") - F.col("mu"), F.col("sd") * F.lit(2.0**0.5)))
    else:
        raise ValueError(f"unknown method {method}")
    return out.withColumn("proba", F.least(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).drop("mu", "sd", "lo", "hi")


def binomial_cdf(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X <= k) of a binomial variable, by summing the smaller tail in logarithms."""
    out = np.empty(len(k))
    for i, (a, m, q) in enumerate(zip(k, n, p, strict=True)):
        a, m = int(a), int(m)
        if a < 0 or a >= m:
            out[i] = 0.0 if a < 0 else 1.0
            continue
        if q <= 0 or q >= 1:
            out[i] = 1.0 if q <= 0 else 0.0
            continue
        sd = max((m * q * (1 - q)) ** 0.5, 1.0)
        # terms farther than 40 deviations from the mean vanish in double precision
        lo, hi = max(0, int(m * q - 40 * sd)), min(m, int(m * q + 40 * sd))
        js = np.arange(lo, min(a, hi) + 1) if a < m * q else np.arange(max(a + 1, lo), hi + 1)
        if not len(js):
            out[i] = 0.0 if a < m * q else 1.0
            continue
        logs = lgamma(m + 1) - np.array([lgamma(j + 1) + lgamma(m - j + 1) for j in js])
        mass = float(np.exp(logs + js * np.log(q) + (m - js) * np.log1p(-q)).sum())
        out[i] = mass if a < m * q else 1 - mass
    return np.clip(out, 0, 1)


def predict_confidence(
    train: DataFrame, scores: DataFrame, fit: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Confidence that the label would stay the same on another training sample."""
    ranked = train_rank(train, scores, keys)
    equal = train.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("_eq"))
    r = ranked.join(equal, [*keys, "score"], "left").withColumn("_le", F.col("rank") + F.coalesce("_eq", F.lit(0)))
    r = attach(r, fit.select(*keys, "threshold", "n", "contamination"), keys)
    r = r.withColumn("_p", (F.col("_le") + 1) / (F.col("n") + 2))

    @F.pandas_udf("double")
    def tail(n: pd.Series, c: pd.Series, p: pd.Series) -> pd.Series:
        k = (n - np.floor(n * c)).to_numpy()
        distinct = pd.DataFrame({"k": k, "n": n, "p": p})
        first = distinct.drop_duplicates()
        first = first.assign(v=1 - binomial_cdf(first["k"].to_numpy(), first["n"].to_numpy(), first["p"].to_numpy()))
        return distinct.merge(first, on=["k", "n", "p"], how="left")["v"]

    r = r.withColumn("_c", tail("n", "contamination", "_p"))
    flagged = F.col("score") > F.col("threshold")
    return r.select(*keys, "t", "score", F.when(flagged, F.col("_c")).otherwise(1 - F.col("_c")).alias("confidence"))


def fit_predict_score(scores: DataFrame, scoring: str = "roc_auc", keys: Sequence[str] = KEYS) -> DataFrame:
    """ROC area or precision at n of labelled scores."""
    if scoring == "roc_auc":
        return pointwise(scores, keys).select(*keys, F.col("auc_roc").alias("value"))
    if scoring == "prc_n":
        return precision_at_n(scores, keys=keys).select(*keys, F.col("precision_at_n").alias("value"))
    raise ValueError(f"unknown scoring {scoring}")


def ensemble_mean(predictions: DataFrame, keys: Sequence[str] = ("dataset", "model"), value: str = "pred") -> DataFrame:
    """Average the predictions of several trained selectors."""
    return predictions.groupBy(*keys).agg(F.avg(value).alias(value))
