"""Quality of detector selection (inventory SQ1-SQ12).  Inputs are long tables (dataset, model, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.scalars import safe_corr

DS, MODEL = "dataset", "model"


def _ranked(perf: DataFrame, truth: str, pred: str, keys: Sequence[str]) -> DataFrame:
    """Predicted position and number of models that are truly better; one group holds the models of a dataset."""
    w = Window.partitionBy(*keys)
    return perf.select(
        *keys, MODEL, F.col(truth).alias("y"), F.col(pred).alias("p"),
        F.row_number().over(w.orderBy(F.col(pred).desc(), MODEL)).alias("pr"),
        (F.rank().over(w.orderBy(F.col(truth).desc())) - 1).alias("better"),
        F.row_number().over(w.orderBy(F.col(truth).desc(), MODEL)).alias("tr"),
    )


def ranked_lists(perf: DataFrame, value: str, n: int | None = None, keys: Sequence[str] = (DS,)) -> DataFrame:
    """Best n (or all) models per dataset as an array; models are few."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), MODEL)
    top = perf.withColumn("_r", F.row_number().over(w))
    top = top if n is None else top.filter(F.col("_r") <= n)
    return top.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_r", MODEL))), lambda s: s[MODEL]).alias("models")
    )


def e_top_nk(perf: DataFrame, n: int, k: int, truth="perf", pred="pred", keys=(DS,)) -> DataFrame:
    """1 when the best true value among the predicted top k is one of the true top n values."""
    r = _ranked(perf, truth, pred, keys)
    best = F.max(F.when(F.col("pr") <= k, F.col("y")))
    floor = F.min(F.when(F.col("tr") <= n, F.col("y")))
    return r.groupBy(*keys).agg((best >= floor).cast("int").alias("hit"))


def e_top_n(perf: DataFrame, n: int, truth="perf", pred="pred", keys=(DS,)) -> DataFrame:
    return e_top_nk(perf, n, 1, truth, pred, keys)


def e_rank_k(perf: DataFrame, k: int = 1, truth="perf", pred="pred", keys=(DS,)) -> DataFrame:
    """True 0-based rank of the best of the predicted top k, over the number of models."""
    r = _ranked(perf, truth, pred, keys)
    return r.groupBy(*keys).agg(
        (F.min(F.when(F.col("pr") <= k, F.col("better"))) / F.count(F.lit(1))).alias("erank")
    )


def ndcg_graded(perf: DataFrame, n: int, truth="perf", pred="pred", keys=(DS,)) -> DataFrame:
    """Relevance n - i of the i-th true model (0-based), gain 2^rel - 1, discount log2(i + 2), over the top n."""
    r = _ranked(perf, truth, pred, keys)
    rel = F.greatest(F.lit(n) - (F.col("tr") - 1), F.lit(0))
    gain = F.pow(F.lit(2.0), rel) - 1
    dcg = F.sum(F.when(F.col("pr") <= n, gain / F.log2(F.col("pr") + 1)))
    ideal = F.sum(F.when(F.col("tr") <= n, gain / F.log2(F.col("tr") + 1)))
    return r.groupBy(*keys).agg(F.coalesce(F.try_divide(dcg, ideal), F.lit(0.0)).alias("ndcg"))


def ndcg_binary(pred: str = "prediction", truth: str = "truth", k: int = 3) -> Column:
    """NDCG@k of two array columns: relevant means in the truth list."""
    taken = F.slice(pred, 1, k)
    gains = F.transform(
        taken, lambda m, i: F.when(F.array_contains(truth, m), F.lit(1.0) / F.log2(i + 2)).otherwise(F.lit(0.0))
    )
    dcg = F.aggregate(gains, F.lit(0.0), lambda s, v: s + v)
    size = F.least(F.size(truth), F.lit(k))
    ideal = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.lit(1.0) / F.log2(i + 1)),
        F.lit(0.0), lambda s, v: s + v,
    )
    return F.when(size > 0, dcg / ideal).otherwise(F.lit(0.0))


def ndcg_linear(perf: DataFrame, truth="perf", pred="pred", keys=(DS,)) -> DataFrame:
    """Gain = performance; models with the same prediction share the mean discount of their positions."""
    w = Window.partitionBy(*keys)
    r = perf.select(
        *keys, F.col(truth).alias("y"), F.col(pred).alias("p"),
        F.row_number().over(w.orderBy(F.col(pred).desc(), MODEL)).alias("pr"),
        F.row_number().over(w.orderBy(F.col(truth).desc(), MODEL)).alias("tr"),
    )
    tied = r.groupBy(*keys, "p").agg(
        (F.avg("y") * F.sum(F.lit(1.0) / F.log2(F.col("pr") + 1))).alias("dcg"),
        F.sum(F.col("y") / F.log2(F.col("tr") + 1)).alias("ideal"),
    )
    return tied.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum("dcg"), F.sum("ideal")), F.lit(0.0)).alias("ndcg"))


def hit_first(pred: str = "prediction", truth: str = "truth", n: int = 3) -> Column:
    """The first prediction is in the true top n."""
    return F.coalesce(F.array_contains(F.slice(truth, 1, n), F.col(pred)[0]), F.lit(False)).cast("int")


def best_found(pred: str = "prediction", truth: str = "truth", n: int = 3) -> Column:
    """The true best model is in the predicted top n."""
    return F.coalesce(F.array_contains(F.slice(pred, 1, n), F.col(truth)[0]), F.lit(False)).cast("int")


def list_spearman(lists: DataFrame, key: str = DS, pred: str = "prediction", truth: str = "truth") -> DataFrame:
    """Rank correlation of two lists; a model missing from the prediction gets rank length + 1."""
    rank = F.array_position(F.col(pred), F.col("m"))
    r = lists.select(key, pred, F.size(truth).alias("_n"), F.posexplode(truth).alias("i", "m")).select(
        key, F.col("i").cast("double").alias("tr"),
        F.when(rank > 0, rank).otherwise(F.col("_n") + 1).cast("double").alias("pr"),
    )
    w = Window.partitionBy(key)
    tie = Window.partitionBy(key, "pr")
    mean_rank = F.rank().over(w.orderBy("pr")) + (F.count(F.lit(1)).over(tie) - 1) / 2
    return r.withColumn("prr", mean_rank).groupBy(key).agg(safe_corr("tr", "prr").alias("rho"))


def percentile_of(perf: DataFrame, recommended: DataFrame, value: str = "perf", keys=(DS,)) -> DataFrame:
    """Share of models the recommended one beats or ties (percent), its value and the best value."""
    own = perf.join(recommended, [*keys, MODEL]).select(*keys, F.col(value).alias("own"))
    return perf.join(own, list(keys)).groupBy(*keys).agg(
        (F.round(F.avg((F.col(value) <= F.col("own")).cast("double")), 2) * 100).alias("percentile"),
        F.max("own").alias("performance"), F.max(value).alias("performance_max"),
    )


def regret(perf: DataFrame, recommended: DataFrame, value: str = "perf", keys=(DS,)) -> DataFrame:
    p = percentile_of(perf, recommended, value, keys)
    return p.select(*keys, "performance_max", "performance",
                    (F.col("performance_max") - F.col("performance")).alias("regret"))
