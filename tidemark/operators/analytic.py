"""Rank, run and peak functions (inventory WF1-WF10), sorts and top-k (TK1-TK9), set operations (SET1-SET5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.attach import attach
from ..plans.ordered import carry, cumulate, framed, shifted
from ..session import cut


def ecdf(df: DataFrame, keys: Sequence[str], value: str = "x", right: bool = False, per_range: int | None = None):
    """One row per distinct value with ``p``: share of rows <= value (or >= value for the right tail)."""
    c = cumulate(df, keys, value, per_range=per_range)
    above = F.col("tot_n") - F.col("cum_n") + F.col("n")
    p = (above if right else F.col("cum_n")) / F.col("tot_n")
    return c.select(*keys, value, p.alias("p"))


def train_rank(
    train: DataFrame, test: DataFrame, keys: Sequence[str] = ("series_id",), score: str = "score",
    normalise: bool = False, per_range: int | None = None,
) -> DataFrame:
    """Number of training scores strictly below each test score (optionally / the largest rank of the key)."""
    both = train.select(*keys, score, F.lit(1).alias("_tr")).unionByName(
        test.select(*keys, score, F.lit(0).alias("_tr"))
    )
    c = cumulate(both, keys, score, {"tr": F.sum("_tr")}, per_range)
    ranks = c.select(
        *keys, score, (F.col("cum_tr") - F.col("tr")).alias("rank"), (F.col("n") - F.col("tr")).alias("_te")
    ).filter("_te > 0").drop("_te")
    if normalise:
        top = ranks.groupBy(*keys).agg(F.max("rank").alias("_top"))
        ranks = attach(ranks, top, keys).withColumn("rank", F.coalesce(F.try_divide("rank", "_top"), F.lit(0.0))).drop("_top")
    return test.join(ranks, [*keys, score])


def runs(
    df: DataFrame, keys: Sequence[str] = ("series_id",), flag: str = "label", order: str = "t",
    extra: dict[str, Column] | None = None, size: int | None = None,
) -> DataFrame:
    """One row per run of flag = 1: (keys, s, e, len) plus aggregates.  Dense order column.

    A row carries the position of the last run start before it, so that a run that spans many chunks is
    still one group, and the groups are reduced before the shuffle.  The run table is checkpointed, since every
    user reads it more than once.
    """
    marked = run_ids(df, keys, flag, order, size)
    table = (
        marked.filter(F.col("run_id").isNotNull())
        .groupBy(*keys, F.col("run_id").alias("s"))
        .agg(
            F.max(order).alias("e"), F.count(F.lit(1)).alias("len"),
            *[c.alias(n) for n, c in (extra or {}).items()],
        )
    )
    return cut(table)


def run_ids(df: DataFrame, keys: Sequence[str] = ("series_id",), flag: str = "label", order: str = "t", size: int | None = None) -> DataFrame:
    """Column ``run_id`` = start position of the run a flagged row belongs to, NULL elsewhere."""
    prev = shifted(df, keys, order, {"_prev": (flag, 1)}, size)
    start = F.when((F.col(flag) == 1) & (F.coalesce("_prev", F.lit(0)) != 1), F.col(order))
    out = carry(prev.withColumn("_start", start), keys, order, {"_id": ("_start", "prev", True)}, size)
    return out.withColumn("run_id", F.when(F.col(flag) == 1, F.col("_id"))).drop("_prev", "_start", "_id")


def local_maxima(df: DataFrame, keys, value: str, order: str = "t", size: int | None = None) -> DataFrame:
    out = shifted(df, keys, order, {"_p": (value, 1), "_n": (value, -1)}, size)
    return out.filter((F.col(value) > F.col("_p")) & (F.col(value) > F.col("_n"))).drop("_p", "_n")


def moving(df: DataFrame, keys, value: str, window: int, stats: Sequence[str], size: int | None = None):
    """Moving statistics over the last ``window`` rows: any of mean, min, max, sum, var."""
    makers = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "var": F.var_samp}
    return framed(
        df, keys, "t", window - 1, 0,
        {s: (lambda w, s=s: makers[s](value).over(w.rowsBetween(-(window - 1), 0))) for s in stats}, size,
    )


def model_rank(perf: DataFrame, dataset: str = "dataset", model: str = "model", value: str = "perf"):
    """Rank of each model inside its dataset (models are few); ties by name."""
    w = Window.partitionBy(dataset).orderBy(F.col(value).desc(), F.col(model))
    return perf.withColumn("rank", F.row_number().over(w))


def roc_table(
    df: DataFrame, keys: Sequence[str] = ("series_id",), score: str = "score", label: str = "label",
    per_range: int | None = None,
) -> DataFrame:
    """Per distinct score: points and positives at or above it (tp, fp) and the totals (pos, neg)."""
    c = cumulate(df, keys, score, {"p": F.sum(F.col(label).cast("long"))}, per_range)
    tp = F.col("tot_p") - F.col("cum_p") + F.col("p")
    cnt = F.col("tot_n") - F.col("cum_n") + F.col("n")
    return c.select(
        *keys, score, F.col("n"), F.col("p"), tp.alias("tp"), (cnt - tp).alias("fp"),
        F.col("tot_p").alias("pos"), (F.col("tot_n") - F.col("tot_p")).alias("neg"),
    )


# Top-k over small groups (models per dataset); raw rows use cumulate instead.


def top_n(df: DataFrame, keys: Sequence[str], value: str, n: int, tie: Sequence[str], desc: bool = True):
    order = F.col(value).desc() if desc else F.col(value).asc()
    w = Window.partitionBy(*keys).orderBy(order, *tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def nth_largest(df: DataFrame, keys: Sequence[str], value: str, n: int, tie: Sequence[str]):
    return top_n(df, keys, value, n, tie).filter(F.col("rank") == n).drop("rank")


def n_extreme_points(
    df: DataFrame, keys: Sequence[str], value: str, n: int, largest: bool = True, per_range: int | None = None
) -> DataFrame:
    """Rows at or beyond the n-th largest (smallest) value; ties are included."""
    c = cumulate(df, keys, value, per_range=per_range)
    beyond = (F.col("tot_n") - F.col("cum_n")) if largest else (F.col("cum_n") - F.col("n"))
    cut_at = c.filter(beyond < n).groupBy(*keys).agg(
        (F.min(value) if largest else F.max(value)).alias("_cut")
    )
    out = attach(df, cut_at, keys)
    keep = F.col(value) >= F.col("_cut") if largest else F.col(value) <= F.col("_cut")
    return out.filter(keep).drop("_cut")


def wide_top_k(df: DataFrame, keys: Sequence[str], name: str, value: str, k: int) -> DataFrame:
    """rec_1..rec_k and score_1..score_k, one row per key."""
    top = top_n(df, keys, value, k, [name])
    at = lambda c, i: F.max(F.when(F.col("rank") == i, F.col(c)))
    return top.groupBy(*keys).agg(
        *[at(name, i).alias(f"rec_{i}") for i in range(1, k + 1)],
        *[at(value, i).alias(f"score_{i}") for i in range(1, k + 1)],
    )


def best_per_key(df: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    """argmax per key as a plain aggregate; the first name wins a tie."""
    best = F.min_by(name, F.struct(-F.col(value), F.col(name)))
    return df.groupBy(*keys).agg(best.alias(name), F.max(value).alias(value))


def sampled_thresholds(
    df: DataFrame, keys: Sequence[str], score: str = "score", max_samples: int = 50, per_range: int | None = None
) -> DataFrame:
    """Distinct scores without the smallest; when more than ``max_samples``: every n-th, and the last."""
    distinct = cumulate(df.select(*keys, score).distinct(), keys, score, per_range=per_range)
    i = F.col("cum_n") - 2  # position after the smallest is dropped
    total = F.col("tot_n") - 1
    step = F.when(total > max_samples, F.floor(total / (max_samples - 1))).otherwise(F.lit(1))
    return distinct.filter((i >= 0) & ((i % step == 0) | (i == total - 1))).select(
        *keys, F.col(score).alias("threshold")
    )


def spaced_order_stats(
    df: DataFrame, keys: Sequence[str], score: str = "score", count: int = 250, per_range: int | None = None
) -> DataFrame:
    """``count`` evenly spaced positions of the descending scores: (keys, k, threshold)."""
    c = cumulate(df, keys, score, per_range=per_range)
    # position of k in descending order; k -> floor(k * (n - 1) / (count - 1))
    first = F.col("tot_n") - F.col("cum_n")  # descending position of the first copy of the value
    last = first + F.col("n") - 1
    step = (F.col("tot_n") - 1) / F.lit(count - 1)
    k_lo = F.greatest(F.floor(first / step) - 1, F.lit(0))
    k_hi = F.least(F.ceil((last + 1) / step) + 1, F.lit(count - 1))
    near = F.when(F.col("tot_n") > 1, F.sequence(k_lo.cast("int"), k_hi.cast("int"))).otherwise(
        F.sequence(F.lit(0), F.lit(count - 1))
    )
    return (
        c.withColumn("k", F.explode(near))
        .withColumn("_pos", F.floor(F.col("k") * step))
        .filter((F.col("_pos") >= first) & (F.col("_pos") <= last))
        .select(*keys, "k", F.col(score).alias("threshold"))
    )


# Set operations on one-column lists.


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).unionByName(b.subtract(a))


def bind_rows(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def train_then_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """Stack both splits with a ``type`` column."""
    return train.withColumn("type", F.lit("train")).unionByName(test.withColumn("type", F.lit("test")))
