"""Range-based precision and recall (MET7, MET13, MET14), after Tatbul et al., NeurIPS 2018."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...plans.attach import attach
from ..analytic import sampled_thresholds
from .levels import GRID, KEYS, level_runs, on_thresholds
from .points import _trace, _with_all_keys

BIASES = ("flat", "front", "middle", "back")


def bias_weight(bias: str, i: Column, length: Column) -> Column:
    """Weight of the i-th point (from 1) of a range."""
    if bias == "flat":
        return F.lit(1.0)
    if bias == "front":
        return (length - i + 1).cast("double")
    if bias == "back":
        return i.cast("double")
    if bias == "middle":
        return F.when(i <= length / 2, i).otherwise(length - i + 1).cast("double")
    raise ValueError(f"unknown bias {bias}")


def bias_total(bias: str, length: Column) -> Column:
    n = length.cast("double")
    if bias == "flat":
        return n
    if bias in ("front", "back"):
        return n * (n + 1) / 2
    half = F.floor(n / 2)
    return F.when(n % 2 == 0, half * (half + 1)).otherwise((half + 1) * (half + 1))


def cardinality_weight(kind: str | Callable[[Column], Column], met: Column) -> Column:
    """Factor for a range that meets ``met`` ranges of the other side; a function plays the user-defined role."""
    if callable(kind):
        return F.when(met > 1, F.lit(1.0) / kind(met)).otherwise(F.lit(1.0))
    if kind == "one":
        return F.lit(1.0)
    if kind in ("reciprocal", "udf_gamma"):
        # the user-defined factor is the constant 1 unless a function is given
        return F.lit(1.0) if kind == "udf_gamma" else F.when(met > 1, F.lit(1.0) / met).otherwise(F.lit(1.0))
    raise ValueError(f"unknown cardinality {kind}")


def recall_by_level(
    trace: DataFrame, levels: DataFrame, alpha: float, cardinality="reciprocal", bias="flat", keys: Sequence[str] = KEYS
) -> DataFrame:
    """(keys, k, recall, existence, overlap): means over the label runs.

    A label point adds its weight at all levels below its own, and one met run at the levels it newly
    reaches.  Both are differences on the levels, summed per run and accumulated downwards.
    """
    pts = trace.filter("label = 1").select(*keys, "cs", "t", "kx", F.when(F.col("st") == 1, 0).otherwise(F.col("pk")).alias("pk"))
    runs = pts.groupBy(*keys, "cs").agg(F.min("t").alias("a"), F.count(F.lit(1)).alias("len"))
    at = [*keys, "cs"]
    placed = pts.join(runs, at)
    weight = bias_weight(bias, F.col("t") - F.col("a") + 1, F.col("len"))
    rising = F.col("kx") > F.col("pk")
    own = placed.filter("kx > 0").select(
        *at, F.col("kx").alias("lev"), weight.alias("w"), rising.cast("int").alias("d")
    )
    back = placed.filter(rising & (F.col("pk") > 0)).select(
        *at, F.col("pk").alias("lev"), F.lit(0.0).alias("w"), F.lit(-1).alias("d")
    )
    dense = attach(runs.select(*at), levels.groupBy(*keys).agg(F.collect_list("k").alias("_ks")), keys).select(
        *at, F.explode(F.transform("_ks", lambda k: k + 1)).alias("lev"), F.lit(0.0).alias("w"), F.lit(0).alias("d")
    )
    steps = own.unionByName(back).unionByName(dense).groupBy(*at, "lev").agg(F.sum("w").alias("w"), F.sum("d").alias("d"))
    down = Window.partitionBy(*at).orderBy(F.col("lev").desc()).rowsBetween(Window.unboundedPreceding, 0)
    per_run = steps.select(
        *at, (F.col("lev") - 1).alias("k"), F.sum("w").over(down).alias("w"), F.sum("d").over(down).alias("met")
    ).join(runs, at)
    exist = (F.col("met") > 0).cast("double")
    overlap = F.col("w") / bias_total(bias, F.col("len")) * cardinality_weight(cardinality, F.col("met"))
    return per_run.groupBy(*keys, "k").agg(
        F.avg(F.lit(alpha) * exist + F.lit(1.0 - alpha) * overlap).alias("recall"),
        F.avg(exist).alias("existence"), F.avg(overlap).alias("overlap"),
    )


def precision_by_level(
    trace: DataFrame, alpha: float = 0.0, cardinality="reciprocal", bias="flat", keys: Sequence[str] = KEYS, size=None,
    runs: DataFrame | None = None,
) -> DataFrame:
    """(keys, k, precision): mean over the predicted runs of every level."""
    r = level_runs(trace, keys, size) if runs is None else runs
    length = (F.col("e") - F.col("s") + 1).cast("double")
    if bias == "flat":
        held = F.col("lab").cast("double")
    elif bias == "front":
        held = ((F.col("e") + 1) * F.col("lab") - F.col("ts")).cast("double")
    elif bias == "back":
        held = (F.col("ts") - (F.col("s") - 1) * F.col("lab")).cast("double")
    elif bias == "middle":
        # rising up to the middle position, falling behind it: split the label counts there
        r = r.withColumn("_m", F.col("s") + F.floor(length / 2).cast("long") - 1)
        mid = trace.select(*keys, F.col("t").cast("long").alias("_m"), F.col("cl").alias("_ml"), F.col("ct").alias("_mt"))
        first = trace.select(
            *keys, F.col("t").alias("s"), (F.col("cl") - F.col("label")).alias("_sl"),
            (F.col("ct") - F.col("label") * F.col("t")).alias("_st"),
        )
        r = r.join(first, [*keys, "s"]).join(mid, [*keys, "_m"], "left")
        has = F.col("_m") >= F.col("s")
        l1 = F.when(has, F.col("_ml") - F.col("_sl")).otherwise(F.lit(0))
        t1 = F.when(has, F.col("_mt") - F.col("_st")).otherwise(F.lit(0))
        rise = t1 - (F.col("s") - 1) * l1
        fall = (F.col("e") + 1) * (F.col("lab") - l1) - (F.col("ts") - t1)
        held = (rise + fall).cast("double")
    else:
        raise ValueError(f"unknown bias {bias}")
    exist = (F.col("ev") > 0).cast("double")
    overlap = held / bias_total(bias, length) * cardinality_weight(cardinality, F.col("ev"))
    return r.groupBy(*keys, "k").agg(F.avg(F.lit(alpha) * exist + F.lit(1.0 - alpha) * overlap).alias("precision"))


def _grid_levels(trace, keys, count):
    return trace.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k"))


def range_f1(
    df: DataFrame | None, keys: Sequence[str] = KEYS, score="score", label="label", pred=None, size=None, trace=None,
    runs=None, alpha: float = 0.2,
) -> DataFrame:
    """Range F1, best over the threshold grid (or of a given prediction)."""
    trace = _trace(df, keys, score, label, pred, size) if trace is None else trace
    levels = _grid_levels(trace, keys, GRID if pred is None else 1)
    r = recall_by_level(trace, levels, alpha, keys=keys)
    p = precision_by_level(trace, 0.0, keys=keys, size=size, runs=runs)
    total = F.col("precision") + F.col("recall")
    f = F.when(total > 0, F.lit(2.0) * F.col("precision") * F.col("recall") / total).otherwise(F.lit(0.0))
    best = r.join(p, [*keys, "k"]).groupBy(*keys).agg(F.max(f).alias("range_f1"))
    return _with_all_keys(trace, best, keys, "range_f1")


def range_scores(
    df: DataFrame, keys: Sequence[str] = KEYS, pred="pred", label="label", r_alpha=0.0, p_alpha=0.0,
    cardinality="reciprocal", r_bias="flat", p_bias="flat", size=None,
) -> DataFrame:
    """Range recall (with its two parts) and precision of a prediction."""
    trace = _trace(df, keys, None, label, pred, size)
    r = recall_by_level(trace, _grid_levels(trace, keys, 1), r_alpha, cardinality, r_bias, keys)
    p = precision_by_level(trace, p_alpha, cardinality, p_bias, keys, size)
    out = r.join(p, [*keys, "k"], "full").drop("k").fillna(0.0)
    return trace.select(*keys).distinct().join(out, list(keys), "left").fillna(0.0)


def range_fbeta(df: DataFrame, beta: float = 1.0, keys: Sequence[str] = KEYS, **kw) -> DataFrame:
    s = range_scores(df, keys, **kw)
    b2 = F.lit(float(beta) ** 2)
    bottom = b2 * F.col("precision") + F.col("recall")
    f = F.when(bottom > 0, (1 + b2) * F.col("precision") * F.col("recall") / bottom).otherwise(F.lit(0.0))
    return s.withColumn("fbeta", f)


def auc_ptrt(
    df: DataFrame, keys: Sequence[str] = KEYS, score="score", label="label", max_samples: int = 50, r_alpha=0.5,
    p_alpha=0.0, cardinality="reciprocal", bias="flat", size=None, per_range=None,
) -> DataFrame:
    """Area under the range-precision / range-recall curve over sampled thresholds."""
    thr = sampled_thresholds(df, keys, score, max_samples, per_range)
    trace = _trace_thresholds(df, thr, keys, score, label, size)
    # the number of thresholds of a key is its highest level: the largest score exceeds all
    levels = trace.groupBy(*keys).agg(F.max("kx").alias("m"), F.avg("label").alias("base"), F.max("label").alias("any"))
    dense = levels.filter("m > 0").select(*keys, F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("k"))
    r = recall_by_level(trace, dense, r_alpha, cardinality, bias, keys)
    p = precision_by_level(trace, p_alpha, cardinality, bias, keys, size)
    curve = r.join(p, [*keys, "k"]).select(*keys, F.lit(1).alias("o"), "recall", "precision")
    start = levels.select(*keys, F.lit(0).alias("o"), F.lit(1.0).alias("recall"), F.col("base").alias("precision"))
    end = levels.select(*keys, F.lit(2).alias("o"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    w = Window.partitionBy(*keys).orderBy("o", F.col("recall").desc(), "precision")
    curve = curve.unionByName(start).unionByName(end).select(
        *keys, "recall", "precision", F.lag("recall").over(w).alias("pr"), F.lag("precision").over(w).alias("pp")
    )
    area = F.sum((F.col("pr") - F.col("recall")) * (F.col("pp") + F.col("precision")) / 2)
    out = curve.groupBy(*keys).agg(area.alias("auc_ptrt"))
    return levels.join(out, list(keys)).select(*keys, F.when(F.col("any") == 1, F.col("auc_ptrt")).alias("auc_ptrt"))


def _trace_thresholds(df, thr, keys, score, label, size):
    from .levels import traced

    return traced(on_thresholds(df, thr, keys, score, label), keys, size)
