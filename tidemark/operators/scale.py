"""Scaling and normalisation (inventory SCL1-SCL11).

Per-series statistics are one aggregate and one join back; per-window scaling is array arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import let, vmean, vsumsq, zero_if_undefined
from ..plans.attach import attach
from ..plans.ordered import cumulate, quantile_of


def _with_stats(df, keys, channels, makers: dict) -> DataFrame:
    stats = df.groupBy(*keys).agg(
        *[make(F.col(c)).alias(f"_{k}_{c}") for c in channels for k, make in makers.items()]
    )
    return attach(df, stats, keys)


def _apply(df, channels, makers, fn) -> DataFrame:
    out = df.withColumns({c: fn(c) for c in channels})
    return out.drop(*[f"_{k}_{c}" for c in channels for k in makers])


def minmax(df: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """To [0, 1] per series and channel; constant channels become 0."""
    makers = {"lo": F.min, "hi": F.max}

    def fn(c):
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))

    return _apply(_with_stats(df, keys, channels, makers), channels, makers, fn)


def standardise(df: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Mean 0 and population deviation 1; a zero deviation counts as 1."""
    makers = {"mu": F.avg, "sd": F.stddev_pop}

    def fn(c):
        sd = F.col(f"_sd_{c}")
        return (F.col(c) - F.col(f"_mu_{c}")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)

    return _apply(_with_stats(df, keys, channels, makers), channels, makers, fn)


def scaler_table(df: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Keepable scaler: mean and population deviation per series and channel."""
    return df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in channels],
        *[F.when(F.stddev_pop(c) == 0, F.lit(1.0)).otherwise(F.stddev_pop(c)).alias(f"std_{c}") for c in channels],
    )


def split_zscore(
    df: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("series_id",), fit: Column | None = None
) -> DataFrame:
    """z-score with the population statistics of the rows where ``fit`` holds; zero deviation counts as 1e-8."""
    cond = F.lit(True) if fit is None else fit
    makers = {
        "mu": lambda c: F.avg(F.when(cond, c)),
        "sd": lambda c: F.stddev_pop(F.when(cond, c)),
    }

    def fn(c):
        sd = F.col(f"_sd_{c}")
        return (F.col(c) - F.col(f"_mu_{c}")) / F.when(sd == 0, F.lit(1e-8)).otherwise(sd)

    return _apply(_with_stats(df, keys, channels, makers), channels, makers, fn)


def zscore_sample(df: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """z-score with the sample deviation."""
    makers = {"mu": F.avg, "sd": F.stddev_samp}
    return _apply(
        _with_stats(df, keys, channels, makers), channels, makers,
        lambda c: F.try_divide(F.col(c) - F.col(f"_mu_{c}"), F.col(f"_sd_{c}")),
    )


def robust(long: DataFrame, keys: Sequence[str] = ("series_id", "channel"), value: str = "x") -> DataFrame:
    """(x - median) / (1.4826 * median absolute deviation), exact medians, long form."""
    med = cumulate(long, keys, value).groupBy(*keys).agg(quantile_of(value, 0.5).alias("_med"))
    dev = attach(long, med, keys).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = cumulate(dev, keys, "_dev").groupBy(*keys).agg(
        (F.lit(1.4826) * quantile_of("_dev", 0.5)).alias("_mad")
    )
    return attach(dev, mad, keys).withColumn(
        value, F.when(F.col("_mad") > 0, (F.col(value) - F.col("_med")) / F.col("_mad"))
    ).drop("_dev", "_med", "_mad")


# Row- and window-wise scaling of arrays.


def row_zscore(x: Column, ddof: int = 1) -> Column:
    """z-score over the elements of one vector; undefined values become 0."""
    mu = vmean(x)
    sd = F.sqrt(vsumsq(x, mu) / (F.size(x) - ddof))
    packed = F.struct(mu.alias("mu"), sd.alias("sd"))
    return let(
        packed,
        lambda s: F.transform(x, lambda v: F.when(s["sd"] > 0, (v - s["mu"]) / s["sd"]).otherwise(F.lit(0.0))),
    )


def row_minmax(x: Column) -> Column:
    packed = F.struct(F.array_min(x).alias("lo"), F.array_max(x).alias("hi"))
    return let(
        packed,
        lambda s: F.transform(
            x, lambda v: F.when(s["hi"] > s["lo"], (v - s["lo"]) / (s["hi"] - s["lo"])).otherwise(F.lit(0.0))
        ),
    )


def instance_norm(x: Column, ddof: int = 0, eps: float = 1e-5) -> Column:
    """Struct (values, mean, scale) of one channel of one window; scale = sqrt(var + eps)."""
    mu = vmean(x)
    scale = F.sqrt(vsumsq(x, mu) / (F.size(x) - ddof) + F.lit(eps))
    packed = F.struct(mu.alias("mu"), scale.alias("sc"))
    return let(
        packed,
        lambda s: F.struct(
            F.transform(x, lambda v: (v - s["mu"]) / s["sc"]).alias("values"),
            s["mu"].alias("mean"),
            s["sc"].alias("scale"),
        ),
    )


def instance_denorm(packed: Column) -> Column:
    return F.transform(packed["values"], lambda v: v * packed["scale"] + packed["mean"])


def segment_norm(x: Column, length: int, segment: int = 25, eps: float = 1e-5) -> Column:
    """Normalise consecutive segments of a window of ``length`` values on their own."""
    parts = [
        instance_norm(F.slice(x, s + 1, min(segment, length - s)), 0, eps)["values"]
        for s in range(0, length, segment)
    ]
    return F.concat(*parts)


def negative_inverse(y: Column) -> Column:
    return F.try_divide(F.lit(-1.0), y)


def nan_safe(x: Column) -> Column:
    return F.transform(x, zero_if_undefined)
