"""Cleaning of series tables (inventory PRJ1-PRJ15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.attach import attach, sized
from ..plans.ordered import carry

FLOAT32_MAX = 3.4028234663852886e38


def finite_or(c: str | Column, default: float = 0.0) -> Column:
    """NULL, NaN and both infinities become ``default``."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    inf = F.lit(float("inf"))
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == inf), F.lit(default)).otherwise(c)


def nan_inf_to_zero(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite_or(c) for c in channels})


def melt(df: DataFrame, ids: Sequence[str], channels: Sequence[str], value: str = "x") -> DataFrame:
    """Wide to long: one row per time point and channel."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in channels]).unpivot(
        list(ids), list(channels), "channel", value
    )


def drop_constant(long: DataFrame, keys: Sequence[str] = ("series_id",), value: str = "x") -> DataFrame:
    """Keep the channels of a series that take more than one value."""
    at = [*keys, "channel"]
    alive = long.groupBy(*at).agg(F.min(value).alias("_a"), F.max(value).alias("_b")).filter("_a < _b")
    return long.join(sized(alive.select(*at)), at, "left_semi")


def drop_all_zero(long: DataFrame, keys: Sequence[str] = ("series_id",), value: str = "x") -> DataFrame:
    at = [*keys, "channel"]
    alive = long.groupBy(*at).agg(F.max(F.abs(value)).alias("_m")).filter("_m > 0")
    return long.join(sized(alive.select(*at)), at, "left_semi")


def impute_mean(df: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """NULL and NaN become the mean of the valid values of the channel."""
    valid = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in channels}
    means = df.groupBy(*keys).agg(*[F.avg(valid[c]).alias(f"_m_{c}") for c in channels])
    out = attach(df, means, keys)
    return out.withColumns({c: F.coalesce(valid[c], F.col(f"_m_{c}")) for c in channels}).drop(
        *[f"_m_{c}" for c in channels]
    )


def with_length(df: DataFrame, keys: Sequence[str] = ("series_id",), name: str = "n") -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return attach(df, counts, keys)


def centre_cut(df: DataFrame, limit: int = 25_000, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Middle ``limit`` rows of longer series, index restarted at 0; shorter series stay whole."""
    start = F.greatest(F.floor((F.col("_n") - limit) / 2), F.lit(0))
    return (
        with_length(df, keys, "_n")
        .withColumn("_s", start)
        .filter((F.col("t") >= F.col("_s")) & (F.col("t") < F.col("_s") + limit))
        .withColumn("t", (F.col("t") - F.col("_s")).cast("long"))
        .drop("_n", "_s")
    )


def repeat_short(
    df: DataFrame, below: int = 500, upto: int = 1000, keys: Sequence[str] = ("series_id",)
) -> DataFrame:
    """Repeat series of fewer than ``below`` rows until they have ``upto`` rows."""
    reps = F.when(F.col("_n") < below, F.ceil(F.lit(upto) / F.col("_n"))).otherwise(F.lit(1))
    return (
        with_length(df, keys, "_n")
        .withColumn("_r", F.explode(F.sequence(F.lit(0), (reps - 1).cast("int"))))
        .withColumn("t", (F.col("_r") * F.col("_n") + F.col("t")).cast("long"))
        .filter((F.col("_n") >= below) | (F.col("t") < upto))
        .drop("_n", "_r")
    )


def sample_and_hold(
    df: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("series_id",), order: str = "t",
    size: int | None = None,
) -> DataFrame:
    """Gaps take the last known value; leading gaps take the first known one."""
    cols = {}
    for c in channels:
        cols[f"_h_{c}"] = (c, "prev", True)
        cols[f"_g_{c}"] = (c, "next", True)
    out = carry(df, keys, order, cols, size)
    return out.withColumns({c: F.coalesce(f"_h_{c}", f"_g_{c}") for c in channels}).drop(*cols)


def tidy_meta(df: DataFrame, drop_prefixes: Sequence[str], defaults: dict[str, float]) -> DataFrame:
    """Drop columns by prefix; replace undefined values of named columns."""
    kept = [c for c in df.columns if not c.startswith(tuple(drop_prefixes))]
    return df.select(
        *[finite_or(c, defaults[c]).alias(c) if c in defaults else F.col(c) for c in kept]
    )


def clamp_float32(c: str) -> Column:
    return F.greatest(F.least(F.col(c).cast("double"), F.lit(FLOAT32_MAX)), F.lit(-FLOAT32_MAX))


def prepare_meta(
    df: DataFrame, features: Sequence[str], method: str = "zscore", train: DataFrame | None = None
) -> DataFrame:
    """Preprocess one row per dataset: drop constant features, then scale with the statistics of ``train``.

    ``method``: ``zscore`` (sample deviation), ``range`` (0-1), or ``none``; values are clamped to float32.
    The statistics are one row, so the driver reads just that row.
    """
    base = df if train is None else train
    stats = base.agg(
        *[F.min(c).alias(f"{c}__lo") for c in features],
        *[F.max(c).alias(f"{c}__hi") for c in features],
        *[F.avg(c).alias(f"{c}__mu") for c in features],
        *[F.stddev_samp(c).alias(f"{c}__sd") for c in features],
    ).first()
    alive = [c for c in features if stats[f"{c}__lo"] is not None and stats[f"{c}__lo"] < stats[f"{c}__hi"]]
    rest = [c for c in df.columns if c not in features]

    def scaled(c: str) -> Column:
        if method == "zscore":
            return ((clamp_float32(c) - stats[f"{c}__mu"]) / stats[f"{c}__sd"]).alias(c)
        if method == "range":
            return ((clamp_float32(c) - stats[f"{c}__lo"]) / (stats[f"{c}__hi"] - stats[f"{c}__lo"])).alias(c)
        return clamp_float32(c).alias(c)

    return df.select(*rest, *[scaled(c) for c in alive])


def dataset_key(c: str) -> Column:
    """Lower-case key without the split and file suffix."""
    return F.regexp_replace(F.lower(c), r"(_test)?\.csv$", "")


def dataset_group(c: str) -> Column:
    return F.split(c, "_")[0]


SIZE_BINS = ((5_000, "<5K"), (20_000, "5K-20K"), (50_000, "20K-50K"))


def size_bin(c: str | Column, bins: Sequence[tuple[int, str]] = SIZE_BINS, last: str = ">=50K") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = None
    for upper, name in bins:
        out = F.when(c < upper, name) if out is None else out.when(c < upper, name)
    return out.otherwise(last)


def sanitise_score(score: str, label: str | None = None, mode: str = "replace") -> Column:
    """NaN and -Inf become 0, +Inf becomes 1; mode ``penalise`` gives NOT label for all of them."""
    s = F.col(score).cast("double")
    inf = float("inf")
    if mode == "penalise":
        wrong = F.lit(1.0) - F.col(label)
        return F.when(s.isNull() | F.isnan(s) | (F.abs(s) == inf), wrong).otherwise(s)
    return F.when(s.isNull() | F.isnan(s) | (s == -inf), F.lit(0.0)).when(s == inf, F.lit(1.0)).otherwise(s)


def check_range(
    value, low=None, high=None, name: str = "parameter", include_low: bool = True, include_high: bool = True
):
    """Raise when a parameter lies outside its range; returns the value."""
    if low is None and high is None:
        raise ValueError("give at least one bound")
    if low is not None and high is not None and low >= high:
        raise ValueError("the lower bound must be below the upper bound")
    too_low = low is not None and (value < low or (value == low and not include_low))
    too_high = high is not None and (value > high or (value == high and not include_high))
    if too_low or too_high:
        left, right = "[" if include_low else "(", "]" if include_high else ")"
        raise ValueError(f"{name}={value} is outside {left}{low}, {high}{right}")
    return value
