"""Windows, un-windowing and padding (inventory WIN1-WIN11).

The row index must be dense inside a series.  Windows of one chunk are made in one task and need the
next ``w - 1`` rows, which ``halo`` copies over; no task holds a whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import framed
from .clean import with_length

KEYS = ("series_id",)


def slide(
    df: DataFrame, channels: Sequence[str], window: int, stride: int = 1, keys: Sequence[str] = KEYS,
    out: str = "win", size: int | None = None, layout: str = "channel",
) -> DataFrame:
    """Windows [t, t + window) as arrays: ``channel`` puts all values of channel 1 first, ``time`` row after row."""
    exprs = {
        f"_w_{c}": (
            lambda w, c=c: F.collect_list(F.col(c).cast("double")).over(w.rowsBetween(0, window - 1))
        )
        for c in channels
    }
    wide = framed(df.select(*keys, "t", *channels), keys, "t", 0, window - 1, exprs, size)
    wide = wide.filter((F.size(f"_w_{channels[0]}") == window) & (F.col("t") % stride == 0))
    if layout == "channel":
        arr = F.concat(*[F.col(f"_w_{c}") for c in channels])
        return wide.select(*keys, "t", arr.alias(out))
    rows = F.arrays_zip(*[F.col(f"_w_{c}") for c in channels])
    arr = F.transform(rows, lambda r: F.array(*[r[f"_w_{c}"] for c in channels]))
    return wide.select(*keys, "t", arr.alias(out))


def forecast_pairs(
    df: DataFrame, channels: Sequence[str], window: int, horizon: int = 1, stride: int = 1,
    keys: Sequence[str] = KEYS, size: int | None = None,
) -> DataFrame:
    """(x, y): a time-major window and the ``horizon`` rows after it."""
    both = slide(df, channels, window + horizon, stride, keys, "_b", size, "time")
    return both.select(
        *keys, "t", F.slice("_b", 1, window).alias("x"), F.slice("_b", window + 1, horizon).alias("y")
    )


def window_count(n: Column, window: int, stride: int = 1) -> Column:
    return F.greatest(F.floor((n - window) / stride) + 1, F.lit(0))


def centre_pad(
    points: DataFrame, scores: DataFrame, window: int, keys: Sequence[str] = KEYS, score: str = "score",
    fill: float | None = None,
) -> DataFrame:
    """Scores of window begins back on the points: the window is centred, the ends repeat the edge scores.

    With ``fill`` the ends take that value.  One equi-join on the computed window begin.
    """
    front = -(-(window - 1) // 2)
    base = with_length(points.select(*keys, "t"), keys, "_n")
    begin = F.col("t") - front
    clamped = F.greatest(F.least(begin, F.col("_n") - window), F.lit(0))
    base = base.withColumn("_b", clamped.cast("long")).withColumn("_inside", begin == clamped).drop("_n")
    looked = base.join(scores.select(*keys, F.col("t").cast("long").alias("_b"), score), [*keys, "_b"], "left")
    if fill is not None:
        looked = looked.withColumn(score, F.when(F.col("_inside"), F.col(score)).otherwise(F.lit(fill)))
    return looked.select(*keys, "t", score)


def front_pad(
    points: DataFrame, scores: DataFrame, window: int, horizon: int = 1, keys: Sequence[str] = KEYS,
    score: str = "score",
) -> DataFrame:
    """Scores of forecasts: the first ``window + horizon - 1`` points repeat the first score."""
    base = points.select(*keys, "t").withColumn(
        "_b", F.greatest(F.col("t") - (window + horizon - 1), F.lit(0)).cast("long")
    )
    looked = base.join(scores.select(*keys, F.col("t").cast("long").alias("_b"), score), [*keys, "_b"], "left")
    return looked.select(*keys, "t", score)


def overlap_mean(
    points: DataFrame, scores: DataFrame, window: int, stride: int = 1, keys: Sequence[str] = KEYS,
    score: str = "score", size: int | None = None,
) -> DataFrame:
    """Mean score of all windows that cover a point; points no window covers get 0, points whose windows all have NULL scores NULL.

    A sliding frame over the window begins; no window is exploded.
    """
    begins = scores.select(*keys, "t", F.col(score).alias("_s"), F.lit(1).alias("_w")).filter(F.col("t") % stride == 0)
    on_grid = points.select(*keys, "t").join(begins, [*keys, "t"], "left")
    out = framed(
        on_grid, keys, "t", window - 1, 0,
        {
            score: lambda w: F.avg("_s").over(w.rowsBetween(-(window - 1), 0)),
            "_any": lambda w: F.max("_w").over(w.rowsBetween(-(window - 1), 0)),
        }, size,
    )
    value = F.col(score)
    return out.select(
        *keys, "t", F.when(F.col("_any").isNull() | F.isnan(value), F.lit(0.0)).otherwise(value).alias(score)
    )


def adapted_window(train_len: Column, default: int = 100, short: int = 50, below: int = 600) -> Column:
    return F.when(train_len < below, F.lit(short)).otherwise(F.lit(default))


def prefix_split(df: DataFrame, valid_share: float = 0.2, keys: Sequence[str] = KEYS) -> DataFrame:
    """Column ``split``: the first floor((1 - v) * n) rows are ``train``, the rest ``valid``."""
    cutoff = F.floor(F.lit(1.0 - valid_share) * F.col("_n"))
    return (
        with_length(df, keys, "_n")
        .withColumn("split", F.when(F.col("t") < cutoff, F.lit("train")).otherwise(F.lit("valid")))
        .drop("_n")
    )


def mask_windows(win: Column, seed_cols: Sequence[str], share: float = 0.25, seed: int = 7) -> Column:
    """Set a hash-chosen share of the steps of a window to 0 (masked reconstruction input)."""
    cut = int(share * 1000)
    return F.transform(
        win,
        lambda v, i: F.when(
            F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in seed_cols], i), F.lit(1000)) < cut, F.lit(0.0)
        ).otherwise(v),
    )
