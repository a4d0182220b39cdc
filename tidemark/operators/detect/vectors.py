"""Row vectors for the point detectors: a vector column ``x`` per (series, t)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import row_zscore, standardise
from ..windows import slide

KEYS = ("series_id",)


def as_vectors(
    df: DataFrame, channels: Sequence[str] | None, window: int = 1, normalise: bool = True, keys: Sequence[str] = KEYS,
    size=None,
) -> DataFrame:
    """(keys, t, x).  Several elements per vector: each vector is z-scored on its own; a single element: over the series.

    ``channels`` None means that the column ``x`` is there already.
    """
    if channels is None:
        v = df.select(*keys, "t", F.col("x").cast("array<double>").alias("x"))
        return v.withColumn("x", row_zscore(F.col("x"))) if normalise else v
    if window <= 1 and len(channels) == 1:
        one = df.select(*keys, "t", F.col(channels[0]).cast("double").alias("x"))
        one = standardise(one, ["x"], keys) if normalise else one
        return one.withColumn("x", F.array("x"))
    if window <= 1:
        v = df.select(*keys, "t", F.array(*[F.col(c).cast("double") for c in channels]).alias("x"))
    else:
        v = slide(df, channels, window, keys=keys, out="x", size=size)
    return v.withColumn("x", row_zscore(F.col("x"))) if normalise else v


def as_long(vectors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, t, channel, x): one row per vector element."""
    return vectors.select(*keys, "t", F.posexplode("x").alias("channel", "x"))
