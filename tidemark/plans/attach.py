"""Join a small table back to the rows it was computed from.

The small table is computed once (checkpointed, so later passes read it instead of its lineage) and its
size is measured.  Below the limit it is broadcast and the rows are not shuffled; above it the join is a plain
shuffle join whose skewed keys adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

BROADCAST_BYTES = 64 << 20


def _row_bytes(df: DataFrame):
    """Upper estimate of the bytes of a row."""
    total = F.lit(16)
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            inner = 64 if isinstance(f.dataType.elementType, (T.StructType, T.ArrayType, T.StringType)) else 8
            total = total + F.coalesce(F.size(f.name).cast("long"), F.lit(0)) * inner
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(f.name).cast("long"), F.lit(0)) + 16
        else:
            total = total + 16
    return total


def sized(small: DataFrame, limit: int | None = None) -> DataFrame:
    """The checkpointed table, marked for broadcast only when its measured size is below the limit.

    The size is observed while the checkpoint is written, so measuring costs no extra job.
    """
    seen = Observation()
    small = cut(small.observe(seen, F.sum(_row_bytes(small)).alias("bytes")))
    limit = BROADCAST_BYTES if limit is None else limit
    return F.broadcast(small) if (seen.get["bytes"] or 0) <= limit else small


def attach(
    df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", limit: int | None = None
) -> DataFrame:
    return df.join(sized(small, limit), list(keys), how)
