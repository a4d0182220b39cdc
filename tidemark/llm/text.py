"""Words, word hashes and window hashes shared by the corpus operators.

Words are runs of characters other than the space and U+0009 to U+000D, unchanged. ``bytes.split()`` without arguments splits on exactly these
characters, and none of their bytes occurs inside a longer UTF-8 sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
LAST = (1 << 63) - 1  # stands for a null id, after all others


def prepare(spark: SparkSession) -> SparkSession:
    """Arrow batches of a few MB, so that long texts cannot pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_keys(id_col: str, text_col: str) -> Column:
    """Key of a row from its id and text, so that rows that share an id stay apart; equal rows share it."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), text_or_empty(text_col))


def tagged(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text`` and the row key ``rid``."""
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), text_or_empty(text_col).alias("text")).withColumn("rid", row_keys("id", "text"))


def untag(col: str) -> Column:
    return F.when(F.col(col) != LAST, F.col(col))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def word_hashes(text: str) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers from a seed."""
    return np.fromiter((xxhash.xxh3_64_intdigest(b"%d" % i, seed) | 1 for i in range(n)), np.uint64, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of all bits over all bits; in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def window_hashes(hashes: np.ndarray, starts: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of the ``width`` words from each start: a multilinear sum, then mixed."""
    out = np.zeros(len(starts), np.uint64)
    for k, c in enumerate(odd_constants(width, seed)):
        out += hashes[starts + k] * c
    return mix(out)


def spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs laid end to end: where each starts, the run of every element, and the element's place in its run."""
    starts = np.cumsum(lengths) - lengths
    run = np.repeat(np.arange(len(lengths)), lengths)
    return starts, run, np.arange(int(lengths.sum())) - starts[run]


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names), strict=True)
