"""Writers of results, predictions and feature tables (inventory SNK1-SNK5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_results(results: DataFrame, path: str, partition: str = "model") -> None:
    """Append result records; the commit protocol of the writer takes the place of a file lock."""
    results.write.mode("append").partitionBy(partition).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """Results so far, or None before the first write."""
    try:
        return spark.read.parquet(path)
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return None
        raise


def write_series(series: DataFrame, path: str, columns: Sequence[str], key: str = "series_id", split: str = "split") -> None:
    """Every series and split as CSV part files in a folder ``file=name_split.csv``, in one write; :func:`read_series` reads them with ``named_by_folder``.

    Rows are dealt out by series and split, a large one to several tasks.
    """
    named = series.select(*columns, F.concat(F.col(key), F.lit("_"), F.col(split), F.lit(".csv")).alias("file"))
    named.hint("rebalance", "file").write.mode("append").option("header", True).partitionBy("file").csv(path)


def pending(inputs: DataFrame, spark: SparkSession, path: str, on: Sequence[str]) -> DataFrame:
    """Inputs without a stored result: an idempotent second run has nothing to do."""
    done = read_results(spark, path)
    return inputs if done is None else inputs.join(done.select(*on).distinct(), list(on), "left_anti")


def append_predictions(rows: DataFrame, path: str) -> None:
    """(dataset, ground_truth, prediction, rho, runtime) rows."""
    rows.write.mode("append").parquet(path)


def transposed(features: DataFrame, key: str, datasets: Sequence[str]) -> DataFrame:
    """One row per feature, one column per dataset."""
    names = [c for c in features.columns if c != key]
    long = features.select(key, *[F.col(c).cast("double").alias(c) for c in names]).unpivot([key], names, "feature", "value")
    return long.groupBy("feature").pivot(key, list(datasets)).agg(F.first("value"))


def write_features(features: DataFrame, path: str, key: str, datasets: Sequence[str] | None = None) -> None:
    out = transposed(features, key, datasets) if datasets else features
    out.write.mode("overwrite").option("header", True).csv(path)


def write_predictions(scores: DataFrame, path: str, models: Sequence[str], key: str = "dataset") -> None:
    """Wide predictions, one column per model."""
    scores.groupBy(key).pivot("model", list(models)).agg(F.first("score")).write.mode("overwrite").option("header", True).csv(path)
