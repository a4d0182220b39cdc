"""Result and performance tables (inventory SRC7, SNK3-SNK5, AGG24-AGG26)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.scalars import parse_list


def melt_performance(wide: DataFrame, key: str = "Dataset") -> DataFrame:
    """Wide matrix (key, one column per model) to (dataset, model, perf)."""
    models = [c for c in wide.columns if c != key]
    long = wide.select(F.col(key).alias("dataset"), *[F.col(f"`{m}`").cast("double").alias(m) for m in models])
    return long.unpivot(["dataset"], models, "model", "perf")


def performance_wide(perf: DataFrame, models: Sequence[str], value: str = "perf") -> DataFrame:
    """(dataset, one column per model)."""
    return perf.groupBy("dataset").pivot("model", list(models)).agg(F.first(value))


def performance_matrix(perf: DataFrame, group: str = "dataset", name: str = "model", value: str = "perf") -> DataFrame:
    """Values of each group in name order, columns 1, 2, 3, ...; the groups are small."""
    w = Window.partitionBy(group).orderBy(name)
    return perf.select(group, F.row_number().over(w).alias("i"), value).groupBy(group).pivot("i").agg(F.first(value))


def ranked_matrix(perf: DataFrame, value: str = "perf") -> DataFrame:
    """(dataset, models): model names in rank order."""
    from .quality import ranked_lists

    return ranked_lists(perf, value)


def recommendation_lists(df: DataFrame, key: str, pred: str, truth: str | None = None) -> DataFrame:
    """Stringified lists to arrays, with a normalised dataset key."""
    from ..clean import dataset_key

    cols = [dataset_key(key).alias("dataset"), parse_list(pred).alias("prediction")]
    if truth:
        cols.append(parse_list(truth).alias("truth"))
    return df.select(*cols)


def wide_recommendations(df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    from ..clean import dataset_key

    return df.select(dataset_key(key).alias("dataset"), F.array(*names).alias("prediction"))


def mean_runtime(df: DataFrame, by: Sequence[str], runtime: str = "runtime") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(runtime).alias("mean_runtime")).orderBy(F.desc("mean_runtime"), *by)


def prediction_row(lists: DataFrame, runtime: str | None = None) -> DataFrame:
    """(dataset, ground_truth, prediction, rho, runtime) rows for the prediction log."""
    from .quality import list_spearman

    out = lists.join(list_spearman(lists), "dataset")
    cols = ["dataset", F.col("truth").alias("ground_truth"), "prediction", "rho"]
    return out.select(*cols, *([runtime] if runtime else []))
