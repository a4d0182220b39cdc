"""Detectors as Spark ML estimators (inventory UDF2): parameters, fit, score, predict, save and load.

A detector with a model of its own (``MODELS``) is fitted once; all others keep the training series and fit when they score. Either way the model is
a table, which is what saving writes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import registry
from .detect import base as bd
from .detect import cluster, density, linear
from .detect.vectors import as_vectors


def _kmeans_fit(df, channels, keys, n_clusters=20, window_size=20):
    return cluster.kmeans_fit(df, channels, n_clusters, window_size, keys=keys)


def _kmeans_score(df, channels, keys, model, n_clusters=20, window_size=20):
    return cluster.kmeans_score(df, channels, n_clusters, window_size, keys=keys, model=model)


def _pca_fit(df, channels, keys, window=100, components=None):
    return linear.pca_fit(df, channels, window, components, keys)


def _pca_score(df, channels, keys, model, window=100, components=None):
    return linear.pca_score(df, channels, window, components, keys=keys, model=model)


def _hbos_fit(df, channels, keys, n_bins=10, tol=0.5, alpha=0.1):
    return density.hbos_fit(as_vectors(df, channels, 1, keys=keys), n_bins, alpha, keys)


def _hbos_score(df, channels, keys, model, n_bins=10, tol=0.5, alpha=0.1):
    return density.hbos_score(as_vectors(df, channels, 1, keys=keys), model, tol, keys)


MODELS: dict[str, tuple[Callable, Callable]] = {
    "KMeansAD": (_kmeans_fit, _kmeans_score), "KMeansAD_U": (_kmeans_fit, _kmeans_score), "PCA": (_pca_fit, _pca_score), "HBOS": (_hbos_fit, _hbos_score),
}


class _DetectorParams(Params):
    detector = Param(Params._dummy(), "detector", "name of a registered detector", TypeConverters.toString)
    channels = Param(Params._dummy(), "channels", "channel columns", TypeConverters.toListString)
    keys = Param(Params._dummy(), "keys", "columns that tell series apart", TypeConverters.toListString)
    settings = Param(Params._dummy(), "settings", "settings of the detector as JSON", TypeConverters.toString)
    contamination = Param(Params._dummy(), "contamination", "share of training points taken as outliers", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(keys=["series_id"], settings="{}", contamination=0.1)

    def get_params(self) -> dict:
        """All parameters that are set or have a default, by name."""
        return {p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)}

    def set_params(self, **values) -> _DetectorParams:
        """Set parameters by name; settings may be a dictionary."""
        if isinstance(values.get("settings"), dict):
            values["settings"] = json.dumps(values["settings"])
        self._set(**values)
        return self

    def _call(self) -> tuple[str, Sequence[str], Sequence[str], dict]:
        name = self.getOrDefault("detector")
        if name not in registry.names():
            raise ValueError(f"unknown detector {name}")
        return name, self.getOrDefault("channels"), self.getOrDefault("keys"), json.loads(self.getOrDefault("settings"))


class Detector(Estimator, _DetectorParams, DefaultParamsReadable, DefaultParamsWritable):
    """``Detector(detector="HBOS", channels=["c1"]).fit(train).transform(test)``."""

    @keyword_only
    def __init__(self, *, detector=None, channels=None, keys=None, settings=None, contamination=None):
        super().__init__()
        self.set_params(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> DetectorModel:
        name, channels, keys, settings = self._call()
        table = cut(MODELS[name][0](dataset, channels, keys, **settings) if name in MODELS else dataset.select(*keys, "t", *channels))
        model = self._copyValues(DetectorModel(table))
        model.summary = cut(bd.fitted(model.decision_function(dataset), self.getOrDefault("contamination"), keys))
        return model


class DetectorModel(Model, _DetectorParams):
    """A fitted detector. ``table`` is its model or training series, ``summary`` what it keeps of its training scores."""

    def __init__(self, table: DataFrame | None = None, summary: DataFrame | None = None):
        super().__init__()
        self.table, self.summary = table, summary

    def decision_function(self, df: DataFrame) -> DataFrame:
        """(keys, t, score)"""
        name, channels, keys, settings = self._call()
        if name in MODELS:
            return MODELS[name][1](df, channels, keys, self.table, **settings)
        return registry.detect(name, df, channels, train=self.table, keys=keys, **settings)

    def predict(self, df: DataFrame) -> DataFrame:
        """(keys, t, score, pred): 1 above the threshold of the training scores."""
        return bd.predict(self.decision_function(df), self.summary, self.getOrDefault("keys"))

    def predict_proba(self, df: DataFrame, method: str = "linear") -> DataFrame:
        return bd.predict_proba(self.decision_function(df), self.summary, method, self.getOrDefault("keys"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        keys = self.getOrDefault("keys")
        return dataset.join(self.predict(dataset), [*keys, "t"])

    def save(self, path: str) -> None:
        """Write parameters, model and summary below a folder on any Hadoop file system."""
        spark = self.table.sparkSession
        spark.createDataFrame([(json.dumps(self.get_params()),)], "params string").coalesce(1).write.json(f"{path}/params")
        self.table.write.parquet(f"{path}/table")
        self.summary.write.parquet(f"{path}/summary")

    @classmethod
    def load(cls, path: str) -> DetectorModel:
        spark = SparkSession.getActiveSession()
        params = json.loads(spark.read.schema("params string").json(f"{path}/params").first()["params"])
        model = cls(spark.read.parquet(f"{path}/table"), spark.read.parquet(f"{path}/summary"))
        return model.set_params(**params)


def fit_predict(df: DataFrame, channels: Sequence[str], detector: str, keys: Sequence[str] = ("series_id",), **settings) -> DataFrame:
    """(keys, t, score, pred) of a detector fitted on the series it scores."""
    return Detector(detector=detector, channels=list(channels), keys=list(keys), settings=settings).fit(df).predict(df).select(*keys, "t", "score", F.col("pred"))
