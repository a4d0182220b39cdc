"""Anomaly analytics over many multivariate time series, written as Spark jobs."""

__version__ = "0.1.0"
