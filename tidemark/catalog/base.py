"""Registry of the runnable queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name, with the SQL that must give the same rows."""

    def wrap(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def rd(c, digits: int = 6) -> Column:
    """Round for comparison; adding 0.0 turns a negative zero into zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, only=None) -> DataFrame:
    """Round every double column (or those named) of a result."""
    names = [n for n, t in df.dtypes if t == "double" and (only is None or n in only)]
    return df.select(*[rd(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def squeeze(sql: str) -> str:
    return re.sub(r"\s+", " ", sql).strip()
