"""Column expressions over ``array<double>`` values; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c) -> Column:
    return F.col(c).cast("array<double>") if isinstance(c, str) else c.cast("array<double>")


def vsum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def vmean(a: Column) -> Column:
    return vsum(a) / F.size(a)


def let(value: Column, body) -> Column:
    """``body(v)`` with the value computed once; an expression inside a lambda is evaluated per element."""
    return F.transform(F.array(value), body)[0]


def vsumsq(a: Column, centre: Column) -> Column:
    return let(centre, lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)))


def vstd(a: Column, ddof: int = 0) -> Column:
    return F.sqrt(vsumsq(a, vmean(a)) / (F.size(a) - ddof))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sqdist(a, b))


def zero_if_undefined(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)


def concat_channels(parts: list[Column]) -> Column:
    return F.concat(*parts)
