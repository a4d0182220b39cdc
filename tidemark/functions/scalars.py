"""Scalar and array formulas (inventory FN1-FN14) as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import dot, let, vmean, vsum, vsumsq

EULER = 0.5772156649  # fixed value


def c_factor(n: Column, clamp: bool = True) -> Column:
    """Mean path length of an unsuccessful search in a binary tree of n points; ``clamp`` treats n < 2 as 2."""
    m = F.greatest(n.cast("double"), F.lit(2.0)) if clamp else n.cast("double")
    return F.lit(2.0) * (F.ln(m - 1) + EULER) - F.lit(2.0) * (m - 1) / m


def invert(score: Column, method: str = "multiplication", largest: Column | None = None) -> Column:
    """Reverse an order: -x, or (largest - x)."""
    if method == "multiplication":
        return -score
    if method == "subtraction":
        return largest - score
    raise ValueError(f"unknown method {method}")


def soft_threshold(x: Column, tau: Column) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - tau, F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def sigmoid_slope(x: Column) -> Column:
    s = sigmoid(x)
    return s * (F.lit(1.0) - s)


def similarity(x: Column, centre: Column, alpha: float) -> Column:
    """2^(-alpha * sum((x - centre)^2) / d)."""
    d2 = F.aggregate(F.zip_with(x, centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return F.pow(F.lit(2.0), -F.lit(alpha) * d2 / F.size(x))


def erf(x: Column) -> Column:
    """Error function, Abramowitz-Stegun 7.1.26, absolute error below 1.5e-7."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * F.abs(x))
    poly = t * (
        F.lit(0.254829592)
        + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429))))
    )
    return F.signum(x) * (F.lit(1.0) - poly * F.exp(-x * x))


def harmonic(p: Column, r: Column, eps: float = 0.0) -> Column:
    total = p + r + F.lit(eps)
    return F.when(total > 0, F.lit(2.0) * p * r / total).otherwise(F.lit(0.0))


# Losses between a truth vector and a prediction vector.


def mse(y: Column, p: Column) -> Column:
    return vmean(F.zip_with(y, p, lambda a, b: (a - b) * (a - b)))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def mae(y: Column, p: Column) -> Column:
    return vmean(F.zip_with(y, p, lambda a, b: F.abs(a - b)))


def smooth_l1(y: Column, p: Column, beta: float = 1.0) -> Column:
    def one(a, b):
        gap = F.abs(a - b)
        return F.when(gap < beta, F.lit(0.5) * gap * gap / beta).otherwise(gap - F.lit(0.5 * beta))

    return vmean(F.zip_with(y, p, one))


def cosine_loss(y: Column, p: Column) -> Column:
    return F.lit(1.0) - F.try_divide(dot(y, p), F.sqrt(dot(y, y)) * F.sqrt(dot(p, p)))


def log_softmax(x: Column) -> Column:
    def shifted(top: Column) -> Column:
        total = F.ln(vsum(F.transform(x, lambda v: F.exp(v - top))))
        return let(total, lambda z: F.transform(x, lambda v: v - top - z))

    return let(F.array_max(x), shifted)


def kl_loss(y: Column, p: Column) -> Column:
    """KL divergence of softmax(prediction) from softmax(truth), averaged over the elements."""
    both = F.zip_with(log_softmax(y), log_softmax(p), lambda a, b: F.exp(a) * (a - b))
    return vmean(both)


def nonzero_mse(truth: Column, pred: Column) -> Column:
    """Aggregate: mean squared error over rows whose truth is not 0."""
    return F.avg(F.when(truth != 0, (truth - pred) * (truth - pred)))


def variance(x: Column, ddof: int = 0) -> Column:
    return vsumsq(x, vmean(x)) / (F.size(x) - ddof)


def safe_corr(x, y) -> Column:
    """Aggregate: Pearson correlation, NULL when one side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


# Heap numbers of binary tree nodes: children of i are 2i+1 and 2i+2.


def branch_to_heap(path: Column) -> Column:
    """Heap number of a path such as ``LRL``."""
    steps = F.filter(F.split(path, ""), lambda c: c != "")
    return F.aggregate(
        steps, F.lit(0).cast("long"), lambda i, c: i * 2 + F.when(c == "L", F.lit(1)).otherwise(F.lit(2))
    )


def heap_depth(i: Column) -> Column:
    return F.floor(F.log2(i + 1) + F.lit(1e-9)).cast("int")


# Hash-ordered sampling: the choice depends on the seed and the row id only.


def hash_share(seed: int, *ids: str) -> Column:
    """A number in [0, 1) per row."""
    h = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in ids]), F.lit(1 << 52))
    return h.cast("double") / F.lit(float(1 << 52))


def split_value(lo: Column, hi: Column, seed: int, *ids: str) -> Column:
    """A hash-random split point in [lo, hi]."""
    return lo + (hi - lo) * hash_share(seed, *ids)


def sample_rows(df: DataFrame, share: float, seed: int, *ids: str, replacement: bool = False) -> DataFrame:
    """Without replacement: keep a row by its hash.  With replacement: Poisson copies, by the inverse distribution as far as doubles tell it from 1."""
    if not replacement:
        return df.filter(hash_share(seed, *ids) < share)
    u = hash_share(seed, *ids)
    bounds, p, cumulative, k = [], math.exp(-share), 0.0, 0
    while k <= share or p > 2.0**-53:
        cumulative += p
        bounds.append(cumulative)
        k += 1
        p = p * share / k
    copies = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= u))
    return (
        df.withColumn("_copies", copies)
        .filter("_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
        .drop("_copies")
    )


def algorithm_label(c: Column) -> Column:
    """``name-12-5-...`` to ``name(12, 5, ...)``."""
    parts = F.split(c, "-")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))
    return F.when(F.size(parts) > 1, F.concat(parts[0], F.lit("("), F.array_join(rest, ", "), F.lit(")"))).otherwise(c)


def parse_list(c: str) -> Column:
    """List literal with single-quoted names to an array of strings."""
    inner = F.regexp_replace(c, r"^\s*\[|\]\s*$|'|\"", "")
    return F.transform(F.filter(F.split(inner, ","), lambda s: F.trim(s) != ""), lambda s: F.trim(s))
