"""Meta-features of a series (inventory AGG1-AGG22, AGG27, AGG28).

All series are described in the same few passes: one aggregate per channel, one over all cells, one Gram matrix.  The result is one
row per series with named columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_corr
from ..functions.special import f_tail
from ..plans.attach import attach
from ..plans.chunks import collected, over_rows, row_moments, solve_per_key, unpack
from ..plans.ordered import cumulate, quantile_of
from ..session import cut
from .clean import melt
from .detect.forest import forest_fit, forest_shape
from .detect.linear import eigen
from .profile import histogram
from .scale import minmax

KEYS = ("series_id",)
SIX = ("min", "max", "mean", "std", "skewness", "kurtosis")
LISTED = ("normality_p", "is_normal_5", "is_normal_1", *[f"moment_{k}" for k in range(5, 11)], "skewness", "kurtosis")


def list6(c: str | Column, name: str) -> list[Column]:
    """Min, max, mean, population deviation, skewness and excess kurtosis over the rows of a group."""
    c = F.col(c) if isinstance(c, str) else c
    return [
        F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.avg(c).alias(f"{name}_mean"),
        F.stddev_pop(c).alias(f"{name}_std"), F.coalesce(F.skewness(c), F.lit(0.0)).alias(f"{name}_skewness"),
        F.coalesce(F.kurtosis(c), F.lit(-3.0)).alias(f"{name}_kurtosis"),
    ]


def six_np(values, name: str) -> dict[str, float]:
    v = np.asarray([x for x in values if x is not None and math.isfinite(x)], float)
    if not len(v):
        return {f"{name}_{s}": 0.0 for s in SIX}
    m, sd = v.mean(), v.std()
    z = (v - m) / sd if sd > 0 else np.zeros(len(v))
    stats = (v.min(), v.max(), m, sd, (z**3).mean() if sd > 0 else 0.0, (z**4).mean() - 3)
    return {f"{name}_{s}": float(x) for s, x in zip(SIX, stats, strict=True)}


def cell_features(long: DataFrame, rows: DataFrame, keys: Sequence[str] = KEYS, per_range=None) -> DataFrame:
    """Statistics over all cells of a series (AGG2-AGG8).  ``rows``: (keys, n_samples).

    Everything that needs an order comes from the table of distinct values with their counts.  The quartile columns are
    the 0.01, 0.25, 0.75 and 0.99 percent points, as the benchmark has them.
    """
    c = cut(cumulate(long, keys, "x", per_range=per_range))
    base = long.groupBy(*keys).agg(
        F.avg("x").alias("sample_mean"), F.var_pop("x").alias("sample_var"), F.min("x").alias("sample_min"),
        F.max("x").alias("sample_max"), F.stddev_pop("x").alias("sample_std"),
    )
    quart = c.groupBy(*keys).agg(
        quantile_of("x", 0.5).alias("sample_median"), quantile_of("x", 0.0001).alias("q1"),
        quantile_of("x", 0.0025).alias("q25"), quantile_of("x", 0.0075).alias("q75"), quantile_of("x", 0.0099).alias("q99"),
    )
    b = cut(base.join(quart, list(keys)).join(rows, list(keys)).withColumn("iqr", F.col("q75") - F.col("q25")))
    w = attach(c, b, keys)
    v = F.col("x") - F.least(F.col("sample_min"), F.lit(0.0)) + F.lit(1e-7)
    n, total = F.col("n"), F.col("tot_n")
    gini = F.sum(n * (2 * F.col("cum_n") - n - total) * v) / (F.max(total) * F.sum(n * v))

    def outside(lo: Column, hi: Column) -> Column:
        return F.sum(F.when((F.col("x") < lo) | (F.col("x") > hi), n).otherwise(F.lit(0)))

    q25, q75, iqr, mu, sd = (F.col(k) for k in ("q25", "q75", "iqr", "sample_mean", "sample_std"))
    bounds = {
        "15iqr": (q25 - 1.5 * iqr, q75 + 1.5 * iqr), "3iqr": (q25 - 3 * iqr, q75 + 3 * iqr),
        "1_99": (F.col("q1"), F.col("q99")), "3std": (mu - 3 * sd, mu + 3 * sd),
    }
    extra = w.groupBy(*keys).agg(
        gini.alias("sample_gini"), (F.sum(n * F.abs(F.col("x") - mu)) / F.max(total)).alias("avg_abs_dev"),
        *[(outside(*v) / F.max("n_samples")).alias(f"percent_outliers_{k}") for k, v in bounds.items()],
        *[(outside(*v) > 0).cast("int").alias(f"has_outliers_{k}") for k, v in bounds.items()],
    )
    dev = w.select(*keys, F.abs(F.col("x") - F.col("sample_median")).alias("d"), "n")
    mad = cumulate(dev, keys, "d", {"n": F.sum("n")}, per_range).groupBy(*keys).agg(quantile_of("d", 0.5).alias("med_abs_dev"))
    out = b.drop("n_samples").join(extra, list(keys)).join(mad, list(keys))
    return out.withColumns({
        "normalized_mean": F.try_divide(mu, F.col("sample_max")),
        "normalized_median": F.try_divide(F.col("sample_median"), F.col("sample_max")),
        "sample_range": F.col("sample_max") - F.col("sample_min"),
        "quant_coeff_disp": (q75 - q25) / (q75 + q25 + F.lit(1e-8)), "coeff_var": F.try_divide(F.col("sample_var"), mu),
    })


def normality_p(g1: Column, g2: Column, n: Column) -> Column:
    """p-value of the omnibus test from population skewness and excess kurtosis; the statistic is chi-square with 2 df."""
    n = n.cast("double")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (F.lit(6.0) * (n - 2)))
    beta2 = F.lit(3.0) * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(F.lit(2.0) * (beta2 - 1)) - 1
    delta = F.lit(1.0) / F.sqrt(F.lit(0.5) * F.ln(w2))
    scaled = y / F.sqrt(F.lit(2.0) / (w2 - 1))
    z1 = delta * F.ln(scaled + F.sqrt(scaled * scaled + 1))
    mean = F.lit(3.0) * (n - 1) / (n + 1)
    var = F.lit(24.0) * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - mean) / F.sqrt(var)
    root = F.lit(6.0) * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(
        F.lit(6.0) * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))
    )
    a = F.lit(6.0) + F.lit(8.0) / root * (F.lit(2.0) / root + F.sqrt(F.lit(1.0) + F.lit(4.0) / (root * root)))
    part = (F.lit(1.0) - F.lit(2.0) / a) / (F.lit(1.0) + x * F.sqrt(F.lit(2.0) / (a - 4)))
    cube = F.signum(part) * F.pow(F.abs(part), F.lit(1.0 / 3.0))
    z2 = ((F.lit(1.0) - F.lit(2.0) / (F.lit(9.0) * a)) - cube) / F.sqrt(F.lit(2.0) / (F.lit(9.0) * a))
    return F.exp(-(z1 * z1 + z2 * z2) / 2)


def channel_features(long: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per channel: normality, moments, skewness, kurtosis, sparsity, value entropy (AGG9-AGG11, AGG14, AGG17)."""
    at = [*keys, "channel"]
    base = long.groupBy(*at).agg(
        F.avg("x").alias("mu"), F.count(F.lit(1)).alias("n"), F.skewness("x").alias("skewness"), F.kurtosis("x").alias("kurtosis")
    )
    centred = attach(long, base.select(*at, "mu"), at)
    moments = centred.groupBy(*at).agg(
        *[F.avg(F.pow(F.col("x") - F.col("mu"), F.lit(float(k)))).alias(f"moment_{k}") for k in range(5, 11)]
    )
    counts = long.groupBy(*at, "x").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.groupBy(*at).agg(
        F.count(F.lit(1)).alias("_d"), F.sum("c").alias("_n"), F.sum(F.col("c") * F.ln(F.col("c").cast("double"))).alias("_s")
    )
    counts = counts.select(
        *at, (F.col("_d") / F.col("_n")).alias("sparsity"),
        ((F.ln(F.col("_n").cast("double")) - F.col("_s") / F.col("_n")) / F.col("_n")).alias("entropy"),
    )
    out = base.join(moments, at).join(counts, at)
    p = normality_p(F.col("skewness"), F.col("kurtosis"), F.col("n"))
    out = out.withColumn("normality_p", p)
    # the names say "normal", the flag is set when normality is rejected
    out = out.withColumn("is_normal_5", (F.col("normality_p") < 0.05).cast("double"))
    out = out.withColumn("is_normal_1", (F.col("normality_p") < 0.01).cast("double"))
    return out.withColumn("skewness", F.coalesce("skewness", F.lit(0.0))).withColumn("kurtosis", F.coalesce("kurtosis", F.lit(-3.0)))


def summarised(per_channel: DataFrame, names: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    return per_channel.groupBy(*keys).agg(*[c for n in names for c in list6(n, n)])


def histogram_landmarks(long: DataFrame, keys: Sequence[str] = KEYS, bins: int = 10) -> DataFrame:
    """Mean, max and min density over the bins of each channel, list6 over the channels (AGG18)."""
    at = [*keys, "channel"]
    h = histogram(long, bins, at).groupBy(*at).agg(
        (F.sum("density") / bins).alias("HBOS_mean"), F.max("density").alias("HBOS_max"),
        F.when(F.count(F.lit(1)) < bins, F.lit(0.0)).otherwise(F.min("density")).alias("HBOS_min"),
    )
    return summarised(h, ("HBOS_mean", "HBOS_max", "HBOS_min"), keys)


MATRIX_COLS = [
    *[f"{n}_{s}" for n in ("correlation", "covariance", "anova_p_value") for s in SIX],
    "first_pca_std", "first_pca_skewness", "first_pca_kurtosis",
    "pca_expl_ratio_1", "pca_expl_ratio_2", "pca_expl_ratio_3", "pca_sv_1", "pca_sv_2", "pca_sv_3",
]


def matrix_features(df: DataFrame, channels: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Correlation, covariance, one-way ANOVA and principal components from one Gram matrix (AGG12, 13, 15, 16, 20)."""
    first = df.groupBy(*keys).agg(F.min_by(F.array(*channels), "t").alias("first"))
    m = row_moments(df, channels, keys).join(first, list(keys))

    def solve(row):
        n, mean, cov = unpack(row["m"])
        d = len(mean)
        low = np.tril_indices(d, -1)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        outer = np.outer(sd, sd)
        corr = np.divide(cov, outer, out=np.zeros_like(cov), where=outer > 1e-15)
        anova = []
        for i, j in zip(*low, strict=True):
            between = n / 2 * (mean[i] - mean[j]) ** 2
            within = n * (cov[i, i] + cov[j, j]) / (2 * n - 2)
            anova.append(f_tail(between / within, 1, 2 * n - 2) if within > 0 else float("nan"))
        out = {**six_np(corr[low], "correlation"), **six_np(cov[low] * n / max(n - 1, 1), "covariance"), **six_np(anova, "anova_p_value")}
        values, vectors = eigen(cov)
        k = min(3, d)
        at = six_np((np.asarray(row["first"], float) - mean) @ vectors[:, :k], "f")
        out.update({f"first_pca_{s}": at[f"f_{s}"] for s in ("std", "skewness", "kurtosis")})
        std_values = eigen(corr)[0]
        for i in range(3):
            out[f"pca_expl_ratio_{i + 1}"] = float(std_values[i] / max(std_values.sum(), 1e-300)) if i < d else 0.0
            out[f"pca_sv_{i + 1}"] = float(math.sqrt(std_values[i] * n)) if i < d else 0.0
        return out

    return solve_per_key(m, solve, ", ".join(f"{c} double" for c in MATRIX_COLS), keys)


def _equals(j: int):
    return lambda v: v == j


def forest_landmarks(df: DataFrame, channels: Sequence[str], trees: int = 100, keys: Sequence[str] = KEYS, seed: int = 0):
    """Leaves, depth and split shares of isolation trees, list6 over the trees (AGG19)."""
    f = forest_fit(df, channels, 1, trees, seed=seed, keys=keys)
    d = len(channels)
    node = F.transform(F.sequence(F.lit(0), (F.size("nodes") / 6 - 1).cast("int")), lambda i: F.element_at("nodes", i * 6 + 1))
    used = F.filter(node, lambda v: v >= 0)
    share = [F.size(F.filter(used, _equals(j))) / F.greatest(F.size(used), F.lit(1)) for j in range(d)]
    fi = f.select(*keys, "tree", F.array(*share).alias("s")).select(
        *keys, "tree", (F.aggregate("s", F.lit(0.0), lambda a, v: a + v) / d).alias("IForest_fi_mean"),
        F.array_max("s").alias("IForest_fi_max"),
    )
    shape = forest_shape(f, keys).withColumnsRenamed({"leaves": "IForest_n_leaves", "depth": "IForest_n_depth"})
    both = shape.join(fi, [*keys, "tree"])
    return summarised(both, ("IForest_n_leaves", "IForest_n_depth", "IForest_fi_mean", "IForest_fi_max"), keys)


def projection_landmarks(
    df: DataFrame, channels: Sequence[str], cuts: int = 100, bins: int = 10, keys: Sequence[str] = KEYS, seed: int = 0
) -> DataFrame:
    """Histograms of sparse random projections: means and maxima by bin and by projection, list6 (AGG21).

    Chunks return partial limits first and partial counts second; the sums are combined by Spark.
    """
    d = len(channels)
    rng = np.random.default_rng(seed)
    proj = np.zeros((d, cuts))
    for j in range(cuts):
        used = rng.permutation(d)[: max(1, int(math.sqrt(d)))]
        proj[used, j] = rng.normal(size=len(used))
    chans = list(channels)

    def limits(pdf, m):
        z = pdf[chans].to_numpy(float) @ proj
        cells = np.empty(len(pdf), dtype=object)
        cells[0] = np.concatenate([-z.min(0), z.max(0)])
        return {"v": cells}

    lim = over_rows(df, chans, limits, "v array<double>", keys).filter("v IS NOT NULL")
    lim = lim.select(*keys, F.posexplode("v").alias("i", "v")).groupBy(*keys, "i").agg(F.max("v").alias("v"))
    lim = cut(lim.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("lim")))

    def counts(pdf, m):
        z = pdf[chans].to_numpy(float) @ proj
        lo, hi = -np.asarray(m["lim"][:cuts]), np.asarray(m["lim"][cuts:])
        b = np.minimum((z - lo) / np.maximum(hi - lo, 1e-300) * bins, bins - 1).astype(int)
        flat = np.zeros((cuts, bins))
        for j in range(cuts):
            flat[j] = np.bincount(b[:, j], minlength=bins)
        cells = np.empty(len(pdf), dtype=object)
        cells[0] = flat.ravel()
        return {"v": cells}

    part = over_rows(df, chans, counts, "v array<double>", keys, models=lim).filter("v IS NOT NULL")
    total = collected(part.select(*keys, F.posexplode("v").alias("i", "v")), keys).join(lim, list(keys))
    names = ("LODA_n_hists_mean", "LODA_n_hists_max", "LODA_n_cuts_mean", "LODA_n_cuts_max")

    def solve(row):
        h = np.asarray(row["m"]).reshape(cuts, bins)
        width = np.maximum(np.asarray(row["lim"][cuts:]) + np.asarray(row["lim"][:cuts]), 1e-12) / bins
        h = h / (h.sum(1) * width)[:, None]
        lists = (h.mean(0), h.max(0), h.mean(1), h.max(1))
        return {k: v for n, x in zip(names, lists, strict=True) for k, v in six_np(x, n).items()}

    return solve_per_key(total, solve, ", ".join(f"{n}_{s} double" for n in names for s in SIX), keys)


BASE_COLS = [
    "n_samples", "n_features", "sample_mean", "sample_median", "sample_var", "sample_min", "sample_max", "sample_std", "q1",
    "q25", "q75", "q99", "iqr", "normalized_mean", "normalized_median", "sample_range", "sample_gini", "med_abs_dev", "avg_abs_dev",
    "quant_coeff_disp", "coeff_var", *[f"percent_outliers_{k}" for k in ("15iqr", "3iqr", "1_99", "3std")],
    *[f"has_outliers_{k}" for k in ("15iqr", "3iqr", "1_99", "3std")],
]


def _six(*names: str) -> list[str]:
    return [f"{n}_{s}" for n in names for s in SIX]


VECTOR = [
    *BASE_COLS, *_six(*LISTED, "correlation", "covariance", "sparsity", "anova_p_value"),
    "first_pca_std", "first_pca_skewness", "first_pca_kurtosis", *_six("entropy", "HBOS_mean", "HBOS_max", "HBOS_min"),
    *_six("IForest_n_leaves", "IForest_n_depth", "IForest_fi_mean", "IForest_fi_max"),
    *[f"pca_expl_ratio_{i}" for i in (1, 2, 3)], *[f"pca_sv_{i}" for i in (1, 2, 3)],
    *_six("LODA_n_hists_mean", "LODA_n_hists_max", "LODA_n_cuts_mean", "LODA_n_cuts_max"),
]


def meta_features(
    df: DataFrame, channels: Sequence[str], keys: Sequence[str] = KEYS, scale: bool = True, landmarkers: bool = True,
    trees: int = 100, cuts: int = 100, seed: int = 0,
) -> DataFrame:
    """The 200 named meta-features, one row per series; missing ones are 0."""
    df = df.select(*keys, "t", *channels)
    df = cut(minmax(df, channels, keys) if scale else df)
    long = melt(df, [*keys], channels)
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"))
    parts = [
        rows.withColumn("n_features", F.lit(len(channels))), cell_features(long, rows, keys),
        summarised(cut(channel_features(long, keys)), (*LISTED, "sparsity", "entropy"), keys),
        matrix_features(df, channels, keys), histogram_landmarks(long, keys),
    ]
    if landmarkers:
        parts += [forest_landmarks(df, channels, trees, keys, seed), projection_landmarks(df, channels, cuts, 10, keys, seed)]
    out = reduce(lambda a, b: a.join(b, list(keys), "left"), [cut(p) for p in parts])
    have = set(out.columns)
    return out.select(
        *keys, *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c) for c in VECTOR]
    )


def as_vector(meta: DataFrame, keys: Sequence[str] = KEYS, length: int = 200) -> DataFrame:
    """(keys, x): features as one array, padded with 0 or cut to ``length`` (AGG22)."""
    names = [c for c in meta.columns if c not in keys][:length]
    pad = [F.lit(0.0)] * (length - len(names))
    return meta.select(*keys, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names], *pad).alias("x"))


def weighted_corr(x: Column, y: Column, w: Column | None = None) -> Column:
    """Aggregate: Pearson correlation with weights, clamped to [-1, 1]."""
    w = F.lit(1.0) if w is None else w
    sw, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    cov = F.sum(w * x * y) / sw - sx / sw * (sy / sw)
    vx = F.sum(w * x * x) / sw - (sx / sw) * (sx / sw)
    vy = F.sum(w * y * y) / sw - (sy / sw) * (sy / sw)
    return F.least(F.greatest(F.try_divide(cov, F.sqrt(vx * vy)), F.lit(-1.0)), F.lit(1.0))


def row_correlations(long: DataFrame, row: str = "dataset", column: str = "model", value: str = "perf") -> DataFrame:
    """(a, b, r) for every pair of rows of a small matrix, joined on the column."""
    a = long.select(F.col(row).alias("a"), column, F.col(value).alias("x"))
    b = long.select(F.col(row).alias("b"), column, F.col(value).alias("y"))
    return a.join(b, column).groupBy("a", "b").agg(safe_corr("x", "y").alias("r"))
