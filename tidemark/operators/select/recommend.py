"""Detector recommenders (inventory SEL1-SEL15).

``perf`` is the long table (dataset, model, perf); ``meta`` has one row per dataset with a vector column ``x``.  Each recommender
returns (dataset, model, score) for the datasets of ``test``, so that ranking and its metrics are plain DataFrame operations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import FMRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.vectors import dot
from ...plans.attach import attach, sized
from ...plans.chunks import array_moments, unpack
from ...plans.ordered import cumulate, quantiles
from ...session import cut
from ..analytic import best_per_key, top_n
from ..joins import nearest_row

DS, MODEL = "dataset", "model"


# Tables


def vectors(meta: DataFrame, features: Sequence[str], key: str = DS) -> DataFrame:
    return meta.select(F.col(key).alias(DS), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))


def column_stats(meta: DataFrame) -> DataFrame:
    """(i, lo, hi, mu, sd, sd_pop) per vector element."""
    long = meta.select(F.posexplode("x").alias("i", "v"))
    return long.groupBy("i").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mu"), F.stddev_samp("v").alias("sd"),
        F.stddev_pop("v").alias("sd_pop"),
    )


def prepared(meta: DataFrame, train: DataFrame, method: str = "zscore") -> DataFrame:
    """Drop elements that are constant in ``train``; scale by its statistics (zscore, range).  The statistics are one array."""
    s = column_stats(train).filter("lo < hi").agg(
        F.sort_array(F.collect_list(F.struct("i", "lo", "hi", "mu", "sd"))).alias("s")
    ).withColumn("_one", F.lit(1))
    def scaled(v):
        if method == "zscore":
            return lambda r: (F.element_at(v, r["i"] + 1) - r["mu"]) / r["sd"]
        return lambda r: (F.element_at(v, r["i"] + 1) - r["lo"]) / (r["hi"] - r["lo"])

    out = attach(meta.withColumn("_one", F.lit(1)), s, ["_one"])
    return out.withColumn("x", F.transform("s", scaled(F.col("x")))).drop("s", "_one")


def vector_moments(meta: DataFrame):
    """(count, mean, covariance) of the vectors: an aggregate whose result is as wide as the vectors, read by the driver."""
    one = meta.select(F.lit(0).alias("k"), "x")
    return unpack(array_moments(one, "x", ["k"]).first()["m"])


def projected(meta: DataFrame, train: DataFrame, dims: int) -> DataFrame:
    """Leading principal coordinates learnt on ``train``."""
    _n, mean, cov = vector_moments(train)
    values, v = np.linalg.eigh(cov)
    v = v[:, np.argsort(values)[::-1][:dims]]
    big = np.abs(v).argmax(0)
    v = v * np.where(v[big, np.arange(v.shape[1])] < 0, -1.0, 1.0)
    axes = F.array(*[F.array(*[F.lit(float(c)) for c in v[:, j]]) for j in range(v.shape[1])])
    centre = F.array(*[F.lit(float(c)) for c in mean])
    moved = F.zip_with("x", centre, lambda a, b: a - b)
    return meta.withColumn("_c", moved).withColumn("x", F.transform(axes, lambda a: dot(a, F.col("_c")))).drop("_c")


# Simple recommenders


def global_best(perf: DataFrame, test: DataFrame, stat: str = "median") -> DataFrame:
    """Mean or median performance of each model, the same for every dataset."""
    if stat == "median":
        scores = quantiles(perf, [MODEL], "perf", {"score": 0.5})
    else:
        scores = perf.groupBy(MODEL).agg(F.avg("perf").alias("score"))
    return attach(test.select(DS).withColumn("_one", F.lit(1)), scores.withColumn("_one", F.lit(1)), ["_one"]).drop("_one")


def nearest_neighbour(perf: DataFrame, meta: DataFrame, test: DataFrame) -> DataFrame:
    """Performance on the nearest train dataset in z-scored feature space."""
    base = meta.join(perf.select(DS).distinct(), DS, "left_semi")
    near = nearest_row(prepared(test, base), prepared(base, base))
    return near.select(DS, F.col("nearest").alias("_n")).join(
        perf.select(F.col(DS).alias("_n"), MODEL, F.col("perf").alias("score")), "_n"
    ).drop("_n")


def _as_features(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector("x"))


def models_of(perf: DataFrame) -> list[str]:
    """Model names; tens of them by nature, read by the driver to loop over models."""
    return [r[MODEL] for r in perf.select(MODEL).distinct().orderBy(MODEL).collect()]


def _fit_columns(train: DataFrame, test: DataFrame, targets: dict[str, str], make: Callable) -> DataFrame:
    """One regressor per target column: (dataset, name, value) on ``test``."""
    a, b = cut(_as_features(train)), _as_features(cut(test.select(DS, "x")))

    def fit(item):
        name, column = item
        fitted = make().setFeaturesCol("features").setLabelCol(column).fit(a)
        return fitted.transform(b).select(DS, F.lit(name).alias("name"), F.col("prediction").alias("value"))

    # the fits are independent Spark jobs, a few of them run side by side
    with ThreadPool(min(8, len(targets))) as pool:
        parts = pool.map(inheritable_thread_target(a.sparkSession)(fit), list(targets.items()))
    return cut(reduce(DataFrame.unionByName, parts))


def _forest(trees: int = 100, depth: int = 5, seed: int = 0):
    return lambda: RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed)


def regression(perf: DataFrame, meta: DataFrame, test: DataFrame, trees: int = 50, seed: int = 0) -> DataFrame:
    """One random forest per model from the meta-features to its performance."""
    names = models_of(perf)
    wide = perf.groupBy(DS).pivot(MODEL, names).agg(F.first("perf"))
    alias = {n: f"y{i}" for i, n in enumerate(names)}
    base = prepared(meta, meta, "range").join(wide.select(DS, *[F.col(f"`{n}`").alias(a) for n, a in alias.items()]), DS)
    out = _fit_columns(base, prepared(test, meta, "range"), alias, _forest(trees, seed=seed))
    return out.select(DS, F.col("name").alias(MODEL), F.col("value").alias("score"))


def residuals(perf: DataFrame, predicted: DataFrame) -> DataFrame:
    """(dataset, model, residual) of a recommender on known datasets."""
    return perf.join(predicted, [DS, MODEL]).select(DS, MODEL, (F.col("perf") - F.col("score")).alias("residual"))


# Factor models


def truncated_svd(perf: DataFrame, factors: int):
    """Left factors per dataset as a DataFrame, and singular values with right factors (models x factors).

    The Gram matrix has one row and column per model; only that is read by the driver.
    """
    names = models_of(perf)
    k = min(factors, len(names))
    a = perf.select(DS, F.col(MODEL).alias("a"), F.col("perf").alias("u"))
    b = perf.select(DS, F.col(MODEL).alias("b"), F.col("perf").alias("v"))
    gram = a.join(b, DS).groupBy("a", "b").agg(F.sum(F.col("u") * F.col("v")).alias("g"))
    pos = {n: i for i, n in enumerate(names)}
    g = np.zeros((len(names), len(names)))
    for r in gram.collect():
        g[pos[r["a"]], pos[r["b"]]] = r["g"]
    values, v = np.linalg.eigh((g + g.T) / 2)
    order = np.argsort(values)[::-1][:k]
    s, v = np.sqrt(np.maximum(values[order], 0)), v[:, order]
    big = np.abs(v).argmax(0)
    v = v * np.where(v[big, np.arange(k)] < 0, -1.0, 1.0)
    spark = perf.sparkSession
    right = spark.createDataFrame(
        [(n, [float(x) for x in v[i]]) for n, i in pos.items()], f"{MODEL} string, v array<double>"
    )
    left = perf.join(F.broadcast(right), MODEL).groupBy(DS).agg(
        *[(F.sum(F.col("perf") * F.col("v")[j]) / F.lit(float(max(s[j], 1e-300)))).alias(f"u{j}") for j in range(k)]
    )
    return left, s, right


def factor_regression(
    perf: DataFrame, meta: DataFrame, test: DataFrame, factors: int = 5, trees: int = 50, seed: int = 0
) -> DataFrame:
    """Random forests predict the left factors; score = predicted factors * singular values * right factors."""
    left, s, right = truncated_svd(perf, factors)
    cols = {f"u{j}": f"u{j}" for j in range(len(s))}
    out = _fit_columns(prepared(meta, meta, "range").join(left, DS), prepared(test, meta, "range"), cols, _forest(trees, seed=seed))
    packed = out.groupBy(DS).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("name", "value"))), lambda r: r["value"]).alias("u")
    )
    weight = F.array(*[F.lit(float(x)) for x in s])
    scaled = packed.select(DS, F.zip_with("u", weight, lambda a, b: a * b).alias("u"), F.lit(1).alias("_one"))
    return attach(scaled, right.withColumn("_one", F.lit(1)), ["_one"]).select(DS, MODEL, dot(F.col("u"), F.col("v")).alias("score"))


def _neighbour_steps(own):
    """Extend a partial grid cell by the three cells around ``own``."""
    steps = F.array(own - 1, own, own + 1)
    return lambda done: F.transform(steps, lambda c: F.concat(done, F.array(c)))


def _near_reduce(table: DataFrame, eps: float, dims: int, carried: str, combine: Callable, out_type: str, block: int) -> DataFrame:
    """(u, v): ``combine`` over the ``carried`` values of all rows of ``table`` within eps of u, for every row u.

    Rows meet in grid cells of width eps; a full cell is split into blocks of both sides.  A task returns one value per row, so
    no pair is ever written, however many rows share a cell.
    """
    around = F.array(F.array().cast("array<bigint>"))
    for j in range(dims):
        around = F.flatten(F.transform(around, _neighbour_steps(F.col("cell")[j])))
    sent = table.select("u", "x", carried, F.explode(around).alias("cell"))
    own = table.select("u", "x", "cell")
    per = F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int")
    blocks = sized(sent.groupBy("cell").agg(per.alias("nb")).join(own.groupBy("cell").agg(per.alias("nq")), "cell"))
    left = own.join(blocks, "cell").withColumn("qb", F.pmod(F.xxhash64("u"), F.col("nq"))).withColumn(
        "bb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    right = sent.join(blocks, "cell").withColumn("bb", F.pmod(F.xxhash64("u"), F.col("nb")).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    left = left.select("cell", F.col("qb").cast("int").alias("qb"), "bb", "u", "x")
    right = right.select(*[F.col(c).alias(c) for c in ("cell", "qb", "bb", "x", carried)])

    def reduce_block(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"u": [], "v": []})
        a, b = np.stack(q["x"].to_numpy()).astype(float), np.stack(c["x"].to_numpy()).astype(float)
        d2 = np.zeros((len(a), len(b)))
        for j in range(a.shape[1]):
            d2 += (a[:, j, None] - b[None, :, j]) ** 2
        return combine(q["u"].to_numpy(), d2 <= eps * eps, c[carried].to_numpy())

    u_type = table.schema["u"].dataType.simpleString()
    return left.groupBy("cell", "qb", "bb").cogroup(right.groupBy("cell", "qb", "bb")).applyInPandas(
        reduce_block, f"u {u_type}, v {out_type}")


def _count_near(u, hit, m):
    return pd.DataFrame({"u": u, "v": hit @ m.astype(float)})


def _least_near(u, hit, label):
    best = np.where(hit, label.astype(float)[None], np.inf).min(1)
    ok = np.isfinite(best)
    return pd.DataFrame({"u": u[ok], "v": best[ok].astype(np.int64)})


def _spanning(u, hit, other):
    """Edges that keep the connections of a block: every row and every candidate to the smallest candidate of its component."""
    label = np.arange(len(other))
    while True:
        row = np.where(hit, label[None], len(other)).min(1)
        back = np.where(hit, row[:, None], len(other)).min(0)
        new = np.minimum(label, back)
        if (new == label).all():
            break
        label = new
    ok = row < len(other)
    one = pd.DataFrame({"u": u[ok], "v": other[row[ok]]})
    met = hit.any(0)
    return pd.concat([one, pd.DataFrame({"u": other[met], "v": other[label[met]]})]).drop_duplicates()


def dbscan(
    points: DataFrame, eps: float = 1.0, min_points: int = 5, id: str = DS, block: int = 4096
) -> DataFrame:
    """(id, cluster): density clusters, 0 is noise.  ``x`` is a short vector (a projection).

    Equal points are one row with a count.  Core points take the smallest label within eps, and the label of that label, until nothing
    changes; the labels are checkpointed each round.
    """
    p = points.select(F.col(id).alias("id"), "x")
    distinct = p.groupBy("x").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m"))
    # number the distinct points in the order of their smallest id
    order = distinct.withColumn("_o", F.struct("first")).withColumn("_all", F.lit(0))
    numbered = cumulate(order.select("_all", "first"), ["_all"], "first") if dict(p.dtypes)["id"] != "string" else None
    if numbered is None:
        numbered = _text_order(order)
    u = cut(distinct.join(numbered.select("first", F.col("cum_n").cast("long").alias("u")), "first").select(
        "u", "x", "m", F.transform("x", lambda v: F.floor(v / F.lit(eps))).alias("cell")))
    dims = u.select(F.size("x").alias("d")).first()
    if dims is None:
        return p.select(F.col("id").alias(id), F.lit(0).alias("cluster"))
    d = dims["d"]
    near = _near_reduce(u, eps, d, "m", _count_near, "double", block).groupBy("u").agg(F.sum("v").alias("n"))
    core = cut(u.join(near.filter(F.col("n") >= min_points).select("u"), "u").select("u", "x", "cell", F.col("u").alias("l")))
    some = _near_reduce(core, eps, d, "l", _spanning, "long", block).filter("u <> v")
    edges = cut(some.unionByName(some.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = core.select("u", "l")
    while True:
        best = edges.join(label.select(F.col("u").alias("v"), F.col("l").alias("lv")), "v").groupBy("u").agg(F.min("lv").alias("l2"))
        jump = label.select(F.col("u").alias("l2"), F.col("l").alias("l3"))
        least = F.least("l", "l2", F.coalesce("l3", "l2"))
        new = cut(label.join(best, "u", "left").withColumn("l2", F.coalesce("l2", "l")).join(jump, "l2", "left").select(
            "u", least.alias("l"), (least < F.col("l")).alias("moved")))
        label = new.drop("moved")
        if not new.agg(F.max("moved").alias("m")).first()["m"]:
            break
    core = cut(core.drop("l").join(label, "u"))
    # border points take the smallest label within eps; a core point already has it
    labelled = u.select("u", "x", "cell").join(core.select("u", F.col("l").alias("own")), "u", "left")
    final = cut(_border(labelled, eps, d, block))
    rank = cumulate(final.filter("l IS NOT NULL").select("l").distinct().withColumn("_all", F.lit(0)), ["_all"], "l")
    named = final.join(rank.select("l", F.col("cum_n").cast("int").alias("cluster")), "l", "left").select("u", "cluster")
    back = u.select("u", F.col("x").alias("_x")).join(named, "u")
    return p.join(back, F.col("x") == F.col("_x")).select(F.col("id").alias(id), F.coalesce("cluster", F.lit(0)).alias("cluster"))


def _border(labelled: DataFrame, eps: float, dims: int, block: int) -> DataFrame:
    """(u, l) for core points and the points near one; the others keep NULL."""
    both = labelled.select("u", "x", "cell", F.coalesce("own", F.lit(np.iinfo(np.int64).max >> 12)).cast("long").alias("l"))
    best = _near_reduce(both, eps, dims, "l", _least_near, "long", block).groupBy("u").agg(F.min("v").alias("v"))
    far = F.lit(np.iinfo(np.int64).max >> 12).cast("long")
    return labelled.select("u", "own").join(best, "u").select("u", F.coalesce("own", F.when(F.col("v") < far, F.col("v"))).alias("l"))


def _text_order(order: DataFrame) -> DataFrame:
    """Position of distinct text ids: numbered inside ranges that Spark balances by sampling, so common beginnings don't matter."""
    part = cut(order.select("first").repartitionByRange("first").withColumn("_r", F.spark_partition_id()))
    w = Window.partitionBy("_r").orderBy("first")
    counts = part.groupBy("_r").agg(F.count(F.lit(1)).alias("_k"))
    before = Window.partitionBy(F.lit(0)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    counts = counts.withColumn("_o", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    return part.withColumn("_i", F.row_number().over(w)).join(counts, "_r").select("first", (F.col("_i") + F.col("_o")).alias("cum_n"))


def model_coordinates(perf: DataFrame, dims: int = 2) -> DataFrame:
    """(model, x): principal coordinates of the models by their z-scored performance per dataset.

    Only the Gram matrix of the models (tens by tens) is read by the driver, whatever the number of datasets.
    """
    names = models_of(perf)
    stat = perf.groupBy(DS).agg(F.avg("perf").alias("_mu"), F.stddev_samp("perf").alias("_sd"))
    z = attach(perf, stat, [DS]).filter("_sd > 0").select(DS, MODEL, ((F.col("perf") - F.col("_mu")) / F.col("_sd")).alias("z"))
    a, b = z.select(DS, F.col(MODEL).alias("a"), F.col("z").alias("u")), z.select(DS, F.col(MODEL).alias("b"), F.col("z").alias("v"))
    gram = a.join(b, DS).groupBy("a", "b").agg(F.sum(F.col("u") * F.col("v")).alias("g"))
    pos, g = {n: i for i, n in enumerate(names)}, np.zeros((len(names), len(names)))
    for r in gram.collect():
        g[pos[r["a"]], pos[r["b"]]] = r["g"]
    values, v = np.linalg.eigh((g + g.T) / 2)
    top = np.argsort(values)[::-1][:dims]
    x = v[:, top] * np.sqrt(np.maximum(values[top], 0))
    rows = [(n, [float(c) for c in x[i]]) for n, i in pos.items()]
    return perf.sparkSession.createDataFrame(rows, f"{MODEL} string, x array<double>")


def clustered_factors(
    perf: DataFrame, meta: DataFrame, test: DataFrame, factors: int = 5, eps: float = 1.0, min_points: int = 3, trees: int = 50,
    seed: int = 0,
) -> DataFrame:
    """Clusters of models by their performance profile, a factor regression per cluster, and the scores together."""
    groups = cut(dbscan(model_coordinates(perf), eps, min_points, id=MODEL))
    numbers = [r["cluster"] for r in groups.select("cluster").distinct().orderBy("cluster").collect()]
    out = None
    for c in numbers:
        some = perf.join(groups.filter(F.col("cluster") == c).select(MODEL), MODEL, "left_semi")
        part = factor_regression(some, meta, test, factors, trees, seed)
        out = part if out is None else out.unionByName(part)
    return out


def cluster_routed(
    perf: DataFrame, meta: DataFrame, test: DataFrame, eps: float = 1.0, min_points: int = 5, more_than: int = 10,
    factors: int = 5, trees: int = 50, seed: int = 0,
) -> DataFrame:
    """Project train and test features together and cluster them.  A test dataset in a cluster with more than ``more_than`` train
    datasets is served by the clustered factor model, the others by a factor regression with two factors."""
    both = meta.select(DS, "x").withColumn("type", F.lit("train")).unionByName(test.select(DS, "x").withColumn("type", F.lit("test")))
    both = both.withColumn("_k", F.concat_ws("|", "type", DS))
    ready = prepared(both, both)
    flat = projected(ready, ready, 2).select(F.col("_k"), "x")
    c = dbscan(flat, eps, min_points, id="_k").join(both.select("_k", "type", DS), "_k")
    size = c.filter("type = 'train'").groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    routed = cut(c.filter("type = 'test'").join(size, "cluster", "left").select(
        DS, (F.coalesce("_n", F.lit(0)) > more_than).alias("dense")))
    a = clustered_factors(perf, meta, test.join(routed.filter("dense").select(DS), DS, "left_semi"), factors, trees=trees, seed=seed)
    b = factor_regression(perf, meta, test.join(routed.filter("NOT dense").select(DS), DS, "left_semi"), 2, trees, seed)
    return a.unionByName(b)


def rank_factorisation(
    perf: DataFrame, meta: DataFrame, test: DataFrame, factors: int = 3, epochs: int = 10, low: float = 0.001, high: float = 0.05,
    trees: int = 50, seed: int = 0, patience: int = 5, valid_share: float = 0.15,
) -> DataFrame:
    """Dataset and model factors that maximise a smoothed ranking gain; forests then predict the dataset factors.

    One epoch computes the pairwise gradients of all datasets in one pass: the model factors (few) go to every task, dataset factors
    stay on their rows, and the gradients of the model factors are summed by Spark.
    """
    split = cut(meta.select(DS, "x").withColumn("_v", F.pmod(F.xxhash64(F.lit(seed), F.col(DS)), F.lit(1000)) < int(valid_share * 1000)))
    base = prepared(split, split)
    init = projected(base, base, factors)
    stats = column_stats(init).orderBy("i").select("mu", "sd_pop").collect()
    mu, sd = [r["mu"] for r in stats], [r["sd_pop"] or 1.0 for r in stats]
    unit = F.zip_with(F.zip_with("x", F.array(*[F.lit(m) for m in mu]), lambda a, b: a - b), F.array(*[F.lit(s) for s in sd]), lambda a, b: a / b)
    names = models_of(perf)
    order = {n: i for i, n in enumerate(names)}
    profile = perf.groupBy(DS).agg(F.sort_array(F.collect_list(F.struct(MODEL, "perf"))).alias("p"))
    rows = cut(init.select(DS, "_v", unit.alias("u")).join(profile, DS).select(
        DS, "_v", "u", F.transform("p", lambda s: s["perf"]).alias("r")))
    rng = np.random.default_rng(seed)
    v = rng.normal(scale=0.1, size=(len(order), factors))
    best, flat = -math.inf, 0

    def epoch(items: np.ndarray, rate: float):
        def run(batches):
            for pdf in batches:
                grads, us, gains = np.zeros_like(items), [], []
                for u, r, valid in zip(pdf["u"], pdf["r"], pdf["_v"], strict=True):
                    u, r = np.asarray(u), np.asarray(r)
                    s = items @ u
                    sig = 1 / (1 + np.exp(-(s[None, :] - s[:, None])))
                    if not valid:
                        phi = sig.sum(1) + 1.0  # the own term is one half, 1.5 in total
                        gain = (10.0**r - 1) / (phi * np.log(phi) ** 2)
                        slope = gain[:, None] * sig * (1 - sig)
                        pull = slope.sum(1)[:, None] * items - slope @ items
                        push = slope.sum(1) - slope.sum(0)
                        grads += push[:, None] * u
                        u = u + rate * pull.sum(0)
                    us.append(u.tolist())
                    top = np.argsort(-s, kind="stable")
                    disc = 1 / np.log2(np.arange(len(r)) + 2)
                    ideal = (np.sort(r)[::-1] * disc).sum()
                    gains.append(float((r[top] * disc).sum() / ideal) if ideal > 0 else 0.0)
                pdf = pdf.assign(u=us, ndcg=gains, g=None)
                pdf["g"] = [grads.ravel().tolist()] + [None] * (len(pdf) - 1)
                yield pdf[[DS, "_v", "u", "r", "ndcg", "g"]]

        kind = rows.schema[DS].dataType.simpleString()
        return cut(rows.mapInPandas(run, f"{DS} {kind}, _v boolean, u array<double>, r array<double>, ndcg double, g array<double>"))

    for e in range(epochs):
        # triangular learning rate: up and down in 8 steps
        rate = low + (high - low) * (1 - abs((e % 8) / 4 - 1))
        done = epoch(v, rate)
        g = done.filter("g IS NOT NULL").select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i")
        v = v + rate * np.array([r["x"] for r in g.collect()]).reshape(v.shape)  # models x factors values
        rows = done.select(DS, "_v", "u", "r")
        gain = done.agg(F.avg(F.when(F.col("_v"), F.col("ndcg"))).alias("v"), F.avg("ndcg").alias("a")).first()
        now = gain["v"] if gain["v"] is not None else gain["a"]
        flat = flat + 1 if best > 0 and (now - best) / best <= 0.001 else 0
        best = max(best, now)
        if flat >= patience:
            break
    cols = {f"f{j}": f"f{j}" for j in range(factors)}
    train = base.select(DS, "x").join(rows.select(DS, *[F.col("u")[j].alias(f"f{j}") for j in range(factors)]), DS)
    out = _fit_columns(train, prepared(test, split), cols, _forest(trees, 10, seed))
    packed = out.groupBy(DS).agg(F.transform(F.sort_array(F.collect_list(F.struct("name", "value"))), lambda r: r["value"]).alias("u"))
    items = perf.sparkSession.createDataFrame([(n, v[i].tolist()) for n, i in order.items()], f"{MODEL} string, v array<double>")
    return attach(packed.withColumn("_one", F.lit(1)), items.withColumn("_one", F.lit(1)), ["_one"]).select(
        DS, MODEL, dot(F.col("u"), F.col("v")).alias("score"))


def factorisation_machine(
    perf: DataFrame, meta: DataFrame, test: DataFrame, factors: int = 4, steps: int = 30, rate: float = 0.05, seed: int = 0
) -> DataFrame:
    """One factorisation machine per model on 0-1 scaled features (squared loss)."""
    names = models_of(perf)
    wide = perf.groupBy(DS).pivot(MODEL, names).agg(F.first("perf"))
    alias = {n: f"y{i}" for i, n in enumerate(names)}
    base = prepared(meta, meta, "range").join(wide.select(DS, *[F.col(f"`{n}`").alias(a) for n, a in alias.items()]), DS)

    def make():
        return FMRegressor(factorSize=factors, maxIter=steps, stepSize=rate, seed=seed)

    out = _fit_columns(base, prepared(test, meta, "range"), alias, make)
    return out.select(DS, F.col("name").alias(MODEL), F.col("value").alias("score"))


def fm_score(x: str, bias: str, linear: str, cross: str):
    """Machine output from given weights: b + w.x + half of sum_k ((v_k.x)^2 - (v_k^2).(x^2)); ``cross`` is a list of k vectors."""
    xc = F.col(x)
    pair = F.aggregate(
        F.transform(cross, lambda v: F.pow(dot(v, xc), F.lit(2.0)) - F.aggregate(
            F.zip_with(v, xc, lambda a, b: a * a * b * b), F.lit(0.0), lambda s, t: s + t)),
        F.lit(0.0), lambda s, t: s + t,
    )
    return F.col(bias) + dot(F.col(linear), xc) + pair / 2


def top_models(scores: DataFrame, n: int = 3) -> DataFrame:
    return top_n(scores, [DS], "score", n, [MODEL])


def best_model(scores: DataFrame) -> DataFrame:
    return best_per_key(scores, [DS], MODEL, "score")


# Resampling


def _positions(df: DataFrame, seed: int, part: Sequence[str] = ()) -> DataFrame:
    """Hash order of the datasets inside ``part``: position ``_p`` (from 0) and group size ``_n``."""
    keys = list(part) or ["_all"]
    df = df if part else df.withColumn("_all", F.lit(0))
    df = df.withColumn("_h", F.xxhash64(F.lit(seed), *[F.col(c) for c in part], F.col(DS)))
    c = cumulate(df, keys, "_h").select(*keys, "_h", (F.col("cum_n") - 1).alias("_p"), F.col("tot_n").alias("_n"))
    return df.join(c, [*keys, "_h"]).drop("_h", "_all")


def random_split(datasets: DataFrame, share: float = 0.75, seed: int = 0) -> DataFrame:
    """Column ``split``: the first floor(share * n) datasets in hash order are train."""
    d = _positions(datasets.select(DS).distinct(), seed)
    return d.select(DS, F.when(F.col("_p") < F.floor(F.col("_n") * share), "train").otherwise("test").alias("split"))


def provider(c: str = DS):
    return F.split(c, "-")[0]


def leave_one_out(datasets: DataFrame, group=None) -> DataFrame:
    """(fold, dataset, split): every provider is the test side once."""
    group = provider() if group is None else group
    d = datasets.select(DS).distinct().withColumn("_g", group)
    folds = d.select(F.col("_g").alias("fold")).distinct().withColumn("_one", F.lit(1))
    both = attach(d.withColumn("_one", F.lit(1)), folds, ["_one"])
    return both.select("fold", DS, F.when(F.col("fold") == F.col("_g"), "test").otherwise("train").alias("split"))


def k_fold(datasets: DataFrame, k: int = 10, repeats: int = 3, seed: int = 0, strata=None) -> DataFrame:
    """(repeat, fold, dataset, split): stratified folds, every repeat in another hash order."""
    strata = provider() if strata is None else strata
    d = datasets.select(DS).distinct().withColumn("_s", strata).withColumn(
        "repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    )
    own = _positions(d, seed, ["repeat", "_s"]).withColumn("_f", F.pmod(F.col("_p") + F.pmod(F.hash("_s"), F.lit(k)), F.lit(k)))
    return own.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(
        "repeat", "fold", DS, F.when(F.col("fold") == F.col("_f"), "test").otherwise("train").alias("split")
    )


def monte_carlo(datasets: DataFrame, share: float = 0.75, repeats: int = 25, seed: int = 0) -> DataFrame:
    """(repeat, dataset, split): independent random splits."""
    d = datasets.select(DS).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    d = _positions(d, seed, ["repeat"])
    return d.select("repeat", DS, F.when(F.col("_p") < F.floor(F.col("_n") * share), "train").otherwise("test").alias("split"))


# Dispatch

RECOMMENDERS: dict[str, Callable] = {
    "global_best": lambda perf, meta, test, **kw: global_best(perf, test, **kw),
    "nearest_neighbour": nearest_neighbour, "regression": regression, "factor_regression": factor_regression,
    "clustered_factors": clustered_factors, "cluster_routed": cluster_routed, "rank_factorisation": rank_factorisation,
    "factorisation_machine": factorisation_machine,
}


def register_recommender(name: str, fn: Callable) -> None:
    """Add ``fn(perf, meta, test, **kw) -> (dataset, model, score)``."""
    RECOMMENDERS[name] = fn


def recommend(name: str, perf: DataFrame, meta: DataFrame, test: DataFrame, **kw) -> DataFrame:
    if name not in RECOMMENDERS:
        raise ValueError(f"unknown recommender {name}")
    return RECOMMENDERS[name](perf, meta, test, **kw)


def analyse_split(name: str, perf: DataFrame, meta: DataFrame, split: DataFrame, **kw) -> DataFrame:
    """Fit on the train side, recommend and grade on the test side; tagged with provider and recommender."""
    from .quality import percentile_of

    train, test = (split.filter(F.col("split") == s).select(DS) for s in ("train", "test"))
    scores = recommend(name, perf.join(train, DS, "left_semi"), meta.join(train, DS, "left_semi"), meta.join(test, DS, "left_semi"), **kw)
    graded = percentile_of(perf, best_model(scores).select(DS, MODEL))
    return graded.withColumn("provider", provider()).withColumn("recommender", F.lit(name))


def spread(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """Predictions wide, one column per model."""
    return scores.groupBy(DS).pivot(MODEL, list(models)).agg(F.first("score"))


def measured(fn: Callable[[], DataFrame]) -> DataFrame:
    """Run a recommendation and add its run time in seconds."""
    import time

    t0 = time.time()
    out = cut(fn())
    return out.withColumn("runtime", F.lit(time.time() - t0))

