"""Detectors against numpy, and independence from the chunk size."""

import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import distance as ds
from tidemark.operators import registry
from tidemark.operators.detect import base as bd
from tidemark.operators.detect import cluster, density, forecast, forest, linear, neighbours, reconstruct
from tidemark.plans.chunks import row_moments, unpack


def vectors(spark, x, series="a"):
    return spark.createDataFrame([(series, i, [float(c) for c in v]) for i, v in enumerate(x)], "series_id string, t int, x array<double>")


def wide(spark, x, series="a"):
    cols = [f"c{j + 1}" for j in range(x.shape[1])]
    pdf = pd.DataFrame(x, columns=cols)
    pdf.insert(0, "t", np.arange(len(x)))
    pdf.insert(0, "series_id", series)
    return spark.createDataFrame(pdf), cols


def scores(df):
    return df.toPandas().sort_values(["series_id", "t"])["score"].to_numpy()


def brute_knn(x, k, p=2):
    d = (np.abs(x[:, None] - x[None]) ** p).sum(-1) ** (1 / p)
    np.fill_diagonal(d, np.inf)
    return np.sort(d, 1)[:, :k]


@pytest.mark.parametrize("plan", [{}, {"rows_per_pivot": 12, "query_block": 9, "base_block": 11}, {"rows_per_pivot": 40, "query_block": 4, "base_block": 3, "block_rows": 6}])
def test_knn_with_copies_and_cells(spark, plan):
    rng = np.random.default_rng(0)
    # a third of the rows are copies of one vector
    x = np.concatenate([rng.normal(size=(80, 3)), np.repeat([[0.1, 0.2, 0.3]], 45, 0), rng.normal(size=(20, 3)) + 6])
    near = brute_knn(x, 5)
    df = vectors(spark, x)
    for method, want in (("largest", near[:, -1]), ("mean", near.mean(1)), ("median", np.median(near, 1))):
        assert np.allclose(scores(neighbours.knn_score(df, 5, method, **plan)), want)


@pytest.mark.parametrize("plan", [{}, {"rows_per_pivot": 10, "query_block": 8, "base_block": 16}, {"rows_per_pivot": 30, "base_block": 7, "block_rows": 5}])
def test_knn_of_new_rows_and_several_series(spark, plan):
    rng = np.random.default_rng(1)
    a, b, q = rng.normal(size=(60, 2)), rng.normal(size=(30, 2)) * 4, rng.normal(size=(25, 2)) * 2
    base = vectors(spark, a).union(vectors(spark, b, "b"))
    query = vectors(spark, q).union(vectors(spark, q, "b"))
    got = scores(neighbours.knn_score(query, 3, train=base, **plan))
    want = [np.sort(np.sqrt(((q[:, None] - s[None]) ** 2).sum(-1)), 1)[:, 2] for s in (a, b)]
    assert np.allclose(got, np.concatenate(want))


def test_neighbours_of_clustered_vectors_grow_about_linearly(spark, monkeypatch):
    moved = {}
    plain = neighbours._block_pairs

    def counted(q, sent, *args):
        pairs = plain(q, sent, *args)
        by = lambda df, n: df.groupBy("cell", F.col("blk").alias(n)).agg(F.count("*").alias(f"n_{n}"))
        both = pairs.join(by(q, "qb"), ["cell", "qb"]).join(by(sent, "bb"), ["cell", "bb"])
        moved["rows"] = both.agg(F.sum(F.col("n_qb") * F.col("nb") + F.col("n_bb") * F.col("nq"))).first()[0] or 0
        moved["pairs"] = both.agg(F.sum(F.col("n_qb") * F.col("n_bb"))).first()[0] or 0
        return pairs

    monkeypatch.setattr(neighbours, "_block_pairs", counted)
    rng = np.random.default_rng(9)
    centres = rng.uniform(-100, 100, (24, 3))
    seen = []
    for n in (1500, 6000):
        x = centres[rng.integers(0, 24, n)] + rng.normal(size=(n, 3)) * 0.5
        out = neighbours.knn_score(vectors(spark, x), 3, rows_per_pivot=400, base_block=100, block_rows=8)
        if n == 1500:
            assert np.allclose(scores(out), brute_knn(x, 3)[:, -1])
        seen.append(dict(moved))
    assert 0 < seen[0]["rows"] and 0 < seen[1]["rows"] < 8 * seen[0]["rows"], seen  # all pairs of blocks would make 16 times as many
    assert seen[1]["pairs"] < 6000**2 / 4


def test_vectors_without_near_cells_are_not_copied_to_every_cell(spark, monkeypatch):
    placed, plain = [], neighbours._in_blocks

    def counted(rows, *args):
        placed.append(rows.count())
        return plain(rows, *args)

    monkeypatch.setattr(neighbours, "_in_blocks", counted)
    x = np.random.default_rng(4).normal(size=(500, 24))
    got = scores(neighbours.knn_score(vectors(spark, x), 3, rows_per_pivot=50, query_block=20, base_block=40, block_rows=50))
    assert np.allclose(got, brute_knn(x, 3)[:, -1])
    assert placed == [500, 500]  # queries and candidates; ten cells would need nearly all candidates each


@pytest.mark.parametrize("p", [1, 2])
def test_nearest_rows_are_those_of_all_distances(monkeypatch, p):
    monkeypatch.setattr(neighbours, "ROW_TILE", 16)
    monkeypatch.setattr(neighbours, "COLUMN_TILE", 50)
    rng = np.random.default_rng(5)
    far = np.full((1, 4), 1e12)
    cases = [
        (rng.normal(size=(40, 8)), rng.normal(size=(333, 8))), (rng.integers(0, 2, (40, 3)) * 1.0, rng.integers(0, 2, (333, 3)) * 1.0),
        (1e8 + rng.normal(size=(40, 4)), 1e8 + rng.normal(size=(333, 4))), (np.r_[rng.normal(size=(39, 4)), far], np.r_[rng.normal(size=(300, 4)) * 1e-6, far, far]),
    ]
    for u, v in cases:
        d = neighbours._gaps(u, v, p)
        order = np.argsort(d, axis=1, kind="stable")
        for k in (1, 5, 31, 400):
            got_d, got = neighbours._nearest_rows(u, v, k, p)
            assert np.array_equal(got, order[:, :k]) and np.array_equal(got_d, np.take_along_axis(d, got, 1))


def test_products_are_looked_through_in_small_tiles():
    rng = np.random.default_rng(6)
    u, v = rng.normal(size=(1024, 8)), rng.normal(size=(40_000, 8))
    tracemalloc.start()
    got_d, got = neighbours._nearest_rows(u, v, 5, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = neighbours._gaps(u[:50], v, 2)
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert np.array_equal(got[:50], want) and np.array_equal(got_d[:50], np.take_along_axis(d, want, 1))
    assert peak < 32 << 20, peak  # one product of 1,024 by 8,192 and its ranking were 64 MB


@pytest.mark.parametrize("shape", [(1, 1), (3, 7), (300, 1030), (257, 2049), (0, 5)])
def test_few_products_within_a_bound(shape):
    rng = np.random.default_rng(8)
    left, right = rng.normal(size=(shape[0], 3)).astype(np.float32), rng.normal(size=(shape[1], 3)).astype(np.float32)
    most = rng.normal(size=shape[0]).astype(np.float32) - 2
    most[::5] = np.finfo(np.float32).max
    product = left.astype(float) @ right.T.astype(float)
    sure = np.abs(product - most[:, None]) > 1e-4
    got = np.zeros(shape, bool)
    got.reshape(-1)[neighbours._within(left, right, most)] = True
    assert np.array_equal(got[sure], (product <= most[:, None])[sure])


@pytest.mark.parametrize("p", [1, 2])
def test_distances_to_pivots_are_measured_by_columns(spark, monkeypatch, p):
    monkeypatch.setattr(neighbours, "BASE_BLOCK", 40)  # several tasks for a key
    rng = np.random.default_rng(3)
    x, pv = rng.normal(size=(150, 6)), rng.normal(size=(9, 6))
    x[0, 0], x[1, 1], pv[2, 3] = np.nan, np.inf, np.nan
    rows = vectors(spark, x).withColumnRenamed("t", "vid").withColumn("m", F.lit(1)).unionByName(
        spark.createDataFrame([("a", 150, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1)], "series_id string, vid int, x array<double>, m int"))
    pivots = spark.createDataFrame([("a", pv.tolist())], "series_id string, pv array<array<double>>")
    out = neighbours._assigned(rows, pivots, ["series_id"], "x", p)
    assert "transform(" not in out._jdf.queryExecution().toString()  # one interpreted step of the JVM for each number
    got = out.orderBy("vid").collect()
    assert [r["vid"] for r in got] == list(range(151)) and got[150]["pd"] is None and got[150]["cell"] is None and got[150]["x"][1] is None
    d = neighbours._gaps(x, pv, p)
    assert np.array_equal(np.array([r["pd"] for r in got[:150]]), d, equal_nan=True)
    assert [r["cell"] for r in got[:2]] == [0, 0]  # no number, and infinite but for pivot 2
    assert [r["cell"] for r in got[2:150]] == np.nanargmin(d[2:], axis=1).tolist()


def test_missing_vectors_are_no_neighbours(spark):
    x = np.random.default_rng(5).normal(size=(60, 2))
    df = vectors(spark, x).unionByName(spark.createDataFrame([("a", 60 + i, None) for i in range(3)], "series_id string, t int, x array<double>"))
    assert np.allclose(scores(neighbours.knn_score(df, 3, rows_per_pivot=1)), brute_knn(x, 3)[:, -1])


def test_manhattan_neighbours_are_first_bounded_in_steps_of_a_byte(monkeypatch):
    rough = []
    monkeypatch.setattr(neighbours, "_rough", lambda *a, old=neighbours._rough: rough.append(1) or old(*a))
    monkeypatch.setattr(neighbours, "COLUMN_TILE", 4500)
    rng = np.random.default_rng(6)
    plain, wide = rng.normal(size=(9001, 64)), rng.normal(size=(400, 1030))
    tails = plain * np.exp(3 * rng.normal(size=(9001, 1)))
    tails[5] = 1e15
    groups = np.repeat(rng.normal(size=(30, 21)), 100, axis=0) + 1e-7 * rng.normal(size=(3000, 21))
    ties = rng.integers(0, 3, (3001, 7)) * 0.1
    for x, loose in ((plain, False), (tails, None), (groups, None), (ties, None), (wide, True), (np.ones((1600, 5)), True)):
        rough.clear()
        u = x[:70]
        d = neighbours._gaps(u, x, 1)
        order = np.argsort(d, axis=1, kind="stable")[:, :5]
        got_d, got = neighbours._nearest_rows(u, x, 5, 1)
        assert np.array_equal(got, order) and np.array_equal(got_d, np.take_along_axis(d, order, 1))
        assert loose is None or bool(rough) == loose


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 4), (70, 2049, 9), (65, 4100, 64)])
def test_sums_of_steps(shape):
    n, m, dims = shape
    rng = np.random.default_rng(7)
    left, right = rng.integers(0, neighbours.LEVELS, (dims, n)).astype(np.int8), rng.integers(0, neighbours.LEVELS, (dims, m)).astype(np.int8)
    assert np.array_equal(neighbours._step_sums(left, right), sum(np.abs(a[:, None].astype(int) - b) for a, b in zip(left, right, strict=True)))
    high, low = np.full((dims, n), neighbours.LEVELS - 1, np.int8), np.zeros((dims, m), np.int8)
    assert (neighbours._step_sums(high, low) == (neighbours.LEVELS - 1) * dims).all()


@pytest.mark.parametrize("p", [1, 2])
def test_lof(spark, p):
    rng = np.random.default_rng(2)
    x, k = rng.normal(size=(70, 3)), 6
    d = (np.abs(x[:, None] - x[None]) ** p).sum(-1) ** (1 / p)
    np.fill_diagonal(d, np.inf)
    nb = np.argsort(d, 1)[:, :k]
    kd = np.sort(d, 1)[:, k - 1]
    lrd = 1 / (np.maximum(np.take_along_axis(d, nb, 1), kd[nb]).mean(1) + 1e-10)
    got = scores(neighbours.lof_score(vectors(spark, x), k, p=p, rows_per_pivot=15, query_block=10, base_block=20))
    assert np.allclose(got, lrd[nb].mean(1) / lrd)


@pytest.mark.parametrize("per_range", [6, 100_000])
def test_copod(spark, per_range):
    rng = np.random.default_rng(3)
    x = np.round(rng.gamma(2.0, size=(60, 3)), 1)
    total = np.zeros(60)
    for j in range(3):
        v = x[:, j]
        left = -np.log([(v <= a).mean() for a in v])
        right = -np.log([(v >= a).mean() for a in v])
        skew = ((v - v.mean()) ** 3).mean()
        side = right if skew > 0 else left
        total += np.maximum(side, (left + right) / 2)
    assert np.allclose(scores(density.copod(vectors(spark, x), per_range=per_range)), total)


def test_hbos_lookup_is_right_closed_and_tolerant(spark):
    x = np.array([[0.0], [0.1], [0.2], [0.5], [1.0], [1.0]])
    model = density.hbos_fit(vectors(spark, x), 5)
    counts = np.histogram(x[:, 0], 5)[0]
    logd = np.log2(counts / (6 * 0.2) + 0.1)
    probe = np.array([[0.0], [0.2], [0.2000001], [1.05], [1.2], [-0.05], [-3.0]])
    got = scores(density.hbos_score(vectors(spark, probe), model))
    # 0.2 is the right end of the first bin; far outside takes the smallest density
    assert np.allclose(got, -np.array([logd[0], logd[0], logd[1], logd[4], logd.min(), logd[0], logd.min()]))


def test_cblof_separation_rule():
    assert sorted(cluster.separate([90, 5, 5], 0.9, 5)) == [0]
    assert sorted(cluster.separate([50, 45, 5], 0.9, 5)) == [0, 1]
    assert sorted(cluster.separate([40, 30, 30], 0.6, 5)) == [0, 1]
    with pytest.raises(ValueError):
        cluster.separate([10, 10], 0.9, 5)


def test_kmeans_finds_planted_groups_whatever_the_chunks(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(100, 2)) * 0.05 + c for c in ([0, 0], [5, 5], [0, 9])])
    x = x[rng.permutation(len(x))]
    df, cols = wide(spark, x)
    a = cluster.kmeans_fit(df, cols, 3, 1, normalise=False).collect()[0]
    b = cluster.kmeans_fit(df, cols, 3, 1, normalise=False, size=37).collect()[0]
    centres = np.sort(np.asarray(a["centres"]).reshape(3, 2), axis=0)
    assert np.allclose(centres, np.sort([[0, 0], [5, 5], [0, 9]], axis=0), atol=0.1)
    assert np.allclose(a["centres"], b["centres"])
    assert sorted(a["sizes"]) == [100, 100, 100]


@pytest.mark.parametrize("oblique", [False, True])
def test_forests_rank_a_planted_outlier_first(spark, oblique):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    x[123] = 9.0
    df, cols = wide(spark, x)
    prep = lambda w: cluster.window_rows(w, False)
    out = []
    for size in (None, 61):
        f = forest.forest_fit(df, cols, 1, 25, oblique=oblique, size=size, prep=prep)
        out.append(scores(forest.forest_score(df, cols, f, 1, size=size, prep=prep)))
    assert out[0].argmax() == 123
    assert np.allclose(out[0], out[1])
    assert ((out[0] > 0) & (out[0] <= 1)).all()


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 3)) @ rng.normal(size=(3, 3))
    df, cols = wide(spark, x)
    got = scores(linear.pca_score(df, cols, 1, 2, size=25))
    z = (x - x.mean(0)) / x.std(0)
    w, v = np.linalg.eigh(z.T @ z / len(z))
    w, v = w[::-1], linear.signed(v[:, ::-1])
    want = sum(np.sqrt(((z - v[:, j]) ** 2).sum(1)) / (w[j] / w.sum()) for j in range(2))
    assert np.allclose(got, want)
    n, mean, cov = unpack(row_moments(df, cols).collect()[0]["m"])
    assert n == 90 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, ddof=0))


def test_robust_pca_splits_low_rank_and_sparse(spark):
    rng = np.random.default_rng(7)
    low = rng.normal(size=(120, 1)) @ rng.normal(size=(1, 5))
    x = low.copy()
    x[40, 2] += 10
    df, cols = wide(spark, x)
    got = scores(linear.robust_pca(df, cols, max_iter=4, size=50))
    assert got.argmax() == 40
    assert np.allclose(got, scores(linear.robust_pca(df, cols, max_iter=4)))  # in one task
    done = scores(linear.robust_pca(df, cols))  # until it converges
    assert done.argmax() == 40 and abs(done[40] - 10) < 0.5 and np.median(done) < 0.5


def test_registered_robust_pca_scores_the_low_rank_part_without_zero_channels(spark):
    rng = np.random.default_rng(24)
    x = rng.normal(size=(120, 1)) @ rng.normal(size=(1, 3)) + 2 + rng.normal(size=(120, 3)) * 0.1
    x[40, 2] += 10
    df, cols = wide(spark, np.insert(x, 1, 0.0, axis=1))
    low, _sparse = linear._pursuit(x, 1000, 1e-7)
    _u, _s, axes = np.linalg.svd(low - low.mean(0), full_matrices=False)
    axes *= np.sign(axes[np.arange(3), np.abs(axes).argmax(1)])[:, None]
    expected = np.abs(low - (low - low.mean(0)) @ axes.T).sum(1)
    assert np.allclose(scores(registry.detect("RobustPCA", df, cols)), expected, atol=1e-4)
    empty, cols = wide(spark, np.zeros((5, 2)), "z")
    both = df.unionByName(empty, allowMissingColumns=True).na.fill(0.0)
    out = registry.detect("RobustPCA", both, ["c1", "c2", "c3", "c4"]).collect()
    assert sum(r.score is None for r in out) == 5 and len(out) == 125


def test_mcd_ignores_a_contaminated_third(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2))
    x[:90] += 12
    df, cols = wide(spark, x)
    prep = lambda w: cluster.window_rows(w, False)
    m = linear.mcd_fit(df, cols, prep=prep, size=70).collect()[0]
    assert np.allclose(m["mean"], 0, atol=0.25)
    assert math.isclose(linear.chi2_quantile(0.975, 2), 7.38, abs_tol=0.1)


def test_ocsvm_ranks_far_points_high(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 4))
    df, cols = wide(spark, np.vstack([x, [[5, -5, 5, -5]]]))
    got = scores(linear.ocsvm_score(df, cols, steps=2))
    assert np.isfinite(got).all() and len(got) == 201


def test_mcd_steps_end_where_the_determinant_stops_falling(spark):
    rng = np.random.default_rng(21)
    x = rng.standard_t(3, size=(3000, 3)) * [1, 20, 300] + [0, 500, 0]
    x[::3] += [6, 0, -900]
    df, cols = wide(spark, x)
    prep = lambda w: cluster.window_rows(w, False)
    short, long = (linear.mcd_fit(df, cols, prep=prep, size=n).collect()[0] for n in (None, 700))

    def distance(mean, cov):
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    rows, before = np.argsort(distance(np.array(long["mean"]), np.linalg.inv(np.reshape(long["inv"], (3, 3)))))[:1502], None
    while before is None or (np.sort(rows) != np.sort(before)).any():
        before, mean, cov = rows, x[rows].mean(0), np.cov(x[rows].T, ddof=0)
        rows = np.argsort(distance(mean, cov))[:1502]
    d = distance(mean, cov)
    kept = x[d <= np.median(d) / linear.chi2_quantile(0.5, 3) * linear.chi2_quantile(0.975, 3)]
    for m in (short, long):
        assert np.allclose(m["mean"], kept.mean(0), rtol=1e-9, atol=1e-9)
        assert np.allclose(np.linalg.inv(np.reshape(m["inv"], (3, 3))), np.cov(kept.T, ddof=0), rtol=1e-6)
        assert m["done"] and m["fall"] <= linear.FALL


def test_ocsvm_steps_end_at_the_smallest_objective(spark):
    rng = np.random.default_rng(22)
    x = np.sin(np.arange(700) / 5) + rng.normal(size=700) * 0.3
    df, cols = wide(spark, x[:, None])
    short, long = (scores(linear.ocsvm_score(df, cols, 6, "linear", nu=0.1, size=n)) for n in (None, 150))
    assert np.allclose(short, long, atol=1e-4)
    v = np.lib.stride_tricks.sliding_window_view(x, 6)
    v = (v - v.min(1, keepdims=True)) / (v.max(1, keepdims=True) - v.min(1, keepdims=True))

    def objective(w, rho):
        return w @ w / 2 - rho + np.maximum(rho - v @ w, 0).mean() / 0.1

    for got in (short, long):
        model = np.linalg.lstsq(np.column_stack([-v, np.ones(len(v))]), got[3:3 + len(v)], rcond=None)[0]
        least = objective(model[:-1], model[-1])
        moves = rng.normal(size=(3000, 7)) * 10.0 ** rng.uniform(-4, -1, size=(3000, 1))
        assert min(objective(model[:-1] + m[:-1], model[-1] + m[-1]) for m in moves) >= least - 1e-5 * abs(least)


def test_unfinished_fits_are_flagged(spark):
    rng = np.random.default_rng(23)
    df, cols = wide(spark, rng.normal(size=(300, 3)))
    prep = lambda w: cluster.window_rows(w, False)
    for size in (None, 100):
        with pytest.warns(RuntimeWarning, match="1 series not converged after 1 steps"):
            m = linear.mcd_fit(df, cols, prep=prep, steps=1, size=size).collect()[0]
        assert not m["done"]
        with pytest.warns(RuntimeWarning, match="1 series not converged after 1 steps"):
            m = linear.ocsvm_fit(df, cols, prep, nu=0.1, steps=1, size=size).collect()[0]
        assert not m["done"] and m["gap"] > linear.GAP


def test_forecast_equals_ridge_in_numpy(spark):
    rng = np.random.default_rng(10)
    x = np.cumsum(rng.normal(size=(150, 2)), 0)
    df, cols = wide(spark, x)
    got = scores(forecast.forecast_score(df, cols, 8, size=40))
    z = (x - x.mean(0)) / x.std(0)
    rows = np.stack([np.concatenate([z[t + 8 - lag] for lag in (1, 2, 4, 8)]) for t in range(142)])
    y = z[8:]
    a, b = rows - rows.mean(0), y - y.mean(0)
    coef = np.linalg.solve(a.T @ a / 142 + 1e-3 * np.eye(8), a.T @ b / 142)
    err = ((a @ coef - b) ** 2).mean(1)
    assert np.allclose(got, np.concatenate([np.full(8, err[0]), err]))


@pytest.mark.parametrize("name", ["AutoEncoder", "USAD", "OmniAnomaly", "TranAD", "Donut", "TimesNet", "AnomalyTransformer", "ALLM4TS", "OFA", "FITS"])
def test_reconstruction_scores_cover_all_points_and_chunks(spark, name):
    rng = np.random.default_rng(11)
    t = np.arange(160)
    x = np.stack([np.sin(t / 5), np.cos(t / 5)], 1) + rng.normal(size=(160, 2)) * 0.05
    x[120] += 3
    df, cols = wide(spark, x)
    a = scores(registry.detect(name, df, cols, window=10))
    b = scores(registry.detect(name, df, cols, window=10, size=33))
    assert len(a) == 160 and np.isfinite(a).all()
    assert np.allclose(a, b)
    if name not in ("AutoEncoder", "ALLM4TS"):  # a single row of two channels does not show the level
        assert abs(int(a.argmax()) - 120) <= 10


def test_low_pass_row_is_the_transform(spark):
    rng = np.random.default_rng(12)
    z = rng.normal(size=24)
    f = np.fft.rfft(z)
    f[5:] = 0
    assert math.isclose(reconstruct.low_pass_row(24, 5) @ z, np.fft.irfft(f, 24)[-1], abs_tol=1e-12)


def test_custom_detector_errors_do_not_stop_the_job(spark):
    def fragile(m):
        if m[0, 0] > 50:
            raise RuntimeError("no")
        return m[:, 0]

    registry.register_detector("fragile", fragile)
    x = np.arange(100, dtype=float)[:, None]
    df, cols = wide(spark, x)
    out = registry.detect("fragile", df, cols, size=60).toPandas()
    assert len(out) == 100
    assert out["error"].notna().sum() == 40 and out["score"].notna().sum() == 60
    with pytest.raises(ValueError):
        registry.detect("nothing", df, cols)


def test_shared_detector_functions(spark):
    train = spark.createDataFrame([("a", i, float(i)) for i in range(100)], "series_id string, t int, score double")
    fit = bd.fitted(train, 0.1)
    assert math.isclose(fit.collect()[0]["threshold"], np.percentile(np.arange(100), 90))
    new = spark.createDataFrame([("a", i, s) for i, s in enumerate([-5.0, 50.0, 95.0, 200.0])], "series_id string, t int, score double")
    assert bd.predict(new, fit).orderBy("t").toPandas()["pred"].tolist() == [0, 0, 1, 1]
    p = bd.predict_proba(new, fit).orderBy("t").toPandas()["proba"].tolist()
    assert np.allclose(p, [0, 50 / 99, 95 / 99, 1])
    u = bd.predict_proba(new, fit, "unify").orderBy("t").toPandas()["proba"].to_numpy()
    mu, sd = np.arange(100).mean(), np.arange(100).std()
    assert np.allclose(u, [max(0, min(1, math.erf((s - mu) / sd / 2**0.5))) for s in [-5, 50, 95, 200]], atol=2e-7)
    c = bd.predict_confidence(train, new, fit).orderBy("t").toPandas()["confidence"].to_numpy()
    le = np.array([0, 51, 96, 100])
    post = (1 + le) / 102
    tail = [1 - sum(math.comb(100, j) * q**j * (1 - q) ** (100 - j) for j in range(91)) for q in post]
    assert np.allclose(c, [1 - tail[0], 1 - tail[1], tail[2], tail[3]], atol=1e-9)


def test_dynamic_programs_on_small_pairs(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ([0.0, 0.0, 1.0], [0.0, 1.0, 1.0]), ([1.0, 2.0, 4.0], [2.0, 2.0, 2.0])],
                               "x array<double>, y array<double>")
    r = df.select(ds.warping()("x", "y").alias("dtw"), ds.edit()("x", "y").alias("edr"), ds.time_warp_edit()("x", "y").alias("twed"),
                  ds.linear_segments(0.5)("x", "y").alias("ssa"), ds.fourier(F.col("x"), F.col("y")).alias("f")).toPandas()
    assert r["dtw"].tolist()[:2] == [0.0, 0.0] and math.isclose(r["dtw"][2], (1 + 0 + 2) / 3)
    assert r["edr"][0] == 0.0 and r["twed"][0] == 0.0 and r["ssa"][0] == 0.0
    z = np.abs(np.fft.fft([1, 2, 4]) - np.fft.fft([2, 2, 2]))
    assert math.isclose(r["f"][2], np.sqrt((z**2).sum()) / 3)
