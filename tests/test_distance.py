"""Dynamic programs over pairs of subsequences against the full tables, and pair counts of windows."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import distance as ds
from tidemark.operators import profile as pf


def dtw(a, b, power):
    n = len(a)
    d = np.full((n + 1, n + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, n + 1):
            d[i, j] = abs(a[i - 1] - b[j - 1]) ** power + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return d[n, n] / n


def edr(a, b, epsilon):
    n = len(a)
    d = np.zeros((n, n))
    d[:, 0] = d[0] = np.arange(n)
    for i in range(1, n):
        for j in range(1, n):
            d[i, j] = d[i - 1, j - 1] if abs(a[i] - b[j]) < epsilon else 1 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return d[-1, -1] / n


def twed(a, b, gamma=0.1, nu=0.1):
    a, b = np.r_[0, a], np.r_[0, b]
    n = len(a)
    d = np.full((n, n), np.inf)
    d[0, 0] = 0
    for i in range(1, n):
        for j in range(1, n):
            drop = min(d[i - 1, j] + abs(a[i - 1] - a[i]), d[i, j - 1] + abs(b[j - 1] - b[j])) + nu + gamma
            d[i, j] = min(drop, d[i - 1, j - 1] + abs(a[i] - b[j]) + abs(a[i - 1] - b[j - 1]) + 2 * nu * abs(i - j))
    return d[-1, -1]


@pytest.mark.parametrize("n", [1, 2, 3, 14, 200])
def test_programs_match_full_tables(spark, monkeypatch, n):
    monkeypatch.setattr(ds, "CELLS", 3 * n)
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=(7, n)), rng.normal(size=(7, n))
    x, y = pd.Series(list(a)), pd.Series(list(b))
    for udf, brute in ((ds.warping(1), lambda p, q: dtw(p, q, 1)), (ds.warping(2), lambda p, q: dtw(p, q, 2)), (ds.edit(0.4), lambda p, q: edr(p, q, 0.4)), (ds.time_warp_edit(), twed)):
        assert np.allclose(udf.func(x, y), [brute(p, q) for p, q in zip(a, b, strict=True)])
        assert len(udf.func(x[:0], y[:0])) == 0
    cost = np.array([dtw(p, q, 1) for p, q in zip(a, b, strict=True)])
    assert (ds.warping_bound(a, b) / n <= cost + 1e-12).all()
    got = ds.warping_within(1).func(x, y, pd.Series(cost * np.where(np.arange(7) % 2, 1.0, 0.99)))
    assert [pd.isna(v) for v in got] == [i % 2 == 0 for i in range(7)] and np.allclose(got[1::2].astype(float), cost[1::2])


def test_long_pairs_need_linear_memory(spark):
    import tracemalloc

    rng = np.random.default_rng(0)
    x = pd.Series(list(rng.normal(size=(40, 1500))))
    run = ds.warping().func
    tracemalloc.start()
    run(x, x[::-1].reset_index(drop=True))
    assert tracemalloc.get_traced_memory()[1] < 40 * 1500 * 8 * 40  # a full table would take 40 * 1501 ** 2 * 8 bytes
    tracemalloc.stop()


def test_far_pairs_are_given_up_early(spark):
    a = np.zeros((50, 400))
    b = np.full((50, 400), 9.0)
    calls = []
    step = lambda g, i, j, up, left, corner: (calls.append(len(g)), np.abs(a[g, i.start - 1:i.stop - 1] - b[g][:, ds._shifted(j)]) + np.minimum(np.minimum(up, left), corner))[1]
    assert np.isinf(ds._wavefront(50, 401, lambda k: np.inf, step, np.full(50, 100.0))).all() and len(calls) < 30


def entropy(x, m=2):
    tol, counts = 0.2 * x.std(), []
    for length in (m, m + 1):
        c = np.lib.stride_tricks.sliding_window_view(x, length)
        counts.append((np.abs(c[:, None, :] - c[None, :, :]).max(-1) <= tol).sum() - len(c))
    return -np.log(counts[1] / counts[0]) if min(counts) > 0 else np.nan


@pytest.mark.parametrize(("window", "stride"), [(20, 1), (20, 3), (7, 7), (3, 1), (2, 1), (60, 1)])
def test_sample_entropy_of_overlapping_windows(window, stride):
    rng = np.random.default_rng(window)
    lines = [rng.normal(size=400).cumsum(), rng.integers(0, 4, 400).astype(float), np.ones(400), np.where(np.arange(400) == 200, np.nan, rng.normal(size=400)), np.r_[rng.normal(size=200), 1e3 * rng.normal(size=200)]]
    for x in lines:
        rows = np.lib.stride_tricks.sliding_window_view(x, window)[::stride]
        want = [entropy(r) if window > 2 else np.nan for r in rows]
        for block in (256, 7):
            assert np.allclose(pf._sample_entropy(rows, block=block), want, equal_nan=True)
    apart = rng.normal(size=(9, window))
    assert np.allclose(pf._sample_entropy(apart), [entropy(r) if window > 2 else np.nan for r in apart], equal_nan=True)


def test_sample_entropy_of_long_windows_is_quick():
    import time

    x = np.random.default_rng(5).normal(size=2500).cumsum()
    rows = np.lib.stride_tricks.sliding_window_view(x, 1000)
    start = time.process_time()
    got = pf._sample_entropy(rows)
    assert time.process_time() - start < 60  # 1,501 windows; one by one they take minutes
    for i in (0, 700, 1500):
        assert got[i] == pytest.approx(entropy(rows[i]))


def simulated(seed, n, omega, alpha, beta):
    rng = np.random.default_rng(seed)
    v, out = omega / (1 - alpha - beta), []
    for z in rng.normal(size=n):
        out.append(np.sqrt(v) * z)
        v = omega + alpha * out[-1] ** 2 + beta * v
    return np.array(out)


def likelihood(e, alpha, beta):
    """Gaussian log-likelihood and conditional variances, one error after the other."""
    e2, v, total, seen = (e - e.mean()) ** 2, e.var(), 0.0, []
    omega = v * (1 - alpha - beta)
    for x in e2:
        seen.append(v)
        total -= 0.5 * (np.log(2 * np.pi * v) + x / v)
        v = omega + alpha * x + beta * v
    return total, np.array(seen)


def test_volatility_is_fitted_by_likelihood(spark):
    planted = {"a": (0.1, 0.12, 0.8), "b": (1.0, 0.3, 0.4), "c": (0.02, 0.05, 0.93)}
    errors = {k: simulated(i, 6000, *p) for i, (k, p) in enumerate(planted.items())} | {"flat": np.zeros(50), "one": np.ones(1)}
    pdf = pd.concat([pd.DataFrame({"series_id": k, "t": np.arange(len(e)), "x": e + 3, "y": 3.0}) for k, e in errors.items()])
    df = spark.createDataFrame(pdf).repartition(7)
    fits = [{r.series_id: r for r in ds.volatility_fit(df, "x", "y", size=size).collect()} for size in (None, 500)]
    assert set(fits[0]) == set(fits[1]) == set(planted)
    for k, (_, alpha, beta) in planted.items():
        r, e = fits[0][k], errors[k]
        assert abs(r.alpha - alpha) < 0.06 and abs(r.beta - beta) < 0.12
        assert abs(r.likelihood - likelihood(e, r.alpha, r.beta)[0]) < 1e-6 * abs(r.likelihood)
        # No other point nearby is better, and the size of a chunk does not matter.
        for a, b in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01), (0.01, -0.01), (-0.01, 0.01)):
            if r.alpha + a >= 0 and r.alpha + r.beta + a + b < 0.9995:
                assert likelihood(e, r.alpha + a, r.beta + b)[0] <= r.likelihood + 1e-6
        assert abs(fits[1][k].alpha - r.alpha) < 1e-6 and abs(fits[1][k].beta - r.beta) < 1e-6 and abs(fits[1][k].likelihood - r.likelihood) < 1e-6
    one = df.filter("series_id = 'b'")
    got = {r.t: r.score for r in ds.volatility_fitted(one, "x", "y", 20, size=700).collect()}
    ratio = np.abs(errors["b"]) / np.sqrt(likelihood(errors["b"], fits[0]["b"].alpha, fits[0]["b"].beta)[1])
    assert len(got) == 6000 - 19 and all(abs(got[t] - ratio[t:t + 20].mean()) < 1e-6 for t in range(0, 5981, 13))
