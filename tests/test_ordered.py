"""Chunked and ranged plans give the same as the plain definition, whatever the chunk size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import analytic as an
from tidemark.operators import clean, windows
from tidemark.plans import attach as at
from tidemark.plans.ordered import carry, cumulate, index_rows, quantiles, running_sum, shifted

K = ["series_id"]


def series(seed=0, sizes=(137, 5, 1)):
    rng = np.random.default_rng(seed)
    parts = []
    for i, n in enumerate(sizes):
        parts.append(pd.DataFrame({
            "series_id": f"s{i}", "t": np.arange(n), "x": np.round(rng.normal(size=n), 2),
            "label": (rng.random(n) < 0.4).astype(int),
        }))
    return pd.concat(parts, ignore_index=True)


def back(df):
    return df.toPandas().sort_values(["series_id", "t"]).reset_index(drop=True)


@pytest.mark.parametrize("size", [3, 16, 1000])
def test_shift_carry_and_running_sum(spark, size):
    pdf = series()
    pdf.loc[pdf["t"] % 7 != 3, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    g = pdf.groupby("series_id")
    out = back(shifted(df, K, "t", {"a": ("label", 2), "b": ("label", -1)}, size))
    pd.testing.assert_series_equal(out["a"].astype(float), g["label"].shift(2), check_names=False)
    pd.testing.assert_series_equal(out["b"].astype(float), g["label"].shift(-1), check_names=False)
    out = back(carry(df, K, "t", {"p": ("x", "prev", True), "n": ("x", "next", False)}, size))
    pd.testing.assert_series_equal(out["p"], g["x"].ffill(), check_names=False)
    want = g["x"].apply(lambda s: s.bfill().shift(-1)).reset_index(drop=True)
    pd.testing.assert_series_equal(out["n"], want, check_names=False)
    out = back(running_sum(df, K, "t", {"c": "label"}, size))
    assert (out["c"] == g["label"].cumsum()).all()


@pytest.mark.parametrize("per_range", [2, 7, 100_000])
def test_cumulate_with_a_hot_key_and_heavy_tail(spark, per_range):
    rng = np.random.default_rng(1)
    x = np.round(np.concatenate([rng.normal(size=300), [1e9, -1e9], np.zeros(200)]), 2)
    pdf = pd.DataFrame({"series_id": ["hot"] * len(x) + ["one"], "x": np.append(x, 5.0)})
    c = cumulate(spark.createDataFrame(pdf), K, "x", per_range=per_range).toPandas()
    hot = c[c.series_id == "hot"].sort_values("x")
    values, counts = np.unique(x, return_counts=True)
    assert hot["x"].tolist() == values.tolist()
    assert hot["cum_n"].tolist() == counts.cumsum().tolist()
    assert set(hot["tot_n"]) == {len(x)}
    q = quantiles(spark.createDataFrame(pdf), K, "x", {"a": 0.5, "b": 0.925, "c": 1.0}, per_range).toPandas()
    got = q[q.series_id == "hot"].iloc[0]
    assert np.allclose([got.a, got.b, got.c], np.quantile(x, [0.5, 0.925, 1.0]))


@pytest.mark.parametrize("width", [10.0, 1e6])
def test_index_rows(spark, width):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"series_id": "a", "ts": rng.permutation(500)})
    out = index_rows(spark.createDataFrame(pdf), K, ["ts"], F.col("ts"), width).toPandas()
    assert (out["t"] == out["ts"]).all()


@pytest.mark.parametrize("size", [4, 50])
def test_windows_do_not_depend_on_chunks(spark, size):
    pdf = series(3)
    df = spark.createDataFrame(pdf)
    w = back(windows.slide(df, ["x", "label"], 4, stride=2, size=size))
    s = pdf[pdf.series_id == "s0"]
    assert len(w[w.series_id == "s0"]) == (137 - 4) // 2 + 1
    row = w[(w.series_id == "s0") & (w.t == 10)].iloc[0]
    assert list(row["win"]) == s["x"][10:14].tolist() + s["label"][10:14].tolist()
    scores = df.filter("series_id = 's0' AND t <= 133").select("series_id", "t", F.col("x").alias("score"))
    out = back(windows.overlap_mean(df.filter("series_id = 's0'"), scores, 4, size=size))
    x = s["x"].to_numpy()[:134]
    want = [x[max(0, t - 3): min(t, 133) + 1].mean() for t in range(137)]
    assert np.allclose(out["score"], want)


def test_constant_scores_stay_constant(spark):
    df = spark.range(40).select(F.lit("a").alias("series_id"), F.col("id").alias("t"))
    scores = df.filter("t <= 30").withColumn("score", F.lit(2.5))
    for out in (windows.overlap_mean(df, scores, 10), windows.centre_pad(df, scores, 10)):
        assert set(out.toPandas()["score"]) == {2.5}


def test_padding_of_a_series_without_windows(spark):
    df = spark.range(3).select(F.lit("a").alias("series_id"), F.col("id").alias("t"))
    empty = df.filter("t < 0").withColumn("score", F.lit(1.0))
    assert windows.centre_pad(df, empty, 10).filter("score IS NOT NULL").count() == 0
    assert set(windows.overlap_mean(df, empty, 10).toPandas()["score"]) == {0.0}


@pytest.mark.parametrize("size", [3, 1000])
def test_runs_across_chunks(spark, size):
    bits = [1, 1, 0, 1, 0, 0, 1, 1, 1, 1, 1, 1, 1, 0, 1]
    df = spark.createDataFrame([("a", i, b) for i, b in enumerate(bits)], "series_id string, t int, label int")
    got = {(r["s"], r["e"], r["len"]) for r in an.runs(df, size=size).collect()}
    assert got == {(0, 1, 2), (3, 3, 1), (6, 12, 7), (14, 14, 1)}


def test_sample_and_hold_fills_both_ends(spark):
    df = spark.createDataFrame(
        [("a", i, v) for i, v in enumerate([None, None, 3.0, None, 5.0, None])], "series_id string, t int, x double")
    assert back(clean.sample_and_hold(df, ["x"], size=2))["x"].tolist() == [3, 3, 3, 3, 5, 5]


def test_attach_without_broadcast_gives_the_same(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("series_id"), "id")
    stats = df.groupBy("series_id").agg(F.max("id").alias("m"))
    small = at.attach(df, stats, K)
    large = at.attach(df, stats, K, limit=0)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (small, large)]
    assert "strategy=broadcast" in plans[0] and "strategy=broadcast" not in plans[1]
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_no_window_over_a_whole_series(spark):
    """Sliding plans partition by series and chunk, never by the series alone."""
    df = spark.createDataFrame(series())
    plan = windows.slide(df, ["x"], 4)._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "Window [" in line]
    assert lines and all("_chunk" in line for line in lines)


def test_sampled_thresholds_and_order_stats_match_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=400), 1)
    df = spark.createDataFrame([("a", float(v)) for v in x], "series_id string, score double")
    for per_range in (5, 10_000):
        got = an.spaced_order_stats(df, K, count=50, per_range=per_range).orderBy("k").toPandas()
        want = np.sort(x)[::-1][np.linspace(0, len(x) - 1, 50).astype(int)]
        assert got["threshold"].tolist() == want.tolist()
        u = np.unique(x)[1:]
        step = len(u) // 49 if len(u) > 50 else 1
        some = u[::step]
        some = some if some[-1] == u[-1] else np.append(some, u[-1])
        got = sorted(r["threshold"] for r in an.sampled_thresholds(df, K, per_range=per_range).collect())
        assert got == some.tolist()
