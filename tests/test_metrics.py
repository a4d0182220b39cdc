"""Hand-worked values and brute force on small series."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import events as ev
from tidemark.operators import metrics as mt
from tidemark.operators import threshold as th

SCORE = [.10, .20, .15, .05, .30, .60, .90, .40, .35, .25, .12, .55, .22, .18, .70, .33, .08, .11, .14, .17]
LABEL = [1 if 5 <= i <= 8 or 13 <= i <= 14 else 0 for i in range(20)]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [("a", i, s, l) for i, (s, l) in enumerate(zip(SCORE, LABEL, strict=True))]
    return spark.createDataFrame(rows, "series_id string, t int, score double, label int").cache()


def one(df, c):
    return df.collect()[0][c]


def test_golden_points(golden):
    r = mt.pointwise(golden).collect()[0]
    assert math.isclose(r["auc_roc"], 0.9047619, abs_tol=1e-7)
    assert math.isclose(r["auc_pr"], 0.8555556, abs_tol=1e-7)
    assert math.isclose(r["best_f1"], 0.8333283, abs_tol=1e-7)
    r = mt.recall_precision(golden).collect()[0]
    assert math.isclose(r["recall"], 1 / 3) and math.isclose(r["precision"], 1)
    assert math.isclose(one(th.ratio_quantile(golden), "threshold"), 0.6575)


@pytest.mark.parametrize("size", [4, 1000])
def test_golden_events_and_ranges(golden, size):
    assert math.isclose(one(mt.point_adjusted_f1(golden, size=size), "pa_f1"), 1.0)
    assert math.isclose(one(mt.event_f1(golden, size=size), "event_f1"), 1.0)
    assert math.isclose(one(mt.range_f1(golden, size=size), "range_f1"), 0.75)


@pytest.mark.parametrize("per_range,size", [(4, 5), (10_000, 1000)])
def test_golden_vus(golden, per_range, size):
    for window, roc, pr in ((4, 0.9430889, 0.8881707), (0, 0.8988095, 0.8293040)):
        r = mt.vus(golden, window, thresholds=10, per_range=per_range, size=size).collect()[0]
        assert math.isclose(r["vus_roc"], roc, abs_tol=1e-6)
        assert math.isclose(r["vus_pr"], pr, abs_tol=1e-6)


def test_golden_affiliation(spark):
    rows = [("a", i, 1 if i in (2, 3, 10, 11) else 0, 1 if 3 <= i < 6 else 0) for i in range(20)]
    df = spark.createDataFrame(rows, "series_id string, t int, label int, pred int")
    r = mt.affiliation(df, pred="pred").collect()[0]
    assert math.isclose(r["precision"], 13 / 21) and math.isclose(r["recall"], 13 / 28)
    assert math.isclose(r["f"], 0.5306122, abs_tol=1e-7)
    for bucket in (4, 1024):
        assert math.isclose(one(mt.affiliation_f(df, pred="pred", bucket=bucket, size=3), "affiliation_f"), 0.5306122, abs_tol=1e-7)


def test_series_without_positive_labels_get_null(spark):
    rows = [("none", i, float(i % 5), 0) for i in range(30)] + [("some", i, float(i % 7), int(10 <= i < 14)) for i in range(30)]
    df = spark.createDataFrame(rows, "series_id string, t int, score double, label int")
    out = {r["series_id"]: r for r in mt.full_report(df, 6, thresholds=20).collect()}
    assert set(out) == {"none", "some"}
    for c in ("auc_roc", "auc_pr", "vus_roc", "f1", "pa_f1", "event_f1", "range_f1", "affiliation_f", "auc_ptrt"):
        assert out["none"][c] is None, c
        assert out["some"][c] is not None, c


def test_auc_does_not_change_under_a_monotone_map(golden):
    a = mt.pointwise(golden).collect()[0]
    b = mt.pointwise(golden.withColumn("score", F.exp("score") * 3)).collect()[0]
    assert math.isclose(a["auc_roc"], b["auc_roc"]) and math.isclose(a["auc_pr"], b["auc_pr"])


def runs_of(bits):
    edge = np.flatnonzero(np.diff(np.r_[0, bits, 0]))
    return list(zip(edge[::2], edge[1::2] - 1, strict=True))


def brute_range(target, other, alpha):
    total = 0.0
    for a, b in runs_of(target):
        met = sum(1 for s, e in runs_of(other) if s <= b and a <= e)
        share = other[a:b + 1].mean()
        total += alpha * (met > 0) + (1 - alpha) * share / max(met, 1)
    n = len(runs_of(target))
    return total / n if n else 0.0


def test_range_and_point_adjusted_f1_by_brute_force(spark):
    rng = np.random.default_rng(11)
    frames, want = [], {}
    for k in range(4):
        n = 60
        label = np.zeros(n, int)
        for s in rng.choice(50, 3, replace=False) + 2:
            label[s:s + rng.integers(1, 6)] = 1
        score = np.round(rng.random(n) + 0.4 * label, 3)
        best_r = best_pa = best_e = 0.0
        for theta in np.linspace(score.min(), score.max(), 100):
            pred = (score > theta).astype(int)
            r, p = brute_range(label, pred, 0.2), brute_range(pred, label, 0.0)
            best_r = max(best_r, 2 * r * p / (r + p) if r + p else 0)
            adj, hits = pred.copy(), 0
            for a, b in runs_of(label):
                if pred[a:b + 1].any():
                    adj[a:b + 1] = 1
                    hits += 1
            tp = (adj * label).sum()
            best_pa = max(best_pa, 2 * tp / (adj.sum() + label.sum()))
            rec = hits / len(runs_of(label))
            prec = (pred * label).sum() / pred.sum() if pred.sum() else 0
            best_e = max(best_e, 2 * rec * prec / (rec + prec + 1e-15))
        frames.append(pd.DataFrame({"series_id": f"s{k}", "t": range(n), "score": score, "label": label}))
        want[f"s{k}"] = (best_r, best_pa, best_e)
    df = spark.createDataFrame(pd.concat(frames))
    for size in (7, 1000):
        r = {x["series_id"]: x["range_f1"] for x in mt.range_f1(df, size=size).collect()}
        p = {x["series_id"]: x["pa_f1"] for x in mt.point_adjusted_f1(df, size=size).collect()}
        e = {x["series_id"]: x["event_f1"] for x in mt.event_f1(df, size=size).collect()}
        for k, v in want.items():
            assert np.allclose([r[k], p[k], e[k]], v)


def test_thresholds(spark, golden):
    assert math.isclose(one(th.percentile(golden, 90), "threshold"), np.percentile(SCORE, 90))
    assert math.isclose(one(th.sigma(golden), "threshold"), np.mean(SCORE) + 3 * np.std(SCORE))
    assert math.isclose(one(th.top_k_points(golden, 3), "threshold"), np.percentile(SCORE, (1 - 3 / 20) * 100))
    g = th.grid(golden).orderBy("k").toPandas()["threshold"].to_numpy()
    assert np.allclose(g, np.linspace(min(SCORE), max(SCORE), 100))
    with pytest.raises(ValueError):
        th.fixed(golden, 1.5)
    with pytest.raises(ValueError):
        th.no_threshold(golden)
    small = spark.createDataFrame([("a", i, s, l) for i, (s, l) in enumerate(zip([.1, .5, .3, .2, .7], [0, 1, 1, 0, 0], strict=True))],
                                  "series_id string, t int, score double, label int")
    top = th.label_by(small, th.top_k_points(small), strict=True).orderBy("t").toPandas()
    assert top["pred"].tolist() == [0, 1, 0, 0, 1]


@pytest.mark.parametrize("per_range", [3, 10_000])
def test_top_k_ranges_by_brute_force(spark, per_range):
    rng = np.random.default_rng(4)
    score = np.round(rng.random(80), 2)
    df = spark.createDataFrame([("a", i, float(s), 0) for i, s in enumerate(score)], "series_id string, t int, score double, label int")
    for k in (1, 5, 12, 500):
        want = None
        for theta in np.unique(score)[::-1][:-1]:
            want = theta
            if len(runs_of((score >= theta).astype(int))) >= k:
                break
        assert one(th.top_k_ranges(df, k, per_range=per_range, size=9), "threshold") == want


def test_affiliation_stays_between_0_and_1(spark):
    rng = np.random.default_rng(8)
    n = 120
    label = np.zeros(n, int)
    label[20:30] = label[70:72] = 1
    df = spark.createDataFrame(pd.DataFrame({"series_id": "a", "t": range(n), "score": rng.random(n), "label": label}))
    out = mt.affiliation(df).toPandas()
    assert len(out) == 99
    for c in ("precision", "recall"):
        assert (out[c] >= 0).all() and (out[c] <= 1 + 1e-12).all()


def test_points_are_adjusted_whole(spark):
    rows = [("a", i, l, p) for i, (l, p) in enumerate(zip([1, 1, 0, 1, 1, 1], [0, 1, 1, 0, 0, 0], strict=True))]
    df = spark.createDataFrame(rows, "series_id string, t int, label int, pred int")
    assert ev.point_adjust(df).orderBy("t").toPandas()["adjusted"].tolist() == [1, 1, 1, 0, 0, 0]
    assert ev.point_adjust(df, compat=True).orderBy("t").toPandas()["adjusted"].tolist() == [0, 1, 1, 0, 0, 0]
