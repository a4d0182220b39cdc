"""Streams over several batches, plug-ins, and series without a model."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import joins as jn
from tidemark.operators import registry
from tidemark.operators.detect import cluster, linear
from tidemark.operators.distance import _line_gap
from tidemark.operators.select.recommend import _text_order
from tidemark.functions.scalars import sample_rows
from tidemark.streaming import streams as st

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def events(spark, tmp_path, files=3):
    rng = np.random.default_rng(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=int(m)), int(rng.integers(4)), "ab"[i % 2], float(rng.normal(100, 10))) for i, m in enumerate(np.sort(rng.integers(0, 3000, 300)))]
    for k in range(files):
        part = rows[k * len(rows) // files:(k + 1) * len(rows) // files]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"{k}"))
    return spark.createDataFrame(rows, SCHEMA), str(tmp_path / "*")


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_complete_results_over_several_batches(spark, tmp_path, slide):
    batch, folder = events(spark, tmp_path)
    stream = st.event_stream(spark, folder, batch.schema)
    got = st.drain(st.windowed_stats(stream, "1 hour", slide), "w", "complete").select("event_type", "start", "n").collect()
    w = F.window("ts", "1 hour", slide) if slide else F.window("ts", "1 hour")
    expected = batch.groupBy(w.alias("w"), "event_type").count().select("event_type", "w.start", "count").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected))
    again = st.drain(st.windowed_stats(stream, "1 hour", slide), "w", "complete")
    assert again.count() == len(expected)


def test_sessions_over_several_batches(spark, tmp_path):
    batch, folder = events(spark, tmp_path)
    got = st.drain(st.sessions(st.event_stream(spark, folder, batch.schema), "20 minutes"), "s", "complete")
    assert got.agg(F.sum("n")).first()[0] == 300
    one = batch.groupBy(F.session_window("ts", "20 minutes"), "user_id").count()
    assert got.count() == one.count()


def test_running_scores_follow_the_definition(spark, tmp_path):
    st.use_state_store(spark)
    batch, folder = events(spark, tmp_path)
    got = {r.event_id: (r.z, r.local_z) for r in st.drain(st.running_scores(st.event_stream(spark, folder, batch.schema), width=5), "r").collect()}
    seen = {}
    for r in batch.orderBy("ts", "event_id").collect():
        past = seen.setdefault(r.user_id, [])
        z = (r.value - np.mean(past)) / np.std(past) if len(set(past)) > 1 else 0.0
        near = past[-5:]
        local = (r.value - np.mean(near)) / np.std(near) if len(set(near)) > 1 else 0.0
        assert np.allclose(got[r.event_id], (z, local), atol=1e-6)
        past.append(r.value)


@pytest.mark.parametrize("memory", [{}, {"held": 150}])
def test_running_scores_of_a_key_with_more_rows_than_an_arrow_batch(spark, tmp_path, memory):
    st.use_state_store(spark)
    rng = np.random.default_rng(12)
    start, files = dt.datetime(2024, 1, 1), 2
    rows = [(i, start + dt.timedelta(minutes=i // 3), 7, "a", float(100 + i / 50 + rng.normal())) for i in range(1200)]
    for k in range(files):
        part = rows[k * 600:(k + 1) * 600]
        spark.createDataFrame([part[i] for i in rng.permutation(600)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"{k}"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        stream = st.event_stream(spark, str(tmp_path / "*"), spark.createDataFrame(rows[:1], SCHEMA).schema)
        got = {r.event_id: (r.z, r.local_z) for r in st.drain(st.running_scores(stream, width=5, **memory), "r").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    x = [r[4] for r in rows]
    assert len(got) == len(rows)
    for i in range(2, len(rows)):
        near = x[max(i - 5, 0):i]
        assert np.allclose(got[i], ((x[i] - np.mean(x[:i])) / np.std(x[:i]), (x[i] - np.mean(near)) / np.std(near)), atol=1e-6), i


def test_merged_runs_are_in_order():
    rng = np.random.default_rng(13)
    for n, held in ((0, 5), (4, 5), (999, 50), (1000, 7)):
        events = np.zeros(n, st.EVENT)
        events["ts"], events["event_id"] = rng.integers(0, 90, n), rng.permutation(n)
        blocks = list(st.in_time_order((events[i:i + 9] for i in range(0, n, 9)), held))
        got = np.concatenate(blocks)
        assert (got == np.sort(events, order=["ts", "event_id"])).all() and all(len(b) <= 2 * held + 18 for b in blocks)


def test_nearest_row_sees_copies(spark):
    rows = [("a", [0.0, 0.0]), ("b", [0.0, 0.0]), ("c", [0.0, 0.0]), ("d", [3.0, 4.0]), ("e", [9.0, 9.0])]
    t = spark.createDataFrame(rows, "dataset string, x array<double>")
    got = {r.dataset: (r.nearest, round(r.distance, 6)) for r in jn.nearest_row(t, t).collect()}
    assert got == {"a": ("b", 0.0), "b": ("a", 0.0), "c": ("a", 0.0), "d": ("a", 5.0), "e": ("d", round(61**0.5, 6))}


def series(spark, parts):
    rows = [(k, i, float(v)) for k, x in parts.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, t int, c1 double")


def test_local_plugins_must_be_local_and_fitted_ones_do_not_see_chunks(spark):
    x = np.random.default_rng(1).normal(size=200).cumsum()
    df = series(spark, {"a": x, "b": x[::-1]})
    registry.register_detector("centred", lambda m: np.abs(m - m.mean(axis=0))[:, 0])
    out = registry.detect("centred", df, ["c1"], size=40).collect()
    assert all(r.score is None and "context" in r.error for r in out)
    registry.register_detector("step", lambda m: np.abs(np.diff(m[:, 0], prepend=m[0, 0])), context=1)
    registry.register_fitted("mean", lambda m: np.append(m.sum(0), len(m)), lambda s: s[:-1] / s[-1], lambda m, c: np.abs(m - c).sum(1))
    for name in ("step", "mean"):
        runs = [sorted((r.series_id, r.t, round(r.score, 9)) for r in registry.detect(name, df, ["c1"], size=n).collect()) for n in (33, 10_000)]
        assert runs[0] == runs[1] and len(runs[0]) == 400


def test_series_without_a_model_keep_their_rows(spark):
    x = np.sin(np.arange(120) / 3)
    df, train = series(spark, {"a": x, "b": x}), series(spark, {"a": x})
    for name, kw in (("KMeansAD", {"n_clusters": 3, "window_size": 10}), ("EIF", {}), ("mean", {})):
        registry.register_fitted("mean", lambda m: np.append(m.sum(0), len(m)), lambda s: s[:-1] / s[-1], lambda m, c: np.abs(m - c).sum(1))
        out = registry.detect(name, df, ["c1"], train=train, **kw).collect()
        assert sum(r.series_id == "b" for r in out) == 120 and all(r.score is None for r in out if r.series_id == "b"), name
        assert all(r.score is not None for r in out if r.series_id == "a"), name


def test_one_inseparable_series_does_not_end_the_job(spark):
    rng = np.random.default_rng(2)
    good = np.concatenate([rng.normal(0, 1, 180), rng.normal(50, 1, 20)])
    df = series(spark, {"good": good, "flat": np.arange(200) % 8})
    out = cluster.cblof_score(df, ["c1"], 8, alpha=1.5, beta=1e9, window=4).collect()
    assert len(out) == 400


def test_kmeans_runs_until_it_converges_and_ignores_chunks(spark):
    rng = np.random.default_rng(5)
    df = series(spark, {"a": rng.normal(size=600).cumsum()})
    models = [cluster.kmeans_fit(df, ["c1"], 4, 10, size=n).collect()[0] for n in (50, 100_000)]
    assert all(m["shift"] <= 1e-4 for m in models)
    assert np.allclose(models[0]["centres"], models[1]["centres"], atol=1e-6)


def test_kernels_differ(spark):
    df = series(spark, {"a": np.random.default_rng(6).normal(size=150)})
    scores = {k: [r.score for r in linear.ocsvm_score(df, ["c1"], 8, kernel=k, steps=2).orderBy("t").collect()] for k in ("rbf", "poly", "linear")}
    assert not np.allclose(scores["rbf"], scores["poly"]) and not np.allclose(scores["poly"], scores["linear"])
    with pytest.raises(ValueError):
        linear.ocsvm_score(df, ["c1"], 8, kernel="sigmoid")


def test_short_train_splits_use_the_short_window(spark, monkeypatch):
    seen = []
    fn = registry._by_length(lambda df, channels, window, train, keys, size, **kw: (seen.append((window, df.select("series_id").distinct().count())), df)[1], 100)
    long, short = np.zeros(700), np.zeros(90)
    df = series(spark, {"a": long, "b": short, "c": short})
    fn(df, ["c1"], train=df)
    assert sorted(seen) == [(50, 2), (100, 1)]


def test_text_order_with_common_beginnings(spark):
    names = [f"train|{i:05d}" for i in range(3000)]
    got = _text_order(spark.createDataFrame([(n,) for n in names], "first string").repartition(7)).collect()
    assert {r["first"]: r["cum_n"] for r in got} == {n: i + 1 for i, n in enumerate(names)}


def test_sampling_with_replacement_has_no_cap(spark):
    n = sample_rows(spark.range(4000), 30.0, 1, "id", replacement=True).count() / 4000
    assert abs(n - 30) < 0.5


def test_line_gap_follows_the_definition():
    def form(x, bound):
        knots, i, value = [], 0, np.zeros(len(x))
        while i < len(x):
            knots.append(i)
            value[i] = x[i]
            j = i + 1
            if j < len(x):
                value[j] = x[j]
                j += 1
                while j < len(x) and abs(x[j] - (x[i] + (j - i) * (x[i + 1] - x[i]))) < bound:
                    value[j] = x[i] + (j - i) * (x[i + 1] - x[i])
                    j += 1
            i = j
        return knots, value

    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17):
        x, y = rng.normal(size=(20, n)), rng.normal(size=(20, n)).cumsum(1)
        for a, b, got in zip(x, y, _line_gap(x, y, 0.7), strict=True):
            (ka, va), (kb, vb) = form(a, 0.7), form(b, 0.7)
            both = sorted(set(ka) | set(kb))
            assert np.isclose(got, np.abs(va - vb)[both].mean())


def test_estimator_round_trip(spark, tmp_path):
    from tidemark.operators.estimator import Detector, DetectorModel

    rng = np.random.default_rng(8)
    df = series(spark, {"a": rng.normal(size=150), "b": rng.normal(size=150) * 3})
    for name, settings in (("HBOS", {}), ("PCA", {"window": 10}), ("KMeansAD", {"n_clusters": 3, "window_size": 10}), ("KNN", {"n_neighbors": 3})):
        d = Detector(detector=name, channels=["c1"], settings=settings, contamination=0.2)
        assert d.get_params()["detector"] == name and d.set_params(contamination=0.1).get_params()["contamination"] == 0.1
        model = d.fit(df)
        own = {(r.series_id, r.t): r.score for r in registry.detect(name, df, ["c1"], train=df, **settings).collect()}
        got = {(r.series_id, r.t): r.score for r in model.decision_function(df).collect()}
        assert got.keys() == own.keys() and np.allclose([got[k] for k in own], [own[k] for k in own]), name
        path = str(tmp_path / name)
        model.save(path)
        again = DetectorModel.load(path)
        assert again.get_params() == model.get_params()
        a, b = (sorted((r.series_id, r.t, round(r.score, 9), r.pred) for r in m.transform(df).collect()) for m in (model, again))
        assert a == b and 0.02 < np.mean([x[3] for x in a]) < 0.2


def test_plain_text_vectors_are_numbered_across_splits(spark, tmp_path):
    import gzip

    from tidemark.sources.series import read_vector

    labels = [int(x) for x in np.random.default_rng(1).integers(0, 2, 5000)]
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
    (tmp_path / "x" / "v.txt").write_text("".join(f"{v}\n" + "\n" * (i % 7 == 0) for i, v in enumerate(labels)))
    (tmp_path / "y" / "v.txt").write_text("1\n0\n")
    (tmp_path / "y" / "w.gz").write_bytes(gzip.compress("".join(f"{v}\n" for v in labels).encode()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = read_vector(spark, str(tmp_path / "*")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.label for r in sorted((r for r in got if r.file == "w.gz"), key=lambda r: r.t)] == labels
    plain = sorted((r.t, r.label) for r in got if r.file == "v.txt")
    assert plain == sorted([*enumerate(labels), (0, 1), (1, 0)])


def disordered(spark, tmp_path, files=6, disorder=600):
    """Events whose files are out of order by up to ``disorder`` minutes."""
    rng = np.random.default_rng(21)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=int(m)), int(rng.integers(3)), "ab"[i % 2], float(rng.normal(100, 10))) for i, m in enumerate(np.sort(rng.integers(0, 9000, 500)))]
    late = [(r[1] - start).total_seconds() / 60 + rng.integers(0, disorder) for r in rows]
    place = np.argsort(np.argsort(late)) * files // len(rows)
    for k in range(files):
        part = [rows[i] for i in rng.permutation(len(rows)) if place[i] == k]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"{k}"))
    return rows, st.event_stream(spark, str(tmp_path / "*"), spark.createDataFrame(rows[:1], SCHEMA).schema)


def test_event_time_scores_do_not_depend_on_the_file(spark, tmp_path):
    st.use_state_store(spark)
    rows, stream = disordered(spark, tmp_path)
    got = {r.event_id: (r.z, r.local_z) for r in st.drain(st.running_scores(stream, width=5, late="800 minutes", held=20), "o").collect()}
    last = max(r[1] for r in rows) - dt.timedelta(minutes=800)
    released = [r for r in rows if r[1].timestamp() // 600 * 600 + 600 <= last.timestamp()]
    assert set(got) == {r[0] for r in released} and len(got) > 400
    seen = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        past = seen.setdefault(r[2], [])
        if r[0] in got:
            near = past[-5:]
            want = [(r[4] - np.mean(p)) / np.std(p) if len(p) > 1 else 0.0 for p in (past, near)]
            assert np.allclose(got[r[0]], want, atol=1e-6)
        past.append(r[4])


def test_silent_keys_leave_the_state(spark, tmp_path):
    st.use_state_store(spark)
    start = dt.datetime(2024, 1, 1)
    days = [(0, 1), (0.01, 1), (0.02, 1), (5, 2), (9, 1), (9.01, 1), (30, 2), (60, 2)]
    rows = [(i, start + dt.timedelta(days=d), k, "a", float(i * i)) for i, (d, k) in enumerate(days)]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"{k}"))
    stream = st.event_stream(spark, str(tmp_path / "*"), spark.createDataFrame(rows[:1], SCHEMA).schema)
    got = {r.event_id: r.z for r in st.drain(st.running_scores(stream, late="1 hour", forget=2 * 86_400), "f").collect()}
    assert got[2] == pytest.approx((4 - 0.5) / 0.5) and got[4] == 0.0 and got[5] == 0.0  # the key starts anew after days of silence
    kept = {r.event_id: r.z for r in st.drain(st.running_scores(stream, late="1 hour"), "f").collect()}
    assert kept[4] == pytest.approx((16 - np.mean([0, 1, 4])) / np.std([0, 1, 4]))


@pytest.mark.parametrize("files", [1, 4])
def test_frozen_models_score_a_stream_like_a_batch(spark, tmp_path, files):
    from tidemark.operators.detect import density
    from tidemark.operators.detect.vectors import as_vectors
    from tidemark.plans.chunks import over_windows

    st.use_state_store(spark)
    batch, folder = events(spark, tmp_path, files)
    order = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")) - 1
    t = batch.select(F.col("event_type").alias("series_id"), order.alias("t"), "event_id", "value").cache()
    train = t.filter(F.col("series_id") == "a")
    stream = st.event_stream(spark, folder, batch.schema)
    ends = {(r.series_id, r.t): r.event_id for r in t.collect()}

    centres = cluster.kmeans_fit(train, ["value"], 3, 6)
    m = centres.first()
    models = st.centre_models(centres.withColumnRenamed("series_id", "event_type"), "event_type", 7)
    older = models.withColumn("version", F.lit(3).cast("long")).withColumn("model", F.lit('{"k": 1, "centres": [0, 0, 0, 0, 0, 0]}'))
    got = {r.event_id: (r.score, r.version) for r in st.drain(st.score_windows(stream, models.unionByName(older), "centres", 6, held=30), "c").collect()}
    scored = over_windows(t, ["value"], 6, lambda w, t, _: {"score": cluster._nearest(cluster.window_rows(w), np.asarray(m["centres"]).reshape(int(m["k"]), -1))[1]}, "score double")
    want = {ends[r.series_id, r.t + 5]: (r.series_id, r.score) for r in scored.collect()}
    assert set(got) == set(want)
    for i, (k, s) in want.items():
        assert (got[i] == (pytest.approx(s), 7)) if k == "a" else got[i] == (None, None)

    vectors = as_vectors(t, ["value"], 4, normalise=False)
    model = density.hbos_fit(as_vectors(t.filter("t < 100"), ["value"], 4, normalise=False), 7)
    want = {ends[r.series_id, r.t + 3]: r.score for r in density.hbos_score(vectors, model).collect()}
    models = st.histogram_models(model.withColumnRenamed("series_id", "event_type"), "event_type")
    got = {r.event_id: r.score for r in st.drain(st.score_windows(stream, models, "histograms", 4, normalise=False), "h").collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i]) for i in want)


def test_interval_joins_copy_a_logarithm_of_the_length(spark):
    rng = np.random.default_rng(31)

    def intervals(n, s, e):
        start = rng.integers(-10**9, 10**9, n)
        length = np.minimum(10 ** rng.uniform(0, 9.3, n), 10**9).astype(int)
        rows = [("a" if i % 5 else "b", int(p), int(p + k)) for i, (p, k) in enumerate(zip(start, length, strict=True))]
        return rows + [("a", 5, 5), ("a", 6, 4), ("a", None, 3), (None, 1, 9), ("a", -8, 7), ("a", -8, 7), ("b", 0, 10**9), ("b", 0, 2**20 - 1)]

    left, right = intervals(150, "s", "e"), intervals(120, "s", "e")
    schema = "series_id string, s long, e long"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = sorted(tuple(r) for r in jn.interval_overlap(a, b).select("series_id", "s", "e", "s2", "e2").collect())
    whole = lambda r: None not in r and r[1] <= r[2]
    want = sorted((*x, *y[1:]) for x in left for y in right if whole(x) and whole(y) and x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    assert got == want
    copies = a.filter("s <= e").select((F.col("e") - F.col("s") + 1).alias("n"), jn._dyadic("s", "e").alias("x"))
    assert all(len(r.x) <= 2 * max(r.n.bit_length() - 1, 1) and sum(2**x.level for x in r.x) == r.n for r in copies.collect())
    counts = {(r.series_id, r.s, r.e): r.hits for r in jn.overlap_count(a, b).collect()}
    assert all(counts[x] == sum(1 for y in right if whole(y) and y[0] == x[0] and x[1] <= y[2] and y[1] <= x[2]) for x in left if whole(x))


def test_events_are_clipped_to_fractional_zones(spark):
    events = spark.createDataFrame([("a", 0, 4), ("a", 7, 9), ("a", 3, 3), ("a", -5, 10**9)], "series_id string, s long, e long")
    zones = spark.createDataFrame([("a", i, lo, hi) for i, (lo, hi) in enumerate([(-2.5, 0.0), (0.0, 3.5), (3.5, 7.25), (7.25, 5e8)])], "series_id string, zone int, z0 double, z1 double")
    got = sorted((r.s, r.zone, r.lo, r.hi) for r in jn.clip_to_zones(events, zones).collect())
    want = sorted((s, z, float(max(s, lo)), float(min(e, hi))) for s, e in [(0, 4), (7, 9), (-5, 10**9)] for z, (lo, hi) in enumerate([(-2.5, 0.0), (0.0, 3.5), (3.5, 7.25), (7.25, 5e8)]) if max(s, lo) < min(e, hi))
    assert got == want


class Kept(dict):
    """Value and map state of one key, which count what is put in."""

    puts = 0

    def get(self):
        return dict.get(self, "v")

    def exists(self):
        return bool(self)

    def update(self, value):
        self.updateValue("v", value)

    def updateValue(self, key, value):  # noqa: N802
        self[key], self.puts = value, self.puts + 1

    getValue, removeKey = dict.__getitem__, dict.__delitem__  # noqa: N815


def test_waiting_events_cost_a_key_one_timer_and_few_entries():
    from types import SimpleNamespace

    import pandas as pd

    from tidemark.streaming.ordered import RunningScore

    states, timers, set_ = {}, set(), []
    state = lambda name, *_: states.setdefault(name, Kept())
    handle = SimpleNamespace(getMapState=state, getValueState=state, getListState=state, registerTimer=lambda t: (timers.add(t), set_.append(t)), deleteTimer=timers.discard)
    p = RunningScore(5, bucket=600)
    p.init(handle)
    rng = np.random.default_rng(3)
    n, start = 3000, pd.Timestamp("2024-01-01")
    rows = pd.DataFrame({"ts": start + pd.to_timedelta(rng.permutation(n) * 300, unit="s"), "event_id": np.arange(n), "value": rng.normal(size=n)})
    at = lambda t: SimpleNamespace(getCurrentWatermarkInMs=lambda: int(t.timestamp() * 1000))
    for k in range(2):
        list(p.handleInputRows(("a",), iter([rows[k::2]]), at(start)))
    assert len(set_) <= 2 and len(timers) == 1 and states["waiting"].puts == 4
    out = []
    for share in (0.25, 0.25, 0.6, 0.999):
        mark = start + pd.Timedelta(seconds=int(n * 300 * share))
        for t in [t for t in sorted(timers) if t <= mark.timestamp() * 1000]:
            out += list(p.handleExpiredTimer(("a",), at(mark), SimpleNamespace(getExpiryTimeInMs=lambda t=t: t)))
            timers.discard(t)
    got = pd.concat(out)["event_id"].tolist()
    due = rows[rows["ts"].dt.floor("600s") + pd.Timedelta(seconds=600) <= mark].sort_values("ts")["event_id"].tolist()
    assert got == due and len(timers) == 1 and states["waiting"].puts < 12


def test_rows_of_a_key_reach_the_windows_in_blocks(spark):
    from tidemark.streaming import ordered

    rows = [(k, i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i // 3), float(i), "unused") for i, k in enumerate(["a", None, "b", "a"] * 50)]
    rows[7] = ("a", None, None, None, "unused")
    events = spark.createDataFrame(rows, "kind string, n long, at timestamp, v double, props string").coalesce(1)
    processor = ordered.WindowScore("centres", 3, True, "at", "n", ["v"])
    got = ordered.in_blocks(events, "kind", processor).collect()
    assert sorted(str(r["kind"]) for r in got) == ["None", "a", "b"]  # 200 rows in three
    for r in got:
        have = np.frombuffer(bytes(r["rows"]), ordered.EVENT)
        mine = processor.packed(pd.DataFrame([x for x in rows if x[0] == r["kind"]], columns=events.columns))
        assert len(have) == len(mine) and all(np.array_equal(have[c], mine[c], equal_nan=c == "value") for c in ("event_id", "nameless", "value"))
        assert np.array_equal(have["ts"] == ordered.FOREVER, mine["ts"] == ordered.FOREVER)
