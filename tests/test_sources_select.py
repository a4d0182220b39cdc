"""Readers on small files, lists, and selection tools by brute force."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import parse_list
from tidemark.operators.profile import optimal_bins
from tidemark.operators.select import quality as sq
from tidemark.operators.select import recommend as rc
from tidemark.sources import series as src


def test_series_csv_and_file_list(spark, tmp_path):
    folder = tmp_path / "sets" / "one"
    folder.mkdir(parents=True)
    head = "timestamp,a,b,is_anomaly\n"
    (folder / "x_train.csv").write_text(head + "2024-01-01 00:30:00,2,,0\n2024-01-01 00:00:00,1,5,0\n")
    (folder / "x_test.csv").write_text(head + "2024-01-02 00:00:00,3,6,1\n")
    df = src.read_series(spark, str(tmp_path / "sets"), src.series_schema(["a", "b"]))
    rows = {(r["dataset"], r["series_id"], r["split"], r["t"]): (r["a"], r["b"], r["label"]) for r in df.collect()}
    assert rows == {("one", "x", "train", 0): (1.0, 5.0, 0), ("one", "x", "train", 1): (2.0, None, 0), ("one", "x", "test", 0): (3.0, 6.0, 1)}
    assert src.read_series(spark, str(tmp_path / "sets"), src.series_schema(["a", "b"]), drop_missing=True).count() == 2
    assert [r["file"] for r in src.list_files(spark, str(tmp_path / "sets")).collect()] == ["x_test.csv"]


def test_arff(spark, tmp_path):
    body = "@relation r\n@attribute a numeric\n@attribute b numeric\n@data\n1,2,7,yes\n3.5,4,8,no\n"
    (tmp_path / "plain.arff").write_text(body)
    (tmp_path / "odd.arff").write_text("@data\n5,6,yes,9\n")
    df = src.read_arff(spark, str(tmp_path), ["a", "b"], misplaced=["odd"])
    assert sorted((r["file"], r["a"], r["b"], r["label"]) for r in df.collect()) == [
        ("odd.arff", 5.0, 6.0, 1), ("plain.arff", 1.0, 2.0, 1), ("plain.arff", 3.5, 4.0, 0)]


def test_gzipped_vectors(spark, tmp_path):
    for name, bits in (("machine_groundtruth", "0110"), ("machine_algo", "0011"), ("machine_other", "1000")):
        with gzip.open(tmp_path / f"{name}.gz", "wt") as f:
            f.write("\n".join(bits) + "\n")
    out = src.read_vectors_with_truth(spark, str(tmp_path)).orderBy("model", "t").collect()
    assert [r["pred"] for r in out if r["model"] == "algo"] == [0, 0, 1, 1]
    assert [r["label"] for r in out if r["model"] == "other"] == [0, 1, 1, 0]


def test_lists_and_list_metrics(spark):
    df = spark.createDataFrame([("d", "['A', 'B', 'C']", "['C', 'A', 'X']")], "dataset string, p string, t string")
    lists = df.select("dataset", parse_list("p").alias("prediction"), parse_list("t").alias("truth"))
    r = lists.select(sq.ndcg_binary().alias("n"), sq.hit_first().alias("h"), sq.best_found().alias("b")).collect()[0]
    ideal = 1 + 1 / np.log2(3) + 0.5
    assert np.isclose(r["n"], (1 + 0.5) / ideal) and r["h"] == 1 and r["b"] == 1


@pytest.mark.parametrize("block", [3, 4096])
def test_dbscan_by_brute_force(spark, block):
    rng = np.random.default_rng(3)
    x = np.round(np.concatenate([rng.normal(size=(25, 2)) * 0.2, rng.normal(size=(25, 2)) * 0.2 + 3, rng.uniform(-4, 6, (12, 2)), np.zeros((9, 2))]), 3)
    eps, need = 0.4, 5
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= need
    label, n = np.zeros(len(x), int), 0
    for i in range(len(x)):
        if core[i] and label[i] == 0:
            n += 1
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] == 0 and core[j]:
                    label[j] = n
                    todo += list(np.flatnonzero(near[j] & core & (label == 0)))
    for i in np.flatnonzero(~core):
        mine = label[near[i] & core]
        label[i] = mine.min() if len(mine) else 0
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "dataset int, x array<double>")
    got = rc.dbscan(df, eps, need, block=block).orderBy("dataset").toPandas()["cluster"].tolist()
    assert got == label.tolist() and n >= 2


def test_optimal_bins_by_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=150), rng.normal(size=60) + 6])
    df = spark.createDataFrame([("a", "c", float(v)) for v in x], "series_id string, channel string, x double")
    n = len(x)
    best = []
    for b in range(1, int(np.sqrt(n))):
        h = np.histogram(x, b)[0]
        best.append(np.sum(h * np.log(b * h / n + 1) - (b - 1 + np.log(b) ** 2.5)))
    assert optimal_bins(df, per_range=20).collect()[0]["bins"] == int(np.argmax(best)) + 1


def test_folds_hold_every_dataset_once(spark):
    df = spark.createDataFrame([(f"p{i % 4}-{i}",) for i in range(40)], "dataset string")
    f = rc.k_fold(df, 5, 2)
    per = f.filter("split = 'test'").groupBy("repeat", "dataset").count()
    assert per.count() == 80 and per.agg(F.max("count")).first()[0] == 1
    split = rc.random_split(df, 0.85)
    assert split.filter("split = 'train'").count() == 34
