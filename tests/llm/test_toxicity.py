import random

import numpy as np

from tidemark.llm import toxicity
from tidemark.llm.toxicity import LANGUAGES, Network, best_threshold, fit, score, train

SCHEMA = "doc_id long, text string, score string, language int"
BAD = {"en": ["fool", "rotten", "vile thing"], "de": ["depp", "mieser kerl", "widerlich"]}


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        words = [rng.choice(LANGUAGES[lang].split() + [f"{lang}{rng.randint(0, 3000)}"] * 30) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.25
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(BAD[lang]))
        rows.append((i, " ".join(words), "x", 1))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(1500, 1)
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels[:1000], "doc_id long, toxic int")
    out = score(docs, fit(docs, known)).collect()
    truth = dict(labels)
    held = [r for r in out if r.doc_id >= 1000]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.97
    assert {r.language for r in out} <= {"en", "de", ""} and all(0 <= r.score <= 1 for r in out)


def test_a_score_depends_on_the_text_alone_and_odd_rows_pass(spark):
    rows, labels = corpus(300, 2)
    docs = spark.createDataFrame(rows, SCHEMA)
    labels += [(None, 1), (5, None), (7, 1), (7, 0), (10**9, 1)]
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    long = "the word " * 150_000 + "fool rotten vile thing"
    odd = [(None, None, "", 1), (1, "", "", 1), (1, " ", "", 1), (2, rows[0][1], "", 1), (3, rows[0][1], None, None), (4, long, "", 1), (6, "the word " * 150_000, "", 1)]
    out = score(spark.createDataFrame(odd, SCHEMA).repartition(3), model).collect()
    assert len(out) == len(odd)
    values = {r.doc_id: r.score for r in out}
    assert abs(values[2] - values[3]) < 1e-5 and abs(values[None] - values[1]) < 1e-5 and values[4] > values[6]
    assert score(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(1, "a b", "", 1), (2, None, "", 1)], SCHEMA)
    for rows in ([], [(1, 0)], [(1, 1)]):
        out = score(docs, fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))).collect()
        assert len(out) == 2 and len({r.score for r in out}) == 1


def test_segments_give_the_same_maxima(monkeypatch):
    rows, labels = corpus(200, 3)
    net = train([r[1] for r in rows], np.array([x for _, x in labels]), np.arange(200) % 4 == 0)
    again = Network.load(net.save())
    texts = [toxicity._Rows(again).of(r[1])[0] for r in rows]
    whole = again.logits(texts)
    monkeypatch.setattr(toxicity, "SEGMENT", 7)
    assert np.allclose(again.logits(texts), whole, atol=1e-4)


def test_threshold():
    assert best_threshold(np.array([3.0, 2.0, 1.0, 0.0]), np.array([1, 1, 0, 0])) == 1.5
