import random

import numpy as np
import pyarrow as pa

from tidemark.llm import substring_dedup
from tidemark.llm.substring_dedup import difference_cover, pack, remove_repeats, unpack

SCHEMA = "doc_id long, text string, rid string, id string, found int"


def brute(rows, window):
    """Rows as (id, words kept); a null id counts as the largest."""
    key = lambda i: (1, 0) if i is None else (0, i)
    split = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    least = {}
    for i, w in split:
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            least[k] = min(least.get(k, (2, 0)), key(i))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            if least[tuple(w[s:s + window])] < key(i):
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=str)


def test_difference_cover():
    assert difference_cover(7) == (0, 1, 3)
    for period in range(1, 40):
        cover = difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for _ in range(50):
        doc = np.sort(rng.integers(0, 5, 40))
        pos = np.concatenate([np.sort(rng.choice(10**6, n, replace=False)) for n in np.bincount(doc) if n]) if len(doc) else doc
        rids = rng.integers(-(2**62), 2**62, 5).astype("<i8")
        a, b = unpack(*pack(doc, pos, rids))
        assert (a == rids[doc]).all() and (b == pos).all()
    assert all(len(x) == 0 for x in unpack(*pack(np.zeros(0, int), np.zeros(0, int), np.zeros(0, "<i8"))))


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    passages = [[f"p{k}w{i}" for i in range(rng.randint(10, 40))] for k in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages)[rng.randint(0, 8):] if rng.random() < 0.6 else [rng.choice(["a", "b", "é"]) for _ in range(rng.randint(0, 20))]
        rows.append((rng.choice([i, i, None, 7]), rng.choice([" ", "\n\x0b", "  "]).join(words), "x", None, 1))
    rows += [(500, None, "x", "y", 1), (501, "", None, "y", 1), (502, "\x85 　", "x", "y", 1), (503, " ".join(passages[0]) * 400, "x", "y", 1), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for window, words in ((13, 1_500_000), (13, 200), (2, 1_500_000), (8, 300)):
        monkeypatch.setattr(substring_dedup, "BATCH_WORDS", words)
        got = sorted(map(tuple, remove_repeats(docs, window=window).collect()), key=str)
        assert got == brute(rows, window)


def test_hot_passage_and_copies(spark):
    passage = " ".join(f"h{i}" for i in range(30))
    rows = [(i, f"start{i} " + passage + f" end{i}", "", "", 0) for i in range(400)] + [(1000 + i, passage, "", "", 0) for i in range(300)]
    got = sorted(map(tuple, remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows, 13)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_settled_anchors_reach_all_buckets_and_work_ignores_empty_ones():
    shared = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    texts = [(1 << 40) * i + 12345 for i in range(300)], [f"{shared} {' '.join(f'w{i}x{j}' for j in range(30))}" for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts[0], pa.int64()), pa.array(texts[1])], names=["rid", "text"])
    for buckets in (1000, 10**9):
        rows = [r for b in substring_dedup._anchors(13, 7, buckets)(iter([batch])) for r in b.to_pylist()]
        settled = [r["bucket"] for r in rows if r["lrid"]]
        assert max(settled) > buckets // 2 and len(set(settled)) > 200  # by the row's key, not by its place in the batch
        assert len(rows) <= 10_000 and all(r["rid"] or r["lrid"] or r["c"] for r in rows)
