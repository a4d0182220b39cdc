import re
from collections import Counter

import numpy as np
import pytest
from zstandard import ZstdCompressor

from tidemark.llm import collocations as module
from tidemark.llm.collocations import Grams, Summary, collocations, frequent_phrases, sections, stream

SCHEMA = "doc_id long, text string, lang string, phrase string, n string, k int"


def counted(rows):
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        own = f.setdefault(lang if lang is not None else "und", Counter())
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang if lang is not None else "und"] += len(words)
            for k in (1, 2, 3):
                own.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    return f, n


def brute(rows, threshold, inside, top):
    out = set()
    every, n = counted(rows)
    for lang, f in every.items():
        found, scored = {p: a for p, a in f.items() if len(p) > 1 and a >= threshold}, []
        for p, a in found.items():
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= inside * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def sample(docs=200, seed=4):
    rng = np.random.default_rng(seed)
    ends = np.array(["", ",", ".", "\n", "\t", " ", "!?"])
    rows = []
    for i in range(docs):
        words = [f"{'Wéx漢'[w % 4]}{w}" for w in rng.zipf(1.5, rng.integers(0, 80)) % 60]
        rows.append((i, " ".join(w + e for w, e in zip(words, rng.choice(ends, len(words), p=[.76, .04, .04, .04, .04, .04, .04]), strict=True)), [None, "en", "de"][i % 3], "", "", 1))
    return rows + [(-1, None, "en", None, None, None), (-2, "", "fr", "", "", 1), (-3, "New York City. " * 30 + "new york " * 40, "fr", "", "", 1), (-4, "a a a a\x0ba a " * 2000, "en", "", "", 1),
                   (None, "long\x1cword " + "x" * 5000 + " y z", "en", "", "", 1), (5, "same row twice here", "en", "", "", 1), (5, "same row twice here", "en", "", "", 1)]


def test_sections_count_each_phrase_once():
    text = ("Alpha, beta gamma  delta. epsilon zeta\teta theta! " * 40).encode()
    whole = Counter()
    for phrases, _, counts in [Grams(b"en", ZstdCompressor().compress(stream(text)), 0).exact(np.ones(10**6, bool))]:
        whole.update(dict(zip(phrases, counts, strict=True)))
    assert whole == {b" ".join(w.encode() for w in p): n for p, n in counted([(0, text.decode(), "en")])[0]["en"].items()}
    for size in (1, 9, 50, 333):
        parts = Counter()
        for part, lead in sections(text, size):
            phrases, _, counts = Grams(b"en", ZstdCompressor().compress(part), lead).exact(np.ones(10**6, bool))
            parts.update(dict(zip(phrases, counts, strict=True)))
        assert parts == whole


@pytest.mark.parametrize("threshold", [2, 10, 30])
def test_summary_keeps_what_is_frequent(threshold):
    rng = np.random.default_rng(threshold)
    blocks = []
    for _ in range(300):
        keys, n = np.unique((rng.zipf(1.2, 2000) % 2_000_000).astype(np.uint32), return_counts=True)
        blocks.append((keys, np.minimum(n, threshold).astype(np.uint8)))
    mass = sum(int(c.sum(dtype=np.int64)) for _, c in blocks)
    truth = Counter()
    summary = Summary(mass // threshold + 1)
    for keys, n in blocks:
        truth.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
        summary.add(keys, n)
        assert len(summary.keys) <= max(summary.capacity, 0) + 1 or summary.waiting
    kept = set(summary.survivors(threshold).tolist())
    assert {k for k, n in truth.items() if n >= threshold} <= kept
    assert summary.lost < threshold and len(kept) <= summary.capacity
    small = Summary(50)  # far below the bound: it forgets, but says by how much it may be wrong
    for keys, n in blocks:
        small.add(keys, n)
    small.settle()
    assert small.lost >= threshold and len(small.keys) <= 50
    assert all(truth[k] - small.lost <= c <= truth[k] for k, c in zip(small.keys.tolist(), small.counts.tolist(), strict=True))


def test_matches_brute_force(spark, monkeypatch):
    rows = sample()
    for parts, chunk, mass, top in ((1, 4 << 20, 8 << 20, 2000), (6, 300, 500, 5), (3, 5000, 1, 2000)):
        monkeypatch.setattr(module, "CHUNK", chunk)
        monkeypatch.setattr(module, "MASS", mass)
        got = collocations(spark.createDataFrame(rows, SCHEMA).repartition(parts), top=top).collect()
        want = brute(rows, 10, 50, top)
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    known, sizes = frequent_phrases(spark.createDataFrame(rows, SCHEMA), 3)
    f, n = counted(rows)
    assert {(r.lang, r.phrase): r.f for r in known.collect()} == {(lang, " ".join(p)): c for lang, own in f.items() for p, c in own.items() if c >= 3}
    assert {r.lang: r.n for r in sizes.collect()} == dict(n)


def test_empty_tables_and_no_words(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([(1, "... \n !", "en", "", "", 1), (2, None, None, "", "", 1)], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        frequent_phrases(spark.createDataFrame([], SCHEMA), 1000)


def test_scores_stay_exact_beyond_64_bits(spark, monkeypatch):
    known = spark.createDataFrame([("en", "a", 1, 9 * 10**13), ("en", "b", 1, 8 * 10**13 + 7), ("en", "a b", 2, 7 * 10**13 + 3)], "lang string, phrase string, k int, f long")
    sizes = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    monkeypatch.setattr(module, "frequent_phrases", lambda *a: (known, sizes))
    row = collocations(None).first()
    assert row.score == 10**6 * (7 * 10**13 + 3) ** 2 // (9 * 10**13 * (8 * 10**13 + 7))
