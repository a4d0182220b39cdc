import hashlib

import numpy as np

from tidemark.llm import multiset_hash
from tidemark.llm.multiset_hash import _sketch, delete, fingerprints, insert, likeness, printed, updated, vector

SCHEMA = "doc_id long, text string, rid string, vector string, following int"


def test_homomorphism():
    parts = ["one paragraph of some length", "another one", "", "short", "éè漢字 " * 30]
    whole = vector("\n".join(parts))
    assert (whole == vector("\n".join(parts[::-1]))).all()
    total = vector(parts[0])
    for p in parts[1:]:
        total = insert(total, p)
    assert (total == whole).all()
    assert (delete(total, parts[4]) == vector("\n".join(parts[:4]))).all()
    assert not (vector("a\na") == vector("a")).all() and not (vector("a") == vector("b")).all()


def test_sketch_in_chunks_matches_one_piece(monkeypatch):
    text = "\n".join(f"line {i} of a long text with words {i * i}" for i in range(300))
    whole = _sketch(text)
    monkeypatch.setattr(multiset_hash, "_CHUNK", 64)
    assert (_sketch(text) == whole).all()


def brute(rows):
    order = sorted(((i if i is not None else 2**63 - 1, t or "") for i, t, *_ in rows), reverse=True)
    out = []
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 3
        edited = t[:len(t) - k] + following[:k]
        own, changed = vector(t), vector(edited)
        out.append((None if i == 2**63 - 1 else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own.tobytes(), changed.tobytes(), likeness(own, changed), likeness(own, vector(following))))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rows = [(i, "\n".join(f"text {i} line {j} with a few words" for j in range(i % 9)), "x", "y", 1) for i in range(80)]
    rows += [(200, None, "", "", 1), (201, "", None, None, None), (202, "é", "", "", 1), (None, "last " * 50, "", "", 1), (203, "long words " * 30_000, "", "", 1), (204, rows[8][1], "", "", 1)]
    for parts in (1, 7, 300):
        out = fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
        got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, bytes(r.vector), bytes(r.edited_vector), r.near_edited, r.near_next) for r in out), key=str)
        assert got == brute(rows)


def test_equal_rows_single_row_and_no_rows(spark):
    one = fingerprints(spark.createDataFrame([(1, "alone in here", "", "", 1)], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    twice = fingerprints(spark.createDataFrame([(1, "twice the same row", "", "", 1)] * 40, SCHEMA).repartition(8)).collect()
    assert len(twice) == 40 and len({tuple(r) for r in twice}) == 1
    assert fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_likeness_follows_the_shared_part():
    rng = np.random.default_rng(3)
    a, b = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 400)) for _ in range(2))
    mixed = a[:len(a) * 2 // 3] + b[:len(a) // 3]
    assert abs(likeness(vector(a), vector(mixed)) - 2 / 3) < 0.12 and likeness(vector(a), vector(b)) < 0.15


def test_printed_fingerprints_can_be_updated(spark):
    texts = ["first\nsecond", "second\nfirst\nthird", "third", "", "first\nfirst"]
    rows = [(i, t, "", "", 1) for i, t in enumerate(texts)]
    out = {r.doc_id: bytes(r.vector).hex() for r in fingerprints(spark.createDataFrame(rows, SCHEMA), wide=False).collect()}
    assert all(out[i] == printed(vector(t)) for i, t in enumerate(texts)) and len(set(out.values())) == len(texts)
    assert updated(out[0], inserted="third") == out[1] and updated(out[1], deleted="second\nfirst") == out[2]
    assert updated(out[0], inserted="first", deleted="second") == out[4]
