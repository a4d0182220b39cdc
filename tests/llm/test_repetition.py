import random

import numpy as np

from tidemark.llm.repetition import Limits, covered, judge, longest_repeats, maximal_repeats


def brute(t):
    out = []
    for i in range(len(t)):
        n = 0
        while i + n < len(t) and any(j != i and t[j:j + n + 1] == t[i:i + n + 1] for j in range(len(t) - n)):
            n += 1
        out.append(n)
    return out


def test_longest_and_maximal_repeats_match_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        texts = [[rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(rng.randint(1, 4))]
        lens, ids, offset = np.array([len(t) for t in texts]), [], 0
        for t in texts:
            number = {}
            ids += [offset + number.setdefault(c, len(number)) for c in t]
            offset += len(t)
        found, at = longest_repeats(np.array(ids, np.int64), lens), 0
        for t in texts:
            expected = brute(t)
            assert list(found[at:at + len(t)]) == expected
            at += len(t)
            union = np.zeros(len(t), bool)
            for n, starts in maximal_repeats(" ".join(t), 2):
                assert len({tuple(t[s:s + n]) for s in starts}) == 1
                for s in starts:
                    union[s:s + n] = True
            assert (union == covered(np.array(expected, np.int64), 2)).all()


def test_verdicts_and_odd_rows(spark):
    prose = " ".join(f"w{i}" for i in range(200))
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [
        (1, prose, "x"), (2, None, "x"), (3, "", "x"), (4, "a b " * 100, "x"), (5, prose + " " + " ".join(f"q{i}" for i in range(100)) + " " + passage + " end " + passage, "x"), (5, prose, None),
        (None, "one\ntwo\none\n \n \nthree # $", "x"), (7, "w " * 60_000, "x"), (8, prose + " " + " ".join(f"p{i}" for i in range(20)) * 2, "x"),
    ]
    out = judge(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    got = {(r.doc_id, r.n_words): r for r in out}
    assert len(out) == len(rows)
    assert got[1, 200].kept and got[5, 200].kept and not got[2, 0].kept and got[3, 0].base_failed
    assert got[4, 200].base_failed and got[4, 200].n_repeat_words == 200
    long = got[5, 541]
    assert not long.base_failed and not long.kept and long.longest == 120 and long.n_covered == 240
    odd = got[None, 6]
    assert (odd.n_dup_lines, odd.n_symbols, odd.word_chars) == (1, 2, 16)
    assert got[7, 60_000].base_failed and got[7, 60_000].longest == 59_999
    assert judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    strict = judge(spark.createDataFrame(rows[:1], "doc_id long, text string, kept string"), limits=Limits(min_words=500)).first()
    assert strict.base_failed
