import re
from collections import Counter, defaultdict

import numpy as np

from tidemark.llm import divergence
from tidemark.llm.divergence import frequencies, pieces
from tidemark.llm.divergence import divergence as audit

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, at long"
PATTERN = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        found = Counter(lowered(t) for t in PATTERN.findall(text))
        count[lang, source] += found
        docs[lang].update(found.keys())
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for la, s in groups if la == lang)
        every = Counter()
        for s in sources:
            every += count[lang, s]

        def shares(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        p, q = {s: shares(count[lang, s]) for s in sources}, shares(every)
        for s in sources:
            near = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            far = sorted(((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]))[:top]
            for part, ranked in (("pair", near), ("term", far)):
                out |= {(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(ranked)}
    return out


def random_rows(n, words, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        text = " ".join(f"{'Wé'[w % 2]}{'abcdefghij'[w % 10]}{'XYZ漢'[w // 10 % 4]}{'q' * (w // 40)}," for w in rng.zipf(1.4, rng.integers(0, 40)) % words)
        rows.append((i, text, "en" if i % 3 else "de", f"s{rng.integers(0, 7) if i % 2 else 0}", "x", 1, 2))
    return rows


def test_pieces_end_between_terms():
    text = ("Some Words, with-dashes_and 1digits é漢字 " * 50).encode()
    whole = frequencies(text)
    assert whole == Counter(lowered(t).encode() for t in PATTERN.findall(text.decode()))
    for size in (1, 7, 100, 10**6):
        assert sum((Counter(p.split()) for p in pieces(text, size)), Counter()) == whole


def test_matches_brute_force(spark, monkeypatch):
    rows = random_rows(300, 200)
    rows += [(900, None, "en", "s1", None, None, None), (901, "", None, None, "", 0, 0), (902, "only here " * 40, "fr", "s1", "", 0, 0), (903, None, "fr", "empty", "", 0, 0),
             (904, "a b c " * 60_000, "en", "s2", "", 0, 0), (905, "12 34 -- !!", "xx", "s1", "", 0, 0), (905, "12 34 -- !!", "xx", "s2", "", 0, 0), rows[4], rows[4], (None, "Wa, Wa", "en", "s0", "", 0, 0)]
    for least, top, terms, sources, held in ((1, 50, 4096, 128, 400_000), (5, 3, 16, 2, 40), (30, 50, 4096, 128, 400_000)):
        for k, v in (("TERMS", terms), ("SOURCES", sources), ("HELD", held)):
            monkeypatch.setattr(divergence, k, v)
        got = audit(spark.createDataFrame(rows, SCHEMA).repartition(5), least, top).collect()
        want = brute(rows, least, top)
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_empty_table_and_no_terms(spark):
    assert audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "few words", "en", "a", "", 0, 0), (2, None, "en", "b", "", 0, 0)]
    assert {tuple(r) for r in audit(spark.createDataFrame(rows, SCHEMA)).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_shares_stay_exact_beyond_64_bits(spark):
    n = 9 * 10**15
    got = spark.createDataFrame([(n, 2 * n + 7, 12345)], "a long, b long, c long").select(divergence.share("a", "b", "c").alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (2 * n + 7 + 5 * 12345)
