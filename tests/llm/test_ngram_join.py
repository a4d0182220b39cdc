import random
from collections import defaultdict
from fractions import Fraction

from tidemark.llm import ngram_join
from tidemark.llm.graph import components
from tidemark.llm.ngram_join import HASHES, STEP, least_matches, similar

SCHEMA = "doc_id long, text string, rid string, key string, label int"


def brute(rows, n=5, threshold=Fraction(4, 5)):
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        sets.append((i, frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else None))
    order = lambda i: (i is None, i)
    classes = defaultdict(list)
    for i, s in sets:
        if s is not None:
            classes[s].append(i)
    heads = {s: min(v, key=order) for s, v in classes.items()}
    keys = list(heads)
    near = {s: [o for o in keys if o != s and Fraction(len(s & o), len(s | o)) >= threshold] for s in keys}
    group = {}
    for s in keys:
        if s in group:
            continue
        seen, todo = {s}, [s]
        while todo:
            for o in near[todo.pop()]:
                if o not in seen:
                    seen.add(o)
                    todo.append(o)
        for o in seen:
            group[o] = min((heads[x] for x in seen), key=order)
    return sorted(((i, i, 1, 0, i) if s is None else (i, heads[s], len(classes[s]), len(near[s]), group[s]) for i, s in sets), key=str)


def edited(rng, words, rate):
    return [w if rng.random() > rate else f"e{rng.randint(0, 10**6)}" for w in words]


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for k in range(25):
        base = [f"b{k}w{rng.randint(0, 60)}" for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(rng.randint(1, 12)):
            rows.append((len(rows), " ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.08]))), "", "", 1))
    rows += [(900, None, "", "", 1), (901, "", "", "", 1), (902, " \n", None, None, None), (None, rows[0][1], "", "", 1), (903, "one", "", "", 1), (904, "one", "", "", 1),
             (0, rows[5][1], "", "", 1), rows[7], (905, "x y " * 20_000, "", "", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for block in (1_000_000, 300):  # the second cuts pivots into many cells
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        assert sorted(map(tuple, similar(docs).collect()), key=str) == brute(rows)


def test_large_group_of_different_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4000)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(edited(rng, base, 0.01)), "", "", 1) for i in range(300)]
    assert sorted(map(tuple, similar(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)


def test_pruning_bound():
    least = least_matches(Fraction(4, 5))
    assert len(least) == HASHES // STEP and least == sorted(least)
    assert 0 < least[0] < 8 and 64 < least[-1] < 90


def test_empty_table(spark):
    assert similar(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_chain_and_odd_edges(spark):
    rng = random.Random(1)
    nodes = list(range(300))
    rng.shuffle(nodes)
    edges = [(nodes[i], nodes[i + 1]) for i in range(299) if i != 150] + [(5000, 5000), (None, 1), (nodes[0], nodes[1])]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    for part in (nodes[:151], nodes[151:]):
        assert {got[x] for x in part} == {min(part)}
    assert 5000 not in got and components(spark.createDataFrame([], "a long, b long")).count() == 0
