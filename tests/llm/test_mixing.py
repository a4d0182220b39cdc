import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.mixing import mix_sources, mixed_texts, permuted, shard_quota, taken, targets

SCHEMA = "doc_id long, text string, source string, n_chars int, uid string, place string"


def shared(sizes, weights=(5, 2, 1), repeat=3):
    """Shares by weight; what is above the cap is reshared until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > repeat * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = repeat * sizes[s]
            left -= out[s]
        free -= over
    return out


def words(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n))


def rows():
    out = [(i, words(5 + i % 40, f"d{i}x"), f"src{i % 5}", 0, "u", "p") for i in range(400)]
    out += [(1000 + i, words(30, f"n{i}x"), None, 0, "u", "p") for i in range(3)] + [(2000, words(20_000, "long"), "src1", 0, "u", "p")]
    out += [(2001, None, "src2", 0, None, None), (2002, "  ", "blank", 0, "u", "p"), (None, words(9, "q"), "src3", 0, "u", "p"), (2003, words(7, "é"), "src3", 0, "u", "p")]
    return out + [out[0]] * 3  # repeated rows


def test_targets(spark):
    for sizes in ({"a": 100, "b": 100, "c": 1, None: 5}, {"z": 10}, {"a": 0, "b": 7}, {f"s{i}": i * i for i in range(30)}, {"a": 0}):
        got = targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")).collect()
        expected = shared(sizes)
        assert all(abs(r.target - expected[r.source]) < 1e-6 for r in got) and len(got) == len(sizes)


def test_words_taken(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    runs = []
    for parts, block in ((1, 64), (9, 64), (4, 4096)):
        plan, pieces = mix_sources(docs.repartition(parts), block=block, shards=5)
        out = taken(plan, pieces).collect()
        runs.append(sorted((str(r.id), r.size, r.taken) for r in out))
        assert len(out) == len(rows()) and all(0 <= r.taken <= 3 * r.size for r in out)
        sums, sizes = {}, {}
        for r in out:
            sums[r.source] = sums.get(r.source, 0) + r.taken
            sizes[r.source] = sizes.get(r.source, 0) + r.size
        for r in out:
            assert abs(sums[r.source] - r.target) <= 1 + 0.01 * r.target and r.source_size == sizes[r.source]
            assert abs(r.target - shared(sizes)[r.source]) < 1e-6
        assert pieces.select("shard", "slot").distinct().count() == pieces.select("shard").distinct().join(pieces.groupBy("shard").agg(F.countDistinct("slot").alias("n")), "shard").agg(F.sum("n")).first()[0]
    assert runs[0] == runs[1]


def splits(quota, lo, hi, seed):
    """Quotas of every shard, from the root down."""
    if hi - lo == 1:
        return [list(map(int, quota))]
    mid, total = (lo + hi) // 2, int(sum(quota))
    draw = np.random.Generator(np.random.PCG64([seed, lo, hi])).multivariate_hypergeometric(quota, total * (mid - lo) // (hi - lo), method="marginals")
    return splits(draw, lo, mid, seed) + splits(quota - draw, mid, hi, seed)


def walked(keyed, block, shards, seed=17):
    """(id, shard, slot, start, stop) of every piece, by a walk over all words of all draws."""
    names = sorted({r.source for r in keyed if r.source is not None}, key=str.encode) + [None]
    streams = [[(str(r.id), w) for r in sorted((r for r in keyed if r.source == s), key=lambda r: r.key) for w in range(r.size)] for s in names]
    target = shared({s: len(x) for s, x in zip(names, streams, strict=True)})
    used = []
    for place, stream in enumerate(streams):
        if stream:
            blocks = -(-len(stream) // block)
            even, left, draws = -(-len(stream) // blocks), round(target[names[place]]), []
            while left > 0:
                cycle, k = divmod(len(draws), blocks)
                at = int(permuted(np.arange(blocks), blocks, (seed * 1_000_003 + place) * 31 + cycle)[k])
                part = stream[at * even:(at + 1) * even]
                # A pass that the target holds whole is never cut short.
                if (cycle + 1) * len(stream) > round(target[names[place]]):
                    part = part[:left if left < even else even]
                    left -= even if left >= even else left
                else:
                    left -= len(part)
                draws.append(part)
            used.append(draws)
    out, first = [], [0] * len(used)
    for shard, quota in enumerate(splits(np.array([len(d) for d in used]), 0, shards, seed)):
        here = [d for draws, a, n in zip(used, first, quota, strict=True) for d in draws[a:a + n]]
        first = [a + n for a, n in zip(first, quota, strict=True)]
        for slot, part in zip(np.random.Generator(np.random.PCG64([seed, shard])).permutation(len(here)), here, strict=True):
            out += [(i, shard, int(slot), w) for i, w in part]
    return out


def test_draws_match_a_walk_over_all_words(spark):
    docs = spark.createDataFrame(rows()[:-3], SCHEMA)
    for block, shards in ((64, 5), (512, 3), (4096, 8)):
        plan, pieces = mix_sources(docs, block=block, shards=shards)
        keyed = plan.select("id", "source", "size", F.xxhash64("rid", F.lit(17)).alias("key")).collect()
        got = [(str(p.id), p.shard, p.slot, w) for p in pieces.collect() for w in range(p.start, p.stop)]
        expected = walked(keyed, block, shards)
        assert sorted(got) == sorted(expected)
        counts = {}
        for i, shard, *_ in expected:
            counts.setdefault(i, {}).setdefault(shard, 0)
            counts[i][shard] += 1
        for r in taken(plan, pieces).collect():
            assert r.taken == sum(counts.get(str(r.id), {}).values()) and {s.shard: s.words for s in r.shards} == counts.get(str(r.id), {})


def test_shards_in_order_and_any_column_names(spark):
    clash = docs = spark.createDataFrame(rows(), SCHEMA)
    for name in ("_rid", "_start", "_stop", "_key", "rid", "shard", "slot", "id", "row", "start"):
        clash = clash.withColumn(name, F.concat(F.lit(name), F.col("uid")))
    out = mixed_texts(clash, block=64, shards=5, places=("in_shard", "in_slot"))
    assert out.columns == [*clash.columns, "in_shard", "in_slot"] and out.filter("uid IS NOT NULL AND (_rid <> '_ridu' OR row <> 'rowu')").count() == 0
    parts = out.select(F.spark_partition_id().alias("task"), "in_shard", "in_slot").collect()
    assert len({(r.task, r.in_shard) for r in parts}) == 5
    assert all((x.in_shard, x.in_slot) <= (y.in_shard, y.in_slot) for x, y in zip(parts, parts[1:]) if x.task == y.task)
    plain = mixed_texts(docs.drop("n_chars"), block=64, shards=5)
    assert sorted((str(r.doc_id), r.text) for r in plain.collect()) == sorted((str(r.doc_id), r.text) for r in out.collect())
    # A shard holds the words that were drawn for it.
    _, pieces = mix_sources(docs, block=64, shards=5)
    expected = {r.shard: r.n for r in pieces.groupBy("shard").agg(F.sum(F.col("stop") - F.col("start")).alias("n")).collect()}
    got = {r.in_shard: r.n for r in out.groupBy("in_shard").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).collect()}
    assert got == expected


def test_texts_of_the_mix(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    plan, pieces = mix_sources(docs, block=64, shards=5)
    expected = {str(r.id): r.n for r in taken(plan, pieces).groupBy("id").agg(F.sum("taken").alias("n")).filter("n > 0").collect()}
    out = mixed_texts(docs, block=64, shards=5)
    assert out.columns == docs.columns
    got = {}
    source = {str(i): t for i, t, *_ in rows()}
    for r in out.collect():
        got[str(r.doc_id)] = got.get(str(r.doc_id), 0) + len(r.text.split())
        assert r.text in source[str(r.doc_id)] and r.n_chars == len(r.text)
    assert got == expected


def test_splitting_tree_and_permutation():
    quota = np.array([100, 0, 37, 5])
    for shards in (1, 2, 7, 16):
        parts = [shard_quota(quota, shards, s, 3) for s in range(shards)]
        assert (sum(c for _, c in parts) == quota).all()
        for k in range(4):
            spans = sorted((int(a[k]), int(a[k] + c[k])) for a, c in parts if c[k])
            assert all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        sizes = [int(c.sum()) for _, c in parts]
        assert max(sizes) - min(sizes) <= len(bin(shards))
    for n in (1, 2, 5, 64, 1000):
        assert sorted(permuted(np.arange(n), n, 99)) == list(range(n))
    assert list(permuted(np.arange(1000), 1000, 1)) != list(permuted(np.arange(1000), 1000, 2))


def test_empty_tables(spark):
    plan, pieces = mix_sources(spark.createDataFrame([], SCHEMA))
    assert plan.count() == 0 and pieces.count() == 0
    only = spark.createDataFrame([(1, None, "a", 0, "", "")], SCHEMA)
    assert [(r.target, r.taken) for r in taken(*mix_sources(only)).collect()] == [(0.0, 0)]
    assert mixed_texts(only).count() == 0
