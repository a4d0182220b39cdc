"""Near-duplicate join: Jaccard similarity of word n-gram sets, with Bayesian pruning of candidates.

1. ``_features``: the set of 64-bit n-gram hashes of a text gives a 128-bit key of the set and ``HASHES`` MinHash values. Texts with equal sets form
   a class; one row stands for it, so copies cost nothing further.
2. Bands of ``ROWS`` MinHash values propose pairs. At similarity 0.8 a pair is missed with probability (1 - 0.8^4)^32 < 1e-7. Instead of emitting
   pairs, each class is sent to the pivots (least member) of its band buckets; classes that share a bucket share its pivot.
3. A pivot's classes are laid out in blocks of about ``BLOCK`` n-grams, a class counting as ``ROW_COST`` more; a cell holds two blocks. ``_cell`` compares MinHash values 16 at a time and
   drops a pair once the posterior probability (uniform prior) that its similarity reaches the threshold falls below ``TOLERANCE``; the rest is
   counted exactly on the n-gram sets. A pair that meets in several pivots is counted at the least of them.
4. A cell returns the number of links of each class and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .graph import components
from .text import LAST, mix, odd_constants, rows_of, spans, tagged, untag, window_hashes, word_hashes

HASHES, ROWS, STEP, TOLERANCE, BLOCK = 128, 4, 16, 1e-7, 1_000_000
ROW_COST = 200  # what a class costs in a cell besides its n-grams (MinHash values, pivots, objects), in n-grams
_SLICE = 1 << 15


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word windows; a shorter text is one window of all its words; no words, no windows."""
    h = word_hashes(text)
    if len(h) == 0:
        return h
    width = min(n, len(h))
    return np.unique(window_hashes(h, np.arange(len(h) - width + 1), width, 100 + width))


def minhashes(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values of the sets that begin at ``starts``: one row for each, ``HASHES`` unsigned 32-bit values."""
    factor, mask = odd_constants(HASHES, 201), odd_constants(HASHES, 202)
    out = np.full((len(starts), HASHES), 0xFFFFFFFF, np.uint32)
    lens = np.diff(starts, append=len(sets))
    owner = np.repeat(np.arange(len(starts)), lens)
    for lo in range(0, len(sets), _SLICE):
        part, own = sets[lo:lo + _SLICE], owner[lo:lo + _SLICE]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        who = own[first]
        for k in range(HASHES):
            v = ((part ^ mask[k]) * factor[k]) >> np.uint64(32)
            out[who, k] = np.minimum(out[who, k], np.minimum.reduceat(v, first).astype(np.uint32))
    return out


FEATURES = "id long, rid long, key binary, size int, sig binary"


def _features(n: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids, rids, sets = [], [], []
            for id_, rid, text in rows_of(iter([b]), "id", "rid", "text"):
                ids.append(id_)
                rids.append(rid)
                sets.append(shingles(text, n))
            lens = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(lens)
            keys, sigs = [None] * len(ids), [None] * len(ids)
            if len(some):
                flat, starts = np.concatenate(sets), spans(lens[some])[0]
                first, second = np.add.reduceat(mix(flat.copy()), starts), np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                sig = minhashes(flat, starts).astype("<u4")
                for i, k in enumerate(some):
                    keys[k], sigs[k] = first[i].tobytes() + second[i].tobytes(), sig[i].tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(rids, pa.int64()), pa.array(keys, pa.binary()), pa.array(lens, pa.int32()), pa.array(sigs, pa.binary())],
                names=[x.split()[0] for x in FEATURES.split(", ")])

    return run


def least_matches(threshold: Fraction) -> list[int]:
    """For 16, 32, ... compared values: matches below this leave P(similarity >= threshold) under ``TOLERANCE``.

    With a uniform prior the posterior after m matches of k is Beta(m + 1, k - m + 1), and P(J >= t) = P(Binomial(k + 1, t) <= m).
    """
    out = []
    for k in range(STEP, HASHES + 1, STEP):
        mass, m = Fraction(0), -1
        while m < k:
            mass += comb(k + 1, m + 1) * threshold ** (m + 1) * (1 - threshold) ** (k - m)
            if mass >= TOLERANCE:
                break
            m += 1
        out.append(m + 1)
    return out


MEMBER_SCHEMA = "pivot long, i int, j int, block int, rid long, pivots binary, sig binary, grams binary"


def _members(n: int):
    """Send each class to the cells of its pivots, with its n-gram set."""

    def run(batches):
        for rid, text, homes in rows_of(batches, "rid", "text", "homes"):
            grams = shingles(text, n)
            sig = minhashes(grams, np.zeros(1, np.int64))[0].astype("<u4").tobytes()
            pivots = np.sort(np.array([h["pivot"] for h in homes], "<i8")).tobytes()
            cells = []
            for h in homes:
                own = (rid ^ h["pivot"]) % h["blocks"]
                cells += [(h["pivot"], min(own, other), max(own, other), own) for other in range(h["blocks"])]
            data = grams.astype("<u8").tobytes()
            per = max(1, (4 << 20) // (len(data) + 1000))
            for lo in range(0, len(cells), per):
                part = cells[lo:lo + per]
                p, i, j, o = zip(*part, strict=True)
                m = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p, pa.int64()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(o, pa.int32()), pa.array([rid] * m, pa.int64()),
                     *(pa.array([x] * m, pa.binary()) for x in (pivots, sig, data))], names=[x.split()[0] for x in MEMBER_SCHEMA.split(", ")])

    return run


def _earlier(a: list[np.ndarray], b: list[np.ndarray], pivot: int) -> np.ndarray:
    """Whether members of a and b share a pivot smaller than this one."""
    a, b = [x[x < pivot] for x in a], [x[x < pivot] for x in b]
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    left, right = np.zeros((len(a), len(both)), np.float32), np.zeros((len(b), len(both)), np.float32)
    for m, rows in ((left, a), (right, b)):
        for i, x in enumerate(rows):
            m[i, np.searchsorted(both, x[np.isin(x, both)])] = 1
    return left @ right.T > 0


def _cell(threshold: Fraction):
    enough = least_matches(threshold)
    num, den = threshold.numerator, threshold.denominator

    def links(grams_a, grams_b, sig_a, sig_b, piv_a, piv_b, pivot, same):
        """For each row of a with links: its place and the linked places in b."""
        sizes = np.array([len(g) for g in grams_b], np.int64)
        flat = np.concatenate(grams_b)
        values, flat = np.unique(flat, return_inverse=True)
        starts = spans(sizes)[0]
        mark = np.zeros(len(values), bool)
        for lo in range(0, len(grams_a), 64):
            rows = slice(lo, lo + 64)
            a, b = np.nonzero(~_earlier(piv_a[rows], piv_b, pivot))
            if same:
                a, b = a[b > a + lo], b[b > a + lo]
            hits = np.zeros(len(a), np.int64)
            for step, least in enumerate(enough):
                cols = slice(step * STEP, step * STEP + STEP)
                for k in range(0, len(a), 1 << 18):
                    part = slice(k, k + (1 << 18))
                    hits[part] += (sig_a[rows][a[part], cols] == sig_b[b[part], cols]).sum(1)
                live = hits >= least
                a, b, hits = a[live], b[live], hits[live]
            bounds = np.searchsorted(a, np.arange(65))
            for r in range(min(64, len(grams_a) - lo)):
                others = b[bounds[r]:bounds[r + 1]]
                if not len(others):
                    continue
                own = grams_a[lo + r]
                at = np.searchsorted(values, own)
                at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == own)]
                mark[at] = True
                n = sizes[others]
                begin, run, place = spans(n)
                common = np.add.reduceat(mark[flat[starts[others][run] + place]].astype(np.int64), begin)
                mark[at] = False
                linked = others[common * den >= num * (len(own) + n - common)]
                if len(linked):
                    yield lo + r, linked

    def run(t: pa.Table) -> pa.Table:
        col = {n: t.column(n).to_pylist() for n in ("rid", "block", "grams", "sig", "pivots")}
        pivot, i, j = (t.column(n)[0].as_py() for n in ("pivot", "i", "j"))
        rid, block = np.array(col["rid"], np.int64), np.array(col["block"])
        sig = np.frombuffer(b"".join(col["sig"]), "<u4").reshape(len(rid), HASHES)
        grams, pivots = [np.frombuffer(x, "<u8") for x in col["grams"]], [np.frombuffer(x, "<i8") for x in col["pivots"]]
        sides = [np.flatnonzero(block == k) for k in (i, j)]
        count, root = np.zeros(len(rid), np.int64), np.arange(len(rid))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        if all(len(s) for s in sides):
            take = lambda xs, s: [xs[k] for k in s]
            a, b = sides
            for x, ys in links(take(grams, a), take(grams, b), sig[a], sig[b], take(pivots, a), take(pivots, b), pivot, i == j):
                count[a[x]] += len(ys)
                count[b[ys]] += 1
                for y in b[ys]:
                    u, v = find(a[x]), find(y)
                    if u != v:
                        root[max(u, v)] = min(u, v)
        some = np.flatnonzero(count)
        return pa.table({"rid": pa.array(rid[some], pa.int64()), "links": pa.array(count[some], pa.int64()), "peer": pa.array([int(rid[find(x)]) for x in some], pa.int64())})

    return run


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, rows_too: bool = False) -> DataFrame:
    """One row per document: ``id_col, class_id, n_copies, n_links, group_id``.

    ``class_id`` is the least id with the same set of ``n``-word windows and ``n_copies`` the size of that class. ``n_links`` counts the other classes
    with Jaccard similarity of at least ``threshold``, and ``group_id`` is the least id that links reach, directly or through others. A text of
    fewer than ``n`` words is one window; null, empty and blank texts are not similar to anything, so they are classes of their own. Ids may be
    tied or null (null counts as largest); equal rows get equal results; other columns are ignored; an empty table gives no rows.
    ``rows_too`` adds ``row_key`` (``row_keys`` of the row, for joins where ids may be tied or null) and ``first``, true for the row that stands
    for its group: the one of least id, and of least key among tied ids.
    """
    limit = Fraction(threshold).limit_denominator(10_000)
    rows = tagged(docs, id_col, text_col)
    feats = cut(rows.mapInArrow(_features(n), FEATURES))
    full = feats.filter("key IS NOT NULL")
    classes = cut(full.groupBy("key").agg(F.min(F.struct("id", "rid", "size")).alias("head"), F.count("*").alias("n_copies")).select(
        "key", F.col("head.id").alias("class_id"), F.col("head.rid").alias("rid"), F.col("head.size").alias("size"), "n_copies"))
    heads = full.select("rid", "sig").join(classes.select("rid"), "rid").dropDuplicates(["rid"])
    width = 4 * ROWS
    bands = heads.select("rid", F.explode(F.expr(f"transform(sequence(0, {HASHES // ROWS - 1}), b -> xxhash64(b, substring(sig, b * {width} + 1, {width})))")).alias("band"))
    pivots = bands.groupBy("band").agg(F.min("rid").alias("pivot"), F.count("*").alias("rows")).filter("rows > 1").select("band", "pivot")
    homes = cut(bands.join(pivots, "band").select("rid", "pivot").distinct())
    # Written first, so that adaptive execution sees two plain sides and can split the members of a large pivot.
    blocks = cut(homes.join(classes.select("rid", "size"), "rid").groupBy("pivot").agg(F.ceil(F.sum(F.col("size") + ROW_COST) / BLOCK).cast("int").alias("blocks")))
    members = homes.join(blocks, "pivot").groupBy("rid").agg(F.collect_list(F.struct("pivot", "blocks")).alias("homes"))
    texts = rows.select("rid", "text").join(members, "rid").dropDuplicates(["rid"])
    found = cut(texts.mapInArrow(_members(n), MEMBER_SCHEMA).groupBy("pivot", "i", "j").applyInArrow(_cell(limit), "rid long, links long, peer long"))
    links = found.groupBy("rid").agg(F.sum("links").alias("n_links"))
    groups = components(found.select(F.col("rid").alias("a"), F.col("peer").alias("b")))
    least = groups.join(classes.select(F.col("rid").alias("node"), "class_id"), "node").withColumnRenamed("node", "rid")
    heads = least.groupBy("label").agg(F.min(F.struct("class_id", "rid")).alias("head"))
    least = least.join(heads, "label").select("rid", F.col("head.class_id").alias("group_id"), F.col("head.rid").alias("group_rid"))
    table = classes.select("key", "rid", "class_id", "n_copies").join(links, "rid", "left").join(least, "rid", "left").withColumnRenamed("rid", "class_rid")
    out = feats.select("id", "rid", "key").join(table, "key", "left")
    alone = F.col("key").isNull()
    first = alone | (F.col("rid") == F.coalesce("group_rid", "class_rid"))
    group = F.coalesce("group_id", "class_id")
    return out.select(
        untag("id").alias(id_col), F.when(alone, untag("id")).otherwise(untag("class_id")).alias("class_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(alone, untag("id")).otherwise(F.when(group != LAST, group)).alias("group_id"),
        *([F.col("rid").alias("row_key"), first.alias("first")] if rows_too else []),
    )
