"""Removal of passages that repeat across documents, found through difference-cover anchors.

A window is ``window`` consecutive words. With ``period`` p and a difference cover D of p, any two positions have a common shift below p that takes
both to cover positions (position mod p in D). So two equal windows share an anchor of ``window - p + 1`` words that starts at a cover position in
both, at the same place of the window. Only anchors are hashed and exchanged (3 of 7 positions for 13 words); windows around anchors that two
documents share are then extended to full length and compared as 96-bit hashes.

1. Copies of a whole text are settled by the hash of the text, so a group of copies costs one representative.
2. ``_anchors``: a batch of documents settles the anchors that repeat inside it and sends one marker for each; all others go, packed by hash
   bucket, to ``_shared``, which finds those that occur in two documents. A frequent passage therefore reaches its bucket once for each batch.
3. ``_windows``: documents with shared anchors extend them. Inside a batch, all but the smallest document of a window are settled; the smallest
   ones go, packed in the same way, to ``_later``, which keeps those that a smaller document has too.
4. ``_kept`` drops the covered words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .text import mix, rows_of, spans, tagged, untag, window_hashes, word_hashes, words

BATCH_WORDS = 1_500_000
BUCKET_ANCHORS = 2_000_000
_48 = np.uint64((1 << 48) - 1)


def difference_cover(period: int) -> tuple[int, ...]:
    """A small set whose differences modulo ``period`` are all residues: greedy, and perfect for 7 (0, 1, 3)."""
    cover, seen = [0], {0}
    while len(seen) < period:
        best = max(range(period), key=lambda c: (len({(c - x) % period for x in cover} | {(x - c) % period for x in cover} | seen), -c))
        seen |= {(best - x) % period for x in cover} | {(x - best) % period for x in cover}
        cover.append(best)
    return tuple(sorted(cover))


def pack(doc: np.ndarray, pos: np.ndarray, rids: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """(doc, pos) pairs in ascending order as runs (row key, first position, length) and 16-bit steps."""
    if not len(doc):
        return b"", b"", b"", b""
    step = np.diff(pos, prepend=0)
    new = np.r_[True, doc[1:] != doc[:-1]] | (step > 65535) | (step < 0)
    at = np.flatnonzero(new)
    step[at] = 0
    return rids[doc[at]].tobytes(), pos[at].astype("<u4").tobytes(), np.diff(at, append=len(doc)).astype("<u4").tobytes(), step.astype("<u2").tobytes()


def unpack(rid: bytes, base: bytes, count: bytes, step: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(count, "<u4").astype(np.int64)
    starts, run, _ = spans(n)
    total = np.cumsum(np.frombuffer(step, "<u2").astype(np.int64))
    pos = total - total[starts][run] + np.frombuffer(base, "<u4").astype(np.int64)[run] if len(n) else total
    return np.frombuffer(rid, "<i8")[run], pos


PACKED = "bucket int, rid binary, base binary, cnt binary, step binary, a binary, b binary, c binary, lrid binary, lbase binary, lcnt binary, lstep binary"
_PACKED = [x.split()[0] for x in PACKED.split(", ")]


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 16):
        part = list(zip(*rows[i:i + 16], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), *(pa.array(c, pa.binary()) for c in part[1:])], names=_PACKED)


def _split(key: np.ndarray, at: np.ndarray) -> dict[int, np.ndarray]:
    """``at`` by the bucket in ``key``, each part in its old order; only buckets that occur."""
    order = np.argsort(key, kind="stable")
    first = _heads(key[order])
    return {k: at[order[a:b]] for k, a, b in zip(key[order[first]].tolist(), first.tolist(), [*first[1:].tolist(), len(key)], strict=False)}


def _together(*parts: dict[int, np.ndarray]) -> Iterator[tuple]:
    """Each bucket that any part reaches, with its piece of every part."""
    none = np.zeros(0, np.int64)
    for k in sorted(set().union(*parts)):
        yield (k, *(p.get(k, none) for p in parts))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h.copy()) % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.int64)


def _lists(t: pa.Table) -> tuple[list, list, np.ndarray]:
    """What a bucket holds: the (row key, position) lists of its entries and of settled ones, and how many entries each run has."""
    col = [t.column(n).to_pylist() for n in _PACKED[1:]]
    own, local = [unpack(*x) for x in zip(*col[:4], strict=True)], [unpack(*x) for x in zip(*col[7:], strict=True)]
    return own, local, np.frombuffer(b"".join(col[2]), "<u4").astype(np.int64)


def _column(t: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _anchors(window: int, period: int, buckets: int):
    cover, width = np.array(difference_cover(period)), window - period + 1

    def flush(rids, arrays):
        rids, lens = np.array(rids, "<i8"), np.array([len(a) for a in arrays])
        hashes = np.concatenate(arrays)
        _, doc, pos = spans(lens)
        at = np.flatnonzero(np.isin(pos % period, cover) & (pos + width <= lens[doc]))
        doc, pos, h = doc[at], pos[at], window_hashes(hashes, at, width, 7)
        order = np.argsort(h, kind="stable")
        sh, sd = h[order], doc[order]
        first = _heads(sh)
        size = np.diff(first, append=len(sh))
        shared = sd[first] != sd[first + size - 1]
        settled = np.zeros(len(h), bool)
        settled[order] = np.repeat(shared, size)
        many, own, local = sh[first[shared]], np.flatnonzero(~settled), np.flatnonzero(settled)
        # Settled entries only have to reach the row they are of, so they are dealt out by its key.
        parts = _together(_split(_bucket(h[own], buckets), own), _split(_bucket(many, buckets), np.arange(len(many))), _split(_bucket(rids.view("<u8")[doc[local]], buckets), local))
        rows = []
        for k, o, m, c in parts:
            low = h[o] & _48
            rows.append((k, *pack(doc[o], pos[o], rids), (low & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), (low >> np.uint64(32)).astype("<u2").tobytes(),
                         (many[m] & _48).tobytes(), *pack(doc[c], pos[c], rids)))
        yield from _batches(rows)

    def run(batches):
        rids, arrays, held = [], [], 0
        for rid, text in rows_of(batches, "rid", "text"):
            h = word_hashes(text)
            if len(h) >= window:
                rids.append(rid)
                arrays.append(h)
                held += len(h)
            if held >= BATCH_WORDS:
                yield from flush(rids, arrays)
                rids, arrays, held = [], [], 0
        if held:
            yield from flush(rids, arrays)

    return run


def _by_row(own: list, local: list, hit: np.ndarray) -> pa.Table:
    """Positions of the chosen entries and the settled ones, by row key."""
    rid, pos = (np.concatenate([np.concatenate([x[i] for x in own])[hit], *(x[i] for x in local)]) for i in (0, 1))
    order = np.lexsort((pos, rid))
    rid, pos = rid[order], pos[order].astype("<u4")
    first = _heads(rid)
    ends = np.append(first[1:], len(rid))[:len(first)]
    return pa.table({"rid": pa.array(rid[first], pa.int64()), "pos": pa.array([pos[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())})


def _shared(t: pa.Table) -> pa.Table:
    """Anchors of one bucket that occur in two rows, with those settled before."""
    own, local, _ = _lists(t)
    low = _column(t, "a", "<u4").astype(np.uint64) | _column(t, "b", "<u2").astype(np.uint64) << np.uint64(32)
    order = np.argsort(low)
    first, rid = _heads(low[order]), np.concatenate([x[0] for x in own])[order]
    hit = np.zeros(len(low), bool)
    if len(low):
        two = (np.minimum.reduceat(rid, first) != np.maximum.reduceat(rid, first)) | np.isin(low[order][first], _column(t, "c", "<u8"))
        hit[order] = np.repeat(two, np.diff(first, append=len(low)))
    return _by_row(own, local, hit)


def _windows(window: int, period: int, buckets: int):
    def flush(ids, rids, lens, hashes, marks):
        ids, rids = np.array(ids, "<i8"), np.array(rids, "<i8")
        lens, hashes, marks = np.array(lens), np.concatenate(hashes), np.concatenate(marks)
        _, doc, pos = spans(lens)
        near = np.concatenate([[0], np.cumsum(marks)])
        end = np.minimum(np.arange(len(marks)) + period, len(marks))
        at = np.flatnonzero((near[end] > near[:-1]) & (pos + window <= lens[doc]))
        if not len(at):
            return
        doc, pos = doc[at], pos[at]
        h1, h2 = window_hashes(hashes, at, window, 13), window_hashes(hashes, at, window, 31) >> np.uint64(32)
        order = np.lexsort((h2, h1))
        first = _heads(h1[order], h2[order])
        least = np.empty(len(at), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(ids[doc[order]], first), np.diff(first, append=len(at)))
        done = ids[doc] > least
        own, local = np.flatnonzero(~done), np.flatnonzero(done)
        rows = []
        for k, o, c in _together(_split(_bucket(h1[own], buckets), own), _split(_bucket(rids.view("<u8")[doc[local]], buckets), local)):
            packed = pack(doc[o], pos[o], rids)
            rows.append((k, *packed, h1[o].astype("<u8").tobytes(), h2[o].astype("<u4").tobytes(), pack(doc[o], pos[o], ids)[0], *pack(doc[c], pos[c], rids)))
        yield from _batches(rows)

    def run(batches):
        held: list[list] = [[], [], [], [], []]
        total = 0
        for id_, rid, text, found in rows_of(batches, "id", "rid", "text", "pos"):
            h = word_hashes(text)
            total += len(h)
            mark = np.zeros(len(h), np.int64)
            mark[np.frombuffer(b"".join(found), "<u4")] = 1
            for x, y in zip(held, (id_, rid, len(h), h, mark), strict=True):
                x.append(y)
            if total >= BATCH_WORDS:
                yield from flush(*held)
                held, total = [[], [], [], [], []], 0
        if held[0]:
            yield from flush(*held)

    return run


def _later(t: pa.Table) -> pa.Table:
    """Windows of one bucket that a document with a smaller id has too, with those settled before."""
    own, local, runs = _lists(t)
    h1, h2, ids = _column(t, "a", "<u8"), _column(t, "b", "<u4"), np.repeat(_column(t, "c", "<i8"), runs)
    order = np.lexsort((h2, h1))
    first = _heads(h1[order], h2[order])
    hit = np.zeros(len(h1), bool)
    if len(h1):
        hit[order] = ids[order] > np.repeat(np.minimum.reduceat(ids[order], first), np.diff(first, append=len(h1)))
    return _by_row(own, local, hit)


def _kept(window: int):
    def run(batches):
        for b in batches:
            out: dict[str, list] = {"id": [], "n_words": [], "n_removed": [], "kept": []}
            for id_, text, copy, found in rows_of(iter([b]), "id", "text", "copy", "found"):
                w = words(text)
                n = len(w)
                if copy and n >= window:
                    w = []
                elif found:
                    starts = np.frombuffer(b"".join(found), "<u4").astype(np.int64)
                    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + window, minlength=n + 1)
                    w = [w[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0)]
                for name, v in zip(out, (id_, n, n - len(w), b" ".join(w).decode("utf-8", "surrogatepass")), strict=True):
                    out[name].append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(out[c], pa.int64()) for c in ("id", "n_words", "n_removed")), pa.array(out["kept"], pa.string())], names=list(out))

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Drop each word covered by a window whose words also start in a document with a smaller id.

    Returns ``id_col, n_words, n_removed, kept`` (the words that stay, joined by one space). Windows are judged on the input. A null text has no
    words, a text of fewer than ``window`` words keeps all; rows that share an id don't shorten each other; a null id counts as the largest.
    Equal rows give equal results, other columns are ignored, an empty table gives no rows.
    """
    if window < 2:
        raise ValueError("a window needs two words")
    period = (window + 1) // 2
    rows = tagged(docs, id_col, text_col)
    marks = cut(rows.select("id", "rid", F.md5("text").alias("same"), F.length("text").alias("n")))
    # Written first, so that adaptive execution sees two plain sides and can split the copies of one text.
    first = cut(marks.groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1").select("same", "first"))
    copies = cut(marks.join(first, "same").filter("id > first").select("rid").distinct())
    chars = marks.agg(F.sum("n")).first()[0] or 0
    # Three anchors for each seven words of some six characters. The figure only sets how finely the hash space is cut.
    buckets = max(32, int(chars / 14 / BUCKET_ANCHORS) + 1)
    anchors = (
        rows.select("rid", "text").mapInArrow(_anchors(window, period, buckets), PACKED)
        .groupBy("bucket").applyInArrow(_shared, "rid long, pos binary")
        .join(copies, "rid", "left_anti").groupBy("rid").agg(F.collect_list("pos").alias("pos"))
    )
    found = rows.join(anchors, "rid").select("id", "rid", "text", "pos").mapInArrow(_windows(window, period, buckets), PACKED)
    gone = found.groupBy("bucket").applyInArrow(_later, "rid long, pos binary").groupBy("rid").agg(F.collect_list("pos").alias("found"))
    plan = gone.select("rid", "found", F.lit(False).alias("copy")).unionByName(copies.select("rid", F.lit(None).cast("array<binary>").alias("found"), F.lit(True).alias("copy")))
    out = rows.join(plan, "rid", "left").select("id", "text", "copy", "found").mapInArrow(_kept(window), "id long, n_words long, n_removed long, kept string")
    return out.select(untag("id").alias(id_col), "n_words", "n_removed", "kept")
