"""Phrases whose words occur together more often than apart.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and into words at blanks. Phrases of two and three words are counted in two passes.

1. *Summaries.* Texts are packed into chunks of one language and written once. For each chunk the n-grams of one to three words are hashed; the upper bits choose
   a hash partition, 32 more name the n-gram in it. A partition merges the counts of all chunks in a Misra-Gries summary: when more counters are held than the
   capacity, the next largest count is subtracted from all. With a mass m and a capacity above m / threshold the subtractions stay below the threshold in sum, so
   every n-gram that occurs that often survives. Counts of a chunk are clipped at the threshold first, which keeps this true and the mass small.
2. *Exact counts.* Each chunk gets back one bit for each of its hashes, goes over its text again and counts the n-grams that survived, told apart by their words.

Nothing is broadcast and no table of all n-grams is shuffled as text: the first pass moves five bytes for each distinct n-gram of a chunk, the second one only survivors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .text import mix, odd_constants

LONGEST = 3
#: Bytes of text of a chunk; n-grams that a hash partition is meant to hold.
CHUNK, MASS = 4 << 20, 8 << 20

_BREAK = b"."
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_A, _B, _C = odd_constants(LONGEST, 77)


def stream(text: bytes) -> bytes:
    """Words and breaks of a text, each break a word of its own."""
    return text.translate(_TABLE).replace(_BREAK, b" . ")


def sections(text: bytes, size: int | None = None) -> Iterator[tuple[bytes, int]]:
    """A stream in parts of about ``size`` bytes. All but the first repeat up to ``LONGEST - 1`` words of the one before; their number comes with the part."""
    size, text, at, lead = size or CHUNK, stream(text), 0, b""
    while at < len(text):
        stop = text.find(b" ", at + size)
        stop = len(text) if stop < 0 else stop
        part = text[at:stop]
        whole = lead + b" " + part
        yield whole, len(lead.split())
        lead, at = b" ".join(whole.rsplit(None, LONGEST - 1)[1 - LONGEST:]), stop


def _chunks(most: int):
    """Rows of ``lang, text`` packed into rows of one language: words, what they repeat of the row before, compressed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[bytes]] = {}
        sizes: dict[bytes, int] = {}
        made = 0
        task = TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(level=1)

        def row(lang: bytes, parts: list[bytes], lead: int):
            nonlocal made
            text = b" . ".join(parts)
            words = text.split()[lead:]
            n = len(words) - words.count(_BREAK)
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([task + made], pa.int64()), pa.array([lang], pa.binary()), pa.array([n], pa.int64()), pa.array([lead], pa.int32()),
                                               pa.array([squeeze.compress(text)], pa.binary())], names=["chunk", "lang", "words", "lead", "packed"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(text) > most:
                    for part, lead in sections(text, most):
                        yield row(lang, [part], lead)
                    continue
                held.setdefault(lang, []).append(stream(text))
                sizes[lang] = sizes.get(lang, 0) + len(text)
                while sizes[lang] >= most or sum(sizes.values()) >= 4 * most:
                    full = max(sizes, key=sizes.get)
                    del sizes[full]
                    yield row(full, held.pop(full), 0)
                    if lang not in sizes:
                        break
        for lang, parts in held.items():
            yield row(lang, parts, 0)

    return run


class Grams:
    """The n-grams of a chunk: sorted distinct hashes, their counts, and the words to tell them apart."""

    def __init__(self, lang: bytes, packed: bytes, lead: int):
        tokens = zstandard.ZstdDecompressor().decompress(packed).split()
        # The longest phrases start LONGEST - 1 words before they end; breaks in front keep places positive.
        tokens = [_BREAK] * (LONGEST - 1) + tokens
        number: dict[bytes, int] = {_BREAK: 0}
        for t in tokens:
            if t not in number:
                number[t] = len(number)
        self.names = list(number)
        self.ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
        own = np.fromiter((xxhash.xxh3_64_intdigest(t, 5) for t in self.names), np.uint64, len(self.names))
        h, word = own[self.ids], self.ids > 0
        seed = np.uint64(xxhash.xxh3_64_intdigest(lang, 6))
        # An n-gram is counted at its last word. The words repeated from the chunk before only serve as its first ones.
        last = np.flatnonzero(word)
        last = last[last >= LONGEST - 1 + lead]
        self.ends, hashes = [], []
        total = seed + np.zeros(len(last), np.uint64)
        for k, c in enumerate((_A, _B, _C)):
            if k:
                whole = word[last - k]
                last, total = last[whole], total[whole]
            total = total + h[last - k] * c
            self.ends.append(last)
            hashes.append(mix(total + np.uint64(k)))
        self.hashes = np.concatenate(hashes)

    def keys(self, bits: int) -> np.ndarray:
        """Partition in the upper ``bits`` bits, 32 more below."""
        return self.hashes >> np.uint64(32 - bits)

    def exact(self, survives: np.ndarray) -> tuple[list[bytes], list[int], list[int]]:
        """Phrases, their numbers of words and counts, of the occurrences that survive."""
        phrases, lengths, counts, at = [], [], [], 0
        for k, ends in enumerate(self.ends):
            ends = ends[survives[at:at + len(self.ends[k])]]
            at += len(self.ends[k])
            code = self.ids[ends]
            for back in range(1, k + 1):
                _, code = np.unique(self.ids[ends - back] * (int(code.max(initial=0)) + 1) + code, return_inverse=True)
            _, first, count = np.unique(code, return_index=True, return_counts=True)
            columns = [[self.names[i] for i in self.ids[ends[first] - back].tolist()] for back in range(k, -1, -1)]
            phrases += map(b" ".join, zip(*columns, strict=True))
            lengths += [k + 1] * len(first)
            counts += count.tolist()
        return phrases, lengths, counts


def _summaries(bits: int, threshold: int):
    """For each chunk and hash partition that it reaches: the n-grams' lower bits, ascending, and their counts clipped at the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, lang, lead, packed in zip(*(b.column(n).to_pylist() for n in ("chunk", "lang", "lead", "packed")), strict=True):
                key, count = np.unique(Grams(lang, packed, lead).keys(bits), return_counts=True)
                place, start = np.unique((key >> np.uint64(32)).astype(np.int64), return_index=True)
                low, count = key.astype("<u4"), np.minimum(count, threshold).astype(np.uint8)
                stop = np.append(start, len(key))[1:]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(place), chunk)), pa.array(place), pa.array([low[a:z].tobytes() for a, z in zip(start, stop, strict=True)], pa.binary()),
                    pa.array([count[a:z].tobytes() for a, z in zip(start, stop, strict=True)], pa.binary())], names=["chunk", "place", "low", "counts"])

    return run


class Summary:
    """A Misra-Gries summary over 32-bit keys, merged with sorted blocks of keys and counts."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size >= max(1 << 16, len(self.keys)):
            self.settle()

    def settle(self) -> None:
        """Merge what waits; above the capacity, subtract the largest count that does not fit from all."""
        if self.waiting:
            keys = np.concatenate([self.keys] + [k for k, _ in self.waiting])
            counts = np.concatenate([self.counts] + [c.astype(np.int64) for _, c in self.waiting])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            self.keys, self.counts = keys[start], np.add.reduceat(counts, start) if len(keys) else counts
            self.waiting, self.size = [], 0
        if len(self.keys) > self.capacity:
            cutoff = np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1]
            left = self.counts > cutoff
            self.keys, self.counts = self.keys[left], self.counts[left] - cutoff
            self.lost += int(cutoff)

    def survivors(self, threshold: int) -> np.ndarray:
        """Keys that may have occurred ``threshold`` times: a counter falls short of the truth by at most what was subtracted."""
        self.settle()
        return self.keys[self.counts + self.lost >= threshold]


def _merge(threshold: int):
    """All blocks of one hash partition: one bit for each hash of each chunk, set where it survives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Two passes over the partition's blocks (five bytes for an n-gram of a chunk): the mass bounds the capacity.
        held = pa.Table.from_batches(list(batches)).select(["chunk", "place", "low", "counts"])
        chunks = held.column("chunk").to_pylist()
        place = held.column("place")[0].as_py()
        low = [np.frombuffer(x.as_buffer(), "<u4") for x in held.column("low")]
        counts = [np.frombuffer(x.as_buffer(), np.uint8) for x in held.column("counts")]
        mass = sum(int(c.sum(dtype=np.int64)) for c in counts)
        summary = Summary(mass // threshold + 1)
        for k, c in zip(low, counts, strict=True):
            summary.add(k, c)
        kept = summary.survivors(threshold)
        out_chunk, out_bits = [], []
        for chunk, k in zip(chunks, low, strict=True):
            if len(kept):
                at = np.minimum(np.searchsorted(kept, k), len(kept) - 1)
                found = kept[at] == k
                if found.any():
                    out_chunk.append(chunk)
                    out_bits.append(np.packbits(found).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out_chunk, pa.int64()), pa.array([place] * len(out_chunk), pa.int64()), pa.array(out_bits, pa.binary())], names=["chunk", "place", "survives"])

    return run


def _recount(bits: int):
    """A chunk and the bits of its hashes: the exact counts of the n-grams that survive."""

    def run(chunk: pa.Table, bitmaps: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        lang = b""
        if chunk.num_rows and bitmaps.num_rows:
            lang, lead, packed = (chunk.column(n)[0].as_py() for n in ("lang", "lead", "packed"))
            grams = Grams(lang, packed, lead)
            key, where = np.unique(grams.keys(bits), return_inverse=True)
            place, start = np.unique((key >> np.uint64(32)).astype(np.int64), return_index=True)
            stop, survives = np.append(start, len(key))[1:], np.zeros(len(key), bool)
            at = np.searchsorted(place, bitmaps.column("place").to_numpy())
            for i, own in zip(at.tolist(), bitmaps.column("survives").to_pylist(), strict=True):
                n = int(stop[i] - start[i])
                survives[start[i]:stop[i]] = np.unpackbits(np.frombuffer(own, np.uint8), count=n)
            out = grams.exact(survives[where])
        return pa.table({"lang": pa.array([lang] * len(out[0]), pa.binary()), "phrase": pa.array(out[0], pa.binary()), "k": pa.array(out[1], pa.int32()), "f": pa.array(out[2], pa.int64())})

    return run


def frequent_phrases(docs: DataFrame, threshold: int = 10, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, k, f)``: all phrases of 1 to 3 words that occur ``threshold`` times or more in a language; ``(lang, n)``: its word occurrences.

    A null text is empty, a null language is ``und``; repeated rows count each time; other columns are ignored; an empty table gives none.
    """
    if not 1 <= threshold <= 255:
        raise ValueError("the threshold must be 1 to 255: counts of a chunk are clipped at it and stored in a byte")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).cast("binary").alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    rows = rows.filter(F.octet_length("text") > 0)
    chunks = cut(rows.mapInArrow(_chunks(CHUNK), "chunk long, lang binary, words long, lead int, packed binary"))
    sizes = chunks.groupBy("lang").agg(F.sum("words").alias("n"))
    mass = LONGEST * (chunks.agg(F.sum("words")).first()[0] or 0)
    bits = min(31, max(0, math.ceil(math.log2(max(mass, 1) / MASS))))
    blocks = chunks.select("chunk", "lang", "lead", "packed").mapInArrow(_summaries(bits, threshold), "chunk long, place long, low binary, counts binary")
    marks = blocks.groupBy("place").applyInArrow(_merge(threshold), "chunk long, place long, survives binary")
    counted = chunks.select("chunk", "lang", "lead", "packed").groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(_recount(bits), "lang binary, phrase binary, k int, f long")
    counted = counted.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).filter(F.col("f") >= threshold)
    return cut(counted.select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "k", "f")), sizes.select(F.col("lang").cast("string").alias("lang"), "n")


def collocations(docs: DataFrame, threshold: int = 10, inside: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best phrases of two or three words of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of the cut with the lowest score ``floor(10**6 * a * a / (l * r))`` (ties: the earlier cut). Phrases inside a longer
    candidate that has at least ``inside`` percent of their count are dropped. Ranks run to ``top``, by falling score, then count, then the phrase's bytes.
    Nulls, repeated rows and empty tables as in :func:`frequent_phrases`. Arithmetic is exact for counts below 10**15.
    """
    known, sizes = frequent_phrases(docs, threshold, text_col, lang_col)
    spoken = F.split("phrase", " ", -1)
    joined = lambda words, lo, n: F.array_join(F.slice(words, lo, n), " ")
    longer = known.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), spoken.alias("words"))
    cuts = longer.select("lang", "phrase", "k", "a", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cuts = cuts.select("lang", "phrase", "a", "at", joined("words", F.lit(1), F.col("at")).alias("first"), joined("words", F.col("at") + 1, F.col("k") - F.col("at")).alias("rest"))
    count = lambda name, value: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    cuts = cuts.join(count("first", "l"), ["lang", "first"]).join(count("rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    top_half = (wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
    scored = cuts.withColumn("score", F.call_function("div", top_half, (wide("l") * wide("r")).cast("decimal(38,0)")).cast("long"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "at", "l", "r")).alias("x"), F.first("a").alias("a"))
    # Parts of two words and the largest count of a longer candidate around them.
    around = longer.filter("k > 2").select("lang", F.col("a").alias("longest"), "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    around = around.groupBy("lang", joined("words", F.col("at"), F.lit(2)).alias("phrase")).agg(F.max("longest").alias("longest"))
    best = best.join(around, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longest") < inside * F.col("a"), F.lit(True)))
    ranked = best.select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    ranked = ranked.withColumn("rank", place).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
