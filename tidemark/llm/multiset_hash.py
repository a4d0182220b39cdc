"""Homomorphic multiset fingerprints of documents.

A text is the multiset of its paragraphs (lines split at ``\\n``, empty ones included). Each paragraph is hashed to a wide vector and the vectors are
added modulo 2**32, so the order of paragraphs does not matter, equal multisets have equal sums, and inserting or deleting a paragraph adds or
subtracts its vector. A vector has two blocks:

* ``IDENTITY`` lanes, uniform 32-bit words of an extendable hash of the paragraph: they tell different multisets apart;
* ``SKETCH`` lanes, signed counts of the paragraph's ``GRAM``-character windows, each hashed to one lane and one sign: the cosine of two sums
  estimates the cosine of their window counts, so likeness can be read off two fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .text import mix, odd_constants, rows_of, tagged, untag

IDENTITY, SKETCH, GRAM = 256, 512, 12
PRINTED = 16  # identity lanes of a printed fingerprint: 512 bits
_CHUNK = 1 << 16
_A, _B, _C, _D, _E = odd_constants(5, 12)


def _sketch(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    counts = np.zeros(2 * SKETCH, np.int64)
    shift = np.uint64(64 - (2 * SKETCH).bit_length() + 1)
    for lo in range(0, len(points) - GRAM + 1, _CHUNK):
        part = points[lo:lo + _CHUNK + GRAM - 1]
        one = mix(part.astype(np.uint64) + _E)
        two = one[:-1] * _A + one[1:]
        four = two[:-2] * _B + two[2:]
        eight = four[:-4] * _C + four[4:]
        h = mix(eight[:-4] * _D + four[8:])
        breaks = np.cumsum(np.concatenate([[0], part == 10]))
        whole = breaks[GRAM:] == breaks[:-GRAM]
        counts += np.bincount((h[whole] >> shift).astype(np.int64), minlength=2 * SKETCH)
    out = counts.reshape(SKETCH, 2)
    out = out[:, 0] - out[:, 1]
    for p in text.split("\n"):
        if 0 < len(p) < GRAM:
            h = int.from_bytes(hashlib.blake2b(p.encode(), digest_size=8).digest(), "little") % (2 * SKETCH)
            out[h // 2] += 1 - 2 * (h % 2)
    return out.astype(np.int32).view(np.uint32)


def vector(text: str) -> np.ndarray:
    """The sum of the vectors of all paragraphs of a text."""
    digests = b"".join(hashlib.shake_128(p.encode()).digest(4 * IDENTITY) for p in text.split("\n"))
    return np.concatenate([np.frombuffer(digests, "<u4").reshape(-1, IDENTITY).sum(0, dtype=np.uint32), _sketch(text)])


def insert(total: np.ndarray, paragraphs: str, lanes: int | None = None) -> np.ndarray:
    return total + vector(paragraphs)[:lanes]


def delete(total: np.ndarray, paragraphs: str, lanes: int | None = None) -> np.ndarray:
    return total - vector(paragraphs)[:lanes]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated cosine of the window counts, 0 to 1; 1 for equal fingerprints."""
    if np.array_equal(a, b):
        return 1.0
    x, y = a[IDENTITY:].view(np.int32).astype(float), b[IDENTITY:].view(np.int32).astype(float)
    norm = np.sqrt((x @ x) * (y @ y))
    return float(np.clip(x @ y / norm, 0.0, 1.0)) if norm else 0.0


def printed(v: np.ndarray) -> str:
    """The first identity lanes of a vector in hex. They add up like the vector, so a printed fingerprint can be updated."""
    return v[:PRINTED].astype("<u4").tobytes().hex()


def updated(fingerprint: str, inserted: str | None = None, deleted: str | None = None) -> str:
    """A printed fingerprint after paragraphs were inserted or deleted; the text itself is not needed."""
    v = np.frombuffer(bytes.fromhex(fingerprint), "<u4").astype(np.uint32)
    if inserted is not None:
        v = insert(v, inserted, PRINTED)
    return printed(v if deleted is None else delete(v, deleted, PRINTED))


def replaced(text: str, following: str) -> tuple[str, int]:
    """The text with its last third replaced by the start of the next, and where the changed paragraphs begin."""
    k = len(text) // 3
    at = len(text) - k
    return text[:at] + following[:k], text.rfind("\n", 0, at) + 1


RESULT = "kind int, id long, rid long, n_chars long, edited_sha256 string, vector binary, edited_vector binary, near_edited double, near_next double, text string"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.string()]


def _result(id_, rid, text, own, following, theirs, wide):
    edited, at = replaced(text, following)
    changed = insert(delete(own, text[at:]), edited[at:]) if edited != text else own
    show = lambda v: v[:None if wide else PRINTED].astype("<u4").tobytes()
    return (0, id_, rid, len(text), hashlib.sha256(edited.encode()).hexdigest(), show(own), show(changed), likeness(own, changed), likeness(own, theirs), None)


def _batches(rows):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 300 + len(row[5] or b"") * 2 + len(row[9] or "")
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names=_NAMES)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names=_NAMES)


def _walk(wide: bool):
    """Rows arrive by ascending id, so the next one in descending order has just been seen; the first row of a task waits for its neighbour."""

    def rows(batches):
        before = None
        for id_, rid, text in rows_of(batches, "id", "rid", "text"):
            own = vector(text)
            yield (1, id_, rid, None, None, None, None, None, None, text) if before is None else _result(id_, rid, text, own, *before[2:], wide)
            before = (id_, rid, text, own)
        if before is not None:
            yield (2, before[0], before[1], None, None, None, None, None, None, before[2])

    return lambda batches: _batches(rows(batches))


def _edge(wide: bool):
    def rows(batches):
        for id_, rid, text, following in rows_of(batches, "id", "rid", "text", "following"):
            yield _result(id_, rid, text, vector(text), following, vector(following), wide)

    return lambda batches: _batches(rows(batches))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: bool = True) -> DataFrame:
    """Fingerprint every text and its edited form: the last third replaced by the start of the next document in descending order of id.

    Returns ``id_col, n_chars, edited_sha256, vector, edited_vector, near_edited, near_next``; ``wide=False`` returns only their first
    ``PRINTED`` identity lanes, which ``updated`` can still insert into and delete from. A null text is empty (one empty paragraph). Tied ids are ordered by a hash of the text, null ids come first in
    descending order, the last document is followed by the first, a single document by itself. Other columns are ignored; no rows give no rows.

    The texts are shuffled once, by ranges of the id. Each task settles all its rows but the first, whose neighbour is the last row of another
    task; these few (one for each task) are joined afterwards. The driver sees only their ids.
    """
    rows = tagged(docs, id_col, text_col).repartitionByRange("id", "rid").sortWithinPartitions("id", "rid")
    walked = cut(rows.mapInArrow(_walk(wide), RESULT))
    ends: dict[int, list] = {1: [], 2: []}
    for r in walked.filter("kind > 0").select("kind", "id", "rid").collect():
        ends[r.kind].append((r.id, r.rid))
    firsts, tails = sorted(ends[1]), sorted(ends[2])
    pairs = [(*f, *t) for f, t in zip(firsts, tails[-1:] + tails[:-1], strict=True)]
    spark = docs.sparkSession
    links = spark.createDataFrame(pairs, "id long, rid long, tail_id long, tail_rid long")
    waiting = walked.filter("kind = 1").select("id", "rid", "text").join(links, ["id", "rid"])
    tail = walked.filter("kind = 2").select(F.col("id").alias("tail_id"), F.col("rid").alias("tail_rid"), F.col("text").alias("following"))
    edges = waiting.join(tail, ["tail_id", "tail_rid"]).select("id", "rid", "text", "following").mapInArrow(_edge(wide), RESULT)
    out = walked.filter("kind = 0").unionByName(edges)
    return out.select(untag("id").alias(id_col), "n_chars", "edited_sha256", "vector", "edited_vector", "near_edited", "near_next")
