"""Byte-level BPE by prefix dynamic programming.

For each prefix of a byte string there is exactly one token that ends its encoding. It is the token t ending there for which the token before it, the
last one of the shorter prefix, and t stay apart when the bytes of both are merged by rank. Storing that token for every prefix gives the encoding by
walking back, allows exact appends, and lets an edit recompute only up to where the stored tokens agree again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LAST, rows_of, text_or_empty, untag

PIECES = 600_000  # encoded pieces and last tokens of prefixes a worker remembers; forgotten all at once beyond that
SHORT = 64  # longer pieces keep their prefixes to themselves


class Vocabulary:
    """Ranks of a byte-level BPE. ``data`` has a base64 token and its rank on each line."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        if any(bytes([i]) not in self.ranks for i in range(256)):
            raise ValueError("every single byte must be a token")
        self.tokens = dict(zip(self.ranks.values(), self.ranks, strict=True))
        self.reach: dict[bytes, int] = {}  # the longest token that ends in three bytes
        for t in self.ranks:
            self.reach[t[-3:]] = max(self.reach.get(t[-3:], 0), len(t))
        self.longest = max(self.reach.values())
        self._last: dict[bytes, int] = {}
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE: join the adjacent pair of least rank until none is a token. Only short strings come here."""
        parts = [data[i:i + 1] for i in range(len(data))]
        rank = self.ranks.get
        while len(parts) > 1:
            best, at = min(((r, i) for i in range(len(parts) - 1) if (r := rank(parts[i] + parts[i + 1])) is not None), default=(None, 0))
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Whether the bytes of a token merge to that token."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merge(self.tokens[token]) == [token]
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens can stand side by side in an encoding."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[key] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def extend(self, data: bytes, last: list[int], stop: int) -> None:
        """Fill ``last`` (``last[i]``: the token that ends the first ``i`` bytes) up to ``stop``."""
        get, fits, reach = self.ranks.get, self._fits.get, self.reach.get
        for i in range(len(last), stop + 1):
            low = i - (reach(data[i - 3:i], 2) if i > 2 else i)
            for j in range(low if low > 0 else 0, i):
                t = get(data[j:i])
                if t is None:
                    continue
                if j:
                    p = last[j]
                    ok = fits(p << 32 | t)
                    if ok is None:
                        ok = self.fits(p, t)
                else:
                    ok = self.whole(t)
                if ok:
                    last.append(t)
                    break
            else:
                raise ValueError(f"no token ends the first {i} bytes")

    def last(self, prefix: bytes) -> int:
        """The token that ends the encoding of a short string; pieces that start alike share what is stored for their prefixes."""
        memo, get, n = self._last, self.ranks.get, len(prefix)
        low = n - self.reach.get(prefix[-3:], 2) if n > 2 else 0
        for j in range(low if low > 0 else 0, n):
            t = get(prefix[j:])
            if t is None:
                continue
            if j:
                before = prefix[:j]
                p = memo.get(before)
                if p is None:
                    p = self.last(before)
                ok = self._fits.get(p << 32 | t)
                if ok is None:
                    ok = self.fits(p, t)
            else:
                ok = self.whole(t)
            if ok:
                memo[prefix] = t
                return t
        raise ValueError("no token ends this string")

    def walk(self, last: list[int], stop: int) -> list[int]:
        out = []
        while stop:
            out.append(last[stop])
            stop -= len(self.tokens[last[stop]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """One piece; as in common encoders, a piece that is a token as a whole is that token."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        if len(piece) > SHORT:
            last = [-1]
            self.extend(piece, last, len(piece))
            return self.walk(last, len(piece))
        memo, out = self._last, []
        if len(memo) > PIECES:
            memo.clear()
        while piece:
            t = memo.get(piece)
            if t is None:
                t = self.last(piece)
            out.append(t)
            piece = piece[:-len(self.tokens[t])]
        return out[::-1]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixEncoder:
    """An editable byte string and its encoding as one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> PrefixEncoder:
        self.data += data
        self.vocabulary.extend(self.data, self.last, len(self.data))
        return self

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Replace ``[start, stop)``; returns the number of prefixes that were computed anew.

        Once as many prefixes in a row as the longest token has bytes agree with the old ones, all later ones do.
        """
        old, shift = self.last, len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        self.last = old[:start + 1]
        agree, at = 0, start
        while at < len(self.data):
            at += 1
            self.vocabulary.extend(self.data, self.last, at)
            if at >= start + len(data):
                agree = agree + 1 if at - shift > stop and old[at - shift] == self.last[at] else 0
                if agree >= self.vocabulary.longest:
                    self.last += old[at - shift + 1:]
                    break
        return at - start

    def ids(self) -> list[int]:
        return self.vocabulary.walk(self.last, len(self.data))


class _Pieces(dict):
    """Piece of text -> its ids as little-endian 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECES:
            self.clear()
        found = np.array(self.vocabulary.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = found
        return found


_LOADED: dict[bytes, _Pieces] = {}


def _pieces(data: bytes) -> _Pieces:
    """Tables of a vocabulary, built once in each worker process."""
    key = hashlib.sha256(data).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = _Pieces(Vocabulary(data))
    return _LOADED[key]


def _encode(data, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]):
        pieces = _pieces(data.value)
        found = regex.compile(pattern).finditer
        for b in batches:
            out: list[list] = [[], [], [], []]
            size = 0
            for id_, text in rows_of(iter([b]), "id", "text"):
                ids = b"".join([pieces[m[0]] for m in found(text)])
                for x, v in zip(out, (id_, len(ids) // 4, ids, pieces.vocabulary.decode(np.frombuffer(ids, "<u4").tolist())), strict=True):
                    x.append(v)
                size += len(ids) + len(text)
                if size > 8 << 20:
                    yield _batch(out)
                    out, size = [[], [], [], []], 0
            yield _batch(out)

    return run


def _batch(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["id", "n_tokens", "ids", "decoded"])


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text: ``id_col, n_tokens, ids`` (little-endian unsigned 32-bit integers) and ``decoded`` (the bytes the ids stand for).

    ``vocabulary`` is the path of a rank file on the driver, sent to the workers once (it is some MB, whatever the input). Each match of ``pattern``
    is encoded separately; characters outside all matches are left out, which the usual patterns have none of. A null text is empty and
    has no tokens. Tied, repeated and null ids pass through; other columns are ignored; no rows give no rows.
    """
    with open(vocabulary, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), text_or_empty(text_col).alias("text"))
    out = rows.mapInArrow(_encode(data, pattern), "id long, n_tokens long, ids binary, decoded binary")
    return out.select(untag("id").alias(id_col), "n_tokens", "ids", "decoded")


def decode_ids(vocabulary: str, ids: bytes) -> bytes:
    """The bytes of one packed encoding, for use outside Spark."""
    with open(vocabulary, "rb") as f:
        return Vocabulary(f.read()).decode(np.frombuffer(ids, "<u4").tolist())
