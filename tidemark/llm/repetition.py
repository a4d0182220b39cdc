"""Quality rules on repetition, from suffix arrays.

The suffixes of a text's words are sorted by prefix doubling (many texts at a time, each with words of its own, so that nothing matches across
texts). The longest common prefixes of neighbours give, for every position, the longest repeat that starts there; the intervals of the array with a
common prefix are the maximal repeated substrings, and the union of their spans is what a text repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .text import spans, words

SYMBOLS = "#*$%&|<>"
BATCH_WORDS = 300_000


@dataclass(frozen=True)
class Limits:
    """A text is kept if the base rules pass, repeats of ``min_repeat`` words or more cover at most ``max_covered`` of its words, and no
    repeat has more than ``max_longest`` words."""

    min_words: int = 50
    max_repeat_words: float = 0.5
    min_repeat: int = 8
    max_covered: float = 0.45
    max_longest: int = 100


def suffix_array(ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of texts laid end to end, and the common prefix of each entry with the one before it (0 across texts).

    ``ids`` numbers the words of each text apart from those of all others. Ranks are refined for 1, 2, 4, ... words; only suffixes that still
    share a rank take part, so ordinary prose needs few rounds over few positions.
    """
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, text, place = spans(lens)
    left = lens[text] - place  # words from here to the end of the text
    order = np.argsort(ids, kind="stable")
    levels, h = [], 1
    ranks = np.empty(n, np.int64)
    first = np.r_[True, ids[order][1:] != ids[order][:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    ranks[order] = start
    sa = order
    levels.append((1, ranks.copy()))
    while True:
        size = np.bincount(ranks, minlength=n)
        tied = np.flatnonzero(size[ranks[sa]] > 1)  # places in the array
        if not len(tied):
            break
        suffix = sa[tied]
        rank = ranks[suffix]
        more = left[suffix] > h
        after = np.where(more, ranks[np.minimum(suffix + h, n - 1)] + 1, 0)
        by = np.lexsort((after, rank))
        suffix, rank, after = suffix[by], rank[by], after[by]
        sa[tied] = suffix
        head = np.r_[True, (rank[1:] != rank[:-1]) | (after[1:] != after[:-1])]
        # A suffix that ends here matches no other to this length.
        head |= after == 0
        head[1:] |= after[:-1] == 0
        ranks[suffix] = tied[np.maximum.accumulate(np.where(head, np.arange(len(tied)), 0))]
        h *= 2
        levels.append((h, ranks.copy()))
    common = np.zeros(n, np.int64)
    a, b = sa[:-1].copy(), sa[1:].copy()
    total = np.zeros(n - 1, np.int64)
    live = np.arange(n - 1)
    for width, rank in reversed(levels):
        same = live[(a[live] < n) & (b[live] < n)]
        same = same[rank[a[same]] == rank[b[same]]]
        total[same] += width
        a[same] += width
        b[same] += width
        ended = (a >= n) | (b >= n)
        live = live[~ended[live]]
    common[1:] = total
    return sa, common


def longest_repeats(ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """For every position, the words of the longest repeat of its text that starts there."""
    sa, common = suffix_array(ids, lens)
    out = np.zeros(len(ids), np.int64)
    out[sa] = np.maximum(common, np.append(common[1:], 0))
    return out


def covered(repeats: np.ndarray, least: int) -> np.ndarray:
    """Positions inside a repeat of ``least`` words or more."""
    n = len(repeats)
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(repeats >= least)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + repeats[at], -1)
    return np.cumsum(edge[:-1]) > 0


def maximal_repeats(text: str, least: int = 1) -> list[tuple[int, list[int]]]:
    """Maximal repeated substrings of a text as (words, starts): the common-prefix intervals that no word extends to the left."""
    found = words(text)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in found], np.int64)
    sa, common = suffix_array(ids, np.array([len(ids)]))
    out, stack = [], []  # stack: (length, first entry)
    for i in range(1, len(sa) + 1):
        length, first = (int(common[i]) if i < len(sa) else 0), i - 1
        while stack and stack[-1][0] > length:
            top, first = stack.pop()
            starts = sorted(int(x) for x in sa[first:i])
            before = {ids[s - 1] if s else -1 - s for s in starts}
            if top >= least and len(before) > 1:
                out.append((top, starts))
        if length and (not stack or stack[-1][0] < length):
            stack.append((length, first))
    return sorted(out, key=lambda x: (-x[0], x[1]))


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest")
_SPACE = " \t\n\x0b\x0c\r"


def _lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


def _figures(group: list[tuple], ids: list[np.ndarray], least: int) -> np.ndarray:
    """One row of ``FIGURES`` for each text of a group."""
    lens = np.array([len(x) for x in ids])
    # Each text gets numbers of its own.
    repeats = longest_repeats(np.concatenate(ids) + np.repeat(np.cumsum(lens) - lens, lens), lens)
    starts, some = np.cumsum(lens) - lens, np.flatnonzero(lens)
    out = np.zeros((len(ids), len(FIGURES)), np.int64)
    out[:, 0], out[:, 1:4] = lens, group
    if len(some):
        for column, values in ((4, covered(repeats, 3)), (5, covered(repeats, least))):
            out[some, column] = np.add.reduceat(values.astype(np.int64), starts[some])
        out[some, 6] = np.maximum.reduceat(repeats, starts[some])
    return out


def measure(texts: list[str], least: int) -> np.ndarray:
    """``FIGURES`` of texts, some ``BATCH_WORDS`` words at a time."""
    group, ids, held, out = [], [], 0, [np.zeros((0, len(FIGURES)), np.int64)]
    for text in texts:
        found = words(text)
        number: dict[bytes, int] = {}
        ids.append(np.array([number.setdefault(w, len(number)) for w in found], np.int64))
        group.append((len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, SYMBOLS)), _lines(text)))
        held += len(found) + 1
        if held >= BATCH_WORDS:
            out.append(_figures(group, ids, least))
            group, ids, held = [], [], 0
    if ids:
        out.append(_figures(group, ids, least))
    return np.concatenate(out)


def _rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            columns = measure([x or "" for x in b.column(1).to_pylist()], least).T
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["id", *FIGURES])

    return run


def _failed(limits: Limits) -> Column:
    return (F.col("n_words") < limits.min_words) | (F.col("n_repeat_words") > limits.max_repeat_words * F.col("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Repetition figures and verdict of every whole text.

    Returns ``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (words in 3-word windows found twice), ``n_covered`` (words in
    repeats of ``limits.min_repeat`` words or more, all occurrences), ``longest`` (words of the longest repeat; occurrences may overlap),
    ``base_failed`` and ``kept``. A null, empty or blank text has zeros everywhere and fails the base rules. Tied, repeated and null ids pass
    through, each row judged by itself; other columns are ignored; no rows give no rows. Nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_rows(limits.min_repeat), ", ".join(f"{c} long" for c in ("id", *FIGURES)))
    fine = (F.col("n_covered") <= limits.max_covered * F.col("n_words")) & (F.col("longest") <= limits.max_longest)
    return out.select(F.col("id").alias(id_col), *FIGURES, _failed(limits).alias("base_failed"), (~_failed(limits) & fine).alias("kept"))


def judge_column(text: Column, limits: Limits = Limits()) -> Column:  # noqa: B008
    """The verdict ``kept`` of ``judge`` as a column, for use in a filter."""

    def run(texts: pd.Series) -> pd.Series:
        f = dict(zip(FIGURES, measure([x or "" for x in texts], limits.min_repeat).T, strict=True))
        base = (f["n_words"] >= limits.min_words) & (f["n_repeat_words"] <= limits.max_repeat_words * f["n_words"])
        return pd.Series(base & (f["n_covered"] <= limits.max_covered * f["n_words"]) & (f["longest"] <= limits.max_longest))

    return F.pandas_udf(run, BooleanType())(text)
