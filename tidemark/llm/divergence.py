"""Audit of how the sources of a language differ in their words.

Terms are runs of ASCII letters and non-ASCII characters. One ``bytes.translate`` lowers A-Z and blanks every other ASCII byte, ``bytes.split`` cuts the
terms, and a ``Counter`` for each document gives frequencies; tasks add them up for each language and source and hand on one row for a term.
Every group has a smoothed share for each term its language keeps, in billionths:

    p = 1 + floor(10**9 * (count + PRIOR) / (N + PRIOR * V))

N is the group's sum of counts of kept terms, V the number of kept terms. The distance of two sources is the sum of ``|p - q|`` over all kept terms. Terms that
neither holds contribute the same difference each, so only terms held by one of them are visited, in numpy blocks of sources by terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.attach import sized
from ..session import cut

SCALE = 1_000_000_000
PRIOR = 5
#: Entries that a task holds before it hands them on; bytes of a text cut at a time; terms and sources of a block.
HELD, PIECE, TERMS, SOURCES = 400_000, 1 << 20, 4096, 128

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes, size: int | None = None) -> Iterator[bytes]:
    """A translated text in pieces of about ``size`` bytes that end between terms."""
    size = size or PIECE
    clean, at = text.translate(_TABLE), 0
    while at < len(clean):
        stop = clean.find(b" ", at + size)
        stop = len(clean) if stop < 0 else stop
        yield clean[at:stop]
        at = stop


def frequencies(text: bytes) -> Counter:
    """Occurrences of every term of one text."""
    found: Counter = Counter()
    for piece in pieces(text):
        found.update(piece.split())
    return found


_NAMES = ["lang", "source", "term", "n", "docs"]
_COUNTED = "lang binary, source binary, term binary, n long, docs long"


def _flush(held: dict) -> pa.RecordBatch:
    langs, sources, terms, ns, docs = [], [], [], [], []
    for (lang, source), (count, rows) in held.items():
        langs += [lang] * len(count)
        sources += [source] * len(count)
        terms += count.keys()
        ns += count.values()
        docs += map(rows.__getitem__, count)
    types = (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((langs, sources, terms, ns, docs), types, strict=True)], names=_NAMES)


def _counter(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                own = frequencies(text)
                if not own:
                    continue
                count, rows = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(count)
                for term, n in own.items():
                    count[term] += n
                rows.update(own.keys())
                size += len(count) - before
                if size >= most:
                    yield _flush(held)
                    held, size = {}, 0
        if held:
            yield _flush(held)

    return run


def _distances(size: int):
    """Of the sources of two blocks: over the block's terms, how far the sum of ``|p - q|`` exceeds the one of absent terms."""

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        lang, i, j = (table.column(n)[0].as_py() for n in ("lang", "i", "j"))
        at, p, base = (table.column(n).to_numpy() for n in ("at", "p", "base"))
        who, first, row = np.unique(at, return_index=True, return_inverse=True)
        floor = base[first]
        names = table.column("term").combine_chunks().dictionary_encode()
        held, term = names.is_valid().to_numpy(zero_copy_only=False), names.indices.fill_null(0).to_numpy()
        shares = np.repeat(floor[:, None], len(names.dictionary), axis=1)
        shares[row[held], term[held]] = p[held]
        block = who // size
        out = ([], [], [])
        for k in np.flatnonzero(block == i):
            others = np.flatnonzero((block == j) & (who > who[k]))
            if len(others):
                part = np.abs(shares[others] - shares[k]).sum(1) - shares.shape[1] * np.abs(floor[others] - floor[k])
                out[0].append(np.full(len(others), who[k]))
                out[1].append(who[others])
                out[2].append(part)
        a, b, part = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(part)], names=["lang", "a", "b", "part"])

    return cell


def share(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """``1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept))``, exact; NULL where nothing is kept."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(25,0)")
    num, den = (wide(count) + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), wide(total) + wide(kept) * PRIOR
    num, den = num.cast("decimal(38,0)"), den.cast("decimal(38,0)")
    whole = F.call_function("div", num, F.when(den > 0, den))
    return (F.lit(1) + whole).cast("long")


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term in every group. Null texts, languages and sources are empty strings."""
    binary = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(binary(lang_col).alias("lang"), binary(source_col).alias("source"), binary(text_col).alias("text")).filter(F.octet_length("text") > 0)
    counted = rows.mapInArrow(_counter(HELD), _COUNTED).select(*(F.col(c).cast("string").alias(c) for c in _NAMES[:3]), "n", "docs")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def divergence(docs: DataFrame, least: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Distances between the sources of a language, and the terms by which each source stands out: ``lang, source, part, item, value, rank``.

    A language keeps the terms that at least ``least`` of its documents (rows) hold. Part ``pair``: ``item`` is every other source of the language, ``value`` the sum
    of differences of shares over all kept terms (0 if there are none). Part ``term``: ``item`` is a kept term that the group holds and whose share
    exceeds the language's, ``value`` that excess, ranks up to ``top``. Ranks start at 1, ordered by falling value, then by the item's bytes.

    Null texts, languages and sources are empty strings; a group without terms has the shares of zero counts; repeated rows count each time. A text without terms
    adds nothing. Other columns are ignored, an empty table gives no rows.

    Only group counts are shuffled. Pairs are as many as the result has: one row for each ordered pair of sources of a language.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counts = term_counts(docs, text_col, lang_col, source_col)
    # One row for each source of a term: the term's documents and occurrences in its language come from a window over these.
    of_term = Window.partitionBy("lang", "term")
    counts = counts.withColumn("lang_docs", F.sum("docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term))
    counts = counts.withColumn("one", (F.row_number().over(of_term.orderBy("source")) == 1).cast("int"))
    kept = cut(counts.filter(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n", "one"))

    groups = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("one").alias("v"))
    of_lang = Window.partitionBy("lang")
    groups = groups.join(sums, ["lang", "source"], "left").na.fill(0, ["total", "v"])
    groups = groups.withColumn("kept", F.sum("v").over(of_lang)).withColumn("lang_total", F.sum("total").over(of_lang))
    groups = groups.withColumn("at", F.row_number().over(of_lang.orderBy("source")) - 1).withColumn("blocks", F.ceil(F.count("*").over(of_lang) / SOURCES))
    groups = sized(groups.select("lang", "source", "at", "blocks", "total", "kept", "lang_total", share(F.lit(0), "total", "kept").alias("base")))

    shares = kept.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "kept"))
    excess = shares.withColumn("value", F.col("p") - share("lang_n", "lang_total", "kept")).filter("value > 0").select("lang", "source", F.col("term").alias("item"), "value")

    # Every source is in every bucket of its language, if only by a row without a term: absent terms have a share too.
    block, buckets = F.floor(F.col("at") / SOURCES), F.ceil(F.col("kept") / TERMS)
    cells = shares.withColumn("bucket", F.pmod(F.xxhash64("term"), buckets))
    rest = groups.filter("kept > 0").withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1))).withColumn("p", F.col("base")).withColumn("term", F.lit(None).cast("string"))
    cells = cells.unionByName(rest, allowMissingColumns=True).select("lang", "term", "bucket", "at", "p", "base", block.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("lang", "term", "bucket", F.col("at").cast("long").alias("at"), "p", "base", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    parts = cells.groupBy("lang", "bucket", "i", "j").applyInArrow(_distances(SOURCES), "lang string, a long, b long, part long")
    parts = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
    side = lambda n: groups.select("lang", F.col("source").alias(f"source_{n}"), F.col("at").cast("long").alias(n), F.col("base").alias(f"base_{n}"), "kept")
    pairs = side("a").join(side("b").drop("kept"), "lang").filter("a < b").join(parts, ["lang", "a", "b"], "left")
    value = F.coalesce(F.col("kept") * F.abs(F.col("base_a") - F.col("base_b")) + F.coalesce("part", F.lit(0)), F.lit(0))
    pairs = pairs.select("lang", value.alias("value"), F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")),
                                                                         F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("x"))
    pairs = pairs.select("lang", "x.source", "x.item", "value")

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    columns = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank"]
    return (pairs.withColumn("part", F.lit("pair")).withColumn("rank", place).select(*columns)
            .unionByName(excess.withColumn("part", F.lit("term")).withColumn("rank", place).filter(F.col("rank") <= top).select(*columns)))
