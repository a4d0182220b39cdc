"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

* Targets share all words by weight; no source gives more than ``MAX_REPEAT`` times its words, the excess is reshared.
* The documents of a source, in hash order, form one stream of words that is cut into blocks. A target is a quota of block draws; draw q of a
  source is block ``permutation(q mod blocks)`` of pass ``q // blocks``, so a block is drawn once in each pass.
* The quotas of all sources are split among the output shards by a binary tree: each node draws, from a multivariate hypergeometric distribution, how
  many of its left child's draws come from each source. The draws of a node depend on the seed and its place only, so every shard finds its own
  path from the root; shards get disjoint ranges of each source's draws and shuffle them locally.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..session import cut
from .text import LAST, WORD, mix, odd_constants, text_or_empty, untag

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK = 4096
MAX_DRAWS = 400_000_000  # numpy draws from populations below a thousand million; blocks grow beyond that
SHARD_WORDS = 1 << 22
BUCKET_ROWS = 1024


def targets(sizes: DataFrame, weights=WEIGHTS, repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds ``place`` (order of the sources by code point, null last), ``weight`` and ``target`` to ``(source, source_size)``.

    The fixed point of sharing by weight and resharing what is above ``repeat`` times a size: the sources of least size for their weight are
    capped, all others get the same amount for each unit of weight. One row for each source, so one task holds them.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    s = sizes.withColumn("place", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * repeat).withColumn("ratio", F.col("cap") / F.col("weight"))
    low = Window.orderBy("ratio", "place")
    every = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(low.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(low.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(every) - before) / rest)
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "place", "level"))).over(every)["level"]
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(level, F.col("ratio")))).drop("cap", "ratio", "level")


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of ``range(n)``: Feistel rounds on the next power of four, walking on while outside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    rounds = odd_constants(4, key & 0xFFFFFFFFFFFFFFFF)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> np.uint64(half), v & low
        for r in rounds:
            left, right = right, left ^ (mix((right + np.uint64(1)) * r) & low)
        v = left << np.uint64(half) | right
        out[todo] = v
        todo = todo[v >= n]
    return out.astype(np.int64)


def shard_quota(quota: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First draw and number of draws of every source for one shard: a walk down the splitting tree."""
    lo, hi, start, quota = 0, shards, np.zeros(len(quota), np.int64), quota.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        total = int(quota.sum())
        left = np.random.Generator(np.random.PCG64([seed, lo, hi])).multivariate_hypergeometric(quota, total * (mid - lo) // (hi - lo), method="marginals") if total else quota
        if shard < mid:
            hi, quota = mid, left
        else:
            lo, start, quota = mid, start + left, quota - left
    return start, quota


DRAWS = "shard long, slot long, place int, pass int, block long, words long"


def _draw(sources: list[tuple[int, int, int, int, int]], shards: int, seed: int):
    """``sources``: (place, block length, blocks, draws, words of the last draw) of each source with a target."""

    def run(batches: Iterator[pd.DataFrame]):
        quota = np.array([s[3] for s in sources], np.int64)
        for shard in (int(s) for b in batches for s in b["id"]):
            start, count = shard_quota(quota, shards, shard, seed)
            parts = []
            for (place, length, blocks, draws, rest), first, n in zip(sources, start, count, strict=True):
                q = np.arange(first, first + n)
                part = pd.DataFrame({"pass": (q // blocks).astype(np.int32), "block": q % blocks, "words": np.where(q == draws - 1, rest, length)})
                for p in part["pass"].unique():
                    here = (part["pass"] == p).to_numpy()
                    part.loc[here, "block"] = permuted(part["block"].to_numpy()[here], blocks, (seed * 1_000_003 + place) * 31 + int(p))
                parts.append(part.assign(place=np.int32(place)))
            if parts:
                out = pd.concat(parts, ignore_index=True)
                slot = np.random.Generator(np.random.PCG64([seed, shard])).permutation(len(out))
                yield out.assign(shard=shard, slot=slot)[[x.split()[0] for x in DRAWS.split(", ")]]

    return run


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, block: int = BLOCK, seed: int = 17):
    """Plan a mix of whole sources. Returns ``(rows, pieces)``.

    ``rows`` has one row per document: ``uid, rid, id, size, source, source_size, target``. ``pieces`` has the draws of the mix: ``uid, id, rid, shard,
    slot, ahead, pass, start, stop``, words ``[start, stop)`` of a document, ``ahead`` words after the begin of the block that an output shard has in a slot. Sizes are numbers of words. A source without words
    has target 0; null texts have size 0 and are never drawn; null ids count as the largest and null sources as one source, the last. Equal
    rows are drawn like different ones. Other columns are ignored; an empty table gives two empty results. The same rows give the same
    mix, whatever their partitions. Sources are few enough to fit one task (their quotas are sent to all shards); documents are never
    gathered, and no source is ordered in one task.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), text_or_empty(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
    rows = cut(base.select("id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), F.xxhash64("id", "text", "source").alias("rid"))
               .withColumn("uid", F.monotonically_increasing_id()).withColumn("key", F.xxhash64("rid", F.lit(seed))))
    sources = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))))
    total, most = sources.agg(F.sum("source_size"), F.max("rows")).first()
    length = max(block, -(-(total or 0) // MAX_DRAWS))
    plan = sources.filter("source_size > 0").select("place", "source_size", "target").collect()
    quotas = []
    for r in sorted(plan):
        blocks = -(-r.source_size // length)
        even = -(-r.source_size // blocks)
        # Whole passes take every block, whatever its length; the draw that ends the last pass takes only what is left of the target.
        passes, words = divmod(round(r.target), r.source_size)
        more = -(-words // even)
        quotas.append((r.place, even, blocks, passes * blocks + more, words - (more - 1) * even if more else even))
    shards = shards or max(8, -(-(total or 0) // SHARD_WORDS))
    quotas = [q for q in quotas if q[3] > 0]
    draws = spark.range(shards).repartition(min(shards, 200)).mapInPandas(_draw(quotas, shards, seed), DRAWS)

    lengths = spark.createDataFrame([(q[0], q[1]) for q in quotas], "place int, length long")
    known = sources.select(F.col("source").alias("s"), "place", "source_size", "target")
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    bits = max(0, ((most or 1) // BUCKET_ROWS).bit_length())
    placed = rows.filter("size > 0").withColumn("bucket", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long"))
    sums = placed.groupBy("place", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("place", "bucket").orderBy("key", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums.select("place", "bucket", "before"), ["place", "bucket"])
    placed = placed.join(lengths, "place").withColumn("at", F.col("before") + F.col("inside"))
    first, last = F.floor(F.col("at") / F.col("length")), F.floor((F.col("at") + F.col("size") - 1) / F.col("length"))
    spread = placed.select("uid", "id", "rid", "place", "size", "length", "at", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.lit(0), F.col("block") * F.col("length") - F.col("at"))
    end = F.least(F.col("size"), (F.col("block") + 1) * F.col("length") - F.col("at"))
    ahead = F.greatest(F.lit(0), F.col("at") - F.col("block") * F.col("length"))
    spread = spread.select("uid", untag("id").alias("id"), "rid", "place", "block", begin.alias("start"), end.alias("stop"), ahead.alias("ahead"))
    pieces = spread.join(draws, ["place", "block"]).withColumn("stop", F.least("stop", F.col("start") + F.col("words") - F.col("ahead"))).filter("stop > start")
    rows = rows.select("uid", "rid", untag("id").alias("id"), "size", "source", "source_size", "target")
    return rows, pieces.select("uid", "id", "rid", "shard", "slot", "ahead", "pass", "start", "stop")


def taken(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Words the mix takes of every document, repeats counted: ``taken``, and ``shards``, an array of ``shard, words`` for the shards that hold some."""
    each = pieces.groupBy("uid", "shard").agg(F.sum(F.col("stop") - F.col("start")).alias("words"))
    sums = each.groupBy("uid").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("shards"))
    none = F.array().cast(sums.schema["shards"].dataType)
    return rows.join(sums, "uid", "left").withColumn("taken", F.coalesce("taken", F.lit(0))).withColumn("shards", F.coalesce("shards", none))


@F.pandas_udf(StringType())
def word_range(text: pd.Series, start: pd.Series, stop: pd.Series) -> pd.Series:
    """Words [start, stop) of a text with what stands between them; the unchanged text if that is all of it."""
    find = re.compile(r"[^ \t-\r]+").finditer
    out = []
    for t, a, b in zip(text, start, stop, strict=True):
        at = [m.span() for m in find(t)]
        out.append(t if a == 0 and b == len(at) else t[at[a][0]:at[b - 1][1]])
    return pd.Series(out)


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", places: tuple[str, str] | None = None, **options) -> DataFrame:
    """The mix itself, shard by shard: the rows of ``docs``, as often as drawn, with the text of the drawn words.

    Pieces that follow each other in a document are joined if one shard holds them in one pass; they stand where the first of them was drawn. Rows
    are dealt out by shard, and each task holds its shards in order, the blocks of a shard in the order of their shuffled slots. ``places`` names
    two columns to add, the shard and the slot of a row. The columns of ``docs`` may have any names, and ``n_chars``, if there, is counted anew.
    Rows that agree in id, text and source, but not in other columns, count as so many rows, all with the other columns of one of them.
    """
    _, pieces = mix_sources(docs, id_col, text_col, source_col, **options)
    run = Window.partitionBy("uid", "shard", "pass").orderBy("start")
    runs = pieces.withColumn("fresh", (F.coalesce(F.lag("stop").over(run), F.lit(-1)) != F.col("start")).cast("int")).withColumn("run", F.sum("fresh").over(run))
    runs = runs.groupBy("uid", "id", "rid", "shard", "pass", "run").agg(F.min(F.struct("start", "slot", "ahead")).alias("head"), F.max("stop").alias("stop"))
    runs = runs.select(F.coalesce("id", F.lit(LAST)).alias("id"), "rid", "shard", "head.slot", "head.ahead", "head.start", "stop")
    id_, text, source = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), text_or_empty(text_col), F.col(source_col).cast("string")
    # The caller's columns travel in one struct, so their names cannot clash with those used here.
    whole = docs.select(id_.alias("id"), F.xxhash64(id_, text, source).alias("rid"), text.alias("text"), F.struct(*docs.columns).alias("row")).dropDuplicates(["id", "rid"])
    out = whole.join(runs, ["id", "rid"]).withColumn("text", word_range(F.col("text"), F.col("start"), F.col("stop")))
    out = out.repartition("shard").sortWithinPartitions("shard", "slot", "ahead")

    def field(name: str):
        if name == text_col:
            return F.col("text").cast(docs.schema[name].dataType)
        return F.length("text").cast(docs.schema[name].dataType) if name == "n_chars" else F.col("row")[name]

    return out.select(*[field(c).alias(c) for c in docs.columns], *([F.col("shard").alias(places[0]), F.col("slot").alias(places[1])] if places else []))
