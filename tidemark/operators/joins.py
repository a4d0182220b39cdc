"""Joins the evaluation needs (inventory JN1-JN12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.attach import attach
from .detect.neighbours import knn


def with_truth(pred: DataFrame, truth: DataFrame, on: str = "dataset") -> DataFrame:
    return pred.join(truth, on)


def with_category(runtimes: DataFrame, sizes: DataFrame, on: str = "dataset") -> DataFrame:
    return runtimes.join(sizes, on, "left")


def nest_meta(perf: DataFrame, meta: DataFrame, on: str = "dataset") -> DataFrame:
    """Performance rows with the meta-features of their dataset as one struct column."""
    packed = meta.select(on, F.struct(*[c for c in meta.columns if c != on]).alias("meta"))
    return attach(perf, packed, [on], "left")


def only_known(meta: DataFrame, perf: DataFrame, on: str = "dataset") -> DataFrame:
    return meta.join(perf.select(on).distinct(), on, "left_semi")


def not_done(inputs: DataFrame, results: DataFrame, on: Sequence[str]) -> DataFrame:
    return inputs.join(results.select(*on).distinct(), list(on), "left_anti")


def _dyadic(s: str, e: str) -> Column:
    """The segment-tree nodes that make up the inclusive interval of whole numbers (s, e): at most two for each level, none if it is empty."""
    start = F.struct(F.col(s).cast("long").alias("l"), (F.col(e) + 1).cast("long").alias("r"), F.array().cast("array<struct<level:int,node:bigint>>").alias("nodes"))
    node = lambda k, x: F.array(F.struct(k.cast("int").alias("level"), x.cast("long").alias("node")))
    none = F.array().cast("array<struct<level:int,node:bigint>>")

    def step(acc, k):
        l, r = acc["l"], acc["r"]
        left, right = (l < r) & (l.bitwiseAND(1) == 1), (l < r) & (r.bitwiseAND(1) == 1)
        nodes = F.concat(acc["nodes"], F.when(left, node(k, l)).otherwise(none), F.when(right & ~(left & (l == r - 1)), node(k, r - 1)).otherwise(none))
        up, down = l + F.when(left, 1).otherwise(0), r - F.when(right, 1).otherwise(0)
        return F.struct(F.shiftright(up, 1).alias("l"), F.shiftright(down, 1).alias("r"), nodes.alias("nodes"))

    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.col(e) - F.col(s) + 1, F.lit(1)))).cast("int") + 1)
    return F.aggregate(levels, start, step, lambda acc: acc["nodes"])


def _starts_inside(intervals: DataFrame, points: DataFrame, s: str, e: str, point: str, keys: Sequence[str]) -> DataFrame:
    """Pairs of an interval and a row whose ``point`` lies in it, each once."""
    top = intervals.agg(F.max(F.col(e) - F.col(s) + 1)).first()[0]
    top = max(int(top or 1), 1).bit_length()
    cover = intervals.withColumn("_node", F.explode(_dyadic(s, e)))
    at = F.expr(f"transform(sequence(0, {top}), k -> struct(k AS level, shiftright(CAST({point} AS BIGINT), k) AS node))")
    return cover.join(points.withColumn("_node", F.explode(at)), [*keys, "_node"]).drop("_node")


def interval_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Pairs of inclusive intervals of whole numbers (s, e) x (s2, e2) that intersect.

    Of two intervals that meet, the one that starts later starts inside the other. An interval is cut into segment-tree nodes, a start is listed once for each
    level, and the join is an equi-join on the node: copies grow with the logarithm of a length, every pair is found once, and only pairs that meet
    are formed. Empty intervals and rows with a null bound or key meet nothing.
    """
    a = left.filter("s <= e")
    b = right.withColumnsRenamed({"s": "s2", "e": "e2"}).filter("s2 <= e2")
    later = _starts_inside(a, b, "s", "e", "s2", keys)
    inner = b.withColumn("_s", F.col("s2") + 1)
    earlier = _starts_inside(inner, a, "_s", "e2", "s", keys).drop("_s")
    return later.unionByName(earlier)


def overlap_count(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("series_id",)):
    """Number of right intervals that intersect each left interval (0 included)."""
    hit = interval_overlap(left.select(*keys, "s", "e").distinct(), right, keys).groupBy(*keys, "s", "e").agg(F.count(F.lit(1)).alias("hits"))
    return left.join(hit, [*keys, "s", "e"], "left").fillna(0, ["hits"])


def clip_to_zones(events: DataFrame, zones: DataFrame, keys: Sequence[str] = ("series_id",)):
    """Half-open events (s, e) cut by zones (zone, z0, z1): one row per non-empty piece (lo, hi). Bounds need not be whole; they meet as the whole cells they touch."""
    a = events.withColumnsRenamed({"s": "_es", "e": "_ee"}).withColumn("s", F.floor("_es").cast("long")).withColumn("e", F.ceil("_ee").cast("long") - 1)
    z = zones.drop("s", "e").withColumn("s", F.floor("z0").cast("long")).withColumn("e", F.ceil("z1").cast("long") - 1)
    both = interval_overlap(a, z, keys).drop("s", "e", "s2", "e2").withColumnsRenamed({"_es": "s", "_ee": "e"})
    lo, hi = F.greatest("s", "z0"), F.least("e", "z1")
    return both.withColumn("lo", lo.cast("double")).withColumn("hi", hi.cast("double")).filter("lo < hi")


def nearest_row(query: DataFrame, base: DataFrame, vector: str = "x", id: str = "dataset") -> DataFrame:
    """Nearest base row of each query row; a base row with the id of the query does not count, an equal row with another id does.

    Among equal base rows the smallest id is returned.
    """
    one = F.lit(0).alias("series_id")
    near, _ = knn(base.select(one, id, vector), 2, x=vector, id=id, queries=query.select(one, id, vector))
    # vid is the smallest id among equal query vectors, so go back to the rows through the vector
    own = query.select(F.col(id).alias("_id"), F.col(vector).alias("_v"))
    vectors = own.groupBy("_v").agg(F.min("_id").alias("vid")).withColumnRenamed("_v", "_w")
    rows = own.join(vectors, F.col("_v") == F.col("_w")).withColumnRenamed("_id", id).join(near, "vid").filter(F.col(id) != F.col("nb")).select(id, "d", "nb")
    # The two smallest ids of a group of equal base rows are enough: one of them is not the query's.
    ids = base.select(F.col(vector).alias("_v"), F.col(id).alias("_a"))
    first = ids.groupBy("_v").agg(F.min("_a").alias("_first"))
    second = ids.join(first.select(F.col("_v").alias("_u"), "_first"), F.col("_v") == F.col("_u")).filter("_a > _first").groupBy("_v").agg(F.min("_a").alias("_second"))
    pair = first.join(second.withColumnRenamed("_v", "_u"), F.col("_v") == F.col("_u"), "left").select(F.col("_v").alias("_b"), "_first", "_second")
    equal = own.join(pair, F.col("_v") == F.col("_b")).select(F.col("_id").alias(id), F.lit(0.0).alias("d"), F.when(F.col("_first") != F.col("_id"), F.col("_first")).otherwise(F.col("_second")).alias("nb"))
    return (
        rows.unionByName(equal.filter("nb IS NOT NULL"))
        .groupBy(id)
        .agg(F.min(F.struct("d", "nb")).alias("m"))
        .select(id, F.col("m.nb").alias("nearest"), F.col("m.d").alias("distance"))
    )


def lookup_centres(points: DataFrame, centres: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Centre (and size) of the cluster each point belongs to."""
    return attach(points, centres, [*keys, "cluster"])
