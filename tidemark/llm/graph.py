"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges (a, b)``, both long: the label is the least node of its component.

    Alternates large-star and small-star steps until nothing changes, so a chain of n nodes takes about log n rounds. Minima are combined
    before each shuffle and joins on a hub are split by adaptive execution; no neighbour list is collected. Loops and repeated edges are
    harmless, rows with a null end are left out, an empty table gives no rows.
    """
    known = cut(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo IS NOT NULL AND hi IS NOT NULL AND lo < hi").distinct())
    state = None
    while True:
        both = known.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(known.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo < hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        known = cut(
            small.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionByName(small.select(F.col("m").alias("lo"), "hi")).filter("lo < hi").distinct()
        )
        now = known.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return known.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(known.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
