"""Order-dependent plans that never put one whole key into one task.

Three shapes are enough for every ordered operator of the library:

* ``halo``: sliding frames.  Rows go to chunks of the order column; the rows near a chunk border are
  copied to the neighbour, so that a frame inside a chunk sees all it needs.
* ``carry`` and ``running_sum``: unbounded frames.  Work inside chunks, then one small row per chunk is
  combined in order and joined back.
* ``cumulate``: ranks by value.  Rows are first reduced to distinct values, then cut into
  value ranges of bounded size from exact counts (all of them order-independent aggregates, so a
  recomputed task gives the same ranges).

A key with a third of all rows is spread over as many tasks as it has chunks or ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .attach import attach

CHUNK = 1 << 16
VALUES_PER_RANGE = 1 << 18


def chunk_id(order: str, size: int) -> Column:
    return F.floor(F.col(order) / F.lit(size)).cast("long")


def halo(
    df: DataFrame,
    keys: Sequence[str],
    order: str = "t",
    before: int = 0,
    after: int = 0,
    size: int | None = None,
) -> DataFrame:
    """Add ``_chunk`` and ``_own``; rows within ``before``/``after`` positions of a border are copied over."""
    size = max(size or CHUNK, before, after, 1)
    home = chunk_id(order, size)
    if before == 0 and after == 0:
        return df.withColumn("_chunk", home).withColumn("_own", F.lit(True))
    pos = F.col(order) - home * F.lit(size)
    homes = [home]
    if after:
        homes.append(F.when(pos < after, home - 1))
    if before:
        homes.append(F.when(pos >= size - before, home + 1))
    return (
        df.withColumn("_home", home)
        .withColumn("_chunk", F.explode(F.array_compact(F.array(*homes))))
        .withColumn("_own", F.col("_chunk") == F.col("_home"))
        .drop("_home")
    )


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    before: int,
    after: int,
    exprs: dict,
    size: int | None = None,
) -> DataFrame:
    """Columns over the frame [-before, after].  ``exprs`` maps a name to a function of the ordered window.

    The order column must be dense (0, 1, 2, ... inside each key).
    """
    w = Window.partitionBy(*keys, "_chunk").orderBy(order)
    out = halo(df, keys, order, before, after, size)
    for name, make in exprs.items():
        out = out.withColumn(name, make(w))
    return out.filter("_own").drop("_chunk", "_own")


def shifted(df: DataFrame, keys, order: str, cols: dict, size: int | None = None) -> DataFrame:
    """Lag (positive offset) or lead (negative offset) columns: ``{name: (column, offset)}``."""
    before = max([o for _, o in cols.values() if o > 0], default=0)
    after = max([-o for _, o in cols.values() if o < 0], default=0)
    exprs = {
        name: (lambda w, c=c, o=o: F.lag(c, o).over(w) if o > 0 else F.lead(c, -o).over(w))
        for name, (c, o) in cols.items()
    }
    return framed(df, keys, order, before, after, exprs, size)


def carry(
    df: DataFrame, keys: Sequence[str], order: str, cols: dict, size: int | None = None
) -> DataFrame:
    """Nearest non-null value in order: ``{name: (column, "prev" | "next", inclusive)}``.

    The order column may have gaps but no duplicates inside a key.
    """
    size = size or CHUNK
    base = df.withColumn("_c", chunk_id(order, size))
    far = base.groupBy(*keys, "_c").agg(
        *[
            (F.max_by if side == "prev" else F.min_by)(
                F.col(c), F.when(F.col(c).isNotNull(), F.col(order))
            ).alias(f"_far_{name}")
            for name, (c, side, _) in cols.items()
        ]
    )
    across = Window.partitionBy(*keys).orderBy("_c")
    inside = Window.partitionBy(*keys, "_c").orderBy(order)
    for name, (_, side, _) in cols.items():
        edge = f"_far_{name}"
        if side == "prev":
            frame = across.rowsBetween(Window.unboundedPreceding, -1)
            far = far.withColumn(f"_in_{name}", F.last(edge, ignorenulls=True).over(frame))
        else:
            frame = across.rowsBetween(1, Window.unboundedFollowing)
            far = far.withColumn(f"_in_{name}", F.first(edge, ignorenulls=True).over(frame))
    far = far.select(*keys, "_c", *[f"_in_{n}" for n in cols])
    for name, (c, side, inclusive) in cols.items():
        if side == "prev":
            frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
            base = base.withColumn(f"_n_{name}", F.last(c, ignorenulls=True).over(frame))
        else:
            frame = inside.rowsBetween(0 if inclusive else 1, Window.unboundedFollowing)
            base = base.withColumn(f"_n_{name}", F.first(c, ignorenulls=True).over(frame))
    out = base.join(far, [*keys, "_c"])
    for name in cols:
        out = out.withColumn(name, F.coalesce(f"_n_{name}", f"_in_{name}")).drop(
            f"_n_{name}", f"_in_{name}"
        )
    return out.drop("_c")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, cols: dict, size: int | None = None
) -> DataFrame:
    """Inclusive running sums ``{name: column}`` in order."""
    size = size or CHUNK
    base = df.withColumn("_c", chunk_id(order, size))
    part = base.groupBy(*keys, "_c").agg(*[F.sum(c).alias(f"_p_{n}") for n, c in cols.items()])
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(
        *keys, "_c", *[F.coalesce(F.sum(f"_p_{n}").over(before), F.lit(0)).alias(f"_p_{n}") for n in cols]
    )
    inside = Window.partitionBy(*keys, "_c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for n, c in cols.items():
        base = base.withColumn(f"_s_{n}", F.sum(c).over(inside))
    out = base.join(part, [*keys, "_c"])
    for n in cols:
        out = out.withColumn(n, F.col(f"_s_{n}") + F.col(f"_p_{n}")).drop(f"_s_{n}", f"_p_{n}")
    return out.drop("_c")


def _range_of(value: Column, lo: Column, hi: Column, n: Column, per_range: int) -> Column:
    """Equal-width range number; monotone in the value, 0 when all fits one range."""
    k = F.ceil(n / F.lit(float(per_range)))
    share = (value - lo) / (hi - lo)
    return F.when((k <= 1) | (hi <= lo), F.lit(0)).otherwise(
        F.least(F.floor(share * k), k - 1)
    ).cast("long")


def value_ranges(df: DataFrame, keys: Sequence[str], value: str, per_range: int) -> DataFrame:
    """Add ``_r1, _r2``: ordered ranges of the value with about ``per_range`` rows each.

    Equal-width first, then every heavy range is cut again by its own bounds.
    """
    v = F.col(value).cast("double")
    stats = [F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(F.lit(1)).alias("_n")]
    for name, at in (("_r1", list(keys)), ("_r2", [*keys, "_r1"])):
        df = attach(df, df.groupBy(*at).agg(*stats), at).withColumn(
            name, _range_of(v, F.col("_lo"), F.col("_hi"), F.col("_n"), per_range)
        ).drop("_lo", "_hi", "_n")
    return df


def largest_key(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest key: one aggregate with map-side counts."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n").alias("n")).first()["n"] or 0


def cumulate(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    measures: dict[str, Column] | None = None,
    per_range: int | None = None,
) -> DataFrame:
    """One row per distinct value with ``n`` and the measures, ``cum_*`` (ascending, inclusive) and ``tot_*``.

    The distinct values are checkpointed.  When every key has at most ``per_range`` of them a window per
    key is enough; otherwise each key is cut into value ranges.
    """
    per_range = per_range or VALUES_PER_RANGE
    measures = {"n": F.count(F.lit(1)), **(measures or {})}
    names = list(measures)
    distinct = cut(df.groupBy(*keys, value).agg(*[m.alias(n) for n, m in measures.items()]))
    upto = Window.unboundedPreceding, 0
    if largest_key(distinct, keys) <= per_range:
        whole = Window.partitionBy(*keys)
        return distinct.select(
            "*",
            *[F.sum(n).over(whole.orderBy(value).rowsBetween(*upto)).alias(f"cum_{n}") for n in names],
            *[
                F.sum(n).over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                .alias(f"tot_{n}")
                for n in names
            ],
        )
    ranged = value_ranges(distinct, keys, value, per_range)
    at = [*keys, "_r1", "_r2"]
    part = ranged.groupBy(*at).agg(*[F.sum(n).alias(f"_p_{n}") for n in names])
    ordered = Window.partitionBy(*keys).orderBy("_r1", "_r2")
    part = part.select(
        *at,
        *[
            F.coalesce(F.sum(f"_p_{n}").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(
                f"_o_{n}"
            )
            for n in names
        ],
        *[F.sum(f"_p_{n}").over(Window.partitionBy(*keys)).alias(f"tot_{n}") for n in names],
    )
    inside = Window.partitionBy(*at).orderBy(value).rowsBetween(*upto)
    out = attach(ranged, part, at)
    return out.withColumns(
        {f"cum_{n}": F.sum(n).over(inside) + F.col(f"_o_{n}") for n in names}
    ).drop("_r1", "_r2", *[f"_o_{n}" for n in names])


def order_value(value: str, position: Column) -> Column:
    """Aggregate over ``cumulate`` rows: the value at a 0-based position of the ascending order."""
    held = (F.col("cum_n") - F.col("n") <= position) & (position < F.col("cum_n"))
    return F.max(F.when(held, F.col(value)))


def quantile_of(value: str, fraction) -> Column:
    """Aggregate over ``cumulate`` rows: quantile with linear interpolation between order statistics."""
    fraction = F.lit(float(fraction)) if isinstance(fraction, (int, float)) else fraction
    pos = fraction * (F.col("tot_n") - 1)
    low = order_value(value, F.floor(pos))
    high = order_value(value, F.ceil(pos))
    weight = F.max(pos - F.floor(pos))
    return low + (high - low) * weight


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: dict, per_range: int | None = None
) -> DataFrame:
    """Exact quantiles per key, one row per key; ``{name: fraction}`` (a number or a column of ``tot_n``)."""
    c = cumulate(df.filter(F.col(value).isNotNull()), keys, value, per_range=per_range)
    return c.groupBy(*keys).agg(*[quantile_of(value, f).alias(n) for n, f in fractions.items()])


def index_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], by: Column, width: float, name: str = "t"
) -> DataFrame:
    """Dense 0-based row index inside each key.

    ``by`` is a number that follows the first order column; rows are numbered inside ranges of ``width``
    of it, and the counts of the earlier ranges are added.
    """
    at = [*keys, "_r"]
    ranged = df.withColumn("_r", F.floor(by / F.lit(width)).cast("long"))
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    part = ranged.groupBy(*at).agg(F.count(F.lit(1)).alias("_p"))
    part = part.select(*at, F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_o"))
    ranged = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy(*at).orderBy(*order)))
    return (
        ranged.join(part, at)
        .withColumn(name, (F.col("_rn") - 1 + F.col("_o")).cast("long"))
        .drop("_r", "_rn", "_o")
    )
