"""Exact nearest neighbours inside each series (inventory DET7, DET8, JN9, JN10).

Equal vectors are reduced to one row with a count, so copies never meet each other.  The distinct vectors are
cut into cells around pivot rows, whose number grows with the square root of the rows.  By the triangle inequality a cell only needs
the vectors within ``reach`` of its pivot, which are sent to it.  Where most cells would need most vectors (many dimensions), the
series stays one cell, or every vector would be copied to every cell.  Inside a cell both sides are cut again, into blocks
around pivots of the cell; each block is known by a ball, and a block of queries meets a block of candidates only
where their balls are near enough.  Where a cell's candidates fit one block it is not cut; where balls do not tell blocks apart (many dimensions), the cell is
split by hashes instead.  A task finds the k best of its block by matrix products in single precision with a bound on their error,
and measures only what may be among them in double precision; and the blocks of one query are merged by one
window over a few rows.  No pair table is ever written, and no candidate is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.scalars import hash_share
from ...plans.attach import attach, sized
from ...session import cut

KEYS = ("series_id",)
PIVOTS = 64
ROWS_PER_PIVOT = 4000
QUERY_BLOCK = 1024
BASE_BLOCK = 8192
BLOCK_ROWS = 512
LITTLE = 0.4
ROW_TILE, COLUMN_TILE = 1024, 8192
#: Tiles of matrix products that stay in the cache; columns by eights.
NEAR_ROWS, NEAR_COLUMNS, FIRST_COLUMNS = 256, 1024, 2048
#: Manhattan distances are first bounded in steps of one byte: steps of a coordinate (four add up to less than 256), coordinates whose sum fits a word, share of a
#: tile's pairs that may remain, tiles that stay in the cache, pairs measured at a time.
LEVELS, STEP_DIMS, REMAINING, STEP_ROWS, STEP_COLUMNS, MEASURED = 64, 1024, 0.05, 64, 2048, 512


def distinct_vectors(df: DataFrame, keys: Sequence[str] = KEYS, x: str = "x", id: str = "t") -> DataFrame:
    """One row per distinct vector: smallest id and number of copies."""
    return df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.min(id).alias("vid"), F.count(F.lit(1)).alias("m"))


def _pivots(base: DataFrame, keys, x: str, rows_per_pivot: int) -> DataFrame:
    """One row per key: array ``pv`` of vectors chosen by hash, one for ``rows_per_pivot`` rows up to PIVOTS, beyond that an eighth of the root of the rows."""
    n = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most = F.greatest(F.lit(PIVOTS), F.ceil(F.sqrt("_n") / 8))
    want = F.least(most, F.ceil(F.col("_n") / rows_per_pivot)).cast("double")
    picked = attach(base.select(*keys, "vid", x), n, keys).withColumn("_h", hash_share(17, "vid"))
    # Hash order inside a small candidate set; the share keeps about 8 candidates per wanted pivot.
    picked = picked.filter(F.col("_h") < F.lit(8.0) * want / F.col("_n") + F.lit(64.0) / F.col("_n"))
    w = Window.partitionBy(*keys).orderBy("_h", "vid")
    picked = picked.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= want)
    return picked.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_rn", x))), lambda s: s[x]).alias("pv")
    )


def _assigned(rows: DataFrame, pivots: DataFrame, keys, x: str, p: int) -> DataFrame:
    """Distances ``pd`` to all pivots of the key, and the nearest one as ``cell``. A key's rows are shared out among tasks, which measure them by columns of numbers."""
    whole = F.forall(x, lambda c: c.isNotNull())  # vectors with a gap have no distance
    parts = sized(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BASE_BLOCK).cast("int").alias("_parts")))
    shared = rows.filter(whole).join(parts, list(keys)).withColumn("_part", F.pmod(F.xxhash64("vid", F.lit(3)), F.col("_parts")).cast("int")).drop("_parts")
    copies = pivots.join(parts, list(keys)).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    copies = copies.select(*[F.col(c).alias(c) for c in copies.columns])
    names = rows.columns

    def measure(a: pa.Table, b: pa.Table) -> pa.Table:  # Arrow keeps what is not a number, pandas makes it null
        a, d, cell = a.select(names), np.zeros((0, 0)), np.zeros(0, int)
        if a.num_rows and b.num_rows:
            u, v = np.stack(a[x].to_numpy()).astype(float), np.array(b["pv"][0].as_py(), float)
            d = np.concatenate([_gaps(u[lo:lo + 512], v, p) for lo in range(0, len(u), 512)])
            unknown = np.isnan(d)
            cell = np.where(unknown, np.inf, d).argmin(1)
            lost = unknown[np.arange(len(d)), cell]  # all others are infinite, or there are none
            cell[lost] = unknown[lost].argmin(1)
        ends = np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]
        out = a.slice(0, len(d)).append_column("pd", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(d.ravel())))
        return out.append_column("cell", pa.array(cell, pa.int32()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", pd array<double>, cell int"
    out = shared.groupBy(*keys, "_part").cogroup(copies.groupBy(*keys, "_part")).applyInArrow(measure, schema)
    return out.unionByName(rows.filter(~whole).withColumns({"pd": F.lit(None).cast("array<double>"), "cell": F.lit(None).cast("int")}))


def _plan_cells(base: DataFrame, queries: DataFrame, pivots: DataFrame, keys, need: int, p: int) -> DataFrame:
    """One row per key: ``reach`` per cell.  Works on one row for each pivot of a key."""
    at = [*keys, "cell"]
    b = base.groupBy(*at).agg(F.sum("m").alias("n"), F.max(F.array_min("pd")).alias("rb"))
    q = queries.groupBy(*at).agg(F.max(F.array_min("pd")).alias("rq"))
    cells = b.join(q, at, "full").join(pivots, list(keys))
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.select(*keys).schema)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pv = np.stack([np.asarray(v, float) for v in pdf["pv"].iloc[0]])
        k = len(pv)
        n, rb, rq = np.zeros(k), np.zeros(k), np.full(k, -1.0)
        c = pdf["cell"].to_numpy(int)
        n[c] = pdf["n"].fillna(0).to_numpy(float)
        rb[c] = pdf["rb"].fillna(0).to_numpy(float)
        rq[c] = pdf["rq"].fillna(-1).to_numpy(float)
        gap = np.abs(pv[:, None, :] - pv[None, :, :])
        d = np.sqrt((gap**2).sum(-1)) if p == 2 else gap.sum(-1)
        reach = np.full(k, -1.0)
        for i in range(k):
            if rq[i] < 0:
                continue  # no query in this cell
            far = d[i] + rb
            order = np.argsort(far, kind="stable")
            enough = np.searchsorted(np.cumsum(n[order]), need)
            bound = far[order[enough]] if enough < k else math.inf
            reach[i] = (2 * rq[i] + bound) * (1 + 1e-9) + 1e-9
        out = pdf.iloc[:1][list(keys)].copy()
        out["reach"] = [reach.tolist()]
        return out

    return cells.groupBy(*keys).applyInPandas(solve, f"{key_schema}, reach array<double>")


def _gaps(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Distances of the rows of two matrices, a coordinate at a time."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        total += gap * gap if p == 2 else np.abs(gap)
    return np.sqrt(total, out=total) if p == 2 else total


def _factors(u: np.ndarray, v: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices in the given precision; the products of their rows are squared distances less the squared norms of ``u``."""
    u, v = u.astype(kind), v.astype(kind)
    norms = (v.astype(float) ** 2).sum(1).astype(kind)
    return np.column_stack([-2 * u, np.ones(len(u), kind)]), np.column_stack([v, norms])


def _within(left: np.ndarray, right: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Places (row by row, in no order) of the few products of rows that are at most ``most`` of the left row. Tiles stay in the cache and are looked through
    eight pairs at a time."""
    found, n = [np.zeros(0, int)], len(right)
    room, mark = np.empty(NEAR_ROWS * NEAR_COLUMNS, left.dtype), np.zeros((NEAR_ROWS, NEAR_COLUMNS), bool)
    for lo in range(0, len(left), NEAR_ROWS):
        rows = left[lo:lo + NEAR_ROWS]
        for at in range(0, n, NEAR_COLUMNS):
            columns = right[at:at + NEAR_COLUMNS]
            shape = len(rows), len(columns)
            product = np.matmul(rows, columns.T, out=room[:shape[0] * shape[1]].reshape(shape))
            mark[:, shape[1]:] = False
            np.less_equal(product, most[lo:lo + NEAR_ROWS, None], out=mark[:shape[0], :shape[1]])
            some = np.flatnonzero(mark[:shape[0]].view(np.uint64) != 0)
            if len(some):
                eight, k = np.nonzero(mark.reshape(-1, 8)[some])
                i, j = np.divmod(some[eight] * 8 + k, NEAR_COLUMNS)
                found.append((i + lo) * n + j + at)
    return np.concatenate(found)


def _rough(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Manhattan distances of two matrices in their own precision."""
    total, left, right = np.zeros((len(u), len(v)), u.dtype), np.ascontiguousarray(u.T), np.ascontiguousarray(v.T)
    for a in range(0, len(u), 256):  # a tile of three matrices stays in the cache
        for b in range(0, len(v), 1024):
            part = np.zeros((min(256, len(u) - a), min(1024, len(v) - b)), u.dtype)
            gap = np.empty_like(part)
            for x, y in zip(left[:, a:a + 256], right[:, b:b + 1024], strict=True):
                np.subtract(x[:, None], y[None], out=gap)
                np.abs(gap, out=gap)
                part += gap
            total[a:a + 256, b:b + 1024] = part
    return total


def _steps(rows: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates (a row each) in whole steps of the range -half to half, those beyond at its ends, and what rounding moved each row by, in steps."""
    exact = (np.clip(rows, -half, half) + half) * ((LEVELS - 1) / (2 * half))
    whole = np.rint(exact)
    return np.ascontiguousarray(whole.T.astype(np.int8)), np.abs(exact - whole).sum(1)


def _step_sums(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Manhattan distances between the columns of two matrices of steps. Four coordinates add up in a byte, pairs of bytes are then added to words."""
    n = right.shape[1]
    right = np.pad(right, ((0, 0), (0, n % 2)))
    total = np.empty((left.shape[1], right.shape[1]), np.uint16)
    for a in range(0, total.shape[0], STEP_ROWS):
        for b in range(0, total.shape[1], STEP_COLUMNS):
            tile = total[a:a + STEP_ROWS, b:b + STEP_COLUMNS]
            part, gap = np.empty(tile.shape, np.int8), np.empty(tile.shape, np.int8)
            pairs, sum_bytes, gap_bytes = part.view(np.uint16), part.view(np.uint8), gap.view(np.uint8)
            even, odd, half = (np.zeros(pairs.shape, np.uint16) for _ in range(3))
            for j in range(0, len(left), 4):
                for i in range(j, min(j + 4, len(left))):
                    to = part if i == j else gap
                    np.subtract(left[i, a:a + STEP_ROWS, None], right[i, None, b:b + STEP_COLUMNS], out=to)
                    np.abs(to, out=to)
                    if i > j:
                        np.add(sum_bytes, gap_bytes, out=sum_bytes)
                np.bitwise_and(pairs, 255, out=half)
                even += half
                np.right_shift(pairs, 8, out=half)
                odd += half
            tile[:, ::2], tile[:, 1::2] = even, odd
    return total[:, :n]


def _single(u: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Manhattan distances of pairs of rows in single precision."""
    out = np.empty(len(i), np.float32)
    for lo in range(0, len(i), 2048):
        gap = u[i[lo:lo + 2048]]
        gap -= v[j[lo:lo + 2048]]
        np.abs(gap, out=gap).sum(1, out=out[lo:lo + 2048])
    return out


def _measured(u: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray, p: int) -> np.ndarray:
    """Distances of pairs of rows, a coordinate at a time as :func:`_gaps` adds them; some pairs at a time, which stay in the cache."""
    out = np.zeros(len(i))
    for lo in range(0, len(i), MEASURED):
        gap, d = u[i[lo:lo + MEASURED]], out[lo:lo + MEASURED]
        gap -= v[j[lo:lo + MEASURED]]
        for part in np.multiply(gap, gap, out=gap).T.copy() if p == 2 else np.abs(gap, out=gap).T.copy():
            d += part
    return np.sqrt(out, out=out) if p == 2 else out


def _nearest_rows(u: np.ndarray, v: np.ndarray, k: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and rows of ``v``, the ``k`` first in the order of (distance, row) for each row of ``u``.

    A rough distance plus the bound on its error tells which pairs can be among them; these are measured as :func:`_gaps` does. For p = 1 a distance in whole steps, less what
    rounding to them can add, comes first: values beyond the range of the steps only make it smaller.
    """
    k = min(k, len(v))
    if not (np.isfinite(u).all() and np.isfinite(v).all()):
        d = _gaps(u, v, p)
        j = np.argsort(d, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(d, j, 1), j
    best, row = np.full((len(u), k), np.inf), np.full((len(u), k), len(v))
    with np.errstate(over="ignore", invalid="ignore"):
        middle = v.mean(0)
        size = max(np.abs(u - middle).max(initial=0), np.abs(v - middle).max(initial=0)) or 1.0
        a, b = (u - middle) / size, (v - middle) / size
    norm = lambda m: np.einsum("ij,ij->i", m, m) if p == 2 else np.abs(m).sum(1)
    own, other = norm(a), norm(b)
    if not (np.isfinite(size) and np.isfinite(own).all() and np.isfinite(other).all()):
        own = None  # differences leave the range of numbers: every pair is measured
    kind, factors, stepped = np.float32, {}, p == 1 and own is not None and u.shape[1] <= STEP_DIMS
    if stepped:
        half = float(np.quantile(np.abs(b[:: max(1, len(b) // 4096)]), 0.99)) or 1.0
        step = 2 * half / (LEVELS - 1)
        stepped = step > 0 and np.isfinite(1 / step)
    if stepped:
        (steps_u, moved_u), (steps_v, moved_v) = _steps(a, half), _steps(b, half)
        single_u, single_v = a.astype(np.float32), b.astype(np.float32)
    # Only the first columns are ranked, the next ones are held against the best so far: for p = 2 few at first, then as many as before them.
    tiles = [0]
    while tiles[-1] < len(v):
        tiles.append(tiles[-1] + (min(max(tiles[-1], FIRST_COLUMNS, k), COLUMN_TILE) if p == 2 else COLUMN_TILE))
    for lo in range(0, len(u), ROW_TILE):
        rows = np.arange(lo, min(lo + ROW_TILE, len(u)))
        for at, end in zip(tiles, tiles[1:], strict=False):
            there = slice(at, end)
            n = len(v[there])
            if own is None:
                hit = np.arange(len(rows) * n)
            else:
                limit, hit = (best[rows, -1] / size) ** p, None
            if own is not None and stepped:
                sums, known = _step_sums(steps_u[:, rows], steps_v[:, there]), np.isfinite(limit).all()
                if n >= k and not known:
                    some = np.argpartition(sums, k - 1, axis=1)[:, :k]  # any k pairs bound the k-th distance
                    near = _measured(u, v, np.repeat(rows, k), some.ravel() + at, p)
                    limit = np.minimum(limit, near.reshape(some.shape).max(1) / size)
                most = limit / step * (1 + 1e-9) + moved_u[rows] + moved_v[there].max() + 1e-6
                hit = np.flatnonzero(sums <= np.minimum(most, 65535).astype(np.uint16)[:, None])
                if len(hit) > REMAINING * sums.size:
                    hit, stepped = None, not known  # steps too wide to tell these vectors apart
                else:
                    i, j = np.divmod(hit, n)
                    enough = limit + np.finfo(np.float32).eps * (u.shape[1] + 8) * (own[rows] + 2 * other[there].max()) + 1e-30
                    hit = hit[_single(single_u, single_v, i + lo, j + at) <= enough[i]]
            if hit is None:
                bounded = np.isfinite(best[rows, -1]).all()
                for kind in (np.float32, np.float64) if kind is np.float32 else (np.float64,):
                    slack = np.finfo(kind).eps * (u.shape[1] + 8) * (own[rows] + 2 * other[there].max()) + 1e-30
                    shift = own[rows] if p == 2 else 0.0
                    reach, rough = limit + slack, None
                    if p == 2 and kind not in factors:
                        factors = {kind: _factors(a, b, kind)}
                    if p == 1:
                        rough = _rough(a[rows].astype(kind), b[there].astype(kind))
                    elif not bounded:
                        rough = factors[kind][0][rows] @ factors[kind][1][there].T
                    if n >= k and not bounded:
                        reach = np.minimum(reach, np.partition(rough, k - 1, axis=1)[:, k - 1] + shift + 2 * slack)
                    if np.median(slack) <= 0.01 * np.median(reach):
                        break
                most = np.minimum(reach - shift + slack, np.finfo(kind).max).astype(kind)
                hit = _within(factors[kind][0][rows], factors[kind][1][there], most) if rough is None else np.flatnonzero(rough <= most[:, None])
            if not len(hit):
                continue
            for few in np.array_split(hit, max(1, len(hit) >> 20)):  # many pairs at equal distances are measured in parts
                i, j = few // n, few % n + at
                d = _measured(u, v, rows[i], j, p)
                some = np.unique(i)
                i = np.concatenate([np.repeat(some, k), i])
                d, j = np.concatenate([best[rows[some]].ravel(), d]), np.concatenate([row[rows[some]].ravel(), j])
                order = np.lexsort((j, d, i))
                start = np.searchsorted(i[order], some)
                first = order[start[:, None] + np.arange(k)]
                best[rows[some]], row[rows[some]] = d[first], j[first]
    return best, row


def _cell_pivots(rows: DataFrame, at: list[str], x: str, block_rows: int) -> DataFrame:
    """(cell, blk, px): one vector for ``block_rows`` rows of a cell, up to four times the root of its rows, chosen by hash."""
    n = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    want = F.least(F.ceil(F.col("_n") / block_rows), F.ceil(4 * F.sqrt("_n"))).cast("double")
    picked = attach(rows.select(*at, "vid", x), n, at).withColumn("_h", hash_share(23, "vid"))
    picked = picked.filter(F.col("_h") < F.lit(4.0) * want / F.col("_n") + F.lit(32.0) / F.col("_n"))
    w = Window.partitionBy(*at).orderBy("_h", "vid")
    picked = picked.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= want)
    return picked.select(*at, (F.col("_rn") - 1).cast("int").alias("blk"), F.col(x).alias("px"))


def _in_blocks(rows: DataFrame, pivots: DataFrame, at: list[str], x: str, p: int) -> DataFrame:
    """Rows of a cell with the nearest pivot of the cell, ``blk``, and the distance to it, ``bd``. A cell's rows are shared out among tasks."""
    parts = sized(rows.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / BASE_BLOCK).cast("int").alias("_parts")))
    shared = rows.join(parts, at).withColumn("_part", F.pmod(F.xxhash64("vid", F.lit(5)), F.col("_parts")).cast("int")).drop("_parts")
    copies = pivots.join(parts, at).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    copies = copies.select(*[F.col(c).alias(c) for c in copies.columns])
    names = rows.columns

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = a[names].copy()
        if a.empty or b.empty:
            return out.iloc[:0].assign(blk=0, bd=0.0)
        centre, blk = np.stack(b["px"].to_numpy()).astype(float), b["blk"].to_numpy()
        gap, best = _nearest_rows(np.stack(a[x].to_numpy()).astype(float), centre, 1, p)
        return out.assign(blk=blk[best[:, 0]], bd=gap[:, 0])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", blk int, bd double"
    return shared.groupBy(*at, "_part").cogroup(copies.groupBy(*at, "_part")).applyInPandas(near, schema)


def _block_pairs(q: DataFrame, sent: DataFrame, pivots: DataFrame, at: list[str], need: int, p: int, query_block: int, base_block: int) -> DataFrame:
    """(cell, qb, bb, nq, nb): the blocks of candidates that a block of queries needs, and into how many parts either is cut. -1 stands for all blocks of a cell."""
    balls = lambda df, n, r: df.groupBy(*at, "blk").agg(F.count(F.lit(1)).alias(n), F.sum("m").alias(f"{n}m"), F.max("bd").alias(r))
    known = pivots.join(balls(q, "nq", "rq"), [*at, "blk"], "left").join(balls(sent, "nb", "rb"), [*at, "blk"], "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pivots.select(*at).schema) + ", qb int, bb int, nq int, nb int"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.fillna({c: 0 for c in ("nq", "nqm", "rq", "nb", "nbm", "rb")})
        centre, blk = np.stack(pdf["px"].to_numpy()).astype(float), pdf["blk"].to_numpy()
        nq, rq, nb, nbm, rb = (pdf[c].to_numpy(float) for c in ("nq", "rq", "nb", "nbm", "rb"))
        asks, has = np.flatnonzero(nq > 0), np.flatnonzero(nb > 0)
        pairs = []
        for i in asks:
            d = _gaps(centre[i:i + 1], centre[has], p)[0]
            far = d + rb[has]
            order = np.argsort(far, kind="stable")
            enough = np.searchsorted(np.cumsum(nbm[has][order]), need)
            bound = far[order[enough]] if enough < len(has) else np.inf
            meets = has[d - rb[has] <= (2 * rq[i] + bound) * (1 + 1e-9) + 1e-9]
            pairs.append((np.full(len(meets), i), meets))
        i, j = (np.concatenate(c) if pairs else np.zeros(0, int) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 2
        if len(i) > LITTLE * len(asks) * len(has):
            # Rows are copied once for every part of the other side: large parts, and some 32 of the queries where that leaves them large enough.
            part = min(max(nq.sum() / 32, 4 * query_block), 16 * query_block)
            out = pd.DataFrame({"qb": [-1], "bb": [-1], "nq": [math.ceil(nq.sum() / part)], "nb": [math.ceil(nb.sum() / (8 * base_block))]})
        else:
            out = pd.DataFrame({"qb": blk[i], "bb": blk[j], "nq": np.ceil(nq[i] / query_block), "nb": np.ceil(nb[j] / base_block)})
        for c in reversed(at):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    return sized(known.groupBy(*at).applyInPandas(solve, schema))


def _held(q: DataFrame, sent: DataFrame, at: list[str]) -> DataFrame:
    """Queries and candidates of each cell that has both."""
    count = lambda df, n: df.groupBy(*at).agg(F.count(F.lit(1)).alias(n))
    return sized(count(sent, "_b").join(count(q, "_q"), at))


def knn(
    base: DataFrame, k: int, keys: Sequence[str] = KEYS, x: str = "x", id: str = "t", p: int = 2,
    queries: DataFrame | None = None, rows_per_pivot: int = ROWS_PER_PIVOT, query_block: int = QUERY_BLOCK,
    base_block: int = BASE_BLOCK, block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Neighbours of every distinct query vector, and the distinct query vectors.

    First result: (keys, vid, d, nb, take): neighbour vector ``nb`` at distance ``d`` counts ``take`` times, the
    counts of one vid add up to k (or to all there are).  Without ``queries`` the base is matched with
    itself and a row is not its own neighbour, but its copies are.
    """
    itself = queries is None
    s = cut(distinct_vectors(base, keys, x, id))
    pivots = sized(_pivots(s, keys, x, rows_per_pivot))
    s = cut(_assigned(s, pivots, keys, x, p))
    q = s if itself else cut(_assigned(cut(distinct_vectors(queries, keys, x, id)), pivots, keys, x, p))
    need = k + 1 if itself else k
    reach = sized(_plan_cells(s, q, pivots, keys, need, p))
    at = [*keys, "cell"]

    def to_cells(rows: DataFrame) -> DataFrame:
        near = F.filter(F.sequence(F.lit(0), F.size("reach") - 1), lambda i: F.element_at("pd", i + 1) <= F.element_at("reach", i + 1))
        return rows.join(reach, list(keys)).select(*keys, "vid", "m", x, F.explode(near).alias("cell"))

    sent = to_cells(s)
    held = _held(q, sent, at)
    all_rows = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    met = held.groupBy(*keys).agg(F.sum(F.col("_b") * F.col("_q")).alias("_met"), F.sum("_q").alias("_asked")).join(all_rows, list(keys))
    undivided = met.filter((F.col("_n") > base_block) & (F.col("_met") > LITTLE * F.col("_asked") * F.col("_n")))
    undivided = sized(undivided.select(*keys, F.lit(0).alias("_one")))
    if not undivided.isEmpty():
        place = F.coalesce("_one", "cell").alias("cell")
        whole = s.join(undivided, list(keys)).select(*keys, "vid", "m", x, F.col("_one").alias("cell"))
        sent = to_cells(s.join(undivided, list(keys), "left_anti")).unionByName(whole)
        q = q.join(undivided, list(keys), "left").select(*keys, "vid", "m", x, place)
        held = _held(q, sent, at)
    if held.filter(F.col("_b") > base_block).isEmpty():  # every cell's candidates fit one block
        one = lambda df: df.select(*at, "vid", "m", x, F.lit(-1).alias("blk"), F.lit(0.0).alias("bd"))
        asked, offered = one(q), one(sent)
        pairs = sized(held.select(*at, F.lit(-1).alias("qb"), F.lit(-1).alias("bb"), F.ceil(F.col("_q") / query_block).cast("int").alias("nq"), F.lit(1).alias("nb")))
    else:
        # Candidates from other cells need pivots of their own, or they would blow up the balls around the cell's pivots.
        both_sides = sent if itself else sent.select(*at, "vid", x).unionByName(q.select(*at, "vid", x))
        subs = sized(_cell_pivots(both_sides, at, x, block_rows))
        asked = cut(_in_blocks(q.select(*at, "vid", "m", x), subs, at, x, p))
        offered = cut(_in_blocks(sent, subs, at, x, p))
        pairs = _block_pairs(asked, offered, subs, at, need, p, query_block, base_block)
    coarse = sized(pairs.filter("qb = -1").select(*at, F.lit(True).alias("_whole")))

    def spread(rows, own, part, own_n, other_part, other_n):
        placed = rows.join(coarse, at, "left").withColumn(own, F.when(F.col("_whole"), F.lit(-1)).otherwise(F.col("blk"))).drop("_whole", "blk", "bd")
        placed = placed.join(pairs, [*at, own]).withColumn(part, F.pmod(F.xxhash64("vid"), F.col(own_n)).cast("int"))
        return placed.withColumn(other_part, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1))).drop("nq", "nb")

    left = spread(asked, "qb", "qp", "nq", "bp", "nb")
    right = spread(offered, "bb", "bp", "nb", "qp", "nq")
    # both sides come from one table: give the columns of one side their own identity
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    group = [*at, "qb", "bb", "qp", "bp"]
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.select(*keys).schema)
    names = list(keys)

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        cols = [*names, "vid", "d", "nb", "n"]
        if a.empty or b.empty:
            return pd.DataFrame(columns=cols)
        u, v = np.stack(a[x].to_numpy()).astype(float), np.stack(b[x].to_numpy()).astype(float)
        bid, bm, aid, am = (c.to_numpy() for c in (b["vid"], b["m"], a["vid"], a["m"]))
        order = np.argsort(bid, kind="stable")
        v, bid, bm = v[order], bid[order], bm[order]
        d, j = _nearest_rows(u, v, need, p)
        i, d, j = np.repeat(np.arange(len(u)), d.shape[1]), d.ravel(), j.ravel()
        n = bm[j].copy()
        if itself:
            same = bid[j] == aid[i]
            n[same] = am[i][same] - 1
            use = n > 0
            i, j, n, d = i[use], j[use], n[use], d[use]
        res = pd.DataFrame({"vid": aid[i], "d": d, "nb": bid[j], "n": n})
        for c in reversed(names):
            res.insert(0, c, a[c].iloc[0])
        return res[cols]

    id_type = base.schema[id].dataType.simpleString()
    best = (
        left.groupBy(*group)
        .cogroup(right.groupBy(*group))
        .applyInPandas(nearest, f"{key_schema}, vid {id_type}, d double, nb {id_type}, n long")
    )
    w = Window.partitionBy(*keys, "vid").orderBy("d", "nb")
    seen = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    best = best.withColumn("_seen", seen).filter(F.col("_seen") < k)
    best = best.withColumn("take", F.least(F.col("n"), F.lit(k) - F.col("_seen"))).drop("n", "_seen")
    return best, q.select(*keys, "vid", "m", x)


def to_rows(df: DataFrame, vectors: DataFrame, scores: DataFrame, keys=KEYS, x: str = "x") -> DataFrame:
    """Results per distinct vector back on the rows that hold it."""
    by_vector = vectors.join(scores, [*keys, "vid"])
    return df.join(by_vector.drop("m"), [*keys, x])


def knn_score(
    df: DataFrame, k: int = 10, method: str = "largest", keys: Sequence[str] = KEYS, x: str = "x", id: str = "t",
    train: DataFrame | None = None, **plan,
) -> DataFrame:
    """(keys, id, score): distance to the k-th neighbour (largest), or mean or median of the k distances."""
    near, vectors = knn(df if train is None else train, k, keys, x, id, queries=None if train is None else df, **plan)
    w = Window.partitionBy(*keys, "vid").orderBy("d", "nb")
    last = F.sum("take").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("take").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = near.withColumn("_last", last).withColumn("_total", total)
    if method == "largest":
        agg = F.max("d")
    elif method == "mean":
        agg = F.sum(F.col("d") * F.col("take")) / F.sum("take")
    elif method == "median":
        def at(pos):
            return F.max(F.when((F.col("_last") - F.col("take") <= pos) & (pos < F.col("_last")), F.col("d")))

        agg = (at(F.floor((F.col("_total") - 1) / 2)) + at(F.floor(F.col("_total") / 2))) / 2
    else:
        raise ValueError(f"unknown method {method}")
    scores = near.groupBy(*keys, "vid").agg(agg.alias("score"))
    return to_rows(df.select(*keys, id, x), vectors, scores, keys, x).select(*keys, id, "score")


def lof_score(
    df: DataFrame, k: int = 30, keys: Sequence[str] = KEYS, x: str = "x", id: str = "t", p: int = 2, **plan
) -> DataFrame:
    """Local outlier factor: mean local reachability density of the neighbours over the own one."""
    near, vectors = knn(df, k, keys, x, id, p, **plan)
    near = cut(near)
    kdist = near.groupBy(*keys, F.col("vid").alias("nb")).agg(F.max("d").alias("kd"))
    reach = near.join(kdist, [*keys, "nb"])
    mean_reach = F.sum(F.greatest("d", "kd") * F.col("take")) / F.sum("take")
    lrd = cut(reach.groupBy(*keys, "vid").agg((F.lit(1.0) / (mean_reach + F.lit(1e-10))).alias("lrd")))
    of_nb = lrd.withColumnsRenamed({"vid": "nb", "lrd": "lrd_nb"})
    scores = (
        near.join(of_nb, [*keys, "nb"])
        .groupBy(*keys, "vid").agg((F.sum(F.col("lrd_nb") * F.col("take")) / F.sum("take")).alias("m"))
        .join(lrd, [*keys, "vid"])
        .select(*keys, "vid", (F.col("m") / F.col("lrd")).alias("score"))
    )
    return to_rows(df.select(*keys, id, x), vectors, scores, keys, x).select(*keys, id, "score")
