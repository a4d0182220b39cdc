"""Queries: cleaning, scaling, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, scale, windows
from . import fixtures as fx
from .base import query, rd, rounded
from .fixtures import sql

C4 = ["c1", "c2", "c3", "c4"]


@query("prj1_nan_inf_to_zero", sql("ts_hour_grid", """SELECT series_id, t, CAST(coalesce(c1, 0) AS DOUBLE) AS c1,
    CASE WHEN c2 IS NULL OR c2 = 0 THEN 0.0 ELSE round(1.0/c2, 6) + 0.0 END AS c2,
    CASE WHEN c3 IS NULL OR c1 = 1 THEN 0.0 ELSE round(c3/(c1-1), 6) + 0.0 END AS c3 FROM ts_hour_grid"""))
def _(spark, d):
    g = fx.ts_hour_grid(spark, d).select(
        "series_id", "t", "c1", F.try_divide(F.lit(1.0), F.col("c2")).alias("c2"),
        F.when(F.col("c1") == 1, F.lit(float("inf"))).otherwise(F.col("c3") / (F.col("c1") - 1)).alias("c3"),
    )
    return rounded(clean.nan_inf_to_zero(g, ["c1", "c2", "c3"]))


@query("prj2_drop_constant", sql("", """SELECT series_id, t, channel, x FROM (SELECT *, min(x) OVER
    (PARTITION BY series_id, channel) AS a, max(x) OVER (PARTITION BY series_id, channel) AS b FROM l) WHERE a < b""",
    """b AS (SELECT l_orderkey AS series_id, l_linenumber AS t, l_quantity AS q, l_tax AS tax, l_discount AS disc
    FROM lineitem), l AS (SELECT series_id, t, 'q' AS channel, q AS x FROM b UNION ALL SELECT series_id, t, 'tax', tax
    FROM b UNION ALL SELECT series_id, t, 'disc', disc FROM b)"""))
def _(spark, d):
    li = fx.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("series_id"), F.col("l_linenumber").alias("t"),
        F.col("l_quantity").alias("q"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("disc"))
    return clean.drop_constant(clean.melt(li, ["series_id", "t"], ["q", "tax", "disc"]))


@query("prj3_drop_all_zero", sql("", """SELECT series_id, t, channel, x FROM (SELECT *, max(abs(x)) OVER
    (PARTITION BY series_id, channel) AS m FROM l) WHERE m > 0""",
    """b AS (SELECT l_orderkey AS series_id, l_linenumber AS t, l_tax AS tax, l_discount AS disc
    FROM lineitem), l AS (SELECT series_id, t, 'tax' AS channel, tax AS x FROM b
    UNION ALL SELECT series_id, t, 'disc', disc FROM b)"""))
def _(spark, d):
    li = fx.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("series_id"), F.col("l_linenumber").alias("t"),
        F.col("l_tax").alias("tax"), F.col("l_discount").alias("disc"))
    return clean.drop_all_zero(clean.melt(li, ["series_id", "t"], ["tax", "disc"]))


@query("prj4_impute_mean", sql("ts_hour_grid", """SELECT series_id, t,
    round(coalesce(c1, avg(c1) OVER (PARTITION BY series_id)), 6) + 0.0 AS c1,
    round(coalesce(c2, avg(c2) OVER (PARTITION BY series_id)), 6) + 0.0 AS c2,
    round(coalesce(c3, avg(c3) OVER (PARTITION BY series_id)), 6) + 0.0 AS c3 FROM ts_hour_grid"""))
def _(spark, d):
    return rounded(clean.impute_mean(fx.ts_hour_grid(spark, d), ["c1", "c2", "c3"]))


@query("prj5_prediction_fix", sql("ts_hour_grid", """SELECT series_id, t, round(coalesce(c2 / c1, 0.0), 6) + 0.0 AS pred
    FROM ts_hour_grid"""))
def _(spark, d):
    g = fx.ts_hour_grid(spark, d)
    ratio = F.coalesce(F.col("c2") / F.col("c1"), F.lit(float("nan")))
    return rounded(g.select("series_id", "t", clean.finite_or(ratio).alias("pred")))


@query("prj6_centre_cut", sql("ts_day", """SELECT series_id, t - s AS t, c1 FROM (SELECT *,
    greatest(CAST(floor((count(*) OVER (PARTITION BY series_id) - 1000) / 2.0) AS BIGINT), 0) AS s FROM ts_day)
    WHERE t >= s AND t < s + 1000"""))
def _(spark, d):
    return clean.centre_cut(fx.ts_day(spark, d).select("series_id", "t", "c1"), 1000)


@query("prj7_repeat_short", sql("ts_user", """SELECT series_id, r * n + t AS t, c1 FROM (SELECT *, count(*) OVER
    (PARTITION BY series_id) AS n FROM ts_user) JOIN (SELECT range AS r FROM range(100)) ON r < ceil(100.0 / n)
    AND n < 50 OR r = 0 WHERE n >= 50 OR r * n + t < 100"""))
def _(spark, d):
    return clean.repeat_short(fx.ts_user(spark, d).select("series_id", "t", "c1"), 50, 100)


@query("prj8_hold", sql("ts_hour_grid", """SELECT series_id, t, coalesce(
    last_value(c2 IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING),
    first_value(c2 IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    AS c2 FROM g""", "g AS (SELECT series_id, t, round(c2, 6) + 0.0 AS c2 FROM ts_hour_grid)"))
def _(spark, d):
    g = fx.ts_hour_grid(spark, d).select("series_id", "t", rd("c2").alias("c2"))
    return clean.sample_and_hold(g, ["c2"])


@query("prj9_tidy_meta", sql("ts_day", """SELECT series_id, count(*) AS n, round(avg(c1), 6) + 0.0 AS mean_c1,
    -3.0 AS ratio FROM ts_day GROUP BY 1"""))
def _(spark, d):
    m = fx.ts_day(spark, d).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("c1").alias("mean_c1"),
        F.avg(F.pow("c3", F.lit(5))).alias("moment_5_mean"), F.lit(float("-inf")).alias("ratio"))
    return rounded(clean.tidy_meta(m, ["moment_5", "moment_6"], {"ratio": -3.0}))


@query("prj10_prepare_meta", sql("perf", """SELECT dataset, round((a - avg(a) OVER ()) / stddev_samp(a) OVER (), 6) + 0.0
    AS a, round((b - avg(b) OVER ()) / stddev_samp(b) OVER (), 6) + 0.0 AS b FROM (SELECT dataset, max(perf) AS a,
    max(pred) AS b FROM perf GROUP BY 1)"""))
def _(spark, d):
    m = fx.perf(spark, d).groupBy("dataset").agg(
        F.max("perf").alias("a"), F.max("pred").alias("b"), F.lit(1.0).alias("constant"))
    return rounded(clean.prepare_meta(m, ["a", "b", "constant"]))


@query("prj11_dataset_keys", sql("", """SELECT doc_id, regexp_replace(lower(concat(lang, '_', source, '_test.csv')),
    '(_test)?\\.csv$', '') AS dataset, lang AS grp FROM documents"""))
def _(spark, d):
    name = F.concat_ws("_", "lang", "source", F.lit("TEST.csv"))
    t = fx.table(spark, d, "documents").select("doc_id", name.alias("f"))
    return t.select("doc_id", clean.dataset_key("f").alias("dataset"), clean.dataset_group("f").alias("grp"))


@query("prj13_size_bins", sql("", """SELECT c_size AS bin, count(*) AS n FROM (SELECT CASE WHEN n_chars < 500 THEN '<500'
    WHEN n_chars < 2000 THEN '500-2000' ELSE '>=2000' END AS c_size FROM documents) GROUP BY 1"""))
def _(spark, d):
    b = clean.size_bin("n_chars", ((500, "<500"), (2000, "500-2000")), ">=2000")
    return fx.table(spark, d, "documents").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("prj14_sanitise", sql("ts_user", """SELECT series_id, t, CASE WHEN c2 = 0 THEN 1.0 WHEN c2 = 1 THEN 0.0
    WHEN c2 = 2 THEN 0.0 ELSE score END AS fixed, CASE WHEN c2 <= 2 THEN 1.0 - label ELSE score END AS penalised
    FROM ts_user"""))
def _(spark, d):
    inf = float("inf")
    bad = F.when(F.col("c2") == 0, F.lit(inf)).when(F.col("c2") == 1, F.lit(-inf)).when(
        F.col("c2") == 2, F.lit(float("nan"))).otherwise(F.col("score"))
    u = fx.ts_user(spark, d).withColumn("score", bad)
    return u.select("series_id", "t", clean.sanitise_score("score").alias("fixed"),
                    clean.sanitise_score("score", "label", "penalise").alias("penalised"))


def _day(spark, d):
    return fx.ts_day(spark, d).select("series_id", "t", *C4)


def _per_col(expr: str) -> str:
    return ", ".join(f"round({expr.replace('#', c)}, 5) + 0.0 AS {c}" for c in C4)


OVER = "OVER (PARTITION BY series_id)"


@query("scl1_minmax", sql("ts_day", f"""SELECT series_id, t, {_per_col(
    f'(# - min(#) {OVER}) / (max(#) {OVER} - min(#) {OVER})')} FROM ts_day"""))
def _(spark, d):
    return rounded(scale.minmax(_day(spark, d), C4), 5)


@query("scl3_window_column_zscore", sql("ts_hour_labelled", """SELECT series_id, t, i - 1 AS pos,
    round((x - avg(x) OVER p) / stddev_pop(x) OVER p, 6) + 0.0 AS z FROM w WINDOW p AS (PARTITION BY series_id, i)""",
    """w AS (SELECT a.series_id, a.t, i, b.c1 AS x FROM ts_hour_labelled a CROSS JOIN (SELECT unnest(range(1, 6)) AS i)
    JOIN ts_hour_labelled b ON a.series_id = b.series_id AND b.t = a.t + i - 1 WHERE a.t <= 715)"""))
def _(spark, d):
    w = windows.slide(fx.ts_hour_labelled(spark, d), ["c1"], 5)
    cols = [f"p{i}" for i in range(5)]
    wide = w.select("series_id", "t", *[F.col("win")[i].alias(c) for i, c in enumerate(cols)])
    z = scale.standardise(wide, cols)
    return rounded(z.select("series_id", "t", F.posexplode(F.array(*cols)).alias("pos", "z")))


@query("scl4_standardise", sql("ts_day", f"""SELECT series_id, t, {_per_col(
    f'(# - avg(#) {OVER}) / stddev_pop(#) {OVER}')} FROM ts_day"""))
def _(spark, d):
    return rounded(scale.standardise(_day(spark, d), C4), 5)


@query("scl5_split_zscore", sql("ts_day", f"""SELECT series_id, t, {_per_col(
    f'(# - avg(#) FILTER (t < 1500) {OVER}) / stddev_pop(#) FILTER (t < 1500) {OVER}')} FROM ts_day"""))
def _(spark, d):
    return rounded(scale.split_zscore(_day(spark, d), C4, fit=F.col("t") < 1500), 5)


@query("scl2_row_zscore", sql("emb emb_long", """SELECT t, channel - 1 AS pos, round((x - avg(x) OVER p) /
    stddev_samp(x) OVER p, 6) + 0.0 AS z FROM emb_long WINDOW p AS (PARTITION BY t)"""))
def _(spark, d):
    z = fx.embeddings(spark, d).select("t", F.posexplode(scale.row_zscore(F.col("x"))).alias("pos", "z"))
    return rounded(z)


@query("scl6_row_minmax", sql("emb emb_long", """SELECT t, channel - 1 AS pos, round((x - min(x) OVER p) /
    (max(x) OVER p - min(x) OVER p), 6) + 0.0 AS z FROM emb_long WINDOW p AS (PARTITION BY t)"""))
def _(spark, d):
    z = fx.embeddings(spark, d).select("t", F.posexplode(scale.row_minmax(F.col("x"))).alias("pos", "z"))
    return rounded(z)


def _win_sql(table: str, cols: list[str], w: int, last: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT a.series_id, a.t, {k} * {w} + (b.t - a.t) AS pos, {k} AS ch, b.t - a.t AS step, b.{c} AS x "
        f"FROM {table} a JOIN {table} b ON a.series_id = b.series_id AND b.t BETWEEN a.t AND a.t + {w - 1}"
        for k, c in enumerate(cols)
    )
    return f"""w AS (SELECT * FROM ({parts}) z WHERE EXISTS (SELECT 1 FROM {table} q WHERE q.series_id = z.series_id
        AND q.t = z.t + {w - 1}))"""


@query("scl7_rin", sql("ts_hour_labelled", """SELECT series_id, t, pos, round((x - avg(x) OVER p) /
    sqrt(var_pop(x) OVER p + 1e-5), 5) + 0.0 AS z, round(x, 5) + 0.0 AS back FROM w
    WINDOW p AS (PARTITION BY series_id, t)""", _win_sql("ts_hour_labelled", ["c1"], 12, "")))
def _(spark, d):
    w = windows.slide(fx.ts_hour_labelled(spark, d), ["c1"], 12)
    n = scale.instance_norm(F.col("win"))
    both = w.select("series_id", "t", n.alias("n")).select(
        "series_id", "t", F.posexplode(F.arrays_zip(F.col("n.values").alias("z"),
                                                    scale.instance_denorm(F.col("n")).alias("back"))).alias("pos", "r"))
    return rounded(both.select("series_id", "t", "pos", F.col("r.z").alias("z"), F.col("r.back").alias("back")), 5)


@query("scl8_segment_norm", sql("ts_hour_labelled", """SELECT series_id, t, pos, round((x - avg(x) OVER p) /
    sqrt(var_pop(x) OVER p + 1e-5), 5) + 0.0 AS z FROM w WINDOW p AS (PARTITION BY series_id, t, pos // 5)""",
    _win_sql("ts_hour_labelled", ["c1"], 12, "")))
def _(spark, d):
    w = windows.slide(fx.ts_hour_labelled(spark, d), ["c1"], 12)
    z = w.select("series_id", "t", F.posexplode(scale.segment_norm(F.col("win"), 12, 5)).alias("pos", "z"))
    return rounded(z, 5)


@query("scl9_robust", sql("ts_day", """SELECT series_id, t, channel, round((x - med) / (1.4826 * mad), 5) + 0.0 AS x
    FROM (SELECT *, median(abs(x - med)) OVER (PARTITION BY series_id, channel) AS mad FROM (SELECT *, median(x) OVER
    (PARTITION BY series_id, channel) AS med FROM l))""", """l AS (""" + " UNION ALL ".join(
    f"SELECT series_id, t, '{c}' AS channel, {c} AS x FROM ts_day" for c in C4) + ")"))
def _(spark, d):
    return rounded(scale.robust(clean.melt(_day(spark, d), ["series_id", "t"], C4)), 5)


@query("scl9_zscore_sample", sql("ts_day", f"""SELECT series_id, t, {_per_col(
    f'(# - avg(#) {OVER}) / stddev_samp(#) {OVER}')} FROM ts_day"""))
def _(spark, d):
    return rounded(scale.zscore_sample(_day(spark, d), C4), 5)


@query("scl11_negative_inverse", sql("perf", """SELECT dataset, model, round(-1.0 / (perf + 1), 6) + 0.0 AS y
    FROM perf"""))
def _(spark, d):
    return rounded(fx.perf(spark, d).select("dataset", "model", scale.negative_inverse(F.col("perf") + 1).alias("y")))


@query("win1_windows", sql("ts_hour_labelled", "SELECT series_id, t, pos, round(x, 6) + 0.0 AS x FROM w",
                           _win_sql("ts_hour_labelled", ["c1", "c2"], 6, "")))
def _(spark, d):
    w = windows.slide(fx.ts_hour_labelled(spark, d), ["c1", "c2"], 6)
    return rounded(w.select("series_id", "t", F.posexplode("win").alias("pos", "x")))


@query("win2_time_major", sql("ts_hour_labelled", """SELECT series_id, t, step, ch, round(x, 6) + 0.0 AS x FROM w
    WHERE t % 3 = 0""", """n AS (SELECT series_id, t, (c1 - avg(c1) OVER p) / stddev_pop(c1) OVER p AS c1,
    (c2 - avg(c2) OVER p) / stddev_pop(c2) OVER p AS c2 FROM ts_hour_labelled WINDOW p AS (PARTITION BY series_id)), """
    + _win_sql("n", ["c1", "c2"], 6, "")))
def _(spark, d):
    s = scale.split_zscore(fx.ts_hour_labelled(spark, d), ["c1", "c2"])
    w = windows.slide(s, ["c1", "c2"], 6, stride=3, layout="time")
    w = w.select("series_id", "t", F.posexplode("win").alias("step", "row"))
    return rounded(w.select("series_id", "t", "step", F.posexplode("row").alias("ch", "x")))


@query("win3_forecast_pairs", sql("ts_hour_labelled", """SELECT series_id, t, step, ch, CASE WHEN step < 5 THEN 'x' ELSE
    'y' END AS part, round(x, 6) + 0.0 AS x FROM w""", _win_sql("ts_hour_labelled", ["c1", "c2"], 7, "")))
def _(spark, d):
    p = windows.forecast_pairs(fx.ts_hour_labelled(spark, d), ["c1", "c2"], 5, 2)
    x = p.select("series_id", "t", F.lit("x").alias("part"), F.posexplode("x").alias("step", "row"))
    y = p.select("series_id", "t", F.lit("y").alias("part"), F.posexplode("y").alias("step", "row")).withColumn(
        "step", F.col("step") + 5)
    return rounded(x.union(y).select("series_id", "t", "part", "step", F.posexplode("row").alias("ch", "x")))


def _wscore(spark, d, w):
    """A window score for the padding queries: the largest value of c1 in the window."""
    win = windows.slide(fx.ts_hour_labelled(spark, d), ["c1"], w)
    return win.select("series_id", "t", F.array_max("win").alias("score"))


WS = """ws AS (SELECT series_id, t, score FROM (SELECT series_id, t, max(c1) OVER (PARTITION BY series_id ORDER BY t
    ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS score FROM ts_hour_labelled) WHERE t <= 711)"""


@query("win4_centre_pad", sql("ts_hour_labelled", """SELECT p.series_id, p.t, ws.score FROM ts_hour_labelled p JOIN ws ON
    ws.series_id = p.series_id AND ws.t = least(greatest(p.t - 4, 0), 711)""", WS))
def _(spark, d):
    return windows.centre_pad(fx.ts_hour_labelled(spark, d), _wscore(spark, d, 9), 9)


@query("win5_front_pad", sql("ts_hour_labelled", """SELECT p.series_id, p.t, ws.score FROM ts_hour_labelled p LEFT JOIN ws
    ON ws.series_id = p.series_id AND ws.t = greatest(p.t - 9, 0)""", WS))
def _(spark, d):
    return windows.front_pad(fx.ts_hour_labelled(spark, d), _wscore(spark, d, 9), 9, 1)


@query("win6_reverse", sql("ts_hour_labelled", """SELECT p.series_id, p.t, round(coalesce(avg(ws.score), 0), 6) + 0.0 AS
    score FROM ts_hour_labelled p LEFT JOIN ws ON ws.series_id = p.series_id AND ws.t BETWEEN p.t - 8 AND p.t
    GROUP BY 1, 2""", WS))
def _(spark, d):
    return rounded(windows.overlap_mean(fx.ts_hour_labelled(spark, d), _wscore(spark, d, 9), 9))


@query("win7_overlap_strided", sql("ts_hour_labelled", """SELECT p.series_id, p.t, round(coalesce(avg(ws.score), 0), 6) +
    0.0 AS score FROM ts_hour_labelled p LEFT JOIN ws ON ws.series_id = p.series_id AND ws.t BETWEEN p.t - 8 AND p.t
    AND ws.t % 7 = 0 GROUP BY 1, 2""", WS))
def _(spark, d):
    return rounded(windows.overlap_mean(fx.ts_hour_labelled(spark, d), _wscore(spark, d, 9), 9, stride=7))


@query("win8_subchunks", sql("ts_hour_labelled", """SELECT series_id, t, step, x FROM w WHERE t % 2 = 0""",
                             _win_sql("ts_hour_labelled", ["c1"], 3, "")))
def _(spark, d):
    w = windows.slide(fx.ts_hour_labelled(spark, d), ["c1"], 3, stride=2)
    return w.select("series_id", "t", F.posexplode("win").alias("step", "x"))


@query("win9_zero_pad", sql("ts_hour_labelled", """SELECT p.series_id, p.t, coalesce(ws.score, 0.0) AS score FROM
    ts_hour_labelled p LEFT JOIN ws ON ws.series_id = p.series_id AND ws.t = p.t - 4""", WS))
def _(spark, d):
    return windows.centre_pad(fx.ts_hour_labelled(spark, d), _wscore(spark, d, 9), 9, fill=0.0)


@query("win10_adapted_window", sql("ts_user", """SELECT series_id, CASE WHEN count(*) < 60 THEN 50 ELSE 100 END AS w
    FROM ts_user GROUP BY 1"""))
def _(spark, d):
    n = fx.table(spark, d, "events").groupBy(F.col("user_id").alias("series_id")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("series_id", windows.adapted_window(F.col("n"), below=60).alias("w"))


@query("win11_split", sql("ts_day", """SELECT series_id, t, CASE WHEN t < floor(0.8::DOUBLE * count(*) OVER (PARTITION BY
    series_id)) THEN 'train' ELSE 'valid' END AS split FROM ts_day"""))
def _(spark, d):
    return windows.prefix_split(_day(spark, d).select("series_id", "t"), 0.2)
