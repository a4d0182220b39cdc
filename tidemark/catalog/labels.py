"""Queries: thresholds and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import threshold as th
from . import fixtures as fx
from .base import query, rd, rounded
from .fixtures import sql

C3 = ["series_id", "t", "pred"]


def scaled_user(spark, d):
    from ..operators.scale import minmax
    return minmax(fx.ts_user(spark, d).select("series_id", "t", "score", "label"), ["score"])


@query("thr1_no_threshold", sql("ts_user", "SELECT series_id, t, label, label AS pred FROM ts_user"))
def _(spark, d):
    return th.no_threshold(fx.ts_user(spark, d).select("series_id", "t", "label"), "label")


@query("thr2_fixed", sql("ts_user", """SELECT series_id, t, CASE WHEN (score - min(score) OVER p) / (max(score) OVER p -
    min(score) OVER p) >= 0.8 THEN 1 ELSE 0 END AS pred FROM ts_user WINDOW p AS (PARTITION BY series_id)"""))
def _(spark, d):
    u = scaled_user(spark, d)
    return th.label_by(u, th.fixed(u, 0.8)).select(*C3)


@query("thr3_percentile", sql("ts_user", """SELECT series_id, t, CASE WHEN score >= quantile_cont(score, 0.9) OVER
    (PARTITION BY series_id) THEN 1 ELSE 0 END AS pred FROM ts_user"""))
def _(spark, d):
    u = fx.ts_user(spark, d)
    return th.label_by(u, th.percentile(u, 90)).select(*C3)


QPOS = """o AS (SELECT series_id, score, row_number() OVER (PARTITION BY series_id ORDER BY score) - 1 AS i FROM {0}),
    k AS (SELECT series_id, (1 - {1} / CAST(count(*) AS DOUBLE)) * (count(*) - 1) AS pos FROM {0} GROUP BY 1),
    th AS (SELECT k.series_id, a.score + (b.score - a.score) * (pos - floor(pos)) AS threshold FROM k JOIN o a ON
    a.series_id = k.series_id AND a.i = floor(pos) JOIN o b ON b.series_id = k.series_id AND b.i = ceil(pos))"""


@query("thr4_top_k_points", sql("scored", "SELECT series_id, round(threshold, 6) AS threshold FROM th",
                                QPOS.format("scored", "sum(label)")))
def _(spark, d):
    return rounded(th.top_k_points(fx.scored(spark, d)))


@query("thr5_top_k_ranges", sql("ts_hour_labelled", """SELECT series_id, round(coalesce(max(theta) FILTER (cnt >= k), min(theta)), 6)
    AS threshold FROM (SELECT c.series_id, c.theta, count(*) FILTER (p.score >= c.theta AND (p.prev IS NULL OR
    p.prev < c.theta)) AS cnt, count(*) FILTER (p.label = 1 AND coalesce(p.pl, 0) = 0) AS k FROM c JOIN p USING (series_id)
    GROUP BY 1, 2) GROUP BY 1""", """p AS (SELECT *, lag(score) OVER w AS prev, lag(label) OVER w AS pl FROM ts_hour_labelled
    WINDOW w AS (PARTITION BY series_id ORDER BY t)), c AS (SELECT DISTINCT series_id, score AS theta FROM p a WHERE
    score > (SELECT min(score) FROM p b WHERE a.series_id = b.series_id))"""))
def _(spark, d):
    return rounded(th.top_k_ranges(fx.ts_hour_labelled(spark, d)))


@query("thr6_sigma", sql("ts_user", """SELECT series_id, t, CASE WHEN score >= avg(score) OVER p + 1.5::DOUBLE * stddev_pop(score)
    OVER p THEN 1 ELSE 0 END AS pred FROM ts_user WINDOW p AS (PARTITION BY series_id)"""))
def _(spark, d):
    u = fx.ts_user(spark, d)
    return th.label_by(u, th.sigma(u, 1.5)).select(*C3)


@query("thr7_outlier_fraction", sql("ts_user", """SELECT series_id, t, CASE WHEN score > quantile_cont(score, 0.95) OVER
    (PARTITION BY series_id) THEN 1 ELSE 0 END AS pred FROM ts_user"""))
def _(spark, d):
    u = fx.ts_user(spark, d)
    return th.label_by(u, th.outlier_fraction(u, 0.05), strict=True).select(*C3)


@query("thr8_precision_at_n", sql("scored", """SELECT s.series_id, round(coalesce(sum(label) FILTER (score > threshold) /
    CAST(nullif(count(*) FILTER (score > threshold), 0) AS DOUBLE), 0), 6) AS precision_at_n FROM scored s JOIN th
    USING (series_id) GROUP BY 1""", QPOS.format("scored", "sum(label)")))
def _(spark, d):
    return rounded(th.precision_at_n(fx.scored(spark, d)))


@query("thr9_q925", sql("ts_user", """SELECT series_id, t, CASE WHEN score >= quantile_cont(score, 0.925) OVER
    (PARTITION BY series_id) THEN 1 ELSE 0 END AS pred FROM ts_user"""))
def _(spark, d):
    u = fx.ts_user(spark, d)
    return th.label_by(u, th.ratio_quantile(u)).select(*C3)


@query("thr10_model_sigma", sql("ts_day", """SELECT series_id, t, CASE WHEN c1 >= avg(c1) FILTER (t < 1500) OVER p + 3 *
    stddev_pop(c1) FILTER (t < 1500) OVER p THEN 1 ELSE 0 END AS pred FROM ts_day WINDOW p AS (PARTITION BY series_id)"""))
def _(spark, d):
    t = fx.ts_day(spark, d)
    stats = t.filter("t < 1500").groupBy("series_id").agg(F.avg("c1").alias("mu"), F.stddev_pop("c1").alias("sd"))
    return th.label_by(t, th.model_sigma(stats), score="c1").select(*C3)


@query("thr11_ratio_report", sql("scored", """SELECT series_id, round(avg(CASE WHEN p = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
    round(coalesce(sum(p * label) / CAST(nullif(sum(p), 0) AS DOUBLE), 0), 6) AS precision, round(coalesce(sum(p * label) /
    CAST(nullif(sum(label), 0) AS DOUBLE), 0), 6) AS recall, round(max(q), 6) AS threshold FROM (SELECT *, CASE WHEN score > q THEN 1 ELSE 0
    END AS p FROM (SELECT *, quantile_cont(score, 0.9) OVER (PARTITION BY series_id) AS q FROM scored)) GROUP BY 1"""))
def _(spark, d):
    return rounded(th.ratio_report(fx.scored(spark, d), 10.0).drop("f1"))


@query("thr12_grid", sql("ts_user", """SELECT series_id, CAST(k AS INT) AS k, round(min(score) + (max(score) - min(score)) * k / 99, 6) AS
    threshold FROM ts_user CROSS JOIN (SELECT range AS k FROM range(100)) GROUP BY series_id, k"""))
def _(spark, d):
    return rounded(th.grid(fx.ts_user(spark, d)))


@query("evt1_ranges", sql("runs", "SELECT series_id, s, e FROM runs"))
def _(spark, d):
    return ev.ranges(fx.ts_hour_labelled(spark, d)).select("series_id", "s", "e")


@query("evt2_events", sql("runs", "SELECT series_id, s, e + 1 AS e FROM runs"))
def _(spark, d):
    return ev.half_open(fx.ts_hour_labelled(spark, d))


@query("evt3_closed", sql("ts_user", """SELECT series_id, s, CASE WHEN e = n - 1 THEN e - 1 ELSE e END AS e FROM (SELECT series_id,
    min(t) AS s, max(t) AS e FROM (SELECT *, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS g FROM ts_user
    WHERE label = 1) GROUP BY series_id, g) JOIN (SELECT series_id, count(*) AS n FROM ts_user GROUP BY 1) USING (series_id)"""))
def _(spark, d):
    return ev.event_runs(fx.ts_user(spark, d), compat=True)


@query("evt4_run_count", sql("ts_user", """SELECT series_id, count(*) FILTER (label = 1 AND coalesce(p, 0) = 0) AS runs FROM
    (SELECT *, lag(label) OVER (PARTITION BY series_id ORDER BY t) AS p FROM ts_user) GROUP BY 1"""))
def _(spark, d):
    return ev.run_count(fx.ts_user(spark, d))


ADJ = """SELECT h.series_id, h.t, CASE WHEN EXISTS (SELECT 1 FROM runs r JOIN ts_hour_labelled q ON q.series_id = r.series_id AND q.t
    BETWEEN r.s AND r.e AND q.score > 8 WHERE r.series_id = h.series_id AND h.t BETWEEN r.s AND r.e) THEN 1 WHEN h.score > 8
    THEN 1 ELSE 0 END AS adjusted FROM ts_hour_labelled h"""


def _pred(spark, d, level=8):
    return fx.ts_hour_labelled(spark, d).withColumn("pred", F.when(F.col("score") > level, 1).otherwise(0))


@query("evt5_point_adjust", sql("runs", ADJ))
def _(spark, d):
    return ev.point_adjust(_pred(spark, d)).select("series_id", "t", "adjusted")


@query("evt5_latency", sql("runs", """SELECT series_id, round(coalesce(sum(f - s), 0) / (count(f) + 1e-4), 6) AS latency FROM
    (SELECT r.series_id, r.s, min(h.t) FILTER (h.score > 7) AS f FROM runs r JOIN ts_hour_labelled h ON h.series_id =
    r.series_id AND h.t BETWEEN r.s AND r.e GROUP BY 1, 2) GROUP BY 1"""))
def _(spark, d):
    return rounded(ev.adjust_latency(_pred(spark, d, 7)))


def _ramp_sql(reach_after: str, w: str, reach_before: str) -> str:
    return f"""SELECT h.series_id, h.t, round(least(1.0, max(h.label) + coalesce(sum(sqrt(1 - CASE WHEN h.t > r.e THEN h.t - r.e
        ELSE r.s - h.t END / CAST({w} AS DOUBLE))), 0)), 6) AS soft FROM ts_hour_labelled h LEFT JOIN runs r ON r.series_id =
        h.series_id AND ((h.t > r.e AND h.t <= r.e + {reach_after}) OR (h.t < r.s AND h.t >= r.s - {reach_before}))
        GROUP BY 1, 2"""


@query("evt6_ramp", sql("runs", _ramp_sql("9", "20", "10")))
def _(spark, d):
    return rounded(ev.ramp(fx.ts_hour_labelled(spark, d), 20, style="edge").select("series_id", "t", "soft"))


@query("evt7_share_ramp", sql("runs", _ramp_sql("floor(0.8::DOUBLE * (r.e - r.s + 1)) - 1", "(2 * floor(0.8::DOUBLE * (r.e - r.s + 1)))",
                                                "floor(0.8::DOUBLE * (r.e - r.s + 1))")))
def _(spark, d):
    return rounded(ev.ramp(fx.ts_hour_labelled(spark, d), 0, share=0.8).select("series_id", "t", "soft"))


@query("evt8_vus_ramp", sql("runs", _ramp_sql("35", "70", "35")))
def _(spark, d):
    return rounded(ev.ramp(fx.ts_hour_labelled(spark, d), 70).select("series_id", "t", "soft"))


@query("evt9_merge", sql("ts_hour_labelled", """SELECT series_id, greatest(min(s) - 4, 0) AS s, least(max(e) + 4, 719) AS e FROM (SELECT *,
    sum(b) OVER (PARTITION BY series_id ORDER BY s) AS g FROM (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY series_id ORDER
    BY s) + 4 >= s - 4 THEN 0 ELSE 1 END AS b FROM r)) GROUP BY series_id, g""", """r AS (SELECT series_id, min(t) AS s,
    max(t) AS e FROM (SELECT *, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS g FROM ts_hour_labelled WHERE
    score > 8) GROUP BY series_id, g)"""))
def _(spark, d):
    p = _pred(spark, d)
    n = ev.lengths(p)
    return ev.merged_halos(ev.ranges(p, flag="pred"), 8, n)


@query("evt10_time_range", sql("runs", """SELECT series_id, min(s) AS t0, max(e) AS t1, max(CASE WHEN s = e THEN 1 ELSE 0 END) AS
    has_points, 0 AS invalid FROM runs GROUP BY 1"""))
def _(spark, d):
    r = ev.ranges(fx.ts_hour_labelled(spark, d))
    bad = ev.invalid_events(r).groupBy("series_id").agg(F.count(F.lit(1)).alias("invalid"))
    return (ev.time_range(r).join(ev.has_point_events(r), "series_id").join(bad, "series_id", "left")
            .fillna(0, ["invalid"]).withColumn("has_points", F.col("has_points").cast("int")))


ZONES = """z AS (SELECT series_id, s, e + 1 AS e, coalesce((lag(e + 1) OVER w + s) / 2.0::DOUBLE, 0.0) AS z0,
    coalesce((e + 1 + lead(s) OVER w) / 2.0::DOUBLE, 720.0) AS z1 FROM runs WINDOW w AS (PARTITION BY series_id ORDER BY s))"""


def _zones(spark, d):
    return ev.zones(ev.half_open(fx.ts_hour_labelled(spark, d)), F.lit(0), F.lit(720))


@query("evt11_zones", sql("runs", "SELECT series_id, s, e, z0, z1 FROM z", ZONES))
def _(spark, d):
    return _zones(spark, d).drop("zone")


# Each zone is probed with the interval from 2.5 points before to 3.25 points behind the start of its event.
LO, HI = "greatest(s - 2.5, z0)", "least(s + 3.25, z1)"


def _probe(spark, d):
    lo = F.greatest(F.col("s") - F.lit(2.5), F.col("z0"))
    hi = F.least(F.col("s") + F.lit(3.25), F.col("z1"))
    return _zones(spark, d).withColumn("lo", lo).withColumn("hi", hi)



def _numeric(f: str, a: str, b: str) -> str:
    """Midpoint rule with 2000 cells, so that the closed forms are checked against the definition."""
    return f"""SELECT series_id, s, round(sum({f}) * max(({b} - {a}) / 2000.0::DOUBLE), 3) + 0.0 AS v FROM (SELECT *, {a} + (i + 0.5::DOUBLE)
        * ({b} - {a}) / 2000.0::DOUBLE AS x, {LO} AS p0, {HI} AS p1 FROM z CROSS JOIN (SELECT range AS i FROM range(2000))) GROUP BY
        1, 2"""


@query("evt12_cut", sql("runs", f"""SELECT series_id, s, greatest(least({HI}, s) - {LO}, 0.0) AS before, greatest(least({HI}, e) -
    greatest({LO}, s), 0.0) AS inside, greatest({HI} - greatest({LO}, e), 0.0) AS after FROM z""", ZONES))
def _(spark, d):
    c = ev.cut_by(F.col("lo"), F.col("hi"), F.col("s"), F.col("e"))
    return rounded(_probe(spark, d).select("series_id", "s", (c["b1"] - c["b0"]).alias("before"),
                                           (c["i1"] - c["i0"]).alias("inside"), (c["a1"] - c["a0"]).alias("after")))


@query("evt13_distance_integral", sql("runs", _numeric("greatest(s - x, x - e, 0)", LO, HI), ZONES))
def _(spark, d):
    v = ev.distance_integral(F.col("lo"), F.col("hi"), F.col("s"), F.col("e"))
    return _probe(spark, d).select("series_id", "s", rd(v, 3).alias("v"))


@query("evt14_precision", sql("runs", """SELECT series_id, s, round(max(ins) + sum((1 - (e - s + least(dist, s - z0) + least(dist, z1 - e))
    / (z1 - z0)) * (b - a) / 500.0::DOUBLE), 3) + 0.0 AS v FROM (SELECT *, CASE WHEN x < s THEN s - x ELSE x - e END AS dist FROM
    (SELECT *, a + (i + 0.5::DOUBLE) * (b - a) / 500.0::DOUBLE AS x FROM w CROSS JOIN (SELECT range AS i FROM range(500)))) GROUP BY 1, 2""",
    ZONES + f""", w AS (SELECT *, {LO} AS a, least({HI}, s) AS b, greatest(least({HI}, e) - s, 0.0) AS ins FROM z UNION ALL
    SELECT *, greatest({LO}, e) AS a, greatest({HI}, e) AS b, greatest(least({HI}, e) - s, 0.0) AS ins FROM z)"""))
def _(spark, d):
    v = ev.precision_integral(*[F.col(c) for c in ("lo", "hi", "s", "e", "z0", "z1")])
    return _probe(spark, d).select("series_id", "s", rd(v, 3).alias("v"))


@query("evt15_recall", sql("runs", _numeric("""CASE WHEN x BETWEEN p0 AND p1 THEN 1 ELSE 1 - (least(greatest(p0 - x, x - p1), x - z0) +
    least(greatest(p0 - x, x - p1), z1 - x)) / (z1 - z0) END""", "s", "e"), ZONES))
def _(spark, d):
    v = ev.recall_integral(F.col("lo"), F.col("hi"), F.lit(float("-inf")), F.lit(float("inf")),
                           *[F.col(c).cast("double") for c in ("s", "e", "z0", "z1")])
    return _probe(spark, d).select("series_id", "s", rd(v, 3).alias("v"))


@query("met17_confusion", sql("ts_hour_labelled", """SELECT series_id, label + 2 * CASE WHEN score > 8 THEN 1 ELSE 0 END AS code, count(*)
    AS n FROM ts_hour_labelled GROUP BY 1, 2"""))
def _(spark, d):
    return _pred(spark, d).groupBy("series_id", ev.confusion_code().alias("code")).agg(F.count(F.lit(1)).alias("n"))
