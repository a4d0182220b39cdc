"""Queries: detectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import estimator, registry
from ..operators.detect import base as bd
from ..operators.detect import cluster, density, forest, neighbours
from ..operators.detect.vectors import as_vectors
from ..operators.settings import GRID
from . import fixtures as fx
from .base import query, rounded
from .fixtures import sql

C4 = ["c1", "c2", "c3", "c4"]
H2 = ["c1", "c2"]

Z = """zr AS MATERIALIZED (SELECT t, channel, (x - avg(x) OVER p) / stddev_samp(x) OVER p AS x FROM emb_long WINDOW p AS (PARTITION BY t))"""


@query("det3_copod", sql("emb emb_long", """SELECT t, round(sum(greatest(CASE WHEN sk > 0 THEN r WHEN sk < 0 THEN l ELSE l + r END, (l + r) / 2)), 4) AS
    score FROM (SELECT t, -ln(cume_dist() OVER (PARTITION BY channel ORDER BY x)) AS l, -ln(cume_dist() OVER (PARTITION BY channel ORDER BY x DESC))
    AS r, skewness(x) OVER (PARTITION BY channel) AS sk FROM zr) GROUP BY 1""", Z))
def _(spark, d):
    v = as_vectors(fx.embeddings(spark, d), None)
    return rounded(density.copod(v).select("t", "score"), 4)


HB = Z + """, hm AS (SELECT channel, min(x) AS lo, max(x) AS hi, count(*) AS n FROM zr GROUP BY 1), he AS (SELECT channel, i, CASE WHEN i = 10 THEN hi ELSE
    lo + i * ((hi - lo) / 10) END AS e, lo, hi, n FROM hm CROSS JOIN (SELECT unnest(range(0, 11)) AS i)), hb AS (SELECT a.channel, a.i, a.e AS e0, b.e AS e1,
    a.lo, a.hi, a.n FROM he a JOIN he b ON a.channel = b.channel AND b.i = a.i + 1), hc AS MATERIALIZED (SELECT hb.channel, hb.i, e0, e1, max(hb.lo) AS lo, log2(count(zr.x) /
    (max(hb.n) * ((max(hb.hi) - max(hb.lo)) / 10)) + 0.1::DOUBLE) AS v FROM hb LEFT JOIN zr ON zr.channel = hb.channel AND zr.x >= e0 AND (zr.x < e1 OR
    (hb.i = 9 AND zr.x <= e1)) GROUP BY 1, 2, 3, 4)"""


@query("det4_hbos", sql("emb emb_long", """SELECT t, round(-sum(v), 4) AS score FROM zr JOIN hc ON zr.channel = hc.channel AND ((zr.x > e0 AND zr.x <= e1) OR
    (zr.x = lo AND hc.i = 0)) GROUP BY 1""", HB))
def _(spark, d):
    return rounded(density.hbos(as_vectors(fx.embeddings(spark, d), None)).select("t", "score"), 4)


@query("det4_hbos_windows")
def _(spark, d):
    return registry.detect("HBOS", fx.ts_hour_labelled(spark, d), H2, window=10, n_bins="auto")


PAIRS = """nn AS MATERIALIZED (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM (SELECT p.t AS a, q.t AS b,
    sqrt(list_sum(list_transform(list_zip(p.x, q.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM emb p JOIN emb q ON p.t <> q.t))"""


def _knn(name: str, expr: str):
    @query(f"det8_knn_{name}", sql("emb", f"SELECT a AS t, round({expr}, 6) AS score FROM nn WHERE r <= 10 GROUP BY 1", PAIRS))
    def _(spark, d):
        v = as_vectors(fx.embeddings(spark, d), None, normalise=False)
        return rounded(neighbours.knn_score(v, 10, name).select("t", "score"))


for _name, _expr in (("largest", "max(d)"), ("mean", "avg(d)"), ("median", "median(d)")):
    _knn(_name, _expr)


@query("det8_knn_new_data", sql("emb", """SELECT a AS t, round(max(d), 6) AS score FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d) AS r FROM
    (SELECT p.t AS a, sqrt(list_sum(list_transform(list_zip(p.x, q.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM emb p JOIN emb q ON p.cls >= 5
    AND q.cls < 5)) WHERE r <= 10 GROUP BY 1"""))
def _(spark, d):
    e = fx.embeddings(spark, d)
    train, test = (as_vectors(e.filter(c), None, normalise=False) for c in ("cls < 5", "cls >= 5"))
    return rounded(neighbours.knn_score(test, 10, train=train).select("t", "score"))


@query("det7_lof", sql("emb", """SELECT l.a AS t, round(avg(m.lrd) / max(l.lrd), 6) AS score FROM lrd l JOIN nn ON nn.a = l.a AND nn.r <= 30 JOIN lrd m ON
    m.a = nn.b GROUP BY 1""", PAIRS + """, kd AS (SELECT a, max(d) AS kd FROM nn WHERE r <= 30 GROUP BY 1), lrd AS (SELECT nn.a, 1 / (avg(greatest(d, kd)) +
    1e-10) AS lrd FROM nn JOIN kd ON kd.a = nn.b WHERE r <= 30 GROUP BY 1)"""))
def _(spark, d):
    v = as_vectors(fx.embeddings(spark, d), None, normalise=False)
    return rounded(neighbours.lof_score(v, 30).select("t", "score"))


@query("det7_lof_manhattan", sql("emb", """SELECT l.a AS t, round(avg(m.lrd) / max(l.lrd), 6) AS score FROM lrd l JOIN nn ON nn.a = l.a AND nn.r <= 20 JOIN lrd m
    ON m.a = nn.b GROUP BY 1""", PAIRS.replace("(z[1] - z[2]) * (z[1] - z[2])", "abs(z[1] - z[2])").replace("sqrt(list_sum", "(list_sum") + """, kd AS (SELECT a,
    max(d) AS kd FROM nn WHERE r <= 20 GROUP BY 1), lrd AS (SELECT nn.a, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.a = nn.b WHERE
    r <= 20 GROUP BY 1)"""))
def _(spark, d):
    v = as_vectors(fx.embeddings(spark, d), None, normalise=False)
    return rounded(neighbours.lof_score(v, 20, p=1).select("t", "score"))


CENTRES = """ce AS (SELECT cls AS cluster, channel, avg(l.x) AS c FROM emb e JOIN emb_long l USING (t) GROUP BY 1, 2), dc AS (SELECT t, cluster, sqrt(sum((x -
    c) * (x - c))) AS d FROM emb_long JOIN ce USING (channel) GROUP BY 1, 2), own AS (SELECT t, arg_min(cluster, d) AS cluster, min(d) AS d FROM dc GROUP BY 1)"""


def _centres(spark, d):
    e = fx.embeddings(spark, d)
    c = e.select("series_id", F.col("cls").alias("cluster"), F.posexplode("x").alias("i", "v")).groupBy("series_id", "cluster", "i").agg(F.avg("v").alias("v"))
    return e, c.groupBy("series_id", "cluster").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("c"))


@query("det1_kmeans_assign", sql("emb emb_long", "SELECT t, cluster, round(d, 6) AS distance FROM own", CENTRES))
def _(spark, d):
    e, c = _centres(spark, d)
    return rounded(cluster.assign(e.select("series_id", "t", "x"), c).select("t", "cluster", "distance"))


@query("det2_cblof_assign", sql("emb emb_long", """SELECT own.t, own.cluster, round(CASE WHEN l.cluster IS NOT NULL THEN own.d ELSE (SELECT min(dc.d) FROM dc JOIN
    lg ON lg.cluster = dc.cluster WHERE dc.t = own.t) END, 6) AS score FROM own LEFT JOIN lg l ON l.cluster = own.cluster""", CENTRES + """, sz AS (SELECT cluster,
    count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, cluster) AS r FROM own GROUP BY 1), sp AS (SELECT *, sum(n) OVER (ORDER BY r) >= 0.55::DOUBLE * (SELECT
    sum(n) FROM sz) AS a, n / CAST(lead(n) OVER (ORDER BY r) AS DOUBLE) >= 5 AS b, r < max(r) OVER () AS ok FROM sz), lg AS (SELECT cluster FROM sp WHERE r <=
    (SELECT coalesce(min(r) FILTER (ok AND a AND b), min(r) FILTER (ok AND a), min(r) FILTER (ok AND b)) FROM sp))"""))
def _(spark, d):
    e, c = _centres(spark, d)
    return rounded(cluster.cblof_from_centres(e.select("series_id", "t", "x"), c, alpha=0.55).select("t", "cluster", "score"))


@query("det1_kmeansad")
def _(spark, d):
    return registry.detect("KMeansAD_U", fx.ts_hour_labelled(spark, d), H2)


@query("det2_cblof")
def _(spark, d):
    return registry.detect("CBLOF", fx.ts_day(spark, d), C4)


@query("det5_iforest")
def _(spark, d):
    return registry.detect("IForest", fx.ts_hour_labelled(spark, d), H2, window=20)


@query("det6_eif")
def _(spark, d):
    return registry.detect("EIF", fx.ts_hour_labelled(spark, d), H2)


@query("det9_pca")
def _(spark, d):
    return registry.detect("PCA", fx.ts_day(spark, d), C4, window=20, components=0.9)


@query("det10_rpca")
def _(spark, d):
    return registry.detect("RobustPCA", fx.ts_hour_labelled(spark, d), H2)


@query("det11_mcd")
def _(spark, d):
    return registry.detect("MCD", fx.ts_day(spark, d), C4, normalise=False)


@query("det12_ocsvm")
def _(spark, d):
    return registry.detect("OCSVM", fx.ts_day(spark, d), C4)


def _semi(key: str, name: str, **kw):
    @query(key)
    def _(spark, d):
        t = fx.ts_day(spark, d)
        return registry.detect(name, t, C4, train=t.filter("t < 1500"), **kw)


_semi("det13a_var", "CNN", window=32)
_semi("det13b_var_ewm", "LSTMAD", window=10)
_semi("det14a_autoencoder", "AutoEncoder")
_semi("det14b_two_stage", "USAD")
_semi("det14c_window_subspace", "OmniAnomaly", window=20)
_semi("det14d_last_step", "TranAD", window=10)
_semi("det14e_probabilistic", "Donut", window=20)
_semi("det14g_association", "AnomalyTransformer", window=20)
_semi("det14h_row_subspace", "ALLM4TS", window=20)
_semi("det14i_segment_subspace", "OFA", window=50)

# Windows of 24 hours, normalised; row (series, begin, step i).
WIN24 = """zs AS (SELECT series_id, t, (c2 - avg(c2) OVER p) / stddev_pop(c2) OVER p AS x FROM ts_hour_labelled WINDOW p AS (PARTITION BY series_id)),
    wn AS MATERIALIZED (SELECT a.series_id, a.t AS b, q.t - a.t AS i, q.x, avg(q.x) OVER g AS mu, var_pop(q.x) OVER g AS vp, var_samp(q.x) OVER g AS vs FROM zs a
    JOIN zs q ON a.series_id = q.series_id AND q.t BETWEEN a.t AND a.t + 23 WHERE a.t <= 696 WINDOW g AS (PARTITION BY a.series_id, a.t))"""
PAD24 = """SELECT p.series_id, p.t, round(s.score, 5) AS score FROM ts_hour_labelled p JOIN sc s ON s.series_id = p.series_id AND s.b =
    least(greatest(p.t - 12, 0), 696)"""


@query("det14f_phase_mean", sql("ts_hour_labelled", PAD24, WIN24 + """, am AS (SELECT *, row_number() OVER (PARTITION BY series_id, b ORDER BY round(a, 9) DESC, f) AS r
    FROM (SELECT series_id, b, f, sqrt(pow(sum((x - mu) / sqrt(vp + 1e-5) * cos(2 * pi() * f * i / 24)), 2) + pow(sum((x - mu) / sqrt(vp + 1e-5) * sin(2 * pi() * f
    * i / 24)), 2)) AS a FROM wn CROSS JOIN (SELECT unnest(range(1, 13)) AS f) GROUP BY 1, 2, 3)),
    pm AS (SELECT am.series_id, am.b, am.r, max(a) AS a, avg((x - mu) / sqrt(vp + 1e-5)) AS m FROM am JOIN wn ON wn.series_id = am.series_id AND wn.b = am.b AND
    am.r <= 2 AND wn.i % (24 // f) = 23 % (24 // f) GROUP BY 1, 2, 3),
    rb AS (SELECT series_id, b, sum(a * m) / sum(a) AS z FROM pm GROUP BY 1, 2), sc AS (SELECT rb.series_id, rb.b, pow(z * sqrt(vp + 1e-5) + mu - x, 2) AS score FROM
    rb JOIN wn ON wn.series_id = rb.series_id AND wn.b = rb.b AND wn.i = 23)"""))
def _(spark, d):
    return rounded(registry.detect("TimesNet", fx.ts_hour_labelled(spark, d), ["c2"], window=24), 5)


@query("det15_lowpass", sql("ts_hour_labelled", PAD24, WIN24.replace("(c2 - avg(c2) OVER p) / stddev_pop(c2) OVER p", "c2").replace("WINDOW p AS (PARTITION BY series_id)", "")
    + """, kr AS (SELECT i, 1 / 24.0::DOUBLE + sum(2 / 24.0::DOUBLE * cos(2 * pi() * f * (23 - i) / 24)) AS k FROM (SELECT unnest(range(0, 24)) AS i) CROSS JOIN (SELECT
    unnest(range(1, 4)) AS f) GROUP BY 1), sc AS (SELECT series_id, b, pow(sum((x - mu) / sqrt(vs + 1e-5) * k) * max(sqrt(vs + 1e-5)) + max(mu) - max(x) FILTER (i =
    23), 2) AS score FROM wn JOIN kr USING (i) GROUP BY 1, 2)""").replace("round(s.score, 5)", "round(s.score, 3)"))
def _(spark, d):
    return rounded(registry.detect("FITS", fx.ts_hour_labelled(spark, d), ["c2"], window=24, cutoff=4), 3)


QT = """f AS (SELECT series_id, quantile_cont(score, 0.9) AS threshold, avg(score) AS mu, stddev_pop(score) AS sd, min(score) AS lo, max(score) AS hi, count(*) AS n
    FROM ts_user WHERE t < 40 GROUP BY 1)"""


def _fit(spark, d):
    u = fx.ts_user(spark, d).select("series_id", "t", "score", "label")
    return u, bd.fitted(u.filter("t < 40"))


@query("det16_contamination", sql("ts_user", """SELECT series_id, round(threshold, 6) AS threshold, round(mu, 6) AS mu, round(sd, 6) AS sd, n FROM f""", QT))
def _(spark, d):
    return rounded(_fit(spark, d)[1].select("series_id", "threshold", "mu", "sd", "n"))


@query("det17_predict", sql("ts_user", """SELECT series_id, t, CASE WHEN score > threshold THEN 1 ELSE 0 END AS pred FROM ts_user JOIN f USING (series_id) WHERE t >=
    40""", QT))
def _(spark, d):
    u, f = _fit(spark, d)
    return bd.predict(u.filter("t >= 40"), f).select("series_id", "t", "pred")


@query("det18_proba_linear", sql("ts_user", """SELECT series_id, t, round(least(greatest((score - lo) / (hi - lo), 0.0), 1.0), 6) AS proba FROM ts_user JOIN f USING
    (series_id) WHERE t >= 40""", QT))
def _(spark, d):
    u, f = _fit(spark, d)
    return rounded(bd.predict_proba(u.filter("t >= 40"), f).select("series_id", "t", "proba"))


@query("det18_proba_unify")
def _(spark, d):
    u, f = _fit(spark, d)
    return bd.predict_proba(u.filter("t >= 40"), f, "unify").select("series_id", "t", "proba")


@query("det19_confidence")
def _(spark, d):
    u, f = _fit(spark, d)
    return bd.predict_confidence(u.filter("t < 40"), u.filter("t >= 40"), f)


@query("det20_fit_predict_score", sql("scored", "SELECT series_id, round(auc, 6) AS value FROM pr", """pr AS (SELECT a.series_id, avg(CASE WHEN a.score > b.score THEN
    1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0.0 END) AS auc FROM scored a JOIN scored b ON a.series_id = b.series_id AND a.label = 1 AND b.label = 0
    GROUP BY 1)"""))
def _(spark, d):
    return rounded(bd.fit_predict_score(fx.scored(spark, d)))


@query("det21_grid_search")
def _(spark, d):
    h = fx.ts_hour_labelled(spark, d)
    return registry.search(h, H2, {name: GRID[name] for name in ("HBOS", "COPOD")})


@query("det22_ensemble_mean", sql("perf", "SELECT dataset, model, round((perf + pred) / 2, 6) AS pred FROM perf"))
def _(spark, d):
    p = fx.perf(spark, d)
    two = p.select("dataset", "model", F.explode(F.array("perf", "pred")).alias("pred"))
    return rounded(bd.ensemble_mean(two))


@query("det_periodic_windows")
def _(spark, d):
    return registry.detect("Sub_PCA", fx.ts_day(spark, d), ["c1"], components=3)


@query("udf1_custom_detector", sql("ts_day", """SELECT series_id, t, round(abs(c1 - avg(c1) OVER w) + abs(c2 - avg(c2) OVER w) + abs(c3 - avg(c3) OVER w) + abs(c4 - avg(c4) OVER w), 4) AS score
    FROM ts_day WINDOW w AS (PARTITION BY series_id)"""))
def _(spark, d):
    registry.register_fitted(
        "distance_to_mean", lambda x: np.append(x.sum(0), len(x)), lambda s: s[:-1] / s[-1], lambda x, m: abs(x - m).sum(1))
    return rounded(registry.detect("distance_to_mean", fx.ts_day(spark, d), C4), 4)


@query("udf1_local_detector", sql("ts_day", """SELECT series_id, t, round(coalesce(abs(c1 - lag(c1) OVER w), 0) + coalesce(abs(c2 - lag(c2) OVER w), 0) + coalesce(abs(c3 - lag(c3) OVER w), 0)
    + coalesce(abs(c4 - lag(c4) OVER w), 0), 7) AS score, CAST(NULL AS VARCHAR) AS error FROM ts_day WINDOW w AS (PARTITION BY series_id ORDER BY t)"""))
def _(spark, d):
    registry.register_detector("step", lambda x: np.abs(np.diff(x, axis=0, prepend=x[:1])).sum(1), context=1)
    return rounded(registry.detect("step", fx.ts_day(spark, d), C4), 7)


@query("agg19_forest_shape")
def _(spark, d):
    f = forest.forest_fit(fx.ts_day(spark, d), C4, 1, 20)
    return forest.forest_shape(f)


@query("udf2_fit_predict")
def _(spark, d):
    day = fx.ts_day(spark, d)
    out = None
    for name, settings in (("HBOS", {}), ("PCA", {"window": 10}), ("KMeansAD", {})):
        part = estimator.fit_predict(day, C4, name, **settings).withColumn("detector", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("udf3_custom_metric", sql("ts_hour_labelled", """SELECT series_id, round(avg(score) FILTER (label = 1) - avg(score) FILTER (label = 0), 6) AS value FROM ts_hour_labelled GROUP BY 1"""))
def _(spark, d):
    gap = F.avg(F.when(F.col("label") == 1, F.col("score"))) - F.avg(F.when(F.col("label") == 0, F.col("score")))
    registry.register_metric("mean_gap", lambda s, keys: s.groupBy(*keys).agg(gap.alias("value")))
    return rounded(registry.METRICS["mean_gap"](fx.ts_hour_labelled(spark, d), ["series_id"]))


@query("udf4_custom_strategy", sql("ts_hour_labelled", "SELECT series_id, round(avg(score) + 2 * stddev_pop(score), 6) AS threshold FROM ts_hour_labelled GROUP BY 1"))
def _(spark, d):
    from ..operators import threshold as th
    th.register_strategy("mean_and_two", lambda df, keys, score: df.groupBy(*keys).agg((F.avg(score) + 2 * F.stddev_pop(score)).alias("threshold")))
    return rounded(th.find_threshold("mean_and_two", fx.ts_hour_labelled(spark, d), keys=["series_id"], score="score").select("series_id", "threshold"))


@query("jn12_lookup_centres", sql("emb emb_long", """SELECT t, round(cx, 6) AS centre, n AS size FROM emb JOIN (SELECT e.cls, avg(l.x) AS cx, count(*) AS n FROM emb e JOIN emb_long l ON l.t = e.t
    AND l.channel = 1 GROUP BY 1) USING (cls)"""))
def _(spark, d):
    from ..operators import joins as jn
    e = fx.embeddings(spark, d).withColumnRenamed("cls", "cluster")
    centres = e.groupBy("series_id", "cluster").agg(F.avg(F.col("x")[0]).alias("centre"), F.count(F.lit(1)).alias("size"))
    return rounded(jn.lookup_centres(e, centres).select("t", "centre", "size"))
