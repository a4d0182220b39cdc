"""Queries: quality metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as mt
from ..operators.metrics.points import false_alarm_share
from . import fixtures as fx
from .base import query, rounded
from .fixtures import sql

PAIRS = """pr AS (SELECT a.series_id, avg(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0.0 END) AS
    auc FROM scored a JOIN scored b ON a.series_id = b.series_id AND a.label = 1 AND b.label = 0 GROUP BY 1)"""
CURVE = """cu AS (SELECT series_id, score, sum(label) OVER w AS tp, count(*) OVER w AS cnt, sum(label) OVER (PARTITION BY
    series_id) AS pos FROM scored WINDOW w AS (PARTITION BY series_id ORDER BY score DESC) QUALIFY row_number() OVER
    (PARTITION BY series_id, score) = 1), cv AS (SELECT *, tp / CAST(cnt AS DOUBLE) AS p, tp / CAST(pos AS DOUBLE) AS r,
    coalesce(lag(tp / CAST(cnt AS DOUBLE)) OVER w, 1.0) AS pp, coalesce(lag(tp / CAST(pos AS DOUBLE)) OVER w, 0.0) AS pr FROM cu
    WINDOW w AS (PARTITION BY series_id ORDER BY score DESC))"""


@query("met1_auc_roc", sql("scored", "SELECT series_id, round(auc, 6) AS auc_roc FROM pr", PAIRS))
def _(spark, d):
    return rounded(mt.pointwise(fx.scored(spark, d)).select("series_id", "auc_roc"))


@query("met2_ap", sql("scored", "SELECT series_id, round(sum((r - pr) * p), 6) AS auc_pr FROM cv GROUP BY 1", CURVE))
def _(spark, d):
    return rounded(mt.pointwise(fx.scored(spark, d)).select("series_id", "auc_pr"))


@query("met3_pr_auc", sql("scored", "SELECT series_id, round(sum((r - pr) * (p + pp) / 2), 6) AS pr_auc FROM cv GROUP BY 1", CURVE))
def _(spark, d):
    return rounded(mt.pointwise(fx.scored(spark, d)).select("series_id", "pr_auc"))


@query("met4_f1", sql("scored", "SELECT series_id, round(max(2 * p * r / (p + r + 1e-5)), 6) AS f1 FROM cv GROUP BY 1", CURVE))
def _(spark, d):
    return rounded(mt.best_f1(fx.scored(spark, d)))


GRID = """lim AS (SELECT series_id, min(score) AS lo, max(score) AS hi FROM ts_hour_labelled GROUP BY 1), th AS (SELECT series_id, k,
    CASE WHEN k = 99 THEN hi ELSE lo + k * ((hi - lo) / 99.0::DOUBLE) END AS theta FROM lim CROSS JOIN (SELECT range AS k FROM
    range(100))), lv AS MATERIALIZED (SELECT h.series_id, k, t, label, CASE WHEN score > theta THEN 1 ELSE 0 END AS pred FROM
    ts_hour_labelled h JOIN th USING (series_id))"""
FIXED = """lv AS MATERIALIZED (SELECT series_id, 0 AS k, t, label, CASE WHEN score > 8 THEN 1 ELSE 0 END AS pred FROM ts_hour_labelled)"""
LEVELS = """, pt AS (SELECT series_id, k, sum(pred * (1 - label)) AS fp, sum(pred * label) AS tp, sum(label) AS pos FROM lv GROUP BY 1, 2),
    hit AS MATERIALIZED (SELECT r.series_id, lv.k, r.s, r.e, max(pred) AS hit, sum(pred) AS got, r.e - r.s + 1 AS len FROM runs r JOIN lv
    ON lv.series_id = r.series_id AND lv.t BETWEEN r.s AND r.e GROUP BY 1, 2, 3, 4),
    ev AS (SELECT series_id, k, sum(hit) AS hits, sum(hit * len) AS tp_pa, count(*) AS n FROM hit GROUP BY 1, 2),
    prun AS MATERIALIZED (SELECT series_id, k, min(t) AS s, max(t) AS e, sum(label) AS lab, count(*) AS len FROM (SELECT *, t - row_number()
    OVER (PARTITION BY series_id, k ORDER BY t) AS g FROM lv WHERE pred = 1) GROUP BY series_id, k, g)"""
RANGES = """, met AS (SELECT h.series_id, h.k, h.s, count(p.s) AS c FROM hit h LEFT JOIN prun p ON p.series_id = h.series_id AND p.k = h.k AND
    p.s <= h.e AND h.s <= p.e GROUP BY 1, 2, 3), rec AS (SELECT h.series_id, h.k, avg(hit) AS existence, avg(got / CAST(len AS DOUBLE) *
    CASE WHEN c > 1 THEN 1.0::DOUBLE / c ELSE 1 END) AS overlap FROM hit h JOIN met USING (series_id, k, s) GROUP BY 1, 2),
    pmet AS (SELECT p.series_id, p.k, p.s, p.lab / CAST(p.len AS DOUBLE) * coalesce(1.0::DOUBLE / nullif(count(r.s), 0), 0) AS w FROM prun p
    LEFT JOIN runs r ON r.series_id = p.series_id AND p.s <= r.e AND r.s <= p.e GROUP BY 1, 2, 3, p.lab, p.len),
    prec AS (SELECT series_id, k, avg(w) AS p FROM pmet GROUP BY 1, 2)"""


@query("met5_pa_f1", sql("runs", """SELECT series_id, round(max(2.0::DOUBLE * tp_pa / (tp_pa + fp + pos)), 6) AS pa_f1 FROM ev JOIN pt USING
    (series_id, k) GROUP BY 1""", GRID + LEVELS))
def _(spark, d):
    return rounded(mt.point_adjusted_f1(fx.ts_hour_labelled(spark, d)))


@query("met6_event_f1", sql("runs", """SELECT series_id, round(max(2 * r * p / (r + p + 1e-15)), 6) AS event_f1 FROM (SELECT series_id,
    hits / CAST(n AS DOUBLE) AS r, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS p FROM ev JOIN pt USING (series_id, k))
    GROUP BY 1""", GRID + LEVELS))
def _(spark, d):
    return rounded(mt.event_f1(fx.ts_hour_labelled(spark, d)))


@query("met7_range_f1", sql("runs", """SELECT series_id, round(max(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS range_f1
    FROM (SELECT series_id, k, 0.2::DOUBLE * existence + 0.8::DOUBLE * overlap AS r, p FROM rec JOIN prec USING (series_id, k)) GROUP BY 1""",
    GRID + LEVELS + RANGES))
def _(spark, d):
    return rounded(mt.range_f1(fx.ts_hour_labelled(spark, d)))


@query("met8_pr", sql("scored", """SELECT series_id, round(coalesce(sum(p * label) / CAST(nullif(sum(label), 0) AS DOUBLE), 0), 6) AS recall,
    round(coalesce(sum(p * label) / CAST(nullif(sum(p), 0) AS DOUBLE), 0), 6) AS precision FROM (SELECT *, CASE WHEN score >=
    quantile_cont(score, 0.925) OVER (PARTITION BY series_id) THEN 1 ELSE 0 END AS p FROM scored) GROUP BY 1"""))
def _(spark, d):
    return rounded(mt.recall_precision(fx.scored(spark, d)))


# The integrands are linear between the listed break points, so the midpoint rule on them is exact.
AFF = """, z AS (SELECT series_id, s AS gs, e + 1 AS ge, coalesce((lag(e + 1) OVER w + s) / 2.0::DOUBLE, 0.0) AS z0, coalesce((e + 1 + lead(s)
    OVER w) / 2.0::DOUBLE, 720.0) AS z1 FROM runs WINDOW w AS (PARTITION BY series_id ORDER BY s)),
    pc AS MATERIALIZED (SELECT *, coalesce((lag(hi) OVER q + lo) / 2, -1e9) AS v0, coalesce((hi + lead(lo) OVER q) / 2, 1e9) AS v1 FROM
    (SELECT p.series_id, p.k, z.gs, z.ge, z.z0, z.z1, greatest(p.s, z0) AS lo, least(p.e + 1, z1) AS hi FROM prun p JOIN z ON
    z.series_id = p.series_id AND greatest(p.s, z0) < least(p.e + 1, z1)) WINDOW q AS (PARTITION BY series_id, k, gs ORDER BY lo)),
    pb AS (SELECT *, lead(x) OVER (PARTITION BY series_id, k, gs, lo ORDER BY x) AS y FROM (SELECT *, least(greatest(unnest([lo, hi, gs, ge,
    ge + gs - z0, gs + ge - z1]), lo), hi) AS x FROM pc)),
    pi AS (SELECT series_id, k, gs, sum(CASE WHEN (x + y) / 2 BETWEEN gs AND ge THEN 1 ELSE 1 - (ge - gs + least(greatest(gs - (x + y) / 2,
    (x + y) / 2 - ge), gs - z0) + least(greatest(gs - (x + y) / 2, (x + y) / 2 - ge), z1 - ge)) / (z1 - z0) END * (y - x)) / sum(y - x) AS p
    FROM pb WHERE y > x GROUP BY 1, 2, 3),
    rb AS (SELECT *, lead(x) OVER (PARTITION BY series_id, k, gs, lo ORDER BY x) AS y FROM (SELECT *, least(greatest(unnest([j0, j1, lo, hi,
    (lo + z0) / 2, (hi + z1) / 2]), j0), j1) AS x FROM (SELECT *, greatest(gs, v0) AS j0, least(ge, v1) AS j1 FROM pc) WHERE j1 > j0)),
    ri AS (SELECT series_id, k, gs, sum((1 - (least(greatest(lo - (x + y) / 2, (x + y) / 2 - hi, 0), (x + y) / 2 - z0) + least(greatest(lo -
    (x + y) / 2, (x + y) / 2 - hi, 0), z1 - (x + y) / 2)) / (z1 - z0)) * (y - x)) / max(ge - gs) AS r FROM rb WHERE y > x GROUP BY 1, 2, 3),
    af AS (SELECT series_id, k, avg(p) AS p, sum(r) / max(n) AS r FROM pi JOIN ri USING (series_id, k, gs) JOIN (SELECT series_id, count(*) AS
    n FROM runs GROUP BY 1) USING (series_id) GROUP BY 1, 2)"""


@query("met9_affiliation_levels", sql("runs", """SELECT series_id, CAST(k AS INT) AS k, round(p, 5) AS precision, round(r, 5) AS recall FROM af""",
                                      GRID + LEVELS + AFF))
def _(spark, d):
    return rounded(mt.affiliation(fx.ts_hour_labelled(spark, d)).select("series_id", "k", "precision", "recall"), 5)


@query("met9_affiliation", sql("runs", """SELECT series_id, round(max(2 * p * r / (p + r + 1e-15)), 6) AS affiliation_f FROM af GROUP BY 1""",
                               GRID + LEVELS + AFF))
def _(spark, d):
    return rounded(mt.affiliation_f(fx.ts_hour_labelled(spark, d)))


def _vus_sql(ws: str, theta: str, ks: int) -> str:
    return f"""wn AS (SELECT CAST(range AS INT) AS w FROM range({ws})), {theta},
        lv AS MATERIALIZED (SELECT h.series_id, k, t, label, CASE WHEN score >= theta THEN 1 ELSE 0 END AS pred FROM ts_hour_labelled h JOIN
        th USING (series_id)),
        soft AS MATERIALIZED (SELECT h.series_id, w, h.t, least(1.0, sum(sqrt(1 - CASE WHEN h.t > r.e THEN h.t - r.e ELSE r.s - h.t END /
        CAST(w AS DOUBLE)))) AS v FROM wn JOIN runs r ON w >= 2 JOIN ts_hour_labelled h ON h.series_id = r.series_id AND h.label = 0 AND
        h.t BETWEEN r.s - w // 2 AND r.e + w // 2 GROUP BY 1, 2, 3),
        sg AS (SELECT series_id, w, min(s) - w // 2 AS s, max(e) + w // 2 AS e FROM (SELECT *, sum(b) OVER (PARTITION BY series_id, w ORDER BY
        s) AS g FROM (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY series_id, w ORDER BY s) + w // 2 >= s - w // 2 THEN 0 ELSE 1 END AS b FROM
        runs CROSS JOIN wn)) GROUP BY series_id, w, g),
        ex AS (SELECT series_id, w, k, avg(hit) AS ratio FROM (SELECT sg.series_id, w, sg.s, k, max(pred) AS hit FROM sg JOIN lv ON
        lv.series_id = sg.series_id AND lv.t BETWEEN sg.s AND sg.e GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
        st AS (SELECT lv.series_id, lv.k, soft.w, sum(v * pred) AS soft FROM soft JOIN lv USING (series_id, t) GROUP BY 1, 2, 3),
        cn AS (SELECT series_id, k, sum(pred) AS np, sum(pred * label) AS tp, sum(label) AS pos, count(*) AS n FROM lv GROUP BY 1, 2),
        al AS (SELECT cn.series_id, cn.k, wn.w, np, n, tp + coalesce(soft, 0) AS tp, (pos + pos + coalesce(soft, 0)) / 2.0::DOUBLE AS pnew, ratio
        FROM cn CROSS JOIN wn LEFT JOIN st ON st.series_id = cn.series_id AND st.k = cn.k AND st.w = wn.w JOIN ex ON ex.series_id =
        cn.series_id AND ex.k = cn.k AND ex.w = wn.w),
        cv AS (SELECT *, lag(tpr, 1, 0.0) OVER q AS pt, lag(fpr, 1, 0.0) OVER q AS pf FROM (SELECT series_id, w, k, least(tp / pnew, 1.0) * ratio
        AS tpr, (np - tp) / (n - pnew) AS fpr, tp / nullif(np, 0) AS prec, least(tp / pnew, 1.0) AS rec FROM al) WINDOW q AS (PARTITION BY
        series_id, w ORDER BY k)),
        ar AS (SELECT series_id, w, sum((fpr - pf) * (tpr + pt) / 2) + max(CASE WHEN k = {ks - 1} THEN (1 - fpr) * (tpr + 1) / 2 END) AS auc,
        sum((tpr - pt) * prec) AS ap FROM cv GROUP BY 1, 2)"""


ORDERED = """os AS (SELECT series_id, score, row_number() OVER (PARTITION BY series_id ORDER BY score DESC) - 1 AS i FROM ts_hour_labelled),
    th AS (SELECT series_id, k, score AS theta FROM os JOIN (SELECT range AS k FROM range(250)) ON i = CAST(floor(k * (719 /
    CAST(249 AS DOUBLE))) AS BIGINT))"""


@query("met10_vus", sql("runs", """SELECT series_id, round(avg(auc), 6) AS vus_roc, round(avg(ap), 6) AS vus_pr FROM ar GROUP BY 1""",
                        _vus_sql("41", ORDERED, 250)))
def _(spark, d):
    return rounded(mt.vus(fx.ts_hour_labelled(spark, d), 40))


@query("met11_range_auc", sql("runs", """SELECT series_id, round(auc, 6) AS range_auc, round(ap, 6) AS range_ap FROM ar""",
                              _vus_sql("100, 101", ORDERED, 250)))
def _(spark, d):
    return rounded(mt.range_auc(fx.ts_hour_labelled(spark, d), 100))


@query("met12_vus_pred", sql("runs", """SELECT series_id, round(avg(rec), 6) AS vus_recall, round(avg(coalesce(prec, 0)), 6) AS vus_precision,
    round(avg(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END), 6) AS vus_f FROM cv GROUP BY 1""",
    _vus_sql("41", "th AS (SELECT DISTINCT series_id, 0 AS k, 8.0::DOUBLE AS theta FROM ts_hour_labelled)", 1)))
def _(spark, d):
    h = fx.ts_hour_labelled(spark, d).withColumn("pred", F.when(F.col("score") >= 8, 1).otherwise(0))
    return rounded(mt.vus_pred(h, 40))


SAMPLED = """th AS (SELECT series_id, i AS k, score AS theta, m FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score) - 2 AS
    i, count(*) OVER (PARTITION BY series_id) - 1 AS m FROM (SELECT DISTINCT series_id, score FROM ts_hour_labelled)) WHERE i >= 0 AND
    (i % CASE WHEN m > 50 THEN m // 49 ELSE 1 END = 0 OR i = m - 1)), lv AS MATERIALIZED (SELECT h.series_id, k, t, label, CASE WHEN score >=
    theta THEN 1 ELSE 0 END AS pred FROM ts_hour_labelled h JOIN th USING (series_id))"""


@query("met13_ptrt", sql("runs", """SELECT series_id, round(sum((pr - r) * (pp + p) / 2), 6) AS auc_ptrt FROM (SELECT *, lag(r) OVER w AS pr,
    lag(p) OVER w AS pp FROM (SELECT series_id, 1 AS o, round(0.5::DOUBLE * existence + 0.5::DOUBLE * overlap, 12) AS r, round(p, 12) AS p FROM rec JOIN prec USING
    (series_id, k) UNION ALL SELECT series_id, 0, 1.0, avg(label) FROM ts_hour_labelled GROUP BY 1 UNION ALL SELECT DISTINCT series_id, 2, 0.0,
    1.0 FROM ts_hour_labelled) WINDOW w AS (PARTITION BY series_id ORDER BY o, r DESC, p)) GROUP BY 1""", SAMPLED + LEVELS + RANGES))
def _(spark, d):
    return rounded(mt.auc_ptrt(fx.ts_hour_labelled(spark, d)))


def _bias_sql(weight: str) -> str:
    """Range scores with a bias, point by point: weight of position i in a range of length n."""
    return FIXED + LEVELS + f""", met AS (SELECT h.series_id, h.s, count(p.s) AS c FROM hit h LEFT JOIN prun p ON p.series_id = h.series_id AND
        p.s <= h.e AND h.s <= p.e GROUP BY 1, 2), rw AS (SELECT series_id, s, sum(pred * wt) / sum(wt) AS w, max(pred) AS hit FROM (SELECT *,
        {weight} AS wt FROM (SELECT r.series_id, r.s, lv.pred, lv.t - r.s + 1 AS i, r.e - r.s + 1 AS n FROM runs r JOIN lv ON lv.series_id =
        r.series_id AND lv.t BETWEEN r.s AND r.e)) GROUP BY 1, 2), rec AS (SELECT series_id, avg(0.3::DOUBLE * hit + 0.7::DOUBLE * w * CASE WHEN
        c > 1 THEN 1.0::DOUBLE / c ELSE 1 END) AS recall FROM rw JOIN met USING (series_id, s) GROUP BY 1),
        pw AS (SELECT series_id, s, sum(label * wt) / CAST(sum(wt) AS DOUBLE) AS w FROM (SELECT *, {weight} AS wt FROM (SELECT p.series_id, p.s, lv.label,
        lv.t - p.s + 1 AS i, p.e - p.s + 1 AS n FROM prun p JOIN lv ON lv.series_id = p.series_id AND lv.t BETWEEN p.s AND p.e)) GROUP BY 1, 2),
        pc AS (SELECT p.series_id, p.s, count(r.s) AS c FROM prun p LEFT JOIN runs r ON r.series_id = p.series_id AND p.s <= r.e AND r.s <= p.e
        GROUP BY 1, 2), prec AS (SELECT series_id, avg(w * CASE WHEN c > 1 THEN 1.0::DOUBLE / c ELSE 1 END) AS precision FROM pw JOIN pc USING
        (series_id, s) GROUP BY 1)"""


WEIGHTS = {"flat": "1", "front": "(n - i + 1)", "middle": "CASE WHEN i <= n / 2.0 THEN i ELSE n - i + 1 END", "back": "i"}


def _register_bias(bias: str):
    @query(f"met14_range_fbeta_{bias}", sql("runs", """SELECT series_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE
        WHEN 4 * precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0 END, 6) AS fbeta FROM rec JOIN prec USING
        (series_id)""", _bias_sql(WEIGHTS[bias])))
    def _(spark, d):
        h = fx.ts_hour_labelled(spark, d).withColumn("pred", F.when(F.col("score") > 8, 1).otherwise(0))
        f = mt.range_fbeta(h, 2.0, r_alpha=0.3, r_bias=bias, p_bias=bias)
        return rounded(f.select("series_id", "precision", "recall", "fbeta"))


for _bias in WEIGHTS:
    _register_bias(_bias)


@query("met15_all", sql("runs", """SELECT series_id, round(auc, 6) AS auc, round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0), 6) AS precision,
    round(tp / CAST(pos AS DOUBLE), 6) AS recall, round(2.0::DOUBLE * tp / (tp + fp + pos), 6) AS f1, round(2.0::DOUBLE * tp_pa / (tp_pa + fp + pos), 6) AS
    pa_f1, round(0.2::DOUBLE * existence + 0.8::DOUBLE * overlap, 6) AS rrecall, round(existence, 6) AS existence, round(overlap, 6) AS overlap,
    round(coalesce(prec.p, 0), 6) AS rprecision, round(coalesce(2.0::DOUBLE * prec.p * (0.2::DOUBLE * existence + 0.8::DOUBLE * overlap) / nullif(prec.p + 0.2::DOUBLE * existence +
    0.8::DOUBLE * overlap, 0), 0), 6) AS rf, round(at_k, 6) AS precision_at_k FROM ev JOIN (SELECT h.series_id, sum(CASE WHEN score > threshold THEN label ELSE 0 END) / CAST(sum(label) AS DOUBLE) AS at_k
    FROM ts_hour_labelled h JOIN kt USING (series_id) GROUP BY 1) USING (series_id) JOIN pt USING (series_id, k) JOIN rec USING (series_id, k) LEFT JOIN prec USING (series_id, k)
    JOIN (SELECT a.series_id, avg(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0.0 END) AS auc FROM
    ts_hour_labelled a JOIN ts_hour_labelled b ON a.series_id = b.series_id AND a.label = 1 AND b.label = 0 GROUP BY 1) USING (series_id)""",
    """lv AS MATERIALIZED (SELECT series_id, 0 AS k, t, label, CASE WHEN score > avg(score) OVER p + 3 * stddev_pop(score) OVER p THEN 1 ELSE 0
    END AS pred FROM ts_hour_labelled WINDOW p AS (PARTITION BY series_id)), ko AS (SELECT series_id, score, row_number() OVER (PARTITION BY series_id ORDER BY score) - 1 AS i FROM ts_hour_labelled),
    kk AS (SELECT series_id, (1 - sum(label) / CAST(count(*) AS DOUBLE)) * (count(*) - 1) AS pos FROM ts_hour_labelled GROUP BY 1), kt AS (SELECT kk.series_id, a.score + (b.score - a.score) *
    (pos - floor(pos)) AS threshold FROM kk JOIN ko a ON a.series_id = kk.series_id AND a.i = floor(pos) JOIN ko b ON b.series_id = kk.series_id AND b.i = ceil(pos))""" + LEVELS + RANGES))
def _(spark, d):
    return rounded(mt.scalar_report(fx.ts_hour_labelled(spark, d)))


@query("met16_fpr", sql("ts_hour_labelled", """SELECT series_id, round(sum(p * (1 - label)) / CAST(sum(p * (1 - label)) + sum(label) AS DOUBLE), 6)
    AS fpr FROM (SELECT *, CASE WHEN score > 8 THEN 1 ELSE 0 END AS p FROM ts_hour_labelled) GROUP BY 1"""))
def _(spark, d):
    h = fx.ts_hour_labelled(spark, d).withColumn("pred", F.when(F.col("score") > 8, 1).otherwise(0))
    return rounded(false_alarm_share(h))


@query("met_full_report")
def _(spark, d):
    return mt.full_report(fx.ts_hour_labelled(spark, d), 40)


@query("met_prediction_report")
def _(spark, d):
    h = fx.ts_hour_labelled(spark, d).withColumn("pred", F.when(F.col("score") > 8, 1).otherwise(0))
    return mt.prediction_report(h, 40)


@query("met18_bulk", sql("ts_hour_labelled", """SELECT dataset, model, round(avg(CASE WHEN a > b THEN 1.0::DOUBLE WHEN a = b THEN 0.5::DOUBLE ELSE
    0.0 END), 6) AS auc_roc FROM (SELECT p.series_id AS dataset, m AS model, CASE m WHEN 'count' THEN p.c1 ELSE p.c2 END AS a, CASE m WHEN 'count'
    THEN n.c1 ELSE n.c2 END AS b FROM ts_hour_labelled p JOIN ts_hour_labelled n ON p.series_id = n.series_id AND p.label = 1 AND n.label = 0
    CROSS JOIN (SELECT unnest(['count', 'sum']) AS m)) GROUP BY 1, 2"""))
def _(spark, d):
    h = fx.ts_hour_labelled(spark, d).withColumnRenamed("series_id", "dataset")
    scores = h.select("dataset", "t", F.explode(F.array(
        F.struct(F.lit("count").alias("model"), F.col("c1").alias("score")),
        F.struct(F.lit("sum").alias("model"), F.col("c2").alias("score")))).alias("m")).select("dataset", "t", "m.*")
    truth = h.select("dataset", "t", "label")
    return rounded(mt.bulk(scores, truth, window=8, thresholds=50).select("dataset", "model", "auc_roc"))
