"""The flagship query: which users' event streams look anomalous, and how well does the score match the labels?"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import distance
from ..operators import metrics as mt
from ..operators.scale import row_zscore
from ..operators.windows import overlap_mean, slide
from ..plans.attach import attach
from . import fixtures as fx
from .base import query, rounded
from .fixtures import sql

WINDOW = 5


@query("m0_user_streams", sql("ts_user", """SELECT p.series_id, count(*) AS points, round(max(p.score), 5) AS top, round(avg(CASE WHEN p.label = 1 THEN a END), 6) AS auc_roc FROM (SELECT x.*, x.r / x.neg AS a FROM
    (SELECT s.*, (SELECT sum(CASE WHEN q.sc < s.sc THEN 1.0::DOUBLE WHEN q.sc = s.sc THEN 0.5::DOUBLE ELSE 0.0 END) FROM pt q WHERE q.series_id = s.series_id AND q.label = 0) AS r, nullif(count(*) FILTER (s.label =
    0) OVER (PARTITION BY s.series_id), 0) AS neg, s.sc AS score FROM pt s) x) p GROUP BY 1""", """w AS MATERIALIZED (SELECT a.series_id, a.t, u.ch, b.t - a.t AS i, CASE WHEN u.ch = 1 THEN b.c1 ELSE b.c2 END AS x FROM
    ts_user a JOIN ts_user b ON a.series_id = b.series_id AND b.t BETWEEN a.t AND a.t + 4 JOIN ts_user l ON l.series_id = a.series_id AND l.t = a.t + 4 CROSS JOIN (SELECT unnest([1, 2]) AS ch) u),
    z AS MATERIALIZED (SELECT series_id, t, ch, i, coalesce((x - avg(x) OVER p) / nullif(stddev_samp(x) OVER p, 0), 0) AS z FROM w WINDOW p AS (PARTITION BY series_id, t)),
    m AS (SELECT series_id, ch, i, avg(z) AS m FROM z GROUP BY 1, 2, 3), ds AS MATERIALIZED (SELECT series_id, t, sqrt(sum((z - m) * (z - m))) AS d FROM z JOIN m USING (series_id, ch, i) GROUP BY 1, 2),
    pt AS MATERIALIZED (SELECT u.series_id, u.t, u.label, round(coalesce(avg(ds.d), 0), 9) AS sc FROM ts_user u LEFT JOIN ds ON ds.series_id = u.series_id AND ds.t BETWEEN u.t - 4 AND u.t GROUP BY 1, 2, 3)"""))
def user_streams(spark, d):
    """One row per user: points, highest score, and ROC area against the labels."""
    u = fx.ts_user(spark, d).select("series_id", "t", "c1", "c2", "label")
    z = slide(u, ["c1", "c2"], WINDOW).withColumn("win", row_zscore(F.col("win")))  # five times the rows: cheaper to slide twice than to write
    mean = z.select("series_id", F.posexplode("win").alias("i", "v")).groupBy("series_id", "i").agg(F.avg("v").alias("v"))
    mean = mean.groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("m"))
    far = attach(z, mean, ["series_id"]).select("series_id", "t", distance(F.col("win"), F.col("m")).alias("score"))
    scored = overlap_mean(u, far, WINDOW).withColumn("score", F.round("score", 9)).join(
        u.select("series_id", "t", "label"), ["series_id", "t"])
    top = scored.groupBy("series_id").agg(F.count(F.lit(1)).alias("points"), F.max("score").alias("top"))
    auc = mt.pointwise(scored).select("series_id", "auc_roc")
    return rounded(rounded(top.join(auc, "series_id", "left"), 6, ["auc_roc"]), 5, ["top"])
