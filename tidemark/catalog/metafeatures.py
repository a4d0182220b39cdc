"""Queries: meta-features and grouped statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import meta as mf
from ..operators.clean import melt, size_bin
from ..operators.scale import minmax
from . import fixtures as fx
from .base import query, rd, rounded
from .fixtures import sql

C4 = ["c1", "c2", "c3", "c4"]
SC = "sc AS MATERIALIZED (SELECT series_id, t, " + ", ".join(
    f"(c{i} - min(c{i}) OVER p) / (max(c{i}) OVER p - min(c{i}) OVER p) AS c{i}" for i in range(1, 5)
) + " FROM ts_day WINDOW p AS (PARTITION BY series_id)), ln AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT series_id, t, 'c{i}' AS channel, c{i} AS x FROM sc" for i in range(1, 5)
) + ")"


def _scaled(spark, d):
    return minmax(fx.ts_day(spark, d).select("series_id", "t", *C4), C4)


def _cells(spark, d):
    s = _scaled(spark, d)
    rows = s.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_samples"))
    return mf.cell_features(melt(s, ["series_id"], C4), rows)


def _six_sql(expr: str, name: str) -> str:
    g = f"avg(pow({expr} - m_{name}, 3)) / nullif(pow(stddev_pop({expr}), 3), 0)"
    k = f"avg(pow({expr} - m_{name}, 4)) / nullif(pow(var_pop({expr}), 2), 0) - 3"
    parts = [f"min({expr})", f"max({expr})", f"avg({expr})", f"stddev_pop({expr})", f"coalesce({g}, 0)", f"coalesce({k}, -3)"]
    return ", ".join(f"round({p}, 5) + 0.0 AS {name}_{s}" for p, s in zip(parts, mf.SIX, strict=True))


@query("agg2_cells", sql("ts_day", """SELECT series_id, round(avg(x), 6) AS sample_mean, round(median(x), 6) AS sample_median, round(var_pop(x), 6) AS
    sample_var, min(x) AS sample_min, max(x) AS sample_max, round(stddev_pop(x), 6) AS sample_std, round(avg(x) / max(x), 6) AS normalized_mean,
    round(median(x) / max(x), 6) AS normalized_median, max(x) - min(x) AS sample_range, round(var_pop(x) / avg(x), 6) AS coeff_var FROM ln GROUP BY 1""", SC))
def _(spark, d):
    return rounded(_cells(spark, d).select(
        "series_id", "sample_mean", "sample_median", "sample_var", "sample_min", "sample_max", "sample_std", "normalized_mean",
        "normalized_median", "sample_range", "coeff_var"))


@query("agg3_quantiles", sql("ts_day", """SELECT series_id, round(quantile_cont(x, 0.0001), 6) AS q1, round(quantile_cont(x, 0.0025), 6) AS q25,
    round(quantile_cont(x, 0.0075), 6) AS q75, round(quantile_cont(x, 0.0099), 6) AS q99, round(quantile_cont(x, 0.0075) - quantile_cont(x, 0.0025), 6) AS iqr,
    round((quantile_cont(x, 0.0075) - quantile_cont(x, 0.0025)) / (quantile_cont(x, 0.0075) + quantile_cont(x, 0.0025) + 1e-8), 6) AS quant_coeff_disp FROM ln
    GROUP BY 1""", SC))
def _(spark, d):
    return rounded(_cells(spark, d).select("series_id", "q1", "q25", "q75", "q99", "iqr", "quant_coeff_disp"))


@query("agg5_gini", sql("ts_day", """SELECT series_id, round(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 6) AS sample_gini FROM (SELECT series_id, x + 1e-7 AS x,
    row_number() OVER (PARTITION BY series_id ORDER BY x) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM ln) GROUP BY 1""", SC))
def _(spark, d):
    return rounded(_cells(spark, d).select("series_id", "sample_gini"))


@query("agg6_deviations", sql("ts_day", """SELECT series_id, round(median(abs(x - med)), 6) AS med_abs_dev, round(avg(abs(x - mu)), 6) AS avg_abs_dev FROM (SELECT
    *, median(x) OVER p AS med, avg(x) OVER p AS mu FROM ln WINDOW p AS (PARTITION BY series_id)) GROUP BY 1""", SC))
def _(spark, d):
    return rounded(_cells(spark, d).select("series_id", "med_abs_dev", "avg_abs_dev"))


def _out(lo: str, hi: str, name: str) -> str:
    return (f"round(count(*) FILTER (x < {lo} OR x > {hi}) / CAST(count(DISTINCT t) AS DOUBLE), 6) AS percent_outliers_{name}, "
            f"CAST(count(*) FILTER (x < {lo} OR x > {hi}) > 0 AS INT) AS has_outliers_{name}")


@query("agg8_outliers", sql("ts_day", f"""SELECT series_id, {_out('b - 1.5 * (c - b)', 'c + 1.5 * (c - b)', '15iqr')}, {_out('b - 3 * (c - b)', 'c + 3 * (c - b)',
    '3iqr')}, {_out('a', 'e', '1_99')}, {_out('mu - 3 * sd', 'mu + 3 * sd', '3std')} FROM (SELECT *, quantile_cont(x, 0.0001) OVER p AS a, quantile_cont(x, 0.0025)
    OVER p AS b, quantile_cont(x, 0.0075) OVER p AS c, quantile_cont(x, 0.0099) OVER p AS e, avg(x) OVER p AS mu, stddev_pop(x) OVER p AS sd FROM ln WINDOW p AS
    (PARTITION BY series_id)) GROUP BY 1""", SC))
def _(spark, d):
    c = _cells(spark, d)
    return rounded(c.select("series_id", *[x for x in c.columns if "outliers" in x]))


def _channels(spark, d):
    return mf.channel_features(melt(_scaled(spark, d), ["series_id"], C4))


CH = ", ch AS MATERIALIZED (SELECT series_id, channel, count(*) AS n, max(g1) AS g1, max(g2) AS g2, " + ", ".join(
    f"avg(pow(x - mu, {k})) AS m{k}" for k in range(5, 11)) + """ FROM (SELECT *, (m3 / pow(m2, 1.5::DOUBLE)) AS g1, m4 / (m2 * m2) - 3 AS g2 FROM (SELECT *, avg(pow(x - mu, 2))
    OVER q AS m2, avg(pow(x - mu, 3)) OVER q AS m3, avg(pow(x - mu, 4)) OVER q AS m4 FROM (SELECT *, avg(x) OVER q AS mu FROM ln WINDOW q AS (PARTITION BY series_id,
    channel)) WINDOW q AS (PARTITION BY series_id, channel))) GROUP BY 1, 2)"""


@query("agg9_normality", sql("ts_day", """SELECT series_id, channel, round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS normality_p FROM (SELECT *, dl * asinh(y / sqrt(2 / (w2 - 1)))
    AS z1, ((1 - 2 / (9 * a)) - sign(u) * pow(abs(u), 1 / 3.0::DOUBLE)) / sqrt(2 / (9 * a)) AS z2 FROM (SELECT *, 1 / sqrt(0.5::DOUBLE * ln(w2)) AS dl, (1 - 2 / a) / (1 + x *
    sqrt(2 / (a - 4))) AS u FROM (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, 6 + 8 / rb * (2 / rb + sqrt(1 + 4 / (rb * rb))) AS a FROM (SELECT series_id, channel, g1 * sqrt((n +
    1) * (n + 3) / (6.0::DOUBLE * (n - 2))) AS y, 3.0::DOUBLE * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2, (g2 + 3 - 3.0::DOUBLE *
    (n - 1) / (n + 1)) / sqrt(24.0::DOUBLE * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, 6.0::DOUBLE * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) *
    sqrt(6.0::DOUBLE * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rb FROM (SELECT series_id, channel, CAST(n AS DOUBLE) AS n, g1, g2 FROM ch)))))""", SC + CH))
def _(spark, d):
    return rounded(_channels(spark, d).select("series_id", "channel", "normality_p"))


@query("agg10_moments", sql("ts_day", "SELECT series_id, channel, " + ", ".join(f"round(m{k}, 9) AS moment_{k}" for k in range(5, 11)) + " FROM ch", SC + CH))
def _(spark, d):
    return rounded(_channels(spark, d).select("series_id", "channel", *[f"moment_{k}" for k in range(5, 11)]), 9)


@query("agg11_shape_list6", sql("ts_day", f"SELECT series_id, {_six_sql('g1', 'skewness')}, {_six_sql('g2', 'kurtosis')} FROM (SELECT *, avg(g1) OVER (PARTITION BY series_id) AS "
                                "m_skewness, avg(g2) OVER (PARTITION BY series_id) AS m_kurtosis FROM ch) GROUP BY 1", SC + CH))
def _(spark, d):
    return rounded(mf.summarised(_channels(spark, d), ("skewness", "kurtosis")), 5)


PAIR = ", pr AS (" + " UNION ALL ".join(
    f"SELECT series_id, corr(c{i}, c{j}) AS r, covar_samp(c{i}, c{j}) * 100 AS v FROM sc GROUP BY 1" for i in range(1, 5) for j in range(1, i)) + ")"


@query("agg12_correlation", sql("ts_day", f"SELECT series_id, {_six_sql('r', 'correlation')} FROM (SELECT *, avg(r) OVER (PARTITION BY series_id) AS m_correlation FROM pr) GROUP "
                                "BY 1", SC + PAIR))
def _(spark, d):
    m = mf.matrix_features(_scaled(spark, d), C4)
    return rounded(m.select("series_id", *[f"correlation_{s}" for s in mf.SIX]), 5)


@query("agg13_covariance", sql("ts_day", f"SELECT series_id, {_six_sql('v', 'covariance')} FROM (SELECT *, avg(v) OVER (PARTITION BY series_id) AS m_covariance FROM pr) GROUP BY 1", SC + PAIR))
def _(spark, d):
    """The figures with a unit in hundredths; skewness and kurtosis have none."""
    m = mf.matrix_features(_scaled(spark, d), C4)
    return m.select("series_id", *[rd(F.col(f"covariance_{s}") * (100 if s in mf.SIX[:4] else 1), 5).alias(f"covariance_{s}") for s in mf.SIX])


@query("agg14_sparsity", sql("ts_day", "SELECT series_id, channel, round(count(DISTINCT x) / CAST(count(*) AS DOUBLE), 6) AS sparsity FROM ln GROUP BY 1, 2", SC))
def _(spark, d):
    return rounded(_channels(spark, d).select("series_id", "channel", "sparsity"))


@query("agg17_entropy", sql("ts_day", """SELECT series_id, channel, round(-sum(c / CAST(n AS DOUBLE) * ln(c / CAST(n AS DOUBLE))) / max(n), 8) AS entropy FROM (SELECT series_id, channel, x,
    count(*) AS c, sum(count(*)) OVER (PARTITION BY series_id, channel) AS n FROM ln GROUP BY 1, 2, 3) GROUP BY 1, 2""", SC))
def _(spark, d):
    return rounded(_channels(spark, d).select("series_id", "channel", "entropy"), 8)


@query("agg18_hist", sql("ts_day", f"SELECT series_id, {_six_sql('hx', 'HBOS_max')}, {_six_sql('hn', 'HBOS_min')}, round(avg(hm), 5) AS HBOS_mean_mean, round(max(hm), 5) AS HBOS_mean_max, "
                         "round(min(hm), 5) AS HBOS_mean_min FROM (SELECT *, avg(hx) OVER (PARTITION BY series_id) AS m_HBOS_max, avg(hn) OVER (PARTITION BY series_id) AS m_HBOS_min FROM (SELECT series_id, "
                         "channel, max(c) / CAST(sum(c) AS DOUBLE) * 10 AS hx, CASE WHEN count(*) < 10 THEN 0.0::DOUBLE ELSE min(c) / CAST(sum(c) AS DOUBLE) * 10 END AS hn, sum(c) / CAST(sum(c) AS DOUBLE) AS hm "
                         "FROM (SELECT series_id, channel, least(floor(x * 10), 9) AS b, count(*) AS c FROM ln GROUP BY 1, 2, 3) GROUP BY 1, 2)) GROUP BY 1", SC))
def _(spark, d):
    """The mean density of a channel is the same for all channels, so its spread has no shape."""
    h = mf.histogram_landmarks(melt(_scaled(spark, d), ["series_id"], C4))
    return rounded(h.select("series_id", *[f"{c}_{s}" for c in ("HBOS_max", "HBOS_min") for s in mf.SIX], "HBOS_mean_mean", "HBOS_mean_max", "HBOS_mean_min"), 5)


@query("agg15_matrix_features")
def _(spark, d):
    return mf.matrix_features(_scaled(spark, d), C4)


@query("agg21_projection_landmarks")
def _(spark, d):
    return mf.projection_landmarks(_scaled(spark, d), C4)


@query("agg22_meta_vector")
def _(spark, d):
    return mf.as_vector(mf.meta_features(fx.ts_day(spark, d), C4))


@query("agg23_catch22")
def _(spark, d):
    from ..operators.catch import catch22_summary
    return catch22_summary(fx.ts_day(spark, d), C4)


@query("agg24_grouped_runtime", sql("", """SELECT bin, grp, round(avg(runtime), 4) AS runtime FROM (SELECT CASE WHEN n_chars < 500 THEN '<500' WHEN n_chars < 2000 THEN
    '500-2000' ELSE '>=2000' END AS bin, lang AS grp, n_chars / 1000.0::DOUBLE AS runtime FROM documents) GROUP BY 1, 2 ORDER BY 1, 3"""))
def _(spark, d):
    b = size_bin("n_chars", ((500, "<500"), (2000, "500-2000")), ">=2000")
    g = fx.table(spark, d, "documents").groupBy(b.alias("bin"), F.col("lang").alias("grp"))
    return g.agg(rd(F.avg(F.col("n_chars") / 1000.0), 4).alias("runtime")).orderBy("bin", "runtime")


@query("agg26_performance_matrix", sql("perf", "SELECT dataset, " + ", ".join(f"round(max(perf) FILTER (i = {i}), 6) AS m{i}" for i in range(1, 26))
    + " FROM (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY model) AS i, perf FROM perf) GROUP BY 1"))
def _(spark, d):
    from ..operators.select.tables import performance_matrix
    return rounded(performance_matrix(fx.perf(spark, d)).select("dataset", *[F.col(str(i)).alias(f"m{i}") for i in range(1, 26)]))


@query("agg27_wcorr", sql("", """SELECT l_returnflag, round((sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w)) / sqrt((sum(w * x * x) / sum(w) - pow(sum(w * x) /
    sum(w), 2)) * (sum(w * y * y) / sum(w) - pow(sum(w * y) / sum(w), 2))), 6) + 0.0 AS r FROM (SELECT l_returnflag, l_quantity AS w, l_discount AS x, l_tax AS y FROM lineitem) GROUP
    BY 1"""))
def _(spark, d):
    li = fx.table(spark, d, "lineitem")
    return rounded(li.groupBy("l_returnflag").agg(
        mf.weighted_corr(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")).alias("r")))


@query("agg28_row_correlations", sql("perf", """SELECT x.dataset AS a, y.dataset AS b, round(corr(x.perf, y.perf), 6) + 0.0 AS r FROM perf x JOIN perf y USING (model) GROUP BY 1, 2"""))
def _(spark, d):
    return rounded(mf.row_correlations(fx.perf(spark, d)))
