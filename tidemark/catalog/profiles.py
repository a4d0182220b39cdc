"""Queries: profiles of a series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as pf
from ..operators.clean import melt
from . import fixtures as fx
from .base import query, rd, rounded
from .fixtures import sql

ACF = """dv AS (SELECT series_id, t, c1 - avg(c1) OVER (PARTITION BY series_id) AS x FROM ts_day),
    ac AS (SELECT a.series_id, b.t - a.t AS lag, sum(a.x * b.x) / max(v) AS acf FROM dv a JOIN dv b ON a.series_id = b.series_id AND
    b.t BETWEEN a.t AND a.t + {0} JOIN (SELECT series_id, sum(x * x) AS v FROM dv GROUP BY 1) tv ON tv.series_id = a.series_id GROUP BY 1, 2)"""


@query("prf1_acf", sql("ts_day", "SELECT series_id, CAST(lag AS INT) AS lag, round(acf, 6) AS acf FROM ac", ACF.format(100)))
def _(spark, d):
    return rounded(pf.autocorrelation(fx.ts_day(spark, d), "c1", 100))


@query("prf2_period", sql("ts_day", """SELECT series_id, CASE WHEN i BETWEEN 3 AND 300 THEN i + 3 ELSE 125 END AS period FROM (SELECT series_id,
    CAST(arg_max(lag - 3, acf) FILTER (acf > p AND acf > n) AS INT) AS i FROM (SELECT *, lag(acf) OVER w AS p, lead(acf) OVER w AS n FROM ac WHERE
    lag >= 3 WINDOW w AS (PARTITION BY series_id ORDER BY lag)) GROUP BY 1)""", ACF.format(400)))
def _(spark, d):
    return pf.period(fx.ts_day(spark, d), "c1")


@query("prf2_period_rank2", sql("ts_day", """SELECT series_id, CASE WHEN j BETWEEN 3 AND 300 THEN j + 3 ELSE 125 END AS period FROM (SELECT
    pk.series_id, CAST(coalesce(arg_max(pk.i, pk.acf) FILTER (pk.i > b.i), max(b.i)) AS INT) AS j FROM pk JOIN (SELECT series_id, arg_max(i, acf) AS i FROM pk GROUP BY 1) b
    USING (series_id) GROUP BY 1)""", ACF.format(400) + """, pk AS (SELECT series_id, lag - 3 AS i, acf FROM (SELECT *, lag(acf) OVER w AS p,
    lead(acf) OVER w AS n FROM ac WHERE lag >= 3 WINDOW w AS (PARTITION BY series_id ORDER BY lag)) WHERE acf > p AND acf > n)"""))
def _(spark, d):
    return pf.period(fx.ts_day(spark, d), "c1", 2)


@query("prf3_fft_period", sql("ts_hour_labelled", """SELECT series_id, rank, freq, CAST(240 // freq AS INT) AS period, round(amp, 4) AS amplitude
    FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(amp, 9) DESC, freq) AS rank FROM (SELECT series_id, CAST(f AS INT) AS
    freq, avg(a) AS amp FROM (SELECT series_id, t // 240 AS b, f, sqrt(pow(sum(c2 * cos(2 * pi() * f * (t % 240) / 240)), 2) + pow(sum(c2 * sin(2 *
    pi() * f * (t % 240) / 240)), 2)) AS a FROM ts_hour_labelled CROSS JOIN (SELECT unnest(range(1, 121)) AS f) GROUP BY 1, 2, 3) GROUP BY 1, 2))
    WHERE rank <= 3"""))
def _(spark, d):
    return rounded(pf.dominant_periods(fx.ts_hour_labelled(spark, d), ["c2"], 240, 3), 4)


@query("prf4_window_stats", sql("ts_day", """SELECT series_id, t, value, round(mean, 5) AS mean, round(var, 4) AS var, round(skew, 5) + 0.0 AS skew,
    round(kurt, 5) + 0.0 AS kurt, max, min, round(acf1, 5) + 0.0 AS acf1 FROM (SELECT a.series_id, a.t, max(a.c1) AS value, avg(b.c1) AS mean,
    var_samp(b.c1) AS var, skewness(b.c1) AS skew, kurtosis(b.c1) AS kurt, max(b.c1) AS max, min(b.c1) AS min, count(*) AS n FROM ts_day a JOIN
    ts_day b ON a.series_id = b.series_id AND b.t BETWEEN a.t - 19 AND a.t GROUP BY 1, 2) JOIN (SELECT a.series_id, a.t, sum((b.c1 - m) * (c.c1 -
    m)) / (19 * max(v)) AS acf1 FROM (SELECT series_id, t, avg(c1) OVER w AS m, var_pop(c1) OVER w AS v FROM ts_day WINDOW w AS (PARTITION BY
    series_id ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) a JOIN ts_day b ON a.series_id = b.series_id AND b.t BETWEEN a.t - 19 AND a.t
    - 1 JOIN ts_day c ON c.series_id = b.series_id AND c.t = b.t + 1 GROUP BY 1, 2) USING (series_id, t) WHERE n = 20"""))
def _(spark, d):
    s = pf.window_stats(fx.ts_day(spark, d), "c1", 20)
    s = rounded(s, 5, ["mean", "skew", "kurt", "acf1"])
    return rounded(s, 4, ["var"])


@query("prf5_lag_autocorrelation", sql("emb emb_long", """SELECT t, round(sum((x - m) * (y - m)) / (62 * max(v)), 6) + 0.0 AS acf FROM (SELECT t, channel,
    x, lead(x, 2) OVER (PARTITION BY t ORDER BY channel) AS y, avg(x) OVER (PARTITION BY t) AS m, var_pop(x) OVER (PARTITION BY t) AS v FROM
    emb_long) WHERE y IS NOT NULL GROUP BY 1"""))
def _(spark, d):
    return fx.embeddings(spark, d).select("t", rd(pf.lag_autocorrelation(F.col("x"), 2)).alias("acf"))


def _pair_count(length: int) -> str:
    cond = " AND ".join(f"abs(a.w[i+{j}] - a.w[k+{j}]) <= a.r + 1e-12" for j in range(length))
    top = 20 - length + 2
    return f"""(SELECT a.series_id, a.t, count(*) AS n FROM a JOIN range(1, {top}) x(i) ON true JOIN range(1, {top}) y(k) ON i <> k AND {cond}
        GROUP BY 1, 2)"""


@query("prf6_sample_entropy", sql("ts_day", f"""SELECT a.series_id, a.t, round(-ln(p.n / CAST(q.n AS DOUBLE)), 6) + 0.0 AS sampen FROM a LEFT JOIN
    {_pair_count(3)} p ON p.series_id = a.series_id AND p.t = a.t LEFT JOIN {_pair_count(2)} q ON q.series_id = a.series_id AND q.t = a.t""",
    """a AS MATERIALIZED (SELECT b.series_id, b.t, list(c.c1 ORDER BY c.t) AS w, 0.2::DOUBLE * stddev_pop(c.c1) AS r FROM ts_day b JOIN ts_day c ON
    b.series_id = c.series_id AND c.t BETWEEN b.t AND b.t + 19 GROUP BY 1, 2 HAVING count(*) = 20)"""))
def _(spark, d):
    return rounded(pf.sample_entropy(fx.ts_day(spark, d), "c1", 20))


@query("prf7_ar")
def _(spark, d):
    return pf.ar_coefficients(fx.ts_day(spark, d), "c1", 60, 5, stride=5)


@query("prf8_hurst", sql("ts_day", """SELECT series_id, round(regr_slope(ln(rs), ln(m)), 6) AS hurst, round(exp(regr_intercept(ln(rs), ln(m))), 6) AS
    const FROM (SELECT series_id, m, avg(r / sd) AS rs FROM (SELECT series_id, m, b, greatest(max(cum), 0) - least(min(cum), 0) AS r,
    stddev_pop(c1) AS sd, count(*) AS n FROM (SELECT *, sum(dev) OVER (PARTITION BY series_id, m, b ORDER BY t) AS cum FROM (SELECT *, c1 - avg(c1)
    OVER (PARTITION BY series_id, m, t // m) AS dev, t // m AS b FROM ts_day CROSS JOIN (SELECT unnest([8, 16, 32, 64, 128]) AS m))) GROUP BY
    1, 2, 3) WHERE n = m AND sd > 0 GROUP BY 1, 2) GROUP BY 1"""))
def _(spark, d):
    return rounded(pf.hurst(fx.ts_day(spark, d), "c1"))


@query("prf9_decompose", sql("ts_day", """SELECT series_id, t, c1, round(trend, 5) AS trend, round(s - avg(s) OVER (PARTITION BY series_id, mark), 4)
    + 0.0 AS seasonal, round(c1 - trend - (s - sm), 4) + 0.0 AS resid FROM (SELECT d.*, 1 AS mark, ph.s, ph.sm FROM dt d JOIN (SELECT *, avg(s)
    OVER (PARTITION BY series_id) AS sm FROM (SELECT series_id, t % 7 AS p, avg(c1 - trend) AS s FROM dt GROUP BY 1, 2)) ph ON ph.series_id =
    d.series_id AND ph.p = d.t % 7)""", """dt AS (SELECT series_id, t, c1, CASE WHEN count(*) OVER w = 7 THEN avg(c1) OVER w END AS trend FROM ts_day
    WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))""").replace(
    "round(s - avg(s) OVER (PARTITION BY series_id, mark), 4)", "round(s - sm, 4)"))
def _(spark, d):
    s = pf.decompose(fx.ts_day(spark, d), "c1", 7)
    return rounded(rounded(s, 5, ["trend"]), 4, ["seasonal", "resid"])


@query("prf10_stepped_features", sql("ts_day", """SELECT d.series_id, d.t, d.c1, round(mean, 5) AS mean, round(var, 4) AS var, round(skew, 5) + 0.0 AS skew, round(kurt, 5) + 0.0 AS kurt, max, min,
    round(acf1, 5) + 0.0 AS acf1 FROM ts_day d JOIN (SELECT a.series_id, a.t, avg(b.c1) AS mean, var_samp(b.c1) AS var, skewness(b.c1) AS skew, kurtosis(b.c1) AS kurt, max(b.c1) AS max, min(b.c1) AS
    min, count(*) AS n FROM ts_day a JOIN ts_day b ON a.series_id = b.series_id AND b.t BETWEEN a.t - 29 AND a.t WHERE a.t % 10 = 0 GROUP BY 1, 2) f ON f.series_id = d.series_id AND f.t = d.t - d.t % 10
    JOIN (SELECT a.series_id, a.t, sum((b.c1 - m) * (c.c1 - m)) / (29 * max(v)) AS acf1 FROM (SELECT series_id, t, avg(c1) OVER w AS m, var_pop(c1) OVER w AS v FROM ts_day WINDOW w AS (PARTITION BY
    series_id ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) a JOIN ts_day b ON a.series_id = b.series_id AND b.t BETWEEN a.t - 29 AND a.t - 1 JOIN ts_day c ON c.series_id = b.series_id AND
    c.t = b.t + 1 WHERE a.t % 10 = 0 GROUP BY 1, 2) g ON g.series_id = f.series_id AND g.t = f.t WHERE n = 30"""))
def _(spark, d):
    s = pf.stepped_features(fx.ts_day(spark, d), "c1", 30, 10)
    return rounded(rounded(s, 5, ["mean", "skew", "kurt", "acf1"]), 4, ["var"])


HIST = """ln AS (SELECT series_id, 'c1' AS channel, c1 AS x FROM ts_day UNION ALL SELECT series_id, 'c2', c2 FROM ts_day), lm AS (SELECT *, min(x) OVER p
    AS lo, max(x) OVER p AS hi, count(*) OVER p AS n FROM ln WINDOW p AS (PARTITION BY series_id, channel)), hs AS (SELECT series_id, channel,
    least(CAST(floor((x - lo) / (hi - lo) * 12) AS INT), 11) AS bin, count(*) AS n, max(n) AS total FROM lm GROUP BY 1, 2, 3)"""


def _long(spark, d):
    return melt(fx.ts_day(spark, d), ["series_id", "t"], ["c1", "c2"])


@query("prf11_entropy", sql("ts_day", """SELECT series_id, channel, round(-sum(n / CAST(total AS DOUBLE) * log2(n / CAST(total AS DOUBLE))), 6) AS entropy
    FROM hs GROUP BY 1, 2""", HIST))
def _(spark, d):
    return rounded(pf.histogram_entropy(pf.histogram(_long(spark, d), 12), ["series_id", "channel"]))


@query("prf12_feature_weight", sql("ts_day", """SELECT series_id, channel, round(1 + sum(n / CAST(total AS DOUBLE) * log2(n / CAST(total AS DOUBLE))) /
    log2(12), 6) AS weight FROM hs GROUP BY 1, 2""", HIST))
def _(spark, d):
    return rounded(pf.feature_weight(_long(spark, d), 12))


@query("prf13_bins", sql("ts_day", """SELECT series_id, channel, CAST(arg_max(b, f - b * (b - 1 + pow(ln(b), 2.5::DOUBLE))) AS INT) AS bins FROM (SELECT
    series_id, channel, b, sum(c * ln(b * c / CAST(n AS DOUBLE) + 1)) AS f FROM (SELECT series_id, channel, b, least(floor((x - lo) / (hi - lo) * b), b
    - 1) AS bin, count(*) AS c, max(n) AS n FROM lm JOIN range(1, 60) r(b) ON b < floor(sqrt(n)) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1,
    2""", HIST))
def _(spark, d):
    return pf.optimal_bins(_long(spark, d))
