"""Queries: recommenders and their quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import meta as mf
from ..operators.select import quality as sq
from ..operators.select import recommend as rc
from ..operators.select import tables as tb
from ..session import cut
from . import fixtures as fx
from .base import query, rd, rounded
from .fixtures import sql

RK = """rk AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY pred DESC, model) AS pr, rank() OVER (PARTITION BY dataset ORDER BY perf DESC) - 1 AS better,
    row_number() OVER (PARTITION BY dataset ORDER BY perf DESC, model) AS tr, count(*) OVER (PARTITION BY dataset) AS m FROM perf)"""


@query("sq1_etopnk", sql("perf", """SELECT dataset, CAST(max(perf) FILTER (pr <= 3) >= min(perf) FILTER (tr <= 5) AS INT) AS hit FROM rk GROUP BY 1""", RK))
def _(spark, d):
    return sq.e_top_nk(fx.perf(spark, d), 5, 3)


@query("sq2_etopn", sql("perf", """SELECT dataset, CAST(max(perf) FILTER (pr = 1) >= min(perf) FILTER (tr <= 5) AS INT) AS hit FROM rk GROUP BY 1""", RK))
def _(spark, d):
    return sq.e_top_n(fx.perf(spark, d), 5)


@query("sq3_erank", sql("perf", "SELECT dataset, round(min(better) FILTER (pr = 1) / CAST(max(m) AS DOUBLE), 6) AS erank FROM rk GROUP BY 1", RK))
def _(spark, d):
    return rounded(sq.e_rank_k(fx.perf(spark, d), 1))


@query("sq4_erankk", sql("perf", "SELECT dataset, round(min(better) FILTER (pr <= 4) / CAST(max(m) AS DOUBLE), 6) AS erank FROM rk GROUP BY 1", RK))
def _(spark, d):
    return rounded(sq.e_rank_k(fx.perf(spark, d), 4))


@query("sq5_ndcg", sql("perf", """SELECT dataset, round(sum((pow(2, greatest(10 - tr + 1, 0)) - 1) / log2(pr + 1)) FILTER (pr <= 10) / sum((pow(2, 10 - tr + 1) - 1) / log2(tr +
    1)) FILTER (tr <= 10), 6) AS ndcg FROM rk GROUP BY 1""", RK))
def _(spark, d):
    return rounded(sq.ndcg_graded(fx.perf(spark, d), 10))


def _lists(spark, d, n=3):
    p = fx.perf(spark, d)
    return sq.ranked_lists(p, "pred", n).withColumnRenamed("models", "prediction").join(
        sq.ranked_lists(p, "perf", n).withColumnRenamed("models", "truth"), "dataset")


@query("sq6_ndcg_binary", sql("perf", """SELECT dataset, round(coalesce(sum(1 / log2(pr + 1)) FILTER (tr <= 3 AND pr <= 3), 0) / (1 + 1 / log2(3) + 0.5::DOUBLE), 6) AS ndcg FROM rk
    GROUP BY 1""", RK))
def _(spark, d):
    return rounded(_lists(spark, d).select("dataset", sq.ndcg_binary().alias("ndcg")))


@query("sq7_ndcg_linear", sql("perf", """SELECT dataset, round(sum(dcg) / max(ideal), 6) AS ndcg FROM (SELECT dataset, avg(perf) * sum(1 / log2(pr + 1)) AS dcg FROM rk GROUP BY dataset,
    pred) JOIN (SELECT dataset, sum(perf / log2(tr + 1)) AS ideal FROM rk GROUP BY 1) USING (dataset) GROUP BY 1""", RK))
def _(spark, d):
    return rounded(sq.ndcg_linear(fx.perf(spark, d)))


@query("sq8_hit3", sql("perf", "SELECT dataset, CAST(max(tr) FILTER (pr = 1) <= 3 AS INT) AS hit FROM rk GROUP BY 1", RK))
def _(spark, d):
    return _lists(spark, d).select("dataset", sq.hit_first().alias("hit"))


@query("sq9_best3", sql("perf", "SELECT dataset, CAST(max(pr) FILTER (tr = 1) <= 3 AS INT) AS hit FROM rk GROUP BY 1", RK))
def _(spark, d):
    return _lists(spark, d).select("dataset", sq.best_found().alias("hit"))


@query("sq10_spearman", sql("perf", """SELECT dataset, round(corr(tr, p), 6) AS rho FROM (SELECT dataset, tr, rank() OVER (PARTITION BY dataset ORDER BY q) + (count(*) OVER
    (PARTITION BY dataset, q) - 1) / 2.0::DOUBLE AS p FROM (SELECT dataset, tr, CASE WHEN pr <= 8 THEN pr ELSE 9 END AS q FROM rk WHERE tr <= 8)) GROUP BY 1""", RK))
def _(spark, d):
    return rounded(sq.list_spearman(_lists(spark, d, 8)))


@query("sq11_percentile", sql("perf", """SELECT p.dataset, round(round(avg(CASE WHEN p.perf <= r.perf THEN 1.0::DOUBLE ELSE 0.0 END), 2) * 100, 6) AS percentile, round(max(r.perf), 6)
    AS performance, round(max(p.perf), 6) AS performance_max FROM perf p JOIN rk r ON r.dataset = p.dataset AND r.pr = 1 GROUP BY 1""", RK))
def _(spark, d):
    p = fx.perf(spark, d)
    rec = rc.best_model(p.withColumnRenamed("pred", "score")).select("dataset", "model")
    return rounded(sq.percentile_of(p, rec))


@query("sq12_regret", sql("perf", """SELECT p.dataset, round(max(p.perf), 6) AS performance_max, round(max(r.perf), 6) AS performance, round(max(p.perf) - max(r.perf), 6) AS regret FROM
    perf p JOIN rk r ON r.dataset = p.dataset AND r.pr = 1 GROUP BY 1""", RK))
def _(spark, d):
    p = fx.perf(spark, d)
    rec = rc.best_model(p.withColumnRenamed("pred", "score")).select("dataset", "model")
    return rounded(sq.regret(p, rec))


@query("sel1_global_best", sql("perf", """SELECT d.dataset, g.model, round(g.score, 6) AS score FROM (SELECT DISTINCT dataset FROM perf) d CROSS JOIN (SELECT model, median(perf) AS score FROM
    perf GROUP BY 1) g"""))
def _(spark, d):
    p = fx.perf(spark, d)
    return rounded(rc.global_best(p, p.select("dataset").distinct()).select("dataset", "model", "score"))


@query("agg25_global_best", sql("perf", "SELECT model, round(median(perf), 6) AS score FROM perf GROUP BY 1 ORDER BY median(perf) DESC, model LIMIT 1"))
def _(spark, d):
    p = fx.perf(spark, d)
    g = rc.global_best(p, p.select("dataset").distinct())
    best = F.min_by("model", F.struct(-F.col("score"), "model"))
    return g.agg(best.alias("model"), rd(F.max("score")).alias("score"))


def _meta(spark, d):
    """Meta-features per nation: statistics of its suppliers' line items."""
    li, s = fx.table(spark, d, "lineitem"), fx.table(spark, d, "supplier")
    n = fx.table(spark, d, "nation")
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    m = j.groupBy(F.col("n_name").alias("dataset")).agg(
        F.round(F.avg("l_quantity"), 9).alias("f1"), F.round(F.avg("l_extendedprice"), 6).alias("f2"),
        F.round(F.stddev_pop("l_quantity"), 9).alias("f3"), F.count(F.lit(1)).cast("double").alias("f4"),
        F.round(F.avg("s_acctbal"), 6).alias("f5"), F.lit(1.0).alias("constant"))
    return cut(rc.vectors(m, ["f1", "f2", "f3", "f4", "f5", "constant"]))


@query("sel2_nearest", sql("perf", """SELECT dataset, model, round(p.perf, 6) AS score FROM (SELECT a.dataset, arg_min(b.dataset, dd) AS n FROM (SELECT x.dataset AS a, y.dataset AS b,
    sqrt(sum((x.z - y.z) * (x.z - y.z))) AS dd FROM fl x JOIN fl y ON x.f = y.f AND x.dataset <> y.dataset GROUP BY 1, 2) q JOIN (SELECT DISTINCT dataset FROM fl) a ON a.dataset = q.a
    JOIN (SELECT DISTINCT dataset FROM fl) b ON b.dataset = q.b GROUP BY 1) w JOIN (SELECT dataset AS n, model, perf FROM perf) p USING (n)""", """ft AS (SELECT n_name AS dataset,
    round(avg(l_quantity), 9) AS f1, round(avg(l_extendedprice), 6) AS f2, round(stddev_pop(l_quantity), 9) AS f3, CAST(count(*) AS DOUBLE) AS f4, round(avg(s_acctbal), 6) AS f5 FROM
    lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), fl AS MATERIALIZED (""" + " UNION ALL ".join(
    f"SELECT dataset, {i} AS f, (f{i} - avg(f{i}) OVER ()) / stddev_samp(f{i}) OVER () AS z FROM ft" for i in range(1, 6)) + ")"))
def _(spark, d):
    m = _meta(spark, d)
    return rounded(rc.nearest_neighbour(fx.perf(spark, d), m, m).select("dataset", "model", "score"))


def _rec(key: str, name: str, **kw):
    @query(key)
    def _(spark, d):
        m = _meta(spark, d)
        p = cut(fx.perf(spark, d).select("dataset", "model", "perf"))
        return rc.recommend(name, p, m, m, **kw).select("dataset", "model", "score")


_rec("sel3_rf", "regression")
_rec("sel4_ureg", "factor_regression")
_rec("sel5_clustered_factors", "clustered_factors")
_rec("sel6_cluster_routed", "cluster_routed")
_rec("sel7_rank_factorisation", "rank_factorisation")
_rec("sel9_fm", "factorisation_machine")


@query("sel9_fm_score", sql("perf", """SELECT dataset, round(0.5::DOUBLE + sum(w * x) + (pow(sum(v1 * x), 2) - sum(v1 * v1 * x * x) + pow(sum(v2 * x), 2) - sum(v2 * v2 * x * x)) / 2, 6) AS
    score FROM (SELECT dataset, perf AS x, i / 10.0::DOUBLE AS w, 0.3::DOUBLE AS v1, i / 5.0::DOUBLE AS v2 FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY model) - 1 AS i FROM
    perf)) GROUP BY 1"""))
def _(spark, d):
    v = fx.perf(spark, d).groupBy("dataset").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("model", "perf"))), lambda r: r["perf"]).alias("x"))
    v = v.withColumn("b", F.lit(0.5)).withColumn("w", F.transform("x", lambda _x, i: i / F.lit(10.0)))
    v = v.withColumn("v", F.array(F.transform("x", lambda _x: F.lit(0.3)), F.transform("x", lambda _x, i: i / F.lit(5.0))))
    return rounded(v.select("dataset", rc.fm_score("x", "b", "w", "v").alias("score")))


BRANDS = [f"Brand#{i}" for i in range(1, 26)]  # the models of the perf table
NATIONS = [f"NATION_{i}" for i in range(25)]  # and its datasets


@query("sel10_wide_predictions", sql("perf", "SELECT dataset, " + ", ".join(f"round(max(pred) FILTER (model = '{b}'), 6) AS b{i}" for i, b in enumerate(BRANDS)) + " FROM perf GROUP BY 1"))
def _(spark, d):
    w = rc.spread(fx.perf(spark, d).withColumnRenamed("pred", "score"), BRANDS)
    return rounded(w.select("dataset", *[F.col(f"`{b}`").alias(f"b{i}") for i, b in enumerate(BRANDS)]))


@query("sel12_folds", sql("perf", """SELECT r AS repeat, CAST(count(DISTINCT dataset) AS BIGINT) AS test_sets, CAST(count(DISTINCT dataset) * 9 AS BIGINT) AS train_sets FROM perf CROSS JOIN
    (SELECT CAST(range AS INT) AS r FROM range(3)) GROUP BY 1"""))
def _(spark, d):
    f = rc.k_fold(fx.perf(spark, d), 10, 3, strata=F.substring("dataset", 1, 1))
    return f.groupBy("repeat").agg(F.count_if(F.col("split") == "test").alias("test_sets"),
                                   F.count_if(F.col("split") == "train").alias("train_sets"))


@query("sel12_monte_carlo", sql("perf", """SELECT r AS repeat, CAST(floor(count(DISTINCT dataset) * 0.75::DOUBLE) AS BIGINT) AS train_sets FROM perf CROSS JOIN (SELECT CAST(range AS INT) AS r
    FROM range(25)) GROUP BY 1"""))
def _(spark, d):
    f = rc.monte_carlo(fx.perf(spark, d))
    return f.groupBy("repeat").agg(F.count_if(F.col("split") == "train").alias("train_sets"))


@query("sel12_leave_one_out", sql("", """SELECT fold, dataset, CASE WHEN fold = substr(dataset, 1, 1) THEN 'test' ELSE 'train' END AS split FROM (SELECT DISTINCT n_name AS dataset FROM nation)
    CROSS JOIN (SELECT DISTINCT substr(n_name, 1, 1) AS fold FROM nation)"""))
def _(spark, d):
    n = fx.table(spark, d, "nation").select(F.col("n_name").alias("dataset"))
    return rc.leave_one_out(n, F.substring("dataset", 1, 1))


@query("sel13_analyse_split")
def _(spark, d):
    p = cut(fx.perf(spark, d).select("dataset", "model", "perf"))
    return rc.analyse_split("nearest_neighbour", p, _meta(spark, d), cut(rc.random_split(p)))


@query("sel14_split", sql("", """SELECT CASE WHEN i < floor(n * 0.85::DOUBLE) THEN 'train' ELSE 'test' END AS split, count(*) AS datasets FROM (SELECT row_number() OVER () - 1 AS i, count(*)
    OVER () AS n FROM (SELECT DISTINCT c_name FROM customer)) GROUP BY 1"""))
def _(spark, d):
    c = fx.table(spark, d, "customer").select(F.col("c_name").alias("dataset"))
    return rc.random_split(c, 0.85).groupBy("split").agg(F.count(F.lit(1)).alias("datasets"))


@query("sel15_dbscan", sql("", """SELECT vec_id, CAST(coalesce(min(cl), 0) AS INT) AS cluster FROM (SELECT vec_id FROM p) LEFT JOIN (SELECT a.a AS vec_id, r.cl FROM nb a JOIN
    (SELECT a, dense_rank() OVER (ORDER BY min(b)) AS cl FROM reach GROUP BY 1) r ON r.a = a.b) USING (vec_id) GROUP BY 1""", """p AS (SELECT vec_id, CAST(embedding[1] AS
    DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), nb AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <=
    0.04::DOUBLE * 0.04::DOUBLE), co AS MATERIALIZED (SELECT a FROM nb GROUP BY 1 HAVING count(*) >= 8), li AS MATERIALIZED (SELECT nb.a, nb.b FROM nb JOIN co c1 ON c1.a = nb.a JOIN co c2 ON
    c2.a = nb.b), reach AS (SELECT a, b FROM li UNION SELECT reach.a, li.b FROM reach JOIN li ON li.a = reach.b)""").replace("WITH p AS", "WITH RECURSIVE p AS"))
def _(spark, d):
    e = fx.table(spark, d, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("x"))
    return rc.dbscan(e, 0.04, 8, id="vec_id")


@query("src7_performance_melt", sql("perf", "SELECT dataset, model, round(perf, 6) AS perf FROM perf"))
def _(spark, d):
    p = fx.perf(spark, d)
    wide = tb.performance_wide(p, rc.models_of(p))
    return rounded(tb.melt_performance(wide, "dataset"))


@query("snk4_transposed", sql("perf", "SELECT feature, " + ", ".join(f"round(max(v) FILTER (dataset = '{n}'), 6) AS {n}" for n in NATIONS)
    + """ FROM (SELECT dataset, 'top' AS feature, max(perf) AS v FROM perf GROUP BY 1 UNION ALL SELECT dataset, 'low', min(perf) FROM perf GROUP BY 1) GROUP BY 1"""))
def _(spark, d):
    from ..sources.sinks import transposed
    m = fx.perf(spark, d).groupBy("dataset").agg(F.max("perf").alias("top"), F.min("perf").alias("low"))
    return rounded(transposed(m, "dataset", NATIONS))



@query("sel_series_meta")
def _(spark, d):
    """Meta-features of every daily series, without the randomised landmarkers."""
    return mf.meta_features(fx.ts_day(spark, d), ["c1", "c2", "c3", "c4"], landmarkers=False)


@query("udf5_custom_recommender", sql("perf", "SELECT dataset, model, round(avg(perf) OVER (PARTITION BY model), 6) AS score FROM perf"))
def _(spark, d):
    p = cut(fx.perf(spark, d).select("dataset", "model", "perf"))
    rc.register_recommender("model_mean", lambda perf, meta, test: test.select("dataset").join(perf, "dataset").select("dataset", "model").join(
        perf.groupBy("model").agg(F.avg("perf").alias("score")), "model"))
    return rounded(rc.recommend("model_mean", p, None, p.select("dataset").distinct()).select("dataset", "model", "score"))


@query("snk5_write_predictions", sql("perf", "SELECT dataset, model, round(pred, 6) AS perf FROM perf"))
def _(spark, d):
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources import series, sinks
    path = f"{ensure_checkpoint_dir(spark)}/wide-{uuid.uuid4().hex}"
    sinks.write_predictions(fx.perf(spark, d).select("dataset", "model", F.col("pred").alias("score")), path, BRANDS)
    return rounded(series.read_performance(spark, path, BRANDS, "dataset").select("dataset", "model", "perf"))
