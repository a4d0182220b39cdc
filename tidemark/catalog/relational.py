"""Queries: formulas, rank functions, top-k, sets and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions import vectors as vec
from ..operators import analytic as an
from ..operators import joins as jn
from . import fixtures as fx
from .base import query, rd, rounded
from .fixtures import sql


def emb_long(spark, d):
    e = fx.embeddings(spark, d)
    return e.select("series_id", "t", F.posexplode("x").alias("channel", "x")).withColumn(
        "channel", F.col("channel") + 1)


@query("wf1_ecdf", sql("emb emb_long", """SELECT t, channel, round(cume_dist() OVER (PARTITION BY channel ORDER BY x), 6)
    AS p FROM emb_long"""))
def _(spark, d):
    e = emb_long(spark, d)
    p = an.ecdf(e, ["series_id", "channel"])
    return rounded(e.join(p, ["series_id", "channel", "x"]).select("t", "channel", "p"))


@query("wf2_right_ecdf", sql("emb emb_long", """SELECT t, channel, round(cume_dist() OVER (PARTITION BY channel ORDER BY
    x DESC), 6) AS p FROM emb_long"""))
def _(spark, d):
    e = emb_long(spark, d)
    p = an.ecdf(e, ["series_id", "channel"], right=True)
    return rounded(e.join(p, ["series_id", "channel", "x"]).select("t", "channel", "p"))


@query("wf3_train_rank", sql("ts_user", """SELECT a.series_id, a.t, (SELECT count(*) FROM ts_user b WHERE
    b.series_id = a.series_id AND b.t < 20 AND b.score < a.score) AS rank FROM ts_user a WHERE a.t >= 20"""))
def _(spark, d):
    u = fx.ts_user(spark, d).select("series_id", "t", "score")
    return an.train_rank(u.filter("t < 20"), u.filter("t >= 20")).select("series_id", "t", "rank")


RUNS = """SELECT series_id, min(t) AS s, max(t) AS e, count(*) AS len FROM (SELECT *, t - row_number() OVER
    (PARTITION BY series_id ORDER BY t) AS g FROM {0} WHERE label = 1) GROUP BY series_id, g"""


@query("wf4_runs", sql("ts_hour_labelled", RUNS.format("ts_hour_labelled")))
def _(spark, d):
    return an.runs(fx.ts_hour_labelled(spark, d))


@query("wf5_run_ids", sql("ts_user", """SELECT series_id, t, CASE WHEN label = 1 THEN min(t) OVER (PARTITION BY series_id,
    label, g) END AS run_id FROM (SELECT *, t - row_number() OVER (PARTITION BY series_id, label ORDER BY t) AS g
    FROM ts_user)"""))
def _(spark, d):
    return an.run_ids(fx.ts_user(spark, d)).select("series_id", "t", "run_id")


@query("wf6_moving", sql("ts_day", """SELECT series_id, t, round(avg(c1) OVER w, 5) AS mean, min(c1) OVER w AS min,
    max(c1) OVER w AS max FROM ts_day WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 6 PRECEDING AND
    CURRENT ROW)"""))
def _(spark, d):
    m = an.moving(fx.ts_day(spark, d), ["series_id"], "c1", 7, ["mean", "min", "max"])
    return rounded(m.select("series_id", "t", "mean", "min", "max"), 5)


@query("wf7_shifted", sql("ts_day", """SELECT series_id, t, lag(c1, 1) OVER w AS lag1, lag(c1, 7) OVER w AS lag7,
    lead(c1, 2) OVER w AS lead2 FROM ts_day WINDOW w AS (PARTITION BY series_id ORDER BY t)"""))
def _(spark, d):
    from ..plans.ordered import shifted
    s = shifted(fx.ts_day(spark, d), ["series_id"], "t", {"lag1": ("c1", 1), "lag7": ("c1", 7), "lead2": ("c1", -2)})
    return s.select("series_id", "t", "lag1", "lag7", "lead2")


@query("wf8_model_rank", sql("perf", """SELECT dataset, model, row_number() OVER (PARTITION BY dataset ORDER BY perf DESC,
    model) AS rank FROM perf"""))
def _(spark, d):
    return an.model_rank(fx.perf(spark, d)).select("dataset", "model", "rank")


@query("wf9_roc_table", sql("scored", """SELECT series_id, score, sum(label) OVER w AS tp, sum(1 - label) OVER w AS fp
    FROM (SELECT series_id, score, label FROM scored) WINDOW w AS (PARTITION BY series_id ORDER BY score DESC)
    QUALIFY row_number() OVER (PARTITION BY series_id, score) = 1"""))
def _(spark, d):
    return an.roc_table(fx.scored(spark, d)).select("series_id", "score", "tp", "fp")


@query("wf10_peaks", sql("ts_hour_labelled", """SELECT series_id, t, round(score, 6) AS score FROM (SELECT *, lag(score)
    OVER w AS p, lead(score) OVER w AS n FROM ts_hour_labelled WINDOW w AS (PARTITION BY series_id ORDER BY t))
    WHERE score > p AND score > n"""))
def _(spark, d):
    m = an.local_maxima(fx.ts_hour_labelled(spark, d), ["series_id"], "score")
    return rounded(m.select("series_id", "t", "score"))


@query("tk1_topn", sql("perf", """SELECT dataset, model, rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset
    ORDER BY pred DESC, model) AS rank FROM perf) WHERE rank <= 3"""))
def _(spark, d):
    return an.top_n(fx.perf(spark, d), ["dataset"], "pred", 3, ["model"]).select("dataset", "model", "rank")


@query("tk2_nth_largest", sql("perf", """SELECT dataset, model FROM (SELECT *, row_number() OVER (PARTITION BY dataset
    ORDER BY perf DESC, model) AS rank FROM perf) WHERE rank = 4"""))
def _(spark, d):
    return an.nth_largest(fx.perf(spark, d), ["dataset"], "perf", 4, ["model"]).select("dataset", "model")


@query("tk3_argmaxn", sql("scored", """SELECT series_id, t, score FROM (SELECT *, rank() OVER (PARTITION BY series_id
    ORDER BY score DESC) AS r FROM scored) WHERE r <= 7"""))
def _(spark, d):
    s = fx.scored(spark, d).select("series_id", "t", "score")
    return an.n_extreme_points(s, ["series_id"], "score", 7).select("series_id", "t", "score")


@query("tk4_wide_topk", sql("perf", """SELECT dataset, max(model) FILTER (r = 1) AS rec_1, max(model) FILTER (r = 2) AS
    rec_2, max(model) FILTER (r = 3) AS rec_3, max(pred) FILTER (r = 1) AS score_1, max(pred) FILTER (r = 2) AS score_2,
    max(pred) FILTER (r = 3) AS score_3 FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY pred DESC, model)
    AS r FROM perf) GROUP BY 1"""))
def _(spark, d):
    return an.wide_top_k(fx.perf(spark, d), ["dataset"], "model", "pred", 3)


@query("tk5_argmax", sql("perf", """SELECT dataset, model, perf FROM perf QUALIFY row_number() OVER (PARTITION BY dataset
    ORDER BY perf DESC, model) = 1"""))
def _(spark, d):
    return an.best_per_key(fx.perf(spark, d), ["dataset"], "model", "perf")


@query("tk6_sorted_groups", sql("perf", """SELECT model, round(avg(perf), 6) AS mean FROM perf GROUP BY 1 ORDER BY 2 DESC,
    1"""))
def _(spark, d):
    m = fx.perf(spark, d).groupBy("model").agg(rd(F.avg("perf")).alias("mean"))
    return m.orderBy(F.desc("mean"), "model")


@query("tk7_sampled_thresholds", sql("ts_user", """SELECT series_id, round(score, 6) AS threshold FROM (SELECT *,
    row_number() OVER (PARTITION BY series_id ORDER BY score) - 2 AS i, count(*) OVER (PARTITION BY series_id) - 1 AS m
    FROM (SELECT DISTINCT series_id, score FROM ts_user)) WHERE i >= 0 AND (i % CASE WHEN m > 50 THEN m // 49 ELSE 1 END
    = 0 OR i = m - 1)"""))
def _(spark, d):
    return rounded(an.sampled_thresholds(fx.ts_user(spark, d), ["series_id"]))


@query("tk8_order_stats", sql("ts_hour_labelled", """SELECT series_id, CAST(k AS INT) AS k, round(score, 6) AS threshold
    FROM (SELECT series_id, score, row_number() OVER (PARTITION BY series_id ORDER BY score DESC) - 1 AS i FROM
    ts_hour_labelled) JOIN (SELECT range AS k FROM range(250)) ON i = CAST(floor(k * (719 / CAST(249 AS DOUBLE))) AS
    BIGINT)"""))
def _(spark, d):
    return rounded(an.spaced_order_stats(fx.ts_hour_labelled(spark, d), ["series_id"]))


@query("tk9_lexicographic", sql("scored", """SELECT series_id, score, row_number() OVER (PARTITION BY series_id ORDER BY r
    DESC, p, score) AS pos FROM (SELECT series_id, score, round(tp / CAST(max(tp) OVER (PARTITION BY series_id) AS DOUBLE),
    9) AS r, round(tp / CAST(tp + fp AS DOUBLE), 9) AS p FROM (SELECT series_id, score, sum(label) OVER w AS tp,
    sum(1 - label) OVER w AS fp FROM scored WINDOW w AS (PARTITION BY series_id ORDER BY score DESC) QUALIFY row_number()
    OVER (PARTITION BY series_id, score) = 1))"""))
def _(spark, d):
    from pyspark.sql import Window
    c = an.roc_table(fx.scored(spark, d))
    r = F.round(F.col("tp") / F.col("pos"), 9)
    p = F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 9)
    s = c.select("series_id", "score", F.struct((-r).alias("r"), p.alias("p"), "score").alias("o"))
    w = Window.partitionBy("series_id").orderBy("o")
    return s.select("series_id", "score", F.row_number().over(w).alias("pos"))


SETS = """a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem)"""


def _sets(spark, d):
    return fx.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), fx.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"))


@query("set1_intersect", sql("", "SELECT k FROM a INTERSECT SELECT k FROM b", SETS))
def _(spark, d):
    return an.intersect(*_sets(spark, d))


@query("set2_diff", sql("", "SELECT k FROM a EXCEPT SELECT k FROM b", SETS))
def _(spark, d):
    return an.difference(*_sets(spark, d))


@query("set3_symdiff", sql("", """(SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL (SELECT k FROM b EXCEPT SELECT k
    FROM a)""", SETS))
def _(spark, d):
    return an.symmetric_difference(*_sets(spark, d))


@query("set4_bind_rows", sql("ts_day ts_hour", """SELECT series_id, c1, c2 FROM ts_day UNION ALL SELECT series_id, CAST(c1 AS DOUBLE), NULL
    FROM ts_hour"""))
def _(spark, d):
    h = fx.ts_hour(spark, d)
    return an.bind_rows(fx.ts_day(spark, d).select("series_id", "c1", "c2"), h.select("series_id", F.col("c1").cast("double").alias("c1")))


@query("set5_train_then_test", sql("ts_day", """SELECT series_id, t, c1, CASE WHEN t < 1500 THEN 'train' ELSE 'test' END
    AS type FROM ts_day"""))
def _(spark, d):
    t = fx.ts_day(spark, d).select("series_id", "t", "c1")
    return an.train_then_test(t.filter("t < 1500"), t.filter("t >= 1500"))


@query("fn1_rowdist", sql("emb emb_long", """SELECT a.t, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 6) AS dist FROM
    emb_long a JOIN emb_long b ON b.t = a.t + 1 AND a.channel = b.channel GROUP BY 1"""))
def _(spark, d):
    e = fx.embeddings(spark, d)
    nxt = e.select((F.col("t") - 1).alias("t"), F.col("x").alias("y"))
    return rounded(e.join(nxt, "t").select("t", vec.distance(F.col("x"), F.col("y")).alias("dist")))


@query("fn2_dist_to_set", sql("emb emb_long", """SELECT t, cls, round(sqrt(sum((x - m) * (x - m))), 6) AS dist FROM
    emb_long JOIN (SELECT e.cls, l.channel, avg(l.x) AS m FROM emb e JOIN emb_long l USING (t) GROUP BY 1, 2) USING (channel)
    GROUP BY 1, 2"""))
def _(spark, d):
    e = fx.embeddings(spark, d)
    centres = (
        e.select("cls", F.posexplode("x").alias("i", "v")).groupBy("cls", "i").agg(F.avg("v").alias("m"))
        .groupBy("cls").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
        .agg(F.collect_list(F.struct("cls", "c")).alias("set"))
    )
    r = e.select("t", "x", F.lit(1).alias("one"))
    from ..plans.attach import attach
    r = attach(r, centres.withColumn("one", F.lit(1)), ["one"])
    return rounded(r.select("t", "x", F.explode("set").alias("s")).select(
        "t", F.col("s.cls").alias("cls"), vec.distance(F.col("x"), F.col("s.c")).alias("dist")))


@query("fn3_cfactor", sql("", """SELECT l_orderkey, round(2.0 * (ln(greatest(n, 2.0) - 1) + 0.5772156649) - 2.0 *
    (greatest(n, 2.0) - 1) / greatest(n, 2.0), 6) AS c FROM (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n FROM lineitem
    GROUP BY 1)"""))
def _(spark, d):
    n = fx.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return rounded(n.select("l_orderkey", fn.c_factor(F.col("n")).alias("c")))


@query("fn4_invert", sql("ts_user", """SELECT series_id, t, -c1 AS neg, round(max(c1) OVER (PARTITION BY series_id) - c1, 6)
    + 0.0 AS sub FROM ts_user"""))
def _(spark, d):
    from ..plans.attach import attach
    u = fx.ts_user(spark, d).select("series_id", "t", "c1")
    top = u.groupBy("series_id").agg(F.max("c1").alias("top"))
    return attach(u, top, ["series_id"]).select(
        "series_id", "t", fn.invert(F.col("c1")).alias("neg"),
        rd(fn.invert(F.col("c1"), "subtraction", F.col("top"))).alias("sub"))


@query("fn5_soft_threshold", sql("emb emb_long", """SELECT t, channel, round(sign(x) * greatest(abs(x) - 0.05::DOUBLE, 0.0), 6)
    + 0.0 AS y FROM emb_long"""))
def _(spark, d):
    return emb_long(spark, d).select("t", "channel", rd(fn.soft_threshold(F.col("x"), F.lit(0.05))).alias("y"))


@query("fn6_sigmoid", sql("emb emb_long", """SELECT t, channel, round(1 / (1 + exp(-x)), 6) AS s, round(1 / (1 + exp(-x)) *
    (1 - 1 / (1 + exp(-x))), 6) AS ds FROM emb_long"""))
def _(spark, d):
    return emb_long(spark, d).select("t", "channel", rd(fn.sigmoid(F.col("x"))).alias("s"),
                                     rd(fn.sigmoid_slope(F.col("x"))).alias("ds"))


@query("fn7_nonzero_mse", sql("", """SELECT l_returnflag, round(avg((l_discount - l_tax) * (l_discount - l_tax)) FILTER
    (l_discount <> 0), 8) AS mse FROM lineitem GROUP BY 1"""))
def _(spark, d):
    li = fx.table(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(rd(fn.nonzero_mse(F.col("l_discount"), F.col("l_tax")), 8).alias("mse"))


@query("fn8_similarity", sql("emb emb_long", """SELECT t, round(pow(2.0, -0.7::DOUBLE * sum(x * x) / 64), 6) AS sim FROM emb_long
    GROUP BY 1"""))
def _(spark, d):
    zero = F.transform(F.col("x"), lambda v: v * 0)
    return fx.embeddings(spark, d).select("t", rd(fn.similarity(F.col("x"), zero, 0.7)).alias("sim"))


@query("fn9_split_value")
def _(spark, d):
    b = fx.ts_day(spark, d).groupBy("series_id").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi"))
    return b.select("series_id", "lo", "hi", fn.split_value(F.col("lo"), F.col("hi"), 3, "series_id").alias("split"))


@query("fn10_heap_numbers", sql("", """SELECT l_orderkey, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(
    list_sort(list(l_linenumber)), lambda n: CASE WHEN n % 2 = 0 THEN 1 ELSE 2 END)), lambda i, c: i * 2 + c) AS heap,
    CAST(count(*) AS INT) AS depth FROM lineitem GROUP BY 1"""))
def _(spark, d):
    step = F.when(F.col("l_linenumber") % 2 == 0, "L").otherwise("R")
    p = fx.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", step.alias("s")))),
                                 lambda r: r["s"]), "").alias("path"))
    return p.select("l_orderkey", fn.branch_to_heap(F.col("path")).alias("heap")).withColumn(
        "depth", fn.heap_depth(F.col("heap")))


@query("fn11_sample_rows")
def _(spark, d):
    e = fx.table(spark, d, "events").select("event_id", "value")
    return fn.sample_rows(e, 0.8, 11, "event_id", replacement=True)


@query("fn12_losses", sql("perf", """SELECT dataset, round(avg((perf - pred) * (perf - pred)), 8) AS mse,
    round(sqrt(avg((perf - pred) * (perf - pred))), 6) AS rmse, round(avg(abs(perf - pred)), 6) AS mae,
    round(avg(0.5 * (perf - pred) * (perf - pred)), 8) AS smooth, round(1 - sum(perf * pred) / (sqrt(sum(perf * perf)) *
    sqrt(sum(pred * pred))), 6) AS cosine, round(avg(exp(a) * (a - b)), 8) + 0.0 AS kl FROM (SELECT *, perf - ln(sum(exp(perf)) OVER
    (PARTITION BY dataset)) AS a, pred - ln(sum(exp(pred)) OVER (PARTITION BY dataset)) AS b FROM perf) GROUP BY 1"""))
def _(spark, d):
    g = fx.perf(spark, d).groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("model", "perf", "pred"))).alias("r"))
    y, p = F.col("r.perf"), F.col("r.pred")
    return g.select("dataset", rd(fn.mse(y, p), 8).alias("mse"), rd(fn.rmse(y, p)).alias("rmse"), rd(fn.mae(y, p)).alias("mae"),
                    rd(fn.smooth_l1(y, p), 8).alias("smooth"), rd(fn.cosine_loss(y, p)).alias("cosine"),
                    rd(fn.kl_loss(y, p), 8).alias("kl"))


@query("fn13_algorithm_label", sql("", """SELECT p_partkey, concat(split_part(k, '-', 1), '(', array_to_string(
    string_split(k, '-')[2:], ', '), ')') AS label FROM (SELECT p_partkey, replace(concat(p_brand, '-',
    p_size), '#', '-') AS k FROM part)"""))
def _(spark, d):
    k = F.regexp_replace(F.concat_ws("-", "p_brand", F.col("p_size").cast("string")), "#", "-")
    return fx.table(spark, d, "part").select("p_partkey", fn.algorithm_label(k).alias("label"))


@query("fn14_harmonic", sql("perf", """SELECT dataset, model, round(CASE WHEN perf + pred > 0 THEN 2 * perf * pred /
    (perf + pred) ELSE 0 END, 6) AS f FROM perf"""))
def _(spark, d):
    return fx.perf(spark, d).select("dataset", "model", rd(fn.harmonic(F.col("perf"), F.col("pred"))).alias("f"))


TOP3 = """SELECT dataset, list(model ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY
    {0} DESC, model) AS r FROM perf) WHERE r <= 3 GROUP BY 1"""


@query("jn1_truth", sql("perf", """SELECT p.dataset, array_to_string(p.top, ',') AS prediction, array_to_string(t.top, ',')
    AS truth FROM p JOIN t USING (dataset)""", f"p AS ({TOP3.format('pred')}), t AS ({TOP3.format('perf')})"))
def _(spark, d):
    from ..operators.select.quality import ranked_lists
    p = fx.perf(spark, d)
    a = ranked_lists(p, "pred", 3).select(F.upper("dataset").alias("dataset"), F.array_join("models", ",").alias("prediction"))
    b = ranked_lists(p, "perf", 3).select("dataset", F.array_join("models", ",").alias("truth"))
    return jn.with_truth(a, b)


@query("jn2_category", sql("", """SELECT o.o_orderkey, c.n, CASE WHEN c.n < 3 THEN 'small' ELSE 'large' END AS size FROM
    orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) c ON c.l_orderkey = o.o_orderkey"""))
def _(spark, d):
    from ..operators.clean import size_bin
    n = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    o = fx.table(spark, d, "orders").select("o_orderkey")
    return jn.with_category(o, n, "o_orderkey").withColumn("size", size_bin("n", ((3, "small"),), "large"))


@query("jn3_nested_meta", sql("perf", """SELECT p.dataset, p.model, p.perf, round(m.mean, 6) AS mean, m.n FROM perf p LEFT
    JOIN (SELECT dataset, avg(pred) AS mean, count(*) AS n FROM perf WHERE pred > 0.04 GROUP BY 1) m USING (dataset)"""))
def _(spark, d):
    p = fx.perf(spark, d)
    m = p.filter("pred > 0.04").groupBy("dataset").agg(F.avg("pred").alias("mean"), F.count(F.lit(1)).alias("n"))
    return jn.nest_meta(p, m).select("dataset", "model", "perf", rd("meta.mean").alias("mean"), F.col("meta.n").alias("n"))


@query("jn4_semi", sql("", """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"""))
def _(spark, d):
    c = fx.table(spark, d, "customer").select("c_custkey")
    return jn.only_known(c, fx.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("jn5_anti", sql("", """SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey =
    o_orderkey)"""))
def _(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey")
    return jn.not_done(o, fx.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])


JN_RUNS = f"lr AS ({RUNS.format('ts_hour_labelled')}), pr AS ({RUNS.format('(SELECT series_id, t, CASE WHEN score > 8 THEN 1 ELSE 0 END AS label FROM ts_hour_labelled)')})"


def _both_runs(spark, d):
    h = fx.ts_hour_labelled(spark, d)
    pred = h.withColumn("label", F.when(F.col("score") > 8, 1).otherwise(0))
    return an.runs(h).drop("len"), an.runs(pred).drop("len")


@query("jn6_event_hit", sql("ts_hour_labelled", """SELECT series_id, s, e FROM lr WHERE EXISTS (SELECT 1 FROM
    ts_hour_labelled p WHERE p.series_id = lr.series_id AND p.t BETWEEN lr.s AND lr.e AND p.score > 8)""", JN_RUNS))
def _(spark, d):
    h = fx.ts_hour_labelled(spark, d)
    r = an.runs(h, extra={"hit": F.max(F.col("score") > 8)})
    return r.filter("hit").select("series_id", "s", "e")


@query("jn7_interval", sql("ts_hour_labelled", """SELECT series_id, s, e, (SELECT count(*) FROM pr WHERE
    pr.series_id = lr.series_id AND pr.s <= lr.e AND lr.s <= pr.e) AS hits FROM lr""", JN_RUNS))
def _(spark, d):
    return jn.overlap_count(*_both_runs(spark, d))


@query("jn8_clip_to_zones", sql("ts_hour_labelled", """SELECT z.series_id, z.zone, greatest(p.s, z.z0) AS lo,
    least(p.e + 1, z.z1) AS hi FROM pr p JOIN z ON z.series_id = p.series_id AND greatest(p.s, z.z0) < least(p.e + 1, z.z1)""",
    JN_RUNS + """, z AS (SELECT series_id, s AS zone, coalesce((lag(e + 1) OVER w + s) / 2.0, 0.0) AS z0,
    coalesce((e + 1 + lead(s) OVER w) / 2.0, 720.0) AS z1 FROM lr WINDOW w AS (PARTITION BY series_id ORDER BY s))"""))
def _(spark, d):
    from ..operators.events import zones
    lab, pred = _both_runs(spark, d)
    z = zones(lab.withColumn("e", F.col("e") + 1), F.lit(0), F.lit(720))
    return jn.clip_to_zones(pred.withColumn("e", F.col("e") + 1), z).select(
        "series_id", F.col("zone"), "lo", "hi")


@query("jn10_nearest", sql("perf", """SELECT dataset, nearest, round(dist, 6) AS distance FROM (SELECT a.dataset, b.dataset
    AS nearest, sqrt(sum((a.perf - b.perf) * (a.perf - b.perf))) AS dist FROM perf a JOIN perf b ON a.model = b.model AND
    a.dataset <> b.dataset GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY dist, nearest) = 1"""))
def _(spark, d):
    v = fx.perf(spark, d).groupBy("dataset").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("model", "perf"))), lambda r: r["perf"]).alias("x"))
    return rounded(jn.nearest_row(v, v))
