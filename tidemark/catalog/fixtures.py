"""The driver tables seen as labelled time series, in Spark and as SQL.

A series table is written once (checkpointed), as a user would store it, and then read by the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordered import index_rows
from ..session import cut
from .base import squeeze


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col: str = "ts"):
    """Microseconds since 1970 of a wall-clock timestamp, whatever the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({col} AS TIMESTAMP_NTZ))")


def seconds(col: str = "ts"):
    return F.floor(micros(col) / F.lit(1_000_000)).cast("long")


def ts_user(spark, sf_dir) -> DataFrame:
    """One irregular series per user, three channels, with a score and a label."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    s = e.select(
        F.col("user_id").alias("series_id"), "event_id", "ts",
        F.col("value").alias("c1"), k.alias("c2"),
        F.hour("ts").cast("double").alias("c3"),
        (F.lit(0.1) * F.col("value") + F.lit(0.2) * k).alias("score"),
        F.when(F.col("value") > 150, 1).otherwise(0).alias("label"),
    )
    return cut(index_rows(s, ["series_id"], ["ts", "event_id"], seconds(), 86_400 * 7))


def ts_hour(spark, sf_dir) -> DataFrame:
    """Hourly aggregates per event type; hours without events are missing."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(
        F.col("event_type").alias("series_id"),
        F.floor((seconds() - 1704067200) / 3600).cast("int").alias("t"),
    ).agg(F.count(F.lit(1)).alias("c1"), F.sum("value").alias("c2"), F.max("value").alias("c3"))


def ts_hour_grid(spark, sf_dir) -> DataFrame:
    """ts_hour on the full grid up to the last hour of the table, gaps as NULL."""
    h = ts_hour(spark, sf_dir)
    last = h.agg(F.max("t")).first()[0]
    grid = h.select("series_id").distinct().select(
        "series_id", F.explode(F.sequence(F.lit(0), F.lit(last if last is not None else 0).cast("int"))).alias("t")
    )
    return grid.join(h, ["series_id", "t"], "left")


def ts_hour_labelled(spark, sf_dir) -> DataFrame:
    """Full grid, gaps 0, a score and label runs of five points."""
    g = ts_hour_grid(spark, sf_dir)
    c1, c2 = F.coalesce("c1", F.lit(0)), F.coalesce("c2", F.lit(0.0))
    return cut(g.select(
        "series_id", "t", c1.cast("double").alias("c1"), c2.alias("c2"),
        F.round(c1 + c2 / 100.0, 9).alias("score"),
        F.when((F.col("t") + 13 * F.length("series_id") + 7) % 60 < 5, 1).otherwise(0).alias("label"),
    ))


def ts_day(spark, sf_dir) -> DataFrame:
    """Daily series per return flag and status, four channels, dense row index t."""
    li = table(spark, sf_dir, "lineitem")
    d = li.groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("series_id"),
        F.col("l_shipdate").cast("date").alias("day"),
    ).agg(
        F.sum("l_quantity").alias("c1"), F.round(F.sum("l_extendedprice"), 2).alias("c2"),
        F.round(F.avg("l_discount"), 9).alias("c3"), F.round(F.avg("l_tax"), 9).alias("c4"),
    )
    return cut(index_rows(d, ["series_id"], ["day"], F.unix_date("day"), 4096))


def embeddings(spark, sf_dir) -> DataFrame:
    """All vectors as one series: the extreme case of a single key."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.lit("emb").alias("series_id"), F.col("vec_id").alias("t"),
        F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("cls"),
    )


def scored(spark, sf_dir) -> DataFrame:
    """Real 0/1 ground truth per language."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return l.join(d, "doc_id").select(
        F.col("lang").alias("series_id"), F.col("doc_id").alias("t"),
        F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("label"),
    )


def perf(spark, sf_dir) -> DataFrame:
    """Performance of each brand ("model") in each nation ("dataset"), and a predicted performance."""
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    n, p = table(spark, sf_dir, "nation"), table(spark, sf_dir, "part")
    return (
        li.join(s, li.l_suppkey == s.s_suppkey)
        .join(n, s.s_nationkey == n.n_nationkey)
        .join(p, li.l_partkey == p.p_partkey)
        .groupBy(F.col("n_name").alias("dataset"), F.col("p_brand").alias("model"))
        .agg(F.round(F.avg("l_discount"), 9).alias("perf"), F.round(F.avg("l_tax"), 9).alias("pred"))
    )


CTES = {
    "ts_user": """SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
        ts, event_id, value AS c1, CAST(json_extract_string(props,'$.k') AS DOUBLE) AS c2,
        CAST(hour(ts) AS DOUBLE) AS c3,
        CAST(0.1 AS DOUBLE)*value + CAST(0.2 AS DOUBLE)*CAST(json_extract_string(props,'$.k') AS DOUBLE) AS score,
        CASE WHEN value > 150 THEN 1 ELSE 0 END AS label FROM events""",
    "ts_hour": """SELECT event_type AS series_id, CAST(floor((epoch(ts) - 1704067200) / 3600) AS INT) AS t,
        count(*) AS c1, sum(value) AS c2, max(value) AS c3 FROM events GROUP BY 1, 2""",
    "ts_hour_grid": """SELECT s.series_id, g.t, a.c1, a.c2, a.c3 FROM (SELECT DISTINCT series_id FROM ts_hour) s
        CROSS JOIN (SELECT CAST(unnest(range(0, (SELECT max(t) + 1 FROM ts_hour))) AS INT) AS t) g
        LEFT JOIN ts_hour a ON a.series_id = s.series_id AND a.t = g.t""",
    "ts_hour_labelled": """SELECT series_id, t, CAST(coalesce(c1, 0) AS DOUBLE) AS c1, coalesce(c2, 0.0) AS c2,
        round(coalesce(c1, 0) + coalesce(c2, 0.0) / 100.0, 9) AS score,
        CASE WHEN (t + 13*length(series_id) + 7) % 60 < 5 THEN 1 ELSE 0 END AS label FROM ts_hour_grid""",
    "ts_day": """SELECT series_id, day, c1, c2, c3, c4,
        row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS t FROM (
        SELECT concat(l_returnflag, l_linestatus) AS series_id, CAST(l_shipdate AS DATE) AS day,
        sum(l_quantity) AS c1, round(sum(l_extendedprice), 2) AS c2, round(avg(l_discount), 9) AS c3,
        round(avg(l_tax), 9) AS c4 FROM lineitem GROUP BY 1, 2)""",
    "emb": """SELECT 'emb' AS series_id, vec_id AS t, CAST(embedding AS DOUBLE[]) AS x, label AS cls
        FROM embeddings""",
    "emb_long": """SELECT series_id, t, i AS channel, x[i] AS x FROM emb, (SELECT unnest(range(1, 65)) AS i)""",
    "scored": """SELECT d.lang AS series_id, l.doc_id AS t, CAST(d.n_chars AS DOUBLE) AS score, l.toxic AS label
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "perf": """SELECT n.n_name AS dataset, p.p_brand AS model, round(avg(l.l_discount), 9) AS perf,
        round(avg(l.l_tax), 9) AS pred
        FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
        JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2""",
    "runs": """SELECT series_id, min(t) AS s, max(t) AS e, max(score) AS top FROM (
        SELECT *, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS g FROM ts_hour_labelled
        WHERE label = 1) GROUP BY series_id, g""",
}
NEEDS = {
    "ts_hour_grid": ["ts_hour"],
    "ts_hour_labelled": ["ts_hour", "ts_hour_grid"],
    "emb_long": ["emb"],
    "runs": ["ts_hour", "ts_hour_grid", "ts_hour_labelled"],
}


def sql(tables: str, body: str, more: str = "") -> str:
    """``WITH`` clause for the named fixtures (and their needs), then ``more`` CTEs, then the body."""
    order: list[str] = []
    for name in tables.split():
        for n in [*NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    ctes = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in order]
    if more.strip():
        ctes.append(more)
    return squeeze(("WITH " + ", ".join(ctes) + " " if ctes else "") + body)
