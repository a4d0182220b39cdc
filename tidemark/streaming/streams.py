"""Streams of events (inventory STR1-STR5)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir
from .ordered import EVENT, centre_models, histogram_models, in_time_order, running_scores, score_windows  # noqa: F401


def event_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", per_batch: int = 1) -> DataFrame:
    """File stream; a wall-clock time column becomes a timestamp, which watermarks need."""
    s = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", pattern).parquet(folder)
    )
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_stats(
    events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "1 hour", key: str = "event_type",
    value: str = "value",
) -> DataFrame:
    """count, sum and mean per key and tumbling or sliding window; rows later than the watermark are dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        events.withWatermark("ts", late).groupBy(w.alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total", "mean")
    )


def sessions(
    events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id", value: str = "value"
) -> DataFrame:
    """Bursts: events of a key closer than the gap."""
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("top"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "top")
    )


def score_frozen(events: DataFrame, thresholds: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Stream-static join with a frozen table of thresholds."""
    return events.join(thresholds.select(*keys, "threshold"), list(keys)).withColumn(
        "pred", (F.col(value) > F.col("threshold")).cast("int")
    )


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all that is there into a new folder below the shared checkpoint folder and read it back.

    Append writes every final row once. In complete mode every batch writes the whole result to a folder of its own; the last one is read.
    """
    if mode not in ("append", "complete"):
        raise ValueError("drain reads back append or complete results")
    spark = stream.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp")
        q = q.outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")
    last = [-1]

    def save(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{root}/out/batch={epoch}")
        last[0] = max(last[0], epoch)

    q = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{root}/cp").outputMode(mode)
    q = q.trigger(availableNow=True).start()
    q.awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], stream.schema).withColumn("epoch", F.lit(0))
    return spark.read.parquet(f"{root}/out/batch={last[0]}")
