"""Readers for labelled series, result tables and 0/1 vectors (inventory SRC1-SRC11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordered import index_rows
from ..session import cut

LABEL = "is_anomaly"


def file_name() -> Column:
    """Base name of the file a row was read from."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def series_schema(channels: Sequence[str], time: str = "timestamp", label: str = LABEL) -> T.StructType:
    return T.StructType(
        [T.StructField(time, T.StringType())]
        + [T.StructField(c, T.DoubleType()) for c in channels]
        + [T.StructField(label, T.IntegerType())]
    )


def read_series(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, pattern: str = "*.csv", drop_missing: bool = False,
    row_width: float = 86_400.0 * 365, named_by_folder: bool = False,
) -> DataFrame:
    """All series of a folder tree in one scan: (dataset, series_id, split, t, ts, channels…, label).

    A series is one file ``name_split.csv``, or with ``named_by_folder`` a folder of that name (or ``file=`` and that name) with part files, as Spark writes it.

    The time column orders the rows; ``t`` is the dense row index inside a series, numbered in ranges of ``row_width`` seconds, so that no task holds a whole series.
    """
    names = schema.fieldNames()
    raw = (
        spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern).csv(path if isinstance(path, str) else list(path))
    )
    parts = F.split(F.col("_metadata.file_path"), "/")
    at = -2 if named_by_folder else -1
    raw = raw.select("*", F.regexp_replace(F.element_at(parts, at), "^file=", "").alias("_f"), F.element_at(parts, at - 1).alias("dataset"))
    if drop_missing:
        raw = raw.na.drop("any", subset=names)
    split = F.regexp_extract("_f", r"_(train|val|test)\.csv$", 1)
    raw = raw.withColumn("split", split).withColumn("series_id", F.regexp_replace("_f", r"(_(train|val|test))?\.csv$", ""))
    time, label = names[0], names[-1]
    ts = F.to_timestamp(F.col(time)) if isinstance(schema[time].dataType, T.StringType) else F.col(time)
    raw = raw.withColumn("ts", ts).drop(time, "_f").withColumnRenamed(label, "label")
    raw = raw.withColumn("_tie", F.xxhash64(*[F.col(c) for c in names[1:-1]]))
    out = index_rows(raw, ["dataset", "series_id", "split"], ["ts", "_tie"], F.unix_timestamp("ts"), row_width)
    return out.select("dataset", "series_id", "split", "t", "ts", *names[1:-1], "label")


def positional(df: DataFrame, time: bool = True) -> tuple[DataFrame, str, list[str]]:
    """First column is time, last is the label, the rest are channels: (channels and label, label name, channel names)."""
    cols = df.columns
    channels = cols[1:-1] if time else cols[:-1]
    return df.select(*channels, cols[-1]), cols[-1], channels


def list_files(spark: SparkSession, path: str, pattern: str = "*_test.csv") -> DataFrame:
    """(file, dataset): the files below a folder whose name fits, without reading their content."""
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    parts = F.split(F.col("path"), "/")
    return meta.select(F.element_at(parts, -1).alias("file"), F.element_at(parts, -2).alias("dataset"), "length")


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def train_length(c: str = "file") -> Column:
    """Train length from a name such as ``001_name_id_train_1500_5000_label.csv``: the third part from the end."""
    return F.element_at(F.split(F.split(c, r"\.")[0], "_"), -3).cast("int")


def train_prefix(df: DataFrame, length: Column | str = "train_len") -> DataFrame:
    length = F.col(length) if isinstance(length, str) else length
    return df.filter(F.col("t") < length)


def read_performance(spark: SparkSession, path: str, models: Sequence[str] | None = None, key: str = "Dataset") -> DataFrame:
    """Wide performance matrix as (dataset, model, perf)."""
    from ..operators.select.tables import melt_performance

    if models is None:
        # the header names the models
        wide = spark.read.option("header", True).csv(path)
        return melt_performance(wide, key)
    schema = T.StructType([T.StructField(key, T.StringType()), *[T.StructField(m, T.DoubleType()) for m in models]])
    return melt_performance(spark.read.schema(schema).option("header", True).csv(path), key)


def read_arff(
    spark: SparkSession, path: str, attributes: Sequence[str], misplaced: Sequence[str] = ()
) -> DataFrame:
    """(file, one double per attribute, label): data lines of ARFF files, label yes/no as 1/0.

    The last column is the label, or the last but one in the files named by ``misplaced``; the other of the two is an id.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("v"), file_name().alias("file"))
    lines = lines.filter((F.col("v") != "") & ~F.col("v").startswith("@") & ~F.col("v").startswith("%"))
    cells = lines.withColumn("c", F.transform(F.split("v", ","), lambda s: F.trim(s)))
    wrong = F.lit(False)
    for m in misplaced:
        wrong = wrong | F.col("file").contains(m)
    raw = F.when(wrong, F.element_at("c", -2)).otherwise(F.element_at("c", -1))
    label = F.when(raw.isin("yes", "'yes'"), 1).when(raw.isin("no", "'no'"), 0).otherwise(raw.try_cast("double").cast("int"))
    return cells.select(
        "file", *[F.col("c")[i].try_cast("double").alias(a) for i, a in enumerate(attributes)], label.alias("label")
    )


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(file, t, label) from text files with one 0/1 per line; blank lines don't count.

    Lines are numbered inside each split of a file and the lines of its earlier splits are added, so plain text may be split. Compressed text cannot
    be: there one task reads a file. Files of the same name in two folders stay apart.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_at"), file_name().alias("file"),
        F.trim("value").try_cast("int").alias("label"), F.monotonically_increasing_id().alias("_i"),
    )
    # fixed once, so that the numbers cannot change when a task runs again
    lines = cut(lines.filter("label IS NOT NULL"))
    counts = lines.groupBy("_path", "_at").agg(F.count(F.lit(1)).alias("_k"))
    earlier = Window.partitionBy("_path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    counts = counts.select("_path", "_at", F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_0"))
    inside = F.row_number().over(Window.partitionBy("_path", "_at").orderBy("_i")) - 1
    return lines.withColumn("_n", inside).join(counts, ["_path", "_at"]).select("file", (F.col("_n") + F.col("_0")).cast("long").alias("t"), "label")


def read_vectors_with_truth(spark: SparkSession, folder: str, truth: str = "groundtruth") -> DataFrame:
    """(dataset, model, t, pred, label): all ``dataset_algorithm.gz`` vectors next to the ground truth of their dataset."""
    v = read_vector(spark, folder)
    stem = F.regexp_replace("file", r"\.gz$", "")
    v = v.withColumn("dataset", F.regexp_extract(stem, r"^(.*)_[^_]+$", 1)).withColumn("model", F.regexp_extract(stem, r"_([^_]+)$", 1))
    gt = v.filter(F.col("model") == truth).select("dataset", "t", "label")
    pred = v.filter(F.col("model") != truth).select("dataset", "model", "t", F.col("label").alias("pred"))
    return pred.join(gt, ["dataset", "t"])


def load_any(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet", **options) -> DataFrame:
    """First readable of several locations on any Hadoop file system."""
    errors = []
    for p in paths:
        try:
            return spark.read.format(fmt).options(**options).load(p)
        except Exception as exc:  # noqa: BLE001 - the next location may work
            errors.append(f"{p}: {type(exc).__name__}")
    raise FileNotFoundError("; ".join(errors))
