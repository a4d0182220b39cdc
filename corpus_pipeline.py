"""A corpus pipeline over ``documents``: five stages, each handing on a table of documents.

1. quality: documents that the repetition rules reject go.
2. duplicates: of each group of near copies the document with the least id stays (equal rows count once; documents without words are kept).
3. secrets: every span that the secret scan finds is replaced by ``[REDACTED]``.
4. mix: sources are brought to their target weights; a row is what a shard of the mix draws of a document, so documents may repeat, be cut or be left
   out. Rows stand in the order of shards and of the shuffled blocks in them.
5. tokens: every row is encoded; ids are little-endian unsigned 32-bit integers.

Null texts count as empty, which the first stage rejects. Tied and null ids are told apart by their texts. Extra columns of any names pass through stages 1 to 4, and ``n_chars`` may be absent. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import encode_texts
from tidemark.llm.mixing import mixed_texts
from tidemark.llm.ngram_join import similar
from tidemark.llm.repetition import judge_column
from tidemark.llm.secret_scan import redact, scan
from tidemark.llm.text import LAST, prepare, row_keys
from tidemark.session import configure, cut

VOCABULARY = "byte_bpe_50k.tiktoken"
# The result depends on seeded draws and on byte-pair merges, which SQL cannot express; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(configure(spark))
    return docs.filter(judge_column(F.col("text")))


def _keyed(docs: DataFrame) -> DataFrame:
    """``id, key`` of every row beside the row itself, in one struct, so that the table's columns may have any names."""
    return docs.select(_id("doc_id").alias("id"), row_keys("doc_id", "text").alias("key"), F.struct(*docs.columns).alias("row"))


def _id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST))


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(configure(spark))
    gone = similar(docs, rows_too=True).filter(~F.col("first")).select(_id("doc_id").alias("id"), F.col("row_key").alias("key")).distinct()
    return _keyed(docs).join(gone, ["id", "key"], "left_anti").dropDuplicates(["id", "key"]).select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(configure(spark))
    found = scan(docs, rows_too=True).filter(F.size("secrets") > 0).select(_id("doc_id").alias("id"), F.col("row_key").alias("key"), "secrets").dropDuplicates(["id", "key"])
    text = F.when(F.col("secrets").isNotNull(), redact(F.col("row.text"), F.col("secrets"))).otherwise(F.col("row.text"))
    out = _keyed(docs).join(found, ["id", "key"], "left").select("row", text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    return out.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(configure(spark))
    return mixed_texts(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(configure(spark))
    return encode_texts(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids")


STAGES = [("quality rules", quality), ("near duplicates", duplicates), ("secrets", secrets), ("source mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder before the next one reads it."""
    docs = prepare(configure(spark)).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
