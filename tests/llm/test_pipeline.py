import importlib.util
import os

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.byte_bpe import Vocabulary
from tidemark.session import cut

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def prose(seed, n=80):
    return " ".join(f"w{seed}x{i}" for i in range(n))


@pytest.fixture(scope="module")
def rows():
    near = prose(3, 200).split()
    near[100] = "changed"
    return [
        (1, prose(1), "en", "a", 0, "x"), (2, prose(1), "en", "b", 0, "x"), (3, prose(3, 200), "en", "a", 0, None), (4, " ".join(near), "en", None, 0, "x"),
        (5, "same words again " * 40, "en", "a", 0, "x"), (6, None, None, None, None, None), (7, "too short", "en", "b", 0, "x"),
        (None, prose(11), "en", "b", 0, "x"), (None, prose(12), "en", "b", 0, "x"), (9, prose(13) + ' token = "abcdef0123456789abcdef0123456789"', "en", "b", 0, "x"),
        (8, prose(8) + ' token = "abcdef0123456789abcdef0123456789"', "en", "b", 0, "x"), (9, prose(9, 30_000), "en", "c", 0, "x"),
    ]


def test_stages_take_effect(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, COLUMNS)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs)
    quality, unique, secrets, mixed, tokens = seen
    assert all(d.columns == [c.split()[0] for c in COLUMNS.split(", ")] for d in seen[:-1])
    ids = lambda d: sorted(r.doc_id or 0 for r in d.select("doc_id").collect())
    assert ids(quality) == [0, 0, 1, 2, 3, 4, 8, 9, 9]
    assert ids(unique) == ids(secrets) == [0, 0, 1, 3, 8, 9, 9]
    text = {r.doc_id: r.text for r in secrets.collect() if r.doc_id != 9}
    assert text[8] == prose(8) + " [REDACTED]\""
    assert {r.text for r in secrets.filter("doc_id = 9").collect()} == {prose(9, 30_000), prose(13) + " [REDACTED]\""}
    words = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    # 280, 322 and 30,000 words, weights 5, 2, 1: the first two stop at three times their size.
    assert words["a"] == 3 * 280 and words["b"] == 3 * 322 and abs(words["c"] - (30_602 - 3 * 602)) < 3
    vocabulary = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=Vocabulary(vocabulary).ranks, special_tokens={})
    expected = sorted((r.doc_id or 0, tuple(coder.encode_ordinary(r.text))) for r in mixed.collect())
    got = sorted((r.doc_id or 0, tuple(int.from_bytes(r.ids[i:i + 4], "little") for i in range(0, len(r.ids), 4))) for r in tokens.collect())
    assert got == expected and all(r.n_tokens * 4 == len(r.ids) for r in tokens.collect())


def test_clashing_columns_and_no_n_chars(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, COLUMNS).drop("n_chars")
    names = ["_key", "_secrets", "_start", "_rid", "_stop", "row", "id", "key", "secrets", "owner", "rid", "shard", "slot"]
    wide = docs.select("*", *[F.concat(F.lit(n), F.coalesce("doc_id", F.lit(0))).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, wide = cut(stage(spark, docs, str(tmp_path))), cut(stage(spark, wide, str(tmp_path)))
        assert wide.columns == [*docs.columns, *names]
        assert sorted(map(str, wide.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
        assert all(r[n] == f"{n}{r.doc_id or 0}" for r in wide.collect() for n in names)


def test_run_and_empty_table(spark, rows, tmp_path):
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    first, second = (sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path / "a")).collect()), key=str) for _ in range(2))
    assert first == second and {r[0] for r in first} == {None, 1, 3, 8, 9}
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_registered_with_the_driver():
    path = os.path.join(os.path.dirname(corpus_pipeline.__file__), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("entry", path)
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    names = [q for q in entry.queries() if q.startswith("op") and q[2].isdigit()]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14)) and "pipeline" in entry.queries()
