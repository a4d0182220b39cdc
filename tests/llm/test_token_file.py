import functools
import io
import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import token_file
from tidemark.llm.token_file import BLOCK, FileReader, FileWriter, PieceEncoder, decode_blocks, encode_blocks, pack, read_tokens, unpack, write_tokens

SCHEMA = "doc_id long, text string, ids string, start string, n_tokens int"
DEFINITION = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(DEFINITION)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("width", [0, 1, 7, 8, 13, 16, 31, 32])
def test_pack_round_trip(width):
    values = np.random.default_rng(width).integers(0, 1 << width, (5, 128), dtype=np.uint64).astype(np.uint32)
    words = pack(values, width)
    assert words.shape == (5, 2 * width)
    if width:
        assert (unpack(words, width) == values).all()
        bits = "".join(f"{int(w):064b}"[::-1] for w in words[0])
        assert [int(bits[k * width:(k + 1) * width][::-1], 2) for k in range(128)] == values[0].tolist()


def test_blocks_hold_outliers_as_exceptions():
    rng = np.random.default_rng(1)
    near = rng.integers(1000, 1016, 3 * BLOCK).astype(np.uint32)
    near[[5, 1023, 2000]] = [4_294_967_295, 70_000, 1016]
    blocks = encode_blocks(near)
    assert len(blocks[2]) == 7 + BLOCK // 8 * 4 and len(blocks[0]) == 7 + BLOCK // 8 * 4 + 2 * 6
    starts = np.cumsum([0] + [len(b) for b in blocks])[:-1]
    assert (decode_blocks(b"".join(blocks), starts) == near).all()
    wild = rng.integers(0, 1 << 32, 2 * BLOCK, dtype=np.uint64).astype(np.uint32)
    blocks = encode_blocks(wild)
    assert (decode_blocks(b"".join(blocks), np.array([0, len(blocks[0])])) == wild).all()


def test_any_range_of_a_file(monkeypatch):
    monkeypatch.setattr(token_file, "GATHER", 4 * BLOCK)
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (1, 0, 700, 9000, 1, 1, 5000)]
    out = io.BytesIO()
    out.close_now, out.close = out.close, lambda: None
    writer = FileWriter(out)
    for i, d in enumerate(docs):
        writer.add(None if i == 4 else i, d)
    writer.close()
    data, every = out.getvalue(), np.concatenate(docs)
    file = FileReader(io.BytesIO(data), len(data))
    assert (file.ids, file.docs) == (len(every), 7) and file.documents(2, 2)[1].tolist() == [700, 9000]
    for lo, hi in ((0, len(every)), (0, 0), (1023, 1025), (len(every) - 1, len(every)), (3000, 8000)):
        assert (file.range(lo, hi) == every[lo:hi]).all()
    with pytest.raises(ValueError):
        FileReader(io.BytesIO(data[:-1]), len(data) - 1)


@functools.cache
def encoders():
    t = Tokenizer.from_file(DEFINITION)
    t.encode_special_tokens = True
    with open(DEFINITION, "rb") as f:
        return t, PieceEncoder(f.read(), most=50)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab1'!. \n\t\r\x0b\x1c\x85 ​　éЖ漢s<|>")), max_size=40), max_size=5))
def test_pieces_give_the_library_s_ids(texts):
    t, encoder = encoders()
    got = encoder.encode(pa.array(["skipped \n"] + texts, pa.string())[1:])
    assert [g.tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def brute(rows, tokenizer):
    out, start = [], 0
    for i, t in sorted(((2**63 - 1 if r[0] is None else r[0]), r[1] or "") for r in rows):
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4")
        out.append((None if i == 2**63 - 1 else i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_matches_brute_force(spark, tmp_path, tokenizer, monkeypatch):
    rows = [(i * 3 % 101, f"Document {i} says \n\n hello's world\t{'x' * (i % 7)}  end <|endoftext|> " * (i % 5), "", "", 1) for i in range(100)]
    rows += [(200, None, None, None, None), (201, "", "", "", 1), (None, "no id", "", "", 1), (202, "漢字 é b " * 4000, "", "", 1), (203, "a" * 3000, "", "", 1)]
    for k, parts in enumerate((1, 6)):
        monkeypatch.setattr(token_file, "FILE_DOCS", 9 if k else 1 << 20)
        monkeypatch.setattr(token_file, "PART_IDS", 500 if k else 1 << 22)
        path = str(tmp_path / f"tokens{k}")
        write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(parts), path, DEFINITION)
        got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in read_tokens(spark, path).orderBy("start").collect()]
        assert got == brute(rows, tokenizer)
        assert read_tokens(spark, path, ids=False).agg({"n_tokens": "sum"}).first()[0] == got[-1][1] + got[-1][2]
    with pytest.raises(Exception, match="token files already"):
        write_tokens(spark.createDataFrame(rows, SCHEMA), path, DEFINITION)


def test_ties_repeated_rows_and_no_rows(spark, tmp_path, tokenizer):
    rows = [(1, "same", "", "", 1)] * 20 + [(1, "other text", "", "", 1)] * 3
    write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(8), str(tmp_path / "a"), DEFINITION)
    got = read_tokens(spark, str(tmp_path / "a")).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(tokenizer.encode(r[1]).ids) + 1 for r in rows)
    assert len({r.start for r in got}) == 23
    write_tokens(spark.createDataFrame([], SCHEMA), str(tmp_path / "b"), DEFINITION)
    assert read_tokens(spark, str(tmp_path / "b")).count() == 0
    ids = read_tokens(spark, str(tmp_path / "a")).select("doc_id", "ids")
    ids.coalesce(1).write.format("pfor").mode("append").option("path", str(tmp_path / "c")).save()  # ids that are known already
    assert sorted(bytes(r.ids) for r in read_tokens(spark, str(tmp_path / "c")).collect()) == sorted(bytes(r.ids) for r in got)
    with open(tmp_path / "b" / "_manifest.json") as f:
        assert json.load(f) == []


def test_new_pieces_are_searched_for_other_white_space_together(tokenizer):
    class Counted:
        def __init__(self, pattern):
            self.pattern, self.calls = pattern, 0

        def search(self, text):
            self.calls += 1
            return self.pattern.search(text)

    with open(DEFINITION, "rb") as f:
        encoder = PieceEncoder(f.read())
    encoder._OTHER = Counted(PieceEncoder._OTHER)
    plain = [" ".join(f"word{i}x{j}" for i in range(100)) for j in range(10)]
    odd = ["a b word1x1  new\n", "​", "end \x0b"]
    for texts, calls in ((plain, 1), (plain, 1), (odd + plain, None)):
        got = encoder.encode(pa.array(texts))
        assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert calls is None or encoder._OTHER.calls == calls
