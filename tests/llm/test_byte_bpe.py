import random

import public_tokenizers
import pytest
import tiktoken

from tidemark.llm.byte_bpe import PrefixEncoder, Vocabulary, decode_ids, encode_texts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return Vocabulary(f.read())


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_prefixes_agree_with_plain_merges(vocabulary):
    rng = random.Random(5)
    for _ in range(300):
        data = "".join(rng.choice("aeithn srd.\n é漢") for _ in range(rng.randint(0, 40))).encode()
        coder = PrefixEncoder(vocabulary, data)
        assert coder.ids() == vocabulary.merge(data)
        for i in range(1, len(data)):  # every prefix has its own encoding
            assert vocabulary.walk(coder.last, i) == vocabulary.merge(data[:i])


def test_appends_and_edits(vocabulary):
    rng = random.Random(6)
    letters = "abcdeinorst hal"
    for _ in range(60):
        coder = PrefixEncoder(vocabulary)
        for _ in range(4):
            coder.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 12))).encode())
        for _ in range(4):
            a = rng.randint(0, len(coder.data))
            b = rng.randint(a, len(coder.data))
            coder.replace(a, b, "".join(rng.choice(letters) for _ in range(rng.randint(0, 5))).encode())
            assert coder.ids() == vocabulary.merge(coder.data)
    long = PrefixEncoder(vocabulary, b"the quick brown fox jumps over the lazy dog " * 100)
    assert long.replace(1000, 1003, b"cat") < 400
    assert long.ids() == vocabulary.merge(long.data)


def test_texts_match_the_reference(spark, vocabulary, reference):
    texts = ["Hello world's   tabs\t\tand\r\n\nlines ", "", None, "🙂 漢字 ñandú ÀÉ 123 ４５ ²½", " ", "　x\x85y  z", "a" * 3000, "#" * 500 + " " * 400, "word " * 20_000, "<|endoftext|>"]
    rows = [(i % 7 if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)]
    out = encode_texts(spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int"), PATH, public_tokenizers.PATTERN).collect()
    got = sorted((str(r.doc_id), [int.from_bytes(r.ids[i:i + 4], "little") for i in range(0, len(r.ids), 4)], bytes(r.decoded)) for r in out)
    assert got == sorted((str(i), reference.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows)
    assert all(decode_ids(PATH, bytes(r.ids)) == bytes(r.decoded) for r in out[:2])
    assert encode_texts(spark.createDataFrame([], "doc_id long, text string"), PATH, public_tokenizers.PATTERN).count() == 0
